"""Fixed values of the model: parameter defaults, presets, synapse types, gene bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parameter defaults of a neuron.
DEFAULTS = {
    "v_rest": -70.0, "v_threshold": -55.0, "v_peak": 30.0, "v_reset": -65.0, "tau_m": 20.0, "tau_ref": 2.0, "r_m": 10.0,
    "c_m": 1.0, "g_na": 120.0, "g_k": 36.0, "g_l": 0.3, "e_na": 50.0, "e_k": -77.0, "e_l": -54.387,
    "izh_a": 0.02, "izh_b": 0.20, "izh_c": -65.0, "izh_d": 8.0, "axon_length": 1.0, "axon_diameter": 1.0, "i_ext": 0.0, "noise_level": 0.5,
}
PRESET_COLUMNS = "neuron_type string, excitatory boolean, v_rest double, v_threshold double, v_reset double, tau_m double, izh_a double, izh_b double, izh_c double, izh_d double, axon_diameter double, myelinated boolean, noise_level double"
PRESETS = [
    ("pyramidal", True, -70.0, -55.0, -65.0, 20.0, 0.02, 0.20, -65.0, 8.0, 2.0, True, 0.5),
    ("interneuron", False, -70.0, -52.0, -65.0, 10.0, 0.10, 0.20, -65.0, 2.0, 0.5, False, 0.5),
    ("motor", True, -65.0, -50.0, -60.0, 15.0, 0.02, 0.20, -65.0, 6.0, 12.0, True, 0.5),
    ("sensory", True, -70.0, -55.0, -65.0, 8.0, 0.02, 0.25, -65.0, 0.05, 1.5, True, 0.5),
    ("purkinje", False, -68.0, -52.0, -65.0, 25.0, 0.02, 0.20, -65.0, 2.0, 3.0, True, 0.5),
    ("granule", True, -75.0, -50.0, -70.0, 5.0, 0.10, 0.20, -65.0, 2.0, 0.2, False, 0.2),
]
#: Synapse types: tau, reversal potential, peak conductance.
SYNAPSES = [("ampa", 2.0, 0.0, 1.0), ("nmda", 100.0, 0.0, 0.5), ("gaba_a", 6.0, -70.0, 1.2), ("gaba_b", 150.0, -90.0, 0.8), ("custom", 5.0, 0.0, 1.0)]
IZH_PRESETS = [("rs", 0.02, 0.20, -65.0, 8.0), ("ib", 0.02, 0.20, -55.0, 4.0), ("ch", 0.02, 0.20, -50.0, 2.0), ("fs", 0.10, 0.20, -65.0, 2.0), ("tc", 0.02, 0.25, -65.0, 0.05), ("lts", 0.02, 0.25, -65.0, 2.0)]
#: Genes in their order, with bounds.
GENES = [
    ("v_rest", -90.0, -50.0), ("v_threshold", -65.0, -40.0), ("v_peak", 10.0, 60.0), ("v_reset", -80.0, -50.0), ("tau_m", 2.0, 50.0),
    ("tau_ref", 0.5, 10.0), ("r_m", 1.0, 50.0), ("g_na", 50.0, 200.0), ("g_k", 10.0, 80.0), ("g_l", 0.05, 2.0),
    ("izh_a", 0.01, 0.5), ("izh_b", 0.1, 0.5), ("izh_c", -80.0, -40.0), ("izh_d", 0.05, 20.0), ("noise_level", 0.0, 3.0),
]
RADII = {"pyramidal": 9, "interneuron": 7, "motor": 12, "sensory": 8, "purkinje": 10, "granule": 5, "custom": 8}
#: Colour stops of a voltage between -90 and 40 mV: position, red, green, blue.
STOPS = [(0.00, 40, 0, 80), (0.15, 0, 20, 120), (0.35, 0, 100, 200), (0.50, 0, 180, 120), (0.65, 30, 220, 60), (0.75, 220, 200, 0), (0.88, 255, 100, 0), (1.00, 255, 240, 20)]


#: A network's configuration: types and defaults.
CONFIG = {
    "n_neurons": ("int", 20), "topology": ("string", "random"), "connect_prob": ("double", 0.20), "exc_ratio": ("double", 0.80), "sw_k": ("int", 4), "sw_beta": ("double", 0.30),
    "sf_m": ("int", 2), "default_model": ("string", "izh"), "max_distance": ("double", 3.0), "weight_mean": ("double", 1.0), "weight_std": ("double", 0.3),
}
LAYER_SIZES = [5, 10, 5]
#: Sliders of a network's form: field, least, most, step.
SLIDERS = [("n_neurons", 4.0, 80.0, 1.0), ("connect_prob", 0.05, 0.80, 0.01), ("exc_ratio", 0.2, 1.0, 0.01), ("max_distance", 0.1, 10.0, 0.1), ("sw_k", 2.0, 20.0, 2.0), ("sw_beta", 0.0, 1.0, 0.05), ("sf_m", 1.0, 10.0, 1.0)]
#: Slots of a neuron's voltage history.
HISTORY = 200
#: What a client may choose from.
CATALOG = {
    "neuron_types": ["pyramidal", "interneuron", "motor", "sensory", "purkinje", "granule", "custom"],
    "synapse_types": ["ampa", "nmda", "gaba_a", "gaba_b", "custom"],
    "stimulus_types": ["constant", "pulse", "ramp", "sinusoidal", "random"],
    "fitness_fns": ["max_firing_rate", "target_20hz", "target_10hz", "synchrony", "diversity", "efficiency"],
    "topologies": ["random", "small_world", "scale_free", "layered"],
    "models": ["hh", "lif", "izh"],
}
#: The fields of a neuron's parameters that are no numbers, with their types and defaults.
CHOICES = {"model": ("string", "izh"), "neuron_type": ("string", "pyramidal"), "excitatory": ("boolean", True), "myelinated": ("boolean", False)}
PARAMS = {**CHOICES, **{k: ("double", x) for k, x in DEFAULTS.items()}}


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, PRESET_COLUMNS)


def synapse_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNAPSES, "syn_type string, tau double, e_rev double, g_max double")

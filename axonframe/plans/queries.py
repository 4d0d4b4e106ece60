"""The registered queries over the Parquet tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import kernels
from ..functions.presets import CATALOG, DEFAULTS, GENES, IZH_PRESETS, PARAMS, PRESETS, RADII, STOPS, SYNAPSES, presets, synapse_types
from ..functions.rng import gauss, uniform
from ..operators import activity, blocks, coupled, display, dynamics, evolution, graph
from ..sources import tables as T
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The length of a run, in ms: it ends with the step of its last spike.
_RUN_SQL = "(SELECT max(t_ms) + 1 FROM spikes)"
#: The moment of its last spike.
_LAST_SQL = "(SELECT max(t_ms) FROM spikes)"
_HALF_SQL = f"({_RUN_SQL} / 2)"

_VIEWS = {
    "neurons": "SELECT s_suppkey AS id, s_suppkey % 5 AS network_id, CASE s_suppkey % 6 WHEN 0 THEN 'pyramidal' WHEN 1 THEN 'interneuron' WHEN 2 THEN 'motor' WHEN 3 THEN 'sensory' WHEN 4 THEN 'purkinje' ELSE 'granule' END AS neuron_type, CASE WHEN s_suppkey % 18 < 6 THEN 'izh' WHEN s_suppkey % 18 < 12 THEN 'lif' ELSE 'hh' END AS model, s_suppkey % 6 NOT IN (1, 4) AS excitatory FROM supplier",
    "population": "SELECT c_custkey AS id, c_nationkey AS network_id, c_custkey % 5 <> 0 AS excitatory, c_acctbal AS v FROM customer",
    "spikes": "SELECT user_id AS neuron_id, CAST(event_id AS DOUBLE) AS t_ms FROM events",
    "synapses": "SELECT src_id, tgt_id, weight, distance, syn_type FROM (SELECT l_suppkey AS src_id, l_partkey % (SELECT count(*) FROM supplier) AS tgt_id, l_quantity / 10 AS weight, 0.1 + l_discount * 29 AS distance, CASE WHEN l_returnflag = 'A' THEN 'ampa' WHEN l_returnflag = 'R' THEN 'gaba_a' WHEN l_linestatus = 'F' THEN 'nmda' ELSE 'gaba_b' END AS syn_type, row_number() OVER (PARTITION BY l_suppkey, l_partkey % (SELECT count(*) FROM supplier) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus) AS rn FROM lineitem) x WHERE rn = 1 AND src_id <> tgt_id",
    "stimuli": "SELECT event_id AS stim_id, user_id AS neuron_id, CASE event_type WHEN 'click' THEN 'pulse' WHEN 'view' THEN 'ramp' WHEN 'purchase' THEN 'constant' WHEN 'signup' THEN 'sinusoidal' ELSE 'random' END AS stim_type, least(value, CAST(30 AS DOUBLE)) AS amplitude, CAST(5 + 5 * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) AS duration_ms, CAST(1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) AS frequency, CAST(event_id AS DOUBLE) AS start_t FROM events",
    "genomes": f"SELECT vec_id, label, CAST(embedding[1:{len(GENES)}] AS DOUBLE[]) AS genome FROM embeddings",
    "presets": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS DOUBLE)" for x in row) + ")" for row in PRESETS) + ") p(neuron_type, p_excitatory, v_rest, v_threshold, v_reset, tau_m, izh_a, izh_b, izh_c, izh_d, axon_diameter, myelinated, noise_level)",
    "kinds": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}::DOUBLE, {e}::DOUBLE, {g}::DOUBLE)" for n, t, e, g in SYNAPSES) + ") k(syn_type, tau, e_rev, g_max)",
    "bounds": "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for i, (n, lo, hi) in enumerate(GENES)) + ") b(i, gene, lo, hi)",
}
_NEEDS = {"cells": ("neurons", "presets"), "wires": ("neurons", "presets", "cells", "synapses"), "rated": ("population", "spikes")}
_VIEWS["cells"] = "SELECT n.*, p.* EXCLUDE (neuron_type, p_excitatory) FROM neurons n JOIN presets p ON p.neuron_type = n.neuron_type"
_VIEWS["wires"] = "SELECT s.*, exp(-s.distance / ((CASE WHEN myelinated THEN 2.0 ELSE 0.5 END) * sqrt(greatest(0.1, axon_diameter)))) AS attenuation, s.distance / greatest(CASE WHEN myelinated THEN greatest(1.0, 6.0 * axon_diameter) ELSE greatest(0.2, 0.57 * sqrt(axon_diameter)) END, 0.001) AS delay_ms, (CASE WHEN myelinated THEN 2.0 ELSE 0.5 END) * sqrt(greatest(0.1, axon_diameter)) AS length FROM synapses s JOIN cells c ON c.id = s.src_id"
_VIEWS["rated"] = f"SELECT p.*, coalesce(k, 0) AS n_spikes, coalesce(k, 0) / greatest({_RUN_SQL}, 1.0) * 1000 AS rate FROM population p LEFT JOIN (SELECT neuron_id, count(*) AS k FROM spikes GROUP BY 1) s ON s.neuron_id = p.id"


def _u(seed: str, *keys: str) -> str:
    return "(CAST(('0x' || substr(md5(concat_ws('|', '" + seed + "', " + ", ".join(keys) + ")), 1, 8)) AS BIGINT) / 4294967296.0)"


def _g(seed: str, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_u(seed + 'r', *keys)})) * cos(2 * pi() * {_u(seed + 'a', *keys)}))"


def _query(sql: str | None = None, *views: str, recursive: bool = False):
    """Registers a query under its name, with its DuckDB twin over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            want = dict.fromkeys(v for name in views for v in (*_NEEDS.get(name, ()), name))
            head = ", ".join(f"{v} AS ({_VIEWS[v]})" for v in want)
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{head}" + ("," if sql.lstrip().startswith("#") else "") + " " if head else "WITH RECURSIVE " if recursive else "") + sql.lstrip().removeprefix("#")
        return f

    return add


def _cells(spark, sf):
    return T.neurons(spark, sf).join(F.broadcast(presets(spark).drop("excitatory")), "neuron_type")


def _wires(spark, sf):
    return activity.cable(T.synapses(spark, sf), _cells(spark, sf))


def _run(spark, sf):
    return T.spikes(spark, sf).select(F.max("t_ms") + 1).scalar()


def _rated(spark, sf):
    return activity.rates(T.population(spark, sf), T.spikes(spark, sf), _run(spark, sf))


def _six(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SYNC = "CASE WHEN count(*) <= 1 THEN 1.0 ELSE 1.0 - least(1.0, stddev_pop(round(rate, 2)) / (avg(round(rate, 2)) + 1e-6)) END"


# --- statistics -----------------------------------------------------------------------------------


@_query(f"""SELECT r.network_id, count(*) AS n_neurons, count_if(excitatory) AS exc_count, count_if(NOT excitatory) AS inh_count, round(avg(v) + 1e-9, 2) AS mean_v,
  CAST(sum(n_spikes) AS BIGINT) AS total_spikes, round(max(rate), 2) AS max_rate, round({_SYNC}, 3) AS synchrony, coalesce(max(e.k), 0) AS n_synapses, {_RUN_SQL} AS sim_time_ms
  FROM rated r LEFT JOIN (SELECT network_id, count(*) AS k FROM synapses s JOIN population p ON p.id = s.src_id GROUP BY 1) e ON e.network_id = r.network_id GROUP BY 1""", "rated", "synapses")  # fmt: skip
def q_network_stats(spark, sf):
    return activity.network_stats(T.population(spark, sf), T.spikes(spark, sf), T.synapses(spark, sf), _run(spark, sf))


@_query("SELECT id, n_spikes, round(rate, 6) AS rate FROM rated", "rated")
def q_firing_rates(spark, sf):
    return _six(_rated(spark, sf).select("id", "n_spikes", "rate"))


@_query(f"SELECT network_id, round({_SYNC}, 3) AS synchrony FROM rated GROUP BY 1", "rated")
def q_synchrony(spark, sf):
    return _rated(spark, sf).groupBy("network_id").agg(F.round(activity.synchrony(), 3).alias("synchrony"))


@_query(f"""SELECT r.network_id, round(avg(rate), 6) AS max_firing_rate, round(-abs(avg(rate) - 10.0), 6) AS target_10hz, round(-abs(avg(rate) - 20.0), 6) AS target_20hz, round(avg(rate), 6) AS other,
  round({_SYNC}, 3) AS synchrony, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(rate) / (avg(rate) + 1e-6) END, 6) AS diversity, round(sum(n_spikes) / (coalesce(max(w), 0) + 1e-6), 6) AS efficiency
  FROM rated r LEFT JOIN (SELECT network_id, sum(weight) AS w FROM synapses JOIN population p ON p.id = src_id GROUP BY 1) e ON e.network_id = r.network_id GROUP BY 1""", "rated", "synapses")  # fmt: skip
def q_fitness_all(spark, sf):
    rated = _rated(spark, sf)
    rated = rated.join(activity.network_weights(T.population(spark, sf), T.synapses(spark, sf)), "network_id")
    return _six(rated.groupBy("network_id").agg(*[activity.fitness(n).alias(n) for n in (*activity.FITNESS, "other")]))


@_query("SELECT round((SELECT sum(n_spikes) FROM rated) / ((SELECT sum(weight) FROM synapses) + 1e-6), 6) AS efficiency", "rated", "synapses")
def q_fitness_efficiency(spark, sf):
    w = T.synapses(spark, sf).agg(F.sum("weight").alias("w"))
    return _rated(spark, sf).agg(F.sum("n_spikes").alias("n")).join(F.broadcast(w), F.lit(True)).select(F.round(F.col("n") / (F.col("w") + 1e-6), 6).alias("efficiency"))


@_query("SELECT network_id, excitatory, count(*) AS n FROM population GROUP BY ALL", "population")
def q_exc_inh_counts(spark, sf):
    return T.population(spark, sf).groupBy("network_id", "excitatory").agg(F.count("*").alias("n"))


@_query("SELECT id, network_id, round(rate / greatest(max(rate) OVER (PARTITION BY network_id), 1.0) * 100, 6) AS bar FROM rated", "rated")
def q_rate_bars(spark, sf):
    return _six(display.rate_bars(_rated(spark, sf)).select("id", "network_id", "bar"))


@_query("SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src_id AS id, 1 AS o, 0 AS i FROM synapses UNION ALL SELECT tgt_id, 0, 1 FROM synapses) GROUP BY 1", "synapses")
def q_degrees(spark, sf):
    return graph.degrees(T.synapses(spark, sf))


@_query("SELECT id, n_spikes, last_t, n_spikes > 0 AS ever FROM (SELECT p.id, count(neuron_id) AS n_spikes, coalesce(max(t_ms), -1e9) AS last_t FROM population p LEFT JOIN spikes s ON s.neuron_id = p.id GROUP BY 1)", "population", "spikes")
def q_spike_bookkeeping(spark, sf):
    last = activity.last_spikes(T.spikes(spark, sf), float("inf")).select("id", "last_t")
    return _rated(spark, sf).join(last, "id", "left").select("id", "n_spikes", F.coalesce("last_t", F.lit(-1e9)).alias("last_t"), (F.col("n_spikes") > 0).alias("ever"))


# --- projections and snapshots --------------------------------------------------------------------


_PLACED = "#p AS (SELECT id, 400 + 300 * cos(2 * pi() * k / n) AS x, 300 + 300 * sin(2 * pi() * k / n) AS y FROM (SELECT id, row_number() OVER (PARTITION BY network_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY network_id) AS n FROM neurons))"
_LAST = "(SELECT neuron_id, count(*) AS k, max(t_ms) AS t FROM spikes GROUP BY 1)"


def _state(spark, sf):
    """The neurons at the time of the last spike of all: fields of a state frame."""
    spikes = T.spikes(spark, sf)
    own = spikes.groupBy(F.col("neuron_id").alias("id")).agg(F.count("*").alias("k"), F.max("t_ms").alias("t"))
    met = graph.circle(_cells(spark, sf)).join(own, "id", "left").withColumn("firing", F.coalesce(F.col("t") == spikes.select(F.max("t_ms")).scalar(), F.lit(False)))
    return met.withColumns({"spikes": F.coalesce("k", F.lit(0)).cast("long"), "i_ext": F.lit(DEFAULTS["i_ext"]), "v": F.col("v_rest"), "type": F.col("neuron_type"), "exc": F.col("excitatory")})


@_query(f"""{_PLACED} SELECT c.id, round(v_rest, 2) AS v, coalesce(s.t = (SELECT max(t_ms) FROM spikes), FALSE) AS firing, coalesce(s.k, 0) AS spikes, 0.0::DOUBLE AS i_ext, neuron_type AS type, excitatory AS exc, model, round(x, 6) AS x, round(y, 6) AS y
  FROM cells c JOIN p ON p.id = c.id LEFT JOIN {_LAST} s ON s.neuron_id = c.id""", "cells", "spikes")  # fmt: skip
def q_neuron_state(spark, sf):
    return _six(_state(spark, sf).select("id", F.round("v", 2).alias("v"), "firing", "spikes", "i_ext", "type", "exc", "model", "x", "y"))


@_query(f"""SELECT 'neuron' AS part, c.id, NULL::BIGINT AS other, round(v_rest, 2) AS value, coalesce(s.t = (SELECT max(t_ms) FROM spikes), FALSE) AS flag FROM cells c LEFT JOIN {_LAST} s ON s.neuron_id = c.id
  UNION ALL SELECT 'synapse', src_id, tgt_id, round(weight, 3), coalesce(s.t = (SELECT max(t_ms) FROM spikes), FALSE) FROM synapses LEFT JOIN {_LAST} s ON s.neuron_id = src_id
  UNION ALL SELECT 'spike', neuron_id, NULL, round(t_ms, 2), NULL FROM spikes""", "cells", "spikes", "synapses")  # fmt: skip
def q_frame_rows(spark, sf):
    state = _state(spark, sf)
    active = T.synapses(spark, sf).join(state.select(F.col("id").alias("src_id"), F.col("firing").alias("active")), "src_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    return display.frame_rows(state, active, T.spikes(spark, sf))


@_query("SELECT CAST(floor(floor(round(t_ms / 0.3, 6)) / 67) AS BIGINT) AS frame, count(*) AS n_spikes, count(DISTINCT neuron_id) AS n_neurons FROM spikes GROUP BY 1", "spikes")
def q_anchored_frames(spark, sf):
    return T.spikes(spark, sf).groupBy(display.anchored_frame(F.col("t_ms")).alias("frame")).agg(F.count("*").alias("n_spikes"), F.countDistinct("neuron_id").alias("n_neurons"))


@_query("SELECT src_id, tgt_id, round(weight, 4) AS weight, round(w.distance, 3) AS distance, syn_type AS type, tau, e_rev, g_max, round(attenuation, 4) AS atten, round(length, 3) AS lambda, FALSE AS active FROM wires w JOIN kinds USING (syn_type)", "wires", "kinds")
def q_synapse_dict(spark, sf):
    met = _wires(spark, sf).join(F.broadcast(synapse_types(spark)), "syn_type")
    return met.select("src_id", "tgt_id", F.round("weight", 4).alias("weight"), F.round("distance", 3).alias("distance"), F.col("syn_type").alias("type"), "tau", "e_rev", "g_max", F.round("attenuation", 4).alias("atten"), F.round("length", 3).alias("lambda"), F.lit(False).alias("active"))


@_query("SELECT vec_id, i, round(genome[1 + (i + vec_id % 15) % 15], 6) AS value FROM genomes, unnest(range(15)) u(i)", "genomes")
def q_ring_buffer_rotate(spark, sf):
    idx = (F.col("vec_id") % 15).cast("int")
    turned = F.concat(F.slice("genome", idx + 1, F.lit(15)), F.slice("genome", F.lit(1), idx))
    return T.genomes(spark, sf).select("vec_id", F.posexplode(turned).alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@_query(f"SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, {DEFAULTS['v_rest']}::DOUBLE AS v_rest, {DEFAULTS['tau_m']}::DOUBLE AS tau_m, TRUE AS excitatory FROM events")
def q_params_from_json(spark, sf):
    p = F.from_json("props", "k double, v_rest double, tau_m double, excitatory boolean")
    return T.table(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", F.col("p.k").alias("k"), F.coalesce("p.v_rest", F.lit(DEFAULTS["v_rest"])).alias("v_rest"), F.coalesce("p.tau_m", F.lit(DEFAULTS["tau_m"])).alias("tau_m"), F.coalesce("p.excitatory", F.lit(True)).alias("excitatory"))


@_query("SELECT neuron_id AS id, round(t_ms, 2) AS t FROM spikes", "spikes")
def q_spike_log(spark, sf):
    return T.spikes(spark, sf).select(F.col("neuron_id").alias("id"), F.round("t_ms", 2).alias("t"))


@_query("SELECT CAST(floor(t_ms / 20.0) AS BIGINT) AS frame, count(*) AS n_spikes, array_to_string(list_sort(list(neuron_id)), ',') AS ids FROM spikes GROUP BY 1", "spikes")
def q_state_frame(spark, sf):
    return display.frames(T.spikes(spark, sf))


@_query("SELECT CAST(floor(t_ms / 20.0) AS BIGINT) AS frame, neuron_id, count(*) AS n_spikes FROM spikes GROUP BY ALL", "spikes")
def q_broadcast_windows(spark, sf):
    return T.spikes(spark, sf).groupBy(F.floor(F.col("t_ms") / 20).alias("frame"), "neuron_id").agg(F.count("*").alias("n_spikes"))


@_query("SELECT neuron_id, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY t_ms DESC) AS rn FROM spikes) WHERE rn <= 20", "spikes")
def q_trace_window(spark, sf):
    return activity.trace_window(T.spikes(spark, sf), "neuron_id", "t_ms", 20)


@_query("SELECT time_bucket(INTERVAL '20 seconds', ts) AS window_start, user_id AS neuron_id, count(*) AS n_spikes FROM events GROUP BY ALL")
def q_stream_windows(spark, sf):
    got = windows.spike_windows(spark, f"{sf}/events.parque[t]", T.table(spark, sf, "events").schema)
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("SELECT * FROM cells WHERE id = 3", "cells")
def q_neuron_detail(spark, sf):
    return _cells(spark, sf).filter("id = 3")


@_query("SELECT network_id, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM neurons GROUP BY 1", "neurons")
def q_full_state(spark, sf):
    return T.neurons(spark, sf).groupBy("network_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


@_query("SELECT neuron_type, p_excitatory AS excitatory, v_rest, tau_m FROM presets", "presets")
def q_presets_catalog(spark, sf):
    return presets(spark).select("neuron_type", "excitatory", "v_rest", "tau_m")


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}', {i}::BIGINT)" for k, xs in CATALOG.items() for i, x in enumerate(xs)) + ") c(kind, name, place)")
def q_catalog(spark, sf):
    rows = [(k, x, i) for k, xs in CATALOG.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "kind string, name string, place long")


_GIVEN = ("v_rest", "v_threshold", "v_reset", "tau_m", "izh_a", "izh_b", "izh_c", "izh_d", "axon_diameter", "myelinated", "noise_level", "model", "neuron_type")


@_query("SELECT id, " + ", ".join(k if k in _GIVEN else f"{x}::DOUBLE AS {k}" if t == "double" else f"{str(x).upper()} AS {k}" for k, (t, x) in PARAMS.items()) + " FROM cells", "cells")
def q_params_struct(spark, sf):
    text = F.to_json(F.struct(*_GIVEN))  # what a panel sends: the fields that are missing fall back to the defaults
    read = _cells(spark, sf).select("id", F.from_json(text, ", ".join(f"{k} {t}" for k, (t, _) in PARAMS.items())).alias("p"))
    return read.select("id", *[F.coalesce(f"p.{k}", F.lit(x)).alias(k) for k, (_, x) in PARAMS.items()])


@_query(f"SELECT 'random' AS topology, a.i AS src_id, b.i AS tgt_id FROM unnest(range(40)) a(i), unnest(range(40)) b(i) WHERE a.i <> b.i AND {_u('er', 'a.i', 'b.i')} < 0.2 UNION ALL SELECT 'custom', a.i, b.i FROM unnest(range(30)) a(i), unnest(range(30)) b(i) WHERE a.i <> b.i AND {_u('er', 'a.i', 'b.i')} < 0.3")
def q_build(spark, sf):
    parts = [graph.build(spark, c).withColumn("topology", F.lit(c["topology"])) for c in ({"topology": "random", "n_neurons": 40}, {"topology": "custom", "n_neurons": 30, "connect_prob": 0.3})]
    return parts[0].unionByName(parts[1])


@_query("SELECT src_id, tgt_id, weight, 0.0::DOUBLE AS g, 0.0::DOUBLE AS dg, FALSE AS active, -1e9::DOUBLE AS pulse_t, 0.0::DOUBLE AS clock FROM synapses", "synapses")
def q_reset_synapses(spark, sf):
    still = {"g": F.lit(0.0), "dg": F.lit(0.0), "active": F.lit(False), "pulse_t": F.lit(-1e9), "clock": F.lit(0.0)}
    return T.synapses(spark, sf).select("src_id", "tgt_id", "weight").withColumns(still)


@_query("SELECT stim_id, neuron_id, start_t FROM stimuli UNION ALL SELECT -1 - id, id, (SELECT max(t_ms) FROM spikes) FROM neurons", "stimuli", "neurons", "spikes")
def q_add_stimulus(spark, sf):
    clock = T.spikes(spark, sf).select(F.max("t_ms")).scalar()  # a stimulus starts when it is added
    new = T.neurons(spark, sf).select((-1 - F.col("id")).alias("stim_id"), F.col("id").alias("neuron_id"), clock.alias("start_t"))
    return T.stimuli(spark, sf).select("stim_id", "neuron_id", "start_t").unionByName(new)


@_query(f"SELECT network_id, 't = ' || printf('%.0f', {_RUN_SQL}) || ' ms' AS clock, CAST(sum(n_spikes) AS BIGINT) || ' spikes' AS spikes, 'sync: ' || printf('%.2f', round(round({_SYNC}, 3), 2)) AS sync FROM rated GROUP BY 1", "spikes", "rated")
def q_header_stats(spark, sf):
    stats = _rated(spark, sf).groupBy("network_id").agg(F.sum("n_spikes").alias("n"), F.round(activity.synchrony(), 3).alias("sync"))
    return stats.select("network_id", F.format_string("t = %.0f ms", _run(spark, sf)).alias("clock"), F.concat(F.col("n").cast("string"), F.lit(" spikes")).alias("spikes"), F.format_string("sync: %.2f", F.round("sync", 2)).alias("sync"))


# --- topologies and edits -------------------------------------------------------------------------


@_query(f"SELECT a.network_id, a.id AS src_id, b.id AS tgt_id FROM neurons a JOIN neurons b USING (network_id) WHERE a.id <> b.id AND {_u('er', 'a.id', 'b.id')} < 0.22", "neurons")
def q_topology_random(spark, sf):
    return graph.random_edges(T.neurons(spark, sf), 0.22)


@_query(f"""#l AS (SELECT DISTINCT i AS src_id, (i + s * j + 200) % 200 AS old FROM unnest(range(200)) a(i), unnest([1, 2]) b(j), unnest([1, -1]) c(s))
  SELECT DISTINCT src_id, CAST(CASE WHEN {_u('swm', 'src_id', 'old')} < 0.3 THEN (src_id + 3 + floor({_u('swt', 'src_id', 'old')} * 195)) % 200 ELSE old END AS BIGINT) AS tgt_id FROM l""", "neurons")  # fmt: skip
def q_topology_small_world(spark, sf):
    return graph.small_world(spark, 200, 4, 0.3)


@_query(f"""#l AS (SELECT * FROM (VALUES (0, 5, 0), (1, 10, 5), (2, 5, 15)) l(layer, size, first)), n AS (SELECT layer, first + p AS id FROM l, unnest(range(size)) u(p))
  SELECT a.id AS src_id, b.id AS tgt_id FROM n a JOIN n b ON b.layer = a.layer + 1 WHERE {_u('ffe', 'a.id', 'b.id')} < 0.5""", "neurons")  # fmt: skip
def q_topology_layered(spark, sf):
    return graph.layered(spark, [5, 10, 5], 0.5, 0.8)[1]


@_query(f"""#l AS (SELECT * FROM (VALUES (0, 5, 0), (1, 10, 5), (2, 5, 15)) l(layer, size, first)), n AS (SELECT layer, p AS place, first + p AS id, size FROM l, unnest(range(size)) u(p))
  SELECT id, CAST(layer AS INT) AS layer, CAST(place AS INT) AS place, CASE WHEN layer = 0 THEN 'sensory' WHEN layer = 2 THEN 'motor' ELSE 'pyramidal' END AS neuron_type,
  layer < 2 OR {_u('ffx', 'id')} < 0.8 AS excitatory, round(80 + 640.0 * layer / 2, 6)::DOUBLE AS x, round(60 + 480.0 * place / greatest(size - 1, 1), 6)::DOUBLE AS y FROM n""", "neurons")  # fmt: skip
def q_layout_layered(spark, sf):
    return graph.layered(spark, [5, 10, 5], 0.5, 0.8)[0]


@_query()
def q_topology_scale_free(spark, sf):
    return graph.scale_free(T.neurons(spark, sf).groupBy("network_id").agg(F.count("*").alias("n")))


@_query(f"""#r AS (SELECT src_id, tgt_id, sum(weight) OVER (PARTITION BY src_id ORDER BY tgt_id ROWS UNBOUNDED PRECEDING) AS upto FROM synapses),
  t AS (SELECT src_id, sum(weight) * {_u('rw', 'src_id')} AS mark FROM synapses GROUP BY src_id) SELECT r.src_id, min(tgt_id) AS tgt_id FROM r JOIN t ON t.src_id = r.src_id WHERE upto > mark GROUP BY 1""", "synapses")  # fmt: skip
def q_roulette_select(spark, sf):
    return graph.roulette(T.synapses(spark, sf), "src_id", "tgt_id", "weight")


@_query("SELECT id, model, n.excitatory, v_rest, izh_a, izh_d, axon_diameter, myelinated FROM neurons n JOIN presets p ON p.neuron_type = CASE WHEN n.excitatory THEN 'pyramidal' ELSE 'interneuron' END", "neurons", "presets")
def q_make_neurons(spark, sf):
    n = T.neurons(spark, sf).withColumn("neuron_type", F.when(F.col("excitatory"), "pyramidal").otherwise("interneuron"))
    return n.join(F.broadcast(presets(spark).drop("excitatory")), "neuron_type").select("id", "model", "excitatory", "v_rest", "izh_a", "izh_d", "axon_diameter", "myelinated")


@_query("SELECT id, round(400 + 300 * cos(2 * pi() * k / n), 6) AS x, round(300 + 300 * sin(2 * pi() * k / n), 6) AS y FROM (SELECT id, row_number() OVER (PARTITION BY network_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY network_id) AS n FROM neurons)", "neurons")
def q_layout_circle(spark, sf):
    return _six(graph.circle(T.neurons(spark, sf)).select("id", "x", "y"))


@_query(f"SELECT src_id, tgt_id, round(greatest(0.05, 1.0 + 0.3 * {_g('w', 'src_id', 'tgt_id')}), 6) AS weight, round(0.1 + 2.9 * {_u('wd', 'src_id', 'tgt_id')}, 6) AS distance FROM synapses", "synapses")
def q_random_weights(spark, sf):
    return _six(graph.with_weights(T.synapses(spark, sf).select("src_id", "tgt_id")))


@_query("SELECT src_id, tgt_id, CASE WHEN excitatory THEN 'ampa' ELSE 'gaba_a' END AS default_type, axon_diameter, myelinated FROM synapses s JOIN cells c ON c.id = s.src_id", "cells", "synapses")
def q_edge_type_default(spark, sf):
    c = _cells(spark, sf).select(F.col("id").alias("src_id"), "excitatory", "axon_diameter", "myelinated")
    return T.synapses(spark, sf).join(c, "src_id").select("src_id", "tgt_id", F.when(F.col("excitatory"), "ampa").otherwise("gaba_a").alias("default_type"), "axon_diameter", "myelinated")


@_query("SELECT n.id, coalesce(array_to_string(list_sort(list(tgt_id) FILTER (tgt_id IS NOT NULL)), ','), '') AS targets FROM neurons n LEFT JOIN synapses s ON s.src_id = n.id GROUP BY 1", "neurons", "synapses")
def q_adjacency(spark, sf):
    return graph.adjacency(T.neurons(spark, sf), T.synapses(spark, sf)).withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))


@_query("SELECT id, network_id, neuron_type FROM neurons UNION ALL SELECT max(id) + 1, NULL, 'granule' FROM neurons", "neurons")
def q_add_neuron(spark, sf):
    return graph.add_node(T.neurons(spark, sf).select("id", "network_id", "neuron_type"), neuron_type="granule")


@_query("SELECT src_id, tgt_id, weight FROM synapses WHERE src_id % 7 <> 0 AND tgt_id % 7 <> 0", "synapses")
def q_remove_neuron_cascade(spark, sf):
    n = T.neurons(spark, sf)
    return graph.remove_nodes(n, T.synapses(spark, sf), n.filter("id % 7 = 0").select("id"))[1].select("src_id", "tgt_id", "weight")


@_query("SELECT src_id, tgt_id FROM synapses UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT id FROM neurons) AND c_nationkey IN (SELECT id FROM neurons)", "neurons", "synapses")
def q_add_synapse_guarded(spark, sf):
    new = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("src_id"), F.col("c_nationkey").cast("long").alias("tgt_id"))
    return graph.add_edges(T.neurons(spark, sf).select("id"), T.synapses(spark, sf).select("src_id", "tgt_id"), new)


@_query("SELECT src_id, tgt_id, weight FROM synapses WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = src_id AND c_nationkey = tgt_id)", "synapses")
def q_remove_synapse(spark, sf):
    gone = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("src_id"), F.col("c_nationkey").cast("long").alias("tgt_id"))
    return T.synapses(spark, sf).join(gone, ["src_id", "tgt_id"], "left_anti").select("src_id", "tgt_id", "weight")


@_query("SELECT src_id, min(tgt_id) AS tgt_id, arg_min(weight, tgt_id) AS weight FROM synapses GROUP BY 1", "synapses")
def q_synapse_first(spark, sf):
    return T.synapses(spark, sf).groupBy("src_id").agg(F.min("tgt_id").alias("tgt_id"), F.min_by("weight", "tgt_id").alias("weight"))


@_query("SELECT id, u AS mu, v FROM (SELECT id, excitatory AS u, coalesce((SELECT arg_max(value, event_id) FROM events WHERE user_id = p.id), v) AS v FROM population p)", "population")
def q_state_merge(spark, sf):
    updates = T.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("value").alias("v"), "event_id")
    return display.merge_state(T.population(spark, sf), updates, "id", "event_id", ["v"]).select("id", F.col("excitatory").alias("mu"), "v")


@_query("SELECT id, v_rest AS v, izh_b * v_rest AS u, 0.05::DOUBLE AS m, 0.6::DOUBLE AS h, 0.32::DOUBLE AS n, 0::BIGINT AS spike_count FROM cells", "cells")
def q_reset_state(spark, sf):
    return _cells(spark, sf).select("id", F.col("v_rest").alias("v"), (F.col("izh_b") * F.col("v_rest")).alias("u"), F.lit(0.05).alias("m"), F.lit(0.6).alias("h"), F.lit(0.32).alias("n"), F.lit(0).cast("long").alias("spike_count"))


# --- axons, synapses, stimuli ---------------------------------------------------------------------


@_query("SELECT id, round(CASE WHEN myelinated THEN greatest(1.0, 6.0 * axon_diameter) ELSE greatest(0.2, 0.57 * sqrt(axon_diameter)) END, 6) AS velocity FROM cells", "cells")
def q_conduction_velocity(spark, sf):
    return _six(_cells(spark, sf).select("id", kernels.velocity(F.col("axon_diameter"), F.col("myelinated")).alias("velocity")))


@_query("SELECT src_id, tgt_id, round(length, 6) AS length, round(attenuation, 6) AS attenuation, round(delay_ms, 6) AS delay_ms FROM wires", "wires")
def q_cable(spark, sf):
    return _six(_wires(spark, sf).select("src_id", "tgt_id", "length", "attenuation", "delay_ms"))


@_query("SELECT src_id, tgt_id, round(CASE WHEN myelinated THEN 6 * axon_diameter ELSE 0.57 * sqrt(axon_diameter) END, 6) AS velocity, round(distance / 6, 6) AS delay FROM synapses s JOIN cells c ON c.id = s.src_id", "cells", "synapses")
def q_panel_cable(spark, sf):
    d = F.col("axon_diameter")
    return _six(_wires(spark, sf).select("src_id", "tgt_id", F.when(F.col("myelinated"), 6 * d).otherwise(0.57 * F.sqrt(d)).alias("velocity"), (F.col("distance") / 6).alias("delay")))


@_query("SELECT src_id, tgt_id, CASE WHEN src_id % 3 = 0 THEN 9.0 ELSE tau END AS tau, e_rev, g_max FROM synapses JOIN kinds USING (syn_type)", "synapses", "kinds")
def q_synapse_defaults(spark, sf):
    given = F.when(F.col("src_id") % 3 == 0, 9.0)
    return T.synapses(spark, sf).join(F.broadcast(synapse_types(spark)), "syn_type").select("src_id", "tgt_id", F.coalesce(given, F.col("tau")).alias("tau"), "e_rev", "g_max")


@_query("SELECT src_id, tgt_id, CASE WHEN src_id % 5 = 0 THEN 3.0 ELSE weight END AS weight, CASE WHEN src_id % 3 = 0 THEN 9.0 ELSE tau END AS tau, round(coalesce(CASE WHEN tgt_id % 4 = 0 THEN 2.0 END, w.distance), 6) AS distance, round(exp(-coalesce(CASE WHEN tgt_id % 4 = 0 THEN 2.0 END, w.distance) / length), 6) AS attenuation FROM wires w JOIN kinds USING (syn_type)", "wires", "kinds")
def q_update_synapse(spark, sf):
    met = _wires(spark, sf).join(F.broadcast(synapse_types(spark)), "syn_type")
    given = {"weight": F.when(F.col("src_id") % 5 == 0, 3.0), "tau": F.when(F.col("src_id") % 3 == 0, 9.0), "distance": F.when(F.col("tgt_id") % 4 == 0, 2.0)}
    met = met.withColumns({k: F.coalesce(new, F.col(k)) for k, new in given.items()})
    return _six(met.select("src_id", "tgt_id", "weight", "tau", "distance", kernels.attenuation(F.col("distance"), F.col("length")).alias("attenuation")))


@_query("SELECT src_id, tgt_id, t_ms, round(t_ms + delay_ms, 6) AS arrive_t, round(weight * attenuation, 6) AS strength FROM spikes JOIN wires ON neuron_id = src_id", "spikes", "wires")
def q_spike_delivery(spark, sf):
    # What belongs to a spike or a wire is rounded before they meet; only the arrival is made for each pair.
    wires = _wires(spark, sf).select("src_id", "tgt_id", "delay_ms", F.round(F.col("weight") * F.col("attenuation"), 6).alias("strength"))
    return activity.deliver(T.spikes(spark, sf), wires).withColumn("arrive_t", F.round("arrive_t", 6))


@_query("SELECT tgt_id, CAST(greatest(floor(t_ms) + 1, ceil(t_ms + delay_ms)) AS BIGINT) AS step, count(*) AS n, round(sum(weight * attenuation), 6) AS kick FROM spikes JOIN wires ON neuron_id = src_id GROUP BY ALL", "spikes", "wires")
def q_delivery_bins(spark, sf):
    wires = _wires(spark, sf).select("src_id", "tgt_id", "delay_ms", (F.col("weight") * F.col("attenuation")).alias("strength"))
    return _six(blocks.binned_arrivals(T.spikes(spark, sf), wires))


@_query("SELECT tgt_id AS id, round(sum(-g_max * weight * (v - e_rev) * 1e-3), 6) AS current FROM synapses JOIN kinds USING (syn_type) JOIN population ON id = tgt_id GROUP BY 1", "synapses", "kinds", "population")
def q_synaptic_input(spark, sf):
    return _six(activity.synaptic_input(T.synapses(spark, sf), synapse_types(spark), T.population(spark, sf)))


@_query(f"""#d AS (SELECT tgt_id, t_ms + delay_ms AS a, weight * attenuation AS w, tau, g_max FROM spikes JOIN wires ON neuron_id = src_id JOIN kinds USING (syn_type)), r AS (SELECT {_RUN_SQL} AS e)
  SELECT tgt_id, round(sum(g_max * w * ((e - a) / tau) * exp(1 - (e - a) / tau)), 6) AS g FROM d, r WHERE a <= e GROUP BY 1""", "spikes", "wires", "kinds")  # fmt: skip
def q_alpha_closed_form(spark, sf):
    wires = _wires(spark, sf)
    end = _run(spark, sf)
    met = T.spikes(spark, sf).withColumnRenamed("neuron_id", "src_id").join(wires, "src_id").join(F.broadcast(synapse_types(spark)), "syn_type")
    x = (end - (F.col("t_ms") + F.col("delay_ms"))) / F.col("tau")
    return _six(met.filter(F.col("t_ms") + F.col("delay_ms") <= end).groupBy("tgt_id").agg(F.sum(F.col("g_max") * F.col("weight") * F.col("attenuation") * x * F.exp(1 - x)).alias("g")))


@_query("""#s(syn_type, k, g, dg, peak) AS (SELECT syn_type, 0, 0.0::DOUBLE, g_max * 2.718281828459045 / tau, 0.0::DOUBLE FROM kinds UNION ALL
  SELECT s.syn_type, k + 1, greatest(0.0, g + (dg + (-2.0 * dg / tau - g / (tau * tau)) * 0.1) * 0.1), dg + (-2.0 * dg / tau - g / (tau * tau)) * 0.1, greatest(peak, g + (dg + (-2.0 * dg / tau - g / (tau * tau)) * 0.1) * 0.1)
  FROM s JOIN kinds n ON n.syn_type = s.syn_type WHERE k < 300) SELECT syn_type, round(g, 6) AS g, round(dg, 6) AS dg, round(peak, 6) AS peak FROM s WHERE k = 300""", "kinds", recursive=True)  # fmt: skip
def q_alpha_ode(spark, sf):
    return _six(dynamics.conductance(synapse_types(spark).withColumn("kick", F.lit(1.0)), 300, 0.1, "syn_type"))


def _stim_sql(t: str, draw: str) -> str:
    rel = f"({t} - start_t)"
    return f"CASE WHEN {rel} < 0 THEN 0.0 WHEN stim_type = 'constant' THEN amplitude WHEN stim_type = 'pulse' AND {rel} <= duration_ms THEN amplitude WHEN stim_type = 'ramp' AND {rel} <= duration_ms THEN amplitude * {rel} / duration_ms WHEN stim_type = 'sinusoidal' THEN amplitude * sin(2 * pi() * frequency * {rel} * 1e-3) WHEN stim_type = 'random' AND {draw} < frequency * 1e-3 THEN amplitude ELSE 0.0 END"


def _stim(rel, draw):
    return kernels.stimulus(F.col("stim_type"), F.col("amplitude"), F.col("duration_ms"), F.col("frequency"), rel, draw)


@_query(f"SELECT stim_id, round({_stim_sql(_HALF_SQL, _u('st', 'stim_id'))}, 6) + 0.0 AS current FROM stimuli", "stimuli", "spikes")
def q_stimulus_current(spark, sf):
    return _six(T.stimuli(spark, sf).select("stim_id", _stim(_run(spark, sf) / 2 - F.col("start_t"), uniform("st", "stim_id")).alias("current")))


@_query(f"SELECT stim_id, k AS step, {_u('sr', 'stim_id', 'k')} < frequency * 1e-3 AS active FROM stimuli, unnest(range(3)) u(k) WHERE stim_type = 'random'", "stimuli")
def q_stimulus_random(spark, sf):
    each = T.stimuli(spark, sf).filter("stim_type = 'random'").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return each.select("stim_id", "step", (uniform("sr", "stim_id", "step") < F.col("frequency") * 1e-3).alias("active"))


@_query(f"SELECT neuron_id, CAST(t AS BIGINT) AS t, round(sum({_stim_sql('t', _u('st', 'stim_id'))}), 6) + 0.0 AS current FROM stimuli, (SELECT floor({_RUN_SQL} * q / 4) AS t FROM unnest(range(1, 5)) u(q)) WHERE start_t <= t GROUP BY ALL", "stimuli", "spikes")
def q_stimulus_superposition(spark, sf):
    each = T.stimuli(spark, sf).withColumn("t", F.explode(F.array(*[F.floor(_run(spark, sf) * q / 4) for q in range(1, 5)]))).filter("start_t <= t")
    return _six(each.groupBy("neuron_id", "t").agg(F.sum(_stim(F.col("t") - F.col("start_t"), uniform("st", "stim_id"))).alias("current")))


@_query(f"SELECT stim_id FROM stimuli WHERE {_stim_sql(_HALF_SQL, _u('st', 'stim_id'))} <> 0 OR {_HALF_SQL} - start_t < 2 * duration_ms", "stimuli", "spikes")
def q_stimulus_retention(spark, sf):
    age = _run(spark, sf) / 2 - F.col("start_t")
    return T.stimuli(spark, sf).filter((_stim(age, uniform("st", "stim_id")) != 0) | (age < 2 * F.col("duration_ms"))).select("stim_id")


@_query(f"SELECT id, round(10.0 * (0.7 + 0.6 * {_u('all', 'id')}), 6) AS amplitude FROM neurons", "neurons")
def q_stimulate_all(spark, sf):
    return _six(T.neurons(spark, sf).select("id", (10.0 * (0.7 + 0.6 * uniform("all", "id"))).alias("amplitude")))


# --- dynamics -------------------------------------------------------------------------------------


@_query("""SELECT id, round(CASE WHEN abs(1.0 - exp(-(v + 40.0) / 10.0)) < 1e-7 THEN 1.0 ELSE 0.1 * (v + 40.0) / (1.0 - exp(-(v + 40.0) / 10.0)) END, 6) AS alpha_m, round(4.0 * exp(-(v + 65.0) / 18.0), 6) AS beta_m,
  round(0.07 * exp(-(v + 65.0) / 20.0), 6) AS alpha_h, round(1.0 / (1.0 + exp(-(v + 35.0) / 10.0)), 6) AS beta_h,
  round(CASE WHEN abs(1.0 - exp(-(v + 55.0) / 10.0)) < 1e-7 THEN 0.1 ELSE 0.01 * (v + 55.0) / (1.0 - exp(-(v + 55.0) / 10.0)) END, 6) AS alpha_n, round(0.125 * exp(-(v + 65.0) / 80.0), 6) AS beta_n FROM (SELECT id, CAST(id % 131 - 90 AS DOUBLE) AS v FROM population)""", "population")  # fmt: skip
def q_hh_rates(spark, sf):
    v = (F.col("id") % 131 - 90).cast("double")
    return _six(T.population(spark, sf).select("id", *[c.alias(n) for n, c in kernels.hh_rates(v).items()]))


_CURRENT = "(3.0 + id % 7)"


def _driven(spark, sf):
    cells = _cells(spark, sf).withColumn("current", 3.0 + F.col("id") % 7)
    return cells.withColumns({k: F.lit(x) for k, x in DEFAULTS.items() if k not in cells.columns})


@_query(f"""#s(id, k, v, u, spikes) AS (SELECT id, 0, v_rest, izh_b * v_rest, 0::BIGINT FROM cells UNION ALL
  SELECT id, k + 1, CASE WHEN nv >= 30 THEN izh_c ELSE nv END, CASE WHEN nv >= 30 THEN nu + izh_d ELSE nu END, spikes + CASE WHEN nv >= 30 THEN 1 ELSE 0 END
  FROM (SELECT s.id, k, spikes, izh_c, izh_d, v + (0.04 * v * v + 5.0 * v + 140.0 - u + {_CURRENT.replace('id', 's.id')} * 10.0) * 0.1 AS nv, u + izh_a * (izh_b * v - u) * 0.1 AS nu FROM s JOIN cells c ON c.id = s.id WHERE k < 200))
  SELECT id, round(v, 4) AS v, round(u, 4) AS u, spikes FROM s WHERE k = 200""", "cells", recursive=True)  # fmt: skip
def q_izh_trajectory(spark, sf):
    return dynamics.izhikevich(_driven(spark, sf), 200, 0.1, "id").select("id", F.round("v", 4).alias("v"), F.round("u", 4).alias("u"), "spikes")


@_query(f"""#s(id, k, v, ref, spikes) AS (SELECT id, 0, v_rest, 0.0::DOUBLE, 0::BIGINT FROM cells UNION ALL
  SELECT id, k + 1, CASE WHEN ref > 0 THEN v_reset WHEN nv >= v_threshold THEN 30.0 ELSE nv END, CASE WHEN ref > 0 THEN ref - 0.1 WHEN nv >= v_threshold THEN 2.0 ELSE ref END, spikes + CASE WHEN ref <= 0 AND nv >= v_threshold THEN 1 ELSE 0 END
  FROM (SELECT s.id, k, spikes, ref, v_reset, v_threshold, v + (-(v - v_rest) + 10.0 * {_CURRENT.replace('id', 's.id')}) / tau_m * 0.1 AS nv FROM s JOIN cells c ON c.id = s.id WHERE k < 200))
  SELECT id, round(v, 4) AS v, spikes FROM s WHERE k = 200""", "cells", recursive=True)  # fmt: skip
def q_lif_trajectory(spark, sf):
    return dynamics.integrate_and_fire(_driven(spark, sf), 200, 0.1, "id").select("id", F.round("v", 4).alias("v"), "spikes")


@_query()
def q_hh_trajectory(spark, sf):
    return dynamics.hodgkin_huxley(_driven(spark, sf), 500, 0.02, "id").select("id", F.round("v", 3).alias("v"), F.round("m", 4).alias("m"), F.round("h", 4).alias("h"), F.round("n", 4).alias("n"), "spikes")


@_query()
def q_model_dispatch(spark, sf):
    return dynamics.by_model(_driven(spark, sf), 200, 0.05).select("id", "model", F.round("v", 3).alias("v"), "spikes")


@_query(f"SELECT id, CAST(k AS INT) AS step, round({_CURRENT} + noise_level * {_g('noise', 'id', 'k')}, 6) AS current FROM cells, unnest(range(1, 6)) u(k)", "cells")
def q_noisy_current(spark, sf):
    return _six(dynamics.noisy_current(_driven(spark, sf), 5))


@_query("SELECT neuron_id, step, v FROM (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY step DESC) AS k FROM (SELECT user_id AS neuron_id, event_id AS step, value AS v FROM events WHERE event_id % 10 = 0)) WHERE k <= 200")
def q_voltage_history(spark, sf):
    samples = T.table(spark, sf, "events").select(F.col("user_id").alias("neuron_id"), F.col("event_id").alias("step"), F.col("value").alias("v"))
    return activity.trace_window(samples.filter("step % 10 = 0"), "neuron_id", "step", 200)  # a slot each ms, with steps of 0.1 ms


@_query()
def q_coupled_network(spark, sf):
    cells = _driven(spark, sf).select("id", F.col("v_rest").alias("v"), "v_rest", "v_reset", "v_threshold", "tau_m", "tau_ref", "r_m", "current")
    wires = _wires(spark, sf).select("src_id", "tgt_id", "delay_ms", (F.col("weight") * F.col("attenuation")).alias("strength"))
    return coupled.simulate(spark, cells, wires, 5).select("id", F.round("v", 4).alias("v"), "spikes")


# --- plasticity and evolution ---------------------------------------------------------------------

@_query(f"""#l AS (SELECT neuron_id AS id, max(t_ms) AS t, max(t_ms) = {_LAST_SQL} AS f FROM spikes WHERE t_ms <= {_LAST_SQL} GROUP BY 1)
  SELECT src_id, tgt_id, round(greatest(0.0, least(10.0, weight + CASE WHEN coalesce(a.f, FALSE) AND NOT coalesce(b.f, FALSE) THEN 0.01 * exp(-({_LAST_SQL} - coalesce(b.t, -1e9)) / 20.0)
  WHEN coalesce(b.f, FALSE) AND NOT coalesce(a.f, FALSE) THEN -0.012 * exp(-({_LAST_SQL} - coalesce(a.t, -1e9)) / 20.0) ELSE 0.0 END)), 6) AS weight FROM synapses LEFT JOIN l a ON a.id = src_id LEFT JOIN l b ON b.id = tgt_id""", "spikes", "synapses")  # fmt: skip
def q_stdp(spark, sf):
    at = T.spikes(spark, sf).select(F.max("t_ms")).scalar()
    out = activity.plasticity(T.synapses(spark, sf), activity.last_spikes(T.spikes(spark, sf), at), at)
    return _six(out.select("src_id", "tgt_id", "weight"))


@_query("SELECT src_id, tgt_id, greatest(0.0, least(10.0, weight * 4 - 2)) AS weight FROM synapses", "synapses")
def q_stdp_clamp(spark, sf):
    return T.synapses(spark, sf).select("src_id", "tgt_id", activity.clamped(F.col("weight") * 4 - 2).alias("weight"))


@_query("SELECT src_id, tgt_id, weight * 4 - 2 AS weight FROM synapses", "synapses")
def q_stdp_no_spike(spark, sf):
    edges = T.synapses(spark, sf).withColumn("weight", F.col("weight") * 4 - 2)
    return activity.plasticity(edges, activity.last_spikes(T.spikes(spark, sf), -1.0), -1.0).select("src_id", "tgt_id", "weight")


_SCORED = "#s AS (SELECT r.*, 0.6 * avg(rate) OVER (PARTITION BY network_id) + 0.4 * rate AS score FROM rated r)"


def _scored(spark, sf):
    rated = _rated(spark, sf)
    return evolution.scores(rated, rated.groupBy("network_id").agg(activity.fitness("max_firing_rate").alias("fitness")))


@_query(f"{_SCORED} SELECT id, round(score, 6) AS score FROM s", "rated")
def q_evolution_scores(spark, sf):
    return _six(_scored(spark, sf).select("id", "score"))


@_query(f"{_SCORED} SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY network_id ORDER BY round(score, 9) DESC, id DESC) - 1 AS rank, count(*) OVER (PARTITION BY network_id) AS n FROM s) WHERE rank < greatest(1, floor(n * 0.2))", "rated")
def q_elite_topk(spark, sf):
    return evolution.elites(_scored(spark, sf).withColumn("score", F.round("score", 9))).select("id", F.col("rank").cast("long").alias("rank"))


@_query(f"{_SCORED} SELECT network_id, round(max(score), 4) AS best_fitness, round(avg(score), 4) AS mean_fitness, CAST(greatest(1, floor(count(*) * 0.2)) AS BIGINT) AS elite_count FROM s GROUP BY 1", "rated")
def q_generation_summary(spark, sf):
    return evolution.summary(_scored(spark, sf))


def _long(df: DataFrame) -> DataFrame:
    """(vec_id, i, value) of a genome column."""
    return df.select("vec_id", F.posexplode("genome").alias("i", "value")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("value", 6).alias("value"))


@_query("SELECT id, CAST(i AS BIGINT) AS i, g[i] AS value FROM (SELECT id, [" + ", ".join(f"{DEFAULTS[g]}::DOUBLE" if g in ("v_peak", "tau_ref", "r_m", "g_na", "g_k", "g_l") else g for g, _, _ in GENES) + "] AS g FROM cells), unnest(range(1, 16)) u(i)", "cells")
def q_genome_encode(spark, sf):
    return _driven(spark, sf).select("id", F.posexplode(evolution.encode()).alias("i", "value")).select("id", (F.col("i") + 1).cast("long").alias("i"), "value")


@_query("SELECT vec_id, CAST(i AS BIGINT) AS i, round(greatest(lo, least(hi, genome[i] * 100)), 6) AS value FROM genomes, bounds", "genomes", "bounds")
def q_genome_clamp(spark, sf):
    return _long(T.genomes(spark, sf).select("vec_id", evolution.clamp(F.transform("genome", lambda x: x * 100)).alias("genome")))


@_query(f"SELECT vec_id, CAST(i AS BIGINT) AS i, round(CASE WHEN {_u('mutu', 'vec_id', 'i - 1')} < 0.15 THEN greatest(lo, least(hi, genome[i] + {_g('mut', 'vec_id', 'i - 1')} * (hi - lo) * 0.1)) ELSE genome[i] END, 6) AS value FROM genomes, bounds", "genomes", "bounds")
def q_mutate(spark, sf):
    return _long(T.genomes(spark, sf).select("vec_id", evolution.mutate(F.col("genome"), F.col("vec_id")).alias("genome")))


@_query(f"SELECT a.vec_id, CAST(i AS BIGINT) AS i, round(CASE WHEN {_u('cross', 'a.vec_id', 'i - 1')} < 0.5 THEN a.genome[i] ELSE b.genome[i] END, 6) AS value FROM genomes a JOIN genomes b ON b.vec_id = a.vec_id + 1, bounds", "genomes", "bounds")
def q_crossover(spark, sf):
    g = T.genomes(spark, sf)
    other = g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("genome").alias("other"))
    return _long(g.join(other, "vec_id").select("vec_id", evolution.crossover(F.col("genome"), F.col("other"), F.col("vec_id")).alias("genome")))


_ELITE = "b AS (SELECT network_id, id, rank FROM (SELECT network_id, id, row_number() OVER (PARTITION BY network_id ORDER BY round(score, 9) DESC, id DESC) - 1 AS rank, count(*) OVER (PARTITION BY network_id) AS n FROM s) WHERE rank < greatest(1, floor(n * 0.2))), k AS (SELECT network_id, count(*) AS k FROM b GROUP BY 1)"


def _drawn(seed: str, rows: str) -> str:
    """Draws of the parents' ranks for the rows of a view."""
    u = lambda x: _u(seed + x, "r.id")
    return f"SELECT r.id, r.network_id, floor({u('a')} * k) AS ra, CASE WHEN k > 1 AND {u('x')} < 0.5 THEN floor({u('b')} * k) END AS rb FROM {rows} r JOIN k ON k.network_id = r.network_id"


@_query(f"{_SCORED}, {_ELITE}, d AS ({_drawn('par', 's')}) SELECT d.id, a.id AS parent_a, x.id AS parent_b FROM d JOIN b a ON a.network_id = d.network_id AND a.rank = ra LEFT JOIN b x ON x.network_id = d.network_id AND x.rank = rb", "rated")
def q_select_parents(spark, sf):
    scored = _scored(spark, sf).withColumn("score", F.round("score", 9))
    return evolution.parents(scored.select("id", "network_id"), evolution.elites(scored).select("network_id", "id", "rank"))


@_query()
def q_run_generation(spark, sf):
    cells = _driven(spark, sf).select("id", "network_id", evolution.encode().alias("genome"))
    rated = activity.rates(cells, T.spikes(spark, sf), _run(spark, sf))
    scored = evolution.scores(rated, rated.groupBy("network_id").agg(activity.fitness("max_firing_rate").alias("fitness")))
    return evolution.generation(cells, scored).select("id", "network_id", F.posexplode("genome").alias("gene", "value"))


@_query()
def q_evolution_history(spark, sf):
    cells = _driven(spark, sf).select("id", "network_id", evolution.encode().alias("genome"))
    out = None
    for g in range(3):  # spike counts stay as they are between generations
        rated = activity.rates(cells, T.spikes(spark, sf), _run(spark, sf))
        scored = evolution.scores(rated, rated.groupBy("network_id").agg(activity.fitness("max_firing_rate").alias("fitness")))
        row = evolution.summary(scored).withColumn("generation", F.lit(g))
        out = row if out is None else out.unionByName(row)
        cells = coupled.cut(spark, evolution.generation(cells, scored, seed=f"g{g}"))
    return out


_CLOCK = 1e7  # ms: late enough that rates are low


def _counted(spark, sf):
    return activity.rates(T.neurons(spark, sf), T.spikes(spark, sf).filter("neuron_id % 3 <> 0"), _CLOCK).select("id", "network_id", "n_spikes")


_GREW = f"""#c AS (SELECT n.id, n.network_id, coalesce(k, 0) AS n_spikes FROM neurons n LEFT JOIN (SELECT neuron_id, count(*) AS k FROM spikes WHERE neuron_id % 3 <> 0 GROUP BY 1) s ON s.neuron_id = n.id),
  l AS (SELECT * FROM c WHERE n_spikes > 0), q AS (SELECT network_id, (SELECT max(id) FROM c) + row_number() OVER (ORDER BY network_id) AS next_id FROM (SELECT network_id FROM l GROUP BY 1 HAVING sum(n_spikes) / {_CLOCK} * 1000 / count(*) < 0.05 AND count(*) < 100)),
  e AS (SELECT src_id, tgt_id, weight, distance, syn_type FROM synapses WHERE weight >= 1.05 AND src_id NOT IN (SELECT id FROM c WHERE n_spikes = 0) AND tgt_id NOT IN (SELECT id FROM c WHERE n_spikes = 0)),
  g AS (SELECT id AS src_id, next_id AS tgt_id, row_number() OVER (PARTITION BY l.network_id ORDER BY {_u('grow', 'next_id', 'id')}, id) AS rn FROM l JOIN q ON q.network_id = l.network_id)"""


@_query(f"""{_GREW} SELECT src_id, tgt_id, round(weight, 6) AS weight, round(distance, 6) AS distance, syn_type FROM e UNION ALL
  SELECT src_id, tgt_id, round(0.5 + 1.5 * {_u('groww', 'tgt_id', 'src_id')}, 6), round(0.5 + 1.5 * {_u('growd', 'tgt_id', 'src_id')}, 6), 'ampa' FROM g WHERE rn <= 3""", "neurons", "spikes", "synapses")  # fmt: skip
def q_structural_edges(spark, sf):
    return _six(evolution.structural_step(_counted(spark, sf), T.synapses(spark, sf), _CLOCK, 1.05)[1])


@_query(f"""{_GREW} SELECT n.network_id, coalesce(w.k, 0) AS pruned_synapses, CAST(n.mute AS BIGINT) AS pruned_neurons, CAST(n.network_id IN (SELECT network_id FROM q) AS BIGINT) AS added_neurons
  FROM (SELECT network_id, count_if(n_spikes = 0) AS mute FROM c GROUP BY 1) n LEFT JOIN (SELECT network_id, count(*) AS k FROM synapses JOIN c ON c.id = src_id WHERE weight < 1.05 GROUP BY 1) w ON w.network_id = n.network_id""", "neurons", "spikes", "synapses")  # fmt: skip
def q_structural_report(spark, sf):
    return evolution.structural_step(_counted(spark, sf), T.synapses(spark, sf), _CLOCK, 1.05)[2]


@_query(f"{_SCORED} SELECT network_id, 'G1 best ' || printf('%.3f', round(round(max(score), 4), 3)) || ' mean ' || printf('%.3f', round(round(avg(score), 4), 3)) AS line FROM s GROUP BY 1", "rated")
def q_history_rows(spark, sf):
    line = F.format_string("G1 best %.3f mean %.3f", F.round(F.col("best_fitness"), 3), F.round(F.col("mean_fitness"), 3))
    return evolution.summary(_scored(spark, sf)).select("network_id", line.alias("line"))


@_query("SELECT src_id, tgt_id, weight FROM synapses WHERE weight >= 1.05", "synapses")
def q_prune_synapses(spark, sf):
    return evolution.prune_edges(T.synapses(spark, sf), 1.05).select("src_id", "tgt_id", "weight")


@_query("SELECT id, network_id FROM rated WHERE n_spikes > 0", "rated")
def q_prune_silent(spark, sf):
    rated = _rated(spark, sf)
    return rated.join(rated.filter("n_spikes = 0").select("id"), "id", "left_anti").select("id", "network_id")


@_query(f"""#q AS (SELECT network_id, max(id) + 1 AS next_id FROM rated GROUP BY 1 HAVING avg(rate) < 1e9 AND count(*) < 10000), d AS (SELECT q.network_id, next_id, id, {_u('grow', 'next_id', 'id')} AS draw FROM population p JOIN q ON q.network_id = p.network_id)
  SELECT network_id, next_id AS new_id, id AS src_id, round(0.5 + 1.5 * {_u('groww', 'next_id', 'id')}, 6) AS weight, round(0.5 + 1.5 * {_u('growd', 'next_id', 'id')}, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY draw, id) AS rn FROM d) WHERE rn <= 3""", "rated")  # fmt: skip
def q_grow_neuron(spark, sf):
    rated = _rated(spark, sf)
    means = rated.groupBy("network_id").agg(F.avg("rate").alias("mean_rate"), F.count("*").alias("n"), (F.max("id") + 1).alias("next_id"))
    return _six(evolution.grow(rated.select("id", "network_id"), means, 1e9, 10000))


# --- display --------------------------------------------------------------------------------------


def _color_sql(v: str) -> str:
    t = f"greatest(0.0, least(1.0, ({v} + 90) / 130.0))"
    parts = []
    for (t0, *a), (t1, *b) in zip(STOPS, STOPS[1:]):
        rgb = " || ',' || ".join(f"CAST(floor({x} + ({t} - {t0}) / ({t1} - {t0}) * ({y} - {x}) + 0.5) AS BIGINT)" for x, y in zip(a, b))
        parts.append(f"WHEN {t} <= {t1} THEN 'rgb(' || {rgb} || ')'")
    return "CASE " + " ".join(parts) + " END"


@_query(f"SELECT id, {_color_sql('vv')} AS color FROM (SELECT id, CAST(id % 151 - 100 AS DOUBLE) + 0.3 AS vv FROM population)", "population")
def q_voltage_color(spark, sf):
    return T.population(spark, sf).select("id", kernels.voltage_color((F.col("id") % 151 - 100).cast("double") + 0.3).alias("color"))


@_query("SELECT id, CASE neuron_type " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in RADII.items()) + " ELSE 8 END AS radius FROM neurons", "neurons")
def q_neuron_radius(spark, sf):
    return T.neurons(spark, sf).select("id", display.radius(F.col("neuron_type")).alias("radius"))


@_query(f"{_PLACED} SELECT s.src_id, s.tgt_id, t_ms, round(a.x, 6) AS sx, round(a.y, 6) AS sy, round(b.x, 6) AS tx, round(b.y, 6) AS ty FROM spikes JOIN synapses s ON s.src_id = neuron_id JOIN p a ON a.id = s.src_id JOIN p b ON b.id = s.tgt_id", "neurons", "spikes", "synapses")
def q_pulse_fanout(spark, sf):
    return display.pulses(T.spikes(spark, sf), T.synapses(spark, sf), _six(graph.circle(T.neurons(spark, sf))))


@_query(f"{_PLACED} SELECT id, CAST(f AS INT) AS frame, round(x * (1 - f * 0.06), 6) AS x, CAST(round(1 - 0.7 * f * 0.06, 6) AS DOUBLE) AS opacity FROM p, unnest(range(17)) u(f) WHERE f * 0.06 < 1", "neurons")
def q_pulse_animation(spark, sf):
    ends = graph.circle(T.neurons(spark, sf)).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    return display.animate(ends).select("id", "frame", "x", "opacity")


@_query("SELECT src_id, tgt_id, round(1 + weight * 0.8, 6) AS width, CASE WHEN syn_type IN ('gaba_a', 'gaba_b') THEN 'inh' ELSE 'exc' END AS arrow, CASE WHEN src_id % 4 = 0 THEN '#ffee00' WHEN syn_type IN ('gaba_a', 'gaba_b') THEN '#ff4466' ELSE '#00bb66' END AS color FROM synapses", "synapses")
def q_edge_style(spark, sf):
    inhibits = F.col("syn_type").isin("gaba_a", "gaba_b")
    active = F.col("src_id") % 4 == 0  # as if these sources had just fired
    color = F.when(active, "#ffee00").when(inhibits, "#ff4466").otherwise("#00bb66")
    return _six(T.synapses(spark, sf).select("src_id", "tgt_id", (1 + F.col("weight") * 0.8).alias("width"), F.when(inhibits, "inh").otherwise("exc").alias("arrow"), color.alias("color")))


@_query("SELECT id, t_ms, CAST(floor(k / greatest(n - 1, 1) * 118 + 0.5) AS BIGINT) AS y, CASE WHEN excitatory THEN 'exc' ELSE 'inh' END AS color FROM spikes JOIN (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY network_id) AS n FROM population) ON id = neuron_id", "population", "spikes")
def q_raster(spark, sf):
    return display.raster(T.spikes(spark, sf), T.population(spark, sf))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in IZH_PRESETS) + ") p(name, a, b, c, d)")
def q_izh_presets(spark, sf):
    return spark.createDataFrame(IZH_PRESETS, "name string, a double, b double, c double, d double")


@_query("SELECT id, 'N' || id || ' ' || neuron_type || CASE WHEN excitatory THEN ' E' ELSE ' I' END AS tip FROM neurons", "neurons")
def q_tooltip(spark, sf):
    return T.neurons(spark, sf).select("id", F.concat(F.lit("N"), F.col("id").cast("string"), F.lit(" "), "neuron_type", F.when(F.col("excitatory"), " E").otherwise(" I")).alias("tip"))


@_query("SELECT vec_id, CAST(count_if(genome[i] NOT BETWEEN lo AND hi) AS BIGINT) AS n_outside FROM genomes, bounds GROUP BY 1", "genomes", "bounds")
def q_param_domain_check(spark, sf):
    outside = F.filter("genome", lambda x, i: ~x.between(evolution.low(i), evolution.high(i)))
    return T.genomes(spark, sf).select("vec_id", F.size(outside).cast("long").alias("n_outside"))


from . import details, runs  # noqa: E402,F401  they register their queries beside these

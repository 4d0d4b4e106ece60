"""Queries of whole state frames, neuron details with their histories, configurations, forms and tips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.presets import CONFIG, DEFAULTS, HISTORY, LAYER_SIZES, SLIDERS
from ..operators import activity, display, graph
from ..sources import tables as T
from .queries import _PLACED, _RUN_SQL, _VIEWS, _cells, _query, _run, _six, _state, _u, _wires

_VIEWS["lit"] = f"SELECT w.*, EXISTS (SELECT 1 FROM spikes s WHERE s.neuron_id = w.src_id AND s.t_ms >= {_RUN_SQL} - 2 - (SELECT max(delay_ms) FROM wires) AND greatest(floor(t_ms) + 1, ceil(t_ms + w.delay_ms)) = {_RUN_SQL}) AS active FROM wires w"


def _lit(spark, sf):
    return display.active_edges(_wires(spark, sf), T.spikes(spark, sf), _run(spark, sf))


@_query("SELECT src_id, tgt_id, active FROM lit", "spikes", "wires", "lit")
def q_synapse_active(spark, sf):
    return _lit(spark, sf).select("src_id", "tgt_id", "active")


def _unpivot(part: str, id: str, other: str, fields: dict[str, tuple[str, bool]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, CAST({id} AS BIGINT) AS id, CAST({other} AS BIGINT) AS other, '{f}' AS field, {'NULL' if text else f'round(CAST({x} AS DOUBLE), 6) + 0.0'} AS value, {x if text else 'NULL'} AS text FROM {source}" for f, (x, text) in fields.items())


_NEURON = {"v": ("round(v_rest, 2)", False), "firing": ("coalesce(l.t = (SELECT max(t_ms) FROM spikes), FALSE)", False), "spikes": ("coalesce(l.k, 0)", False), "i_ext": ("0", False), "type": ("neuron_type", True), "exc": ("excitatory", False), "x": ("x", False), "y": ("y", False)}
_STATS = {k: (k, False) for k in ("n_neurons", "n_synapses", "exc_count", "inh_count", "mean_v", "total_spikes", "synchrony", "sim_time_ms")}


@_query(f"""{_PLACED}, l AS (SELECT neuron_id, count(*) AS k, max(t_ms) AS t FROM spikes GROUP BY 1), ce AS (SELECT c.*, x, y FROM cells c JOIN p ON p.id = c.id),
  st AS (SELECT network_id, count(*) AS n_neurons, coalesce(max(e), 0) AS n_synapses, count_if(excitatory) AS exc_count, count_if(NOT excitatory) AS inh_count, avg(v_rest) AS mean_v, sum(coalesce(k, 0)) AS total_spikes,
    round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE 1.0 - least(1.0, stddev_pop(round(r, 2)) / (avg(round(r, 2)) + 1e-6)) END, 3) AS synchrony, {_RUN_SQL} AS sim_time_ms
    FROM (SELECT c.*, k, coalesce(k, 0) / greatest({_RUN_SQL}, 1.0) * 1000 AS r FROM cells c LEFT JOIN l ON neuron_id = id) LEFT JOIN (SELECT network_id AS g, count(*) AS e FROM synapses JOIN neurons ON id = src_id GROUP BY 1) ON g = network_id GROUP BY 1)
  {_unpivot('neuron', 'id', 'NULL', _NEURON, 'ce LEFT JOIN l ON neuron_id = id')} UNION ALL {_unpivot('synapse', 'src_id', 'tgt_id', {'w': ('round(weight, 3)', False), 'active': ('active', False)}, 'lit')}
  UNION ALL {_unpivot('spike', 'neuron_id', 'NULL', {'t': ('round(t_ms, 2)', False)}, 'spikes')} UNION ALL {_unpivot('stats', 'network_id', 'NULL', _STATS, 'st')}
  UNION ALL {_unpivot('rate', 'id', 'network_id', {'rate': (f'round(coalesce(k, 0) / greatest({_RUN_SQL}, 1.0) * 1000, 2)', False)}, 'ce LEFT JOIN l ON neuron_id = id')}""", "spikes", "wires", "lit", "cells")  # fmt: skip
def q_state_rows(spark, sf):
    state, spikes, edges = _state(spark, sf), T.spikes(spark, sf), T.synapses(spark, sf)
    stats = activity.network_stats(state.select("id", "network_id", "excitatory", "v"), spikes, edges, _run(spark, sf))
    # The mean potential has six places here, where the rounding of its ties can't tell engines apart.
    stats = stats.drop("mean_v").join(state.groupBy("network_id").agg(F.avg("v").alias("mean_v")), "network_id")
    rates = activity.rates(state.select("id", "network_id"), spikes, _run(spark, sf))
    parts = [
        display.field_rows(state.withColumn("v", F.round("v", 2)), "neuron", "id", None, list(_NEURON)),
        display.field_rows(_lit(spark, sf).withColumn("w", F.round("weight", 3)), "synapse", "src_id", "tgt_id", ["w", "active"]),
        display.field_rows(spikes.withColumn("t", F.round("t_ms", 2)), "spike", "neuron_id", None, ["t"]),
        display.field_rows(stats, "stats", "network_id", None, list(_STATS)),
        display.field_rows(rates.withColumn("rate", F.round("rate", 2)), "rate", "id", "network_id", ["rate"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.round("value", 6) + 0.0)


@_query(f"""SELECT id, neuron_type, model, CAST(slot AS INT) AS slot, coalesce(s.v, v_rest) AS v FROM cells CROSS JOIN unnest(range({HISTORY})) u(slot)
  LEFT JOIN (SELECT user_id, value AS v, {HISTORY} - row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 10 = 0) s ON s.user_id = id AND s.k = slot""", "cells")  # fmt: skip
def q_neuron_history(spark, sf):
    cells = _cells(spark, sf)
    samples = T.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("step"), F.col("value").alias("v")).filter("step % 10 = 0")
    return display.ordered_history(cells, samples, HISTORY).join(cells.select("id", "neuron_type", "model"), "id").select("id", "neuron_type", "model", "slot", "v")


@_query(f"SELECT id, v_rest AS v, izh_b * v_rest AS u, FALSE AS firing, 0::BIGINT AS spike_count, -1e9::DOUBLE AS last_spike_t, 0.0::DOUBLE AS i_syn, {HISTORY} AS n_history, v_rest AS oldest, v_rest AS newest FROM cells", "cells")
def q_reset_history(spark, sf):
    rest = F.col("v_rest")
    full = _cells(spark, sf).withColumn("history", F.array_repeat(rest, HISTORY))
    return full.select("id", rest.alias("v"), (F.col("izh_b") * rest).alias("u"), F.lit(False).alias("firing"), F.lit(0).cast("long").alias("spike_count"), F.lit(-1e9).alias("last_spike_t"), F.lit(0.0).alias("i_syn"), F.size("history").alias("n_history"), F.element_at("history", 1).alias("oldest"), F.element_at("history", -1).alias("newest"))


@_query(f"""{_PLACED} SELECT n.id, network_id, neuron_type, round(x, 6) AS x, round(y, 6) AS y FROM neurons n JOIN p ON p.id = n.id UNION ALL SELECT max(id) + 1, NULL, 'granule', 400.0, 300.0 FROM neurons""", "neurons")
def q_add_neuron_placed(spark, sf):
    placed = graph.circle(T.neurons(spark, sf)).select("id", "network_id", "neuron_type", "x", "y")
    return _six(graph.add_node(placed, neuron_type="granule"))


# --- configurations -------------------------------------------------------------------------------

#: What a client sends for a network, field by field: its value and the parts for which it is missing.
_SENT = {"n_neurons": ("p_size * 3 - 10", 2), "connect_prob": ("p_retailprice / 2000", 3), "sw_beta": ("p_retailprice / 1500 - 0.2", 5), "max_distance": ("p_size / 4.0", 7), "sw_k": ("p_size - 5", 4), "topology": ("p_brand", 3)}
_CONFIG_SQL = {k: (f"CASE WHEN p_partkey % {_SENT[k][1]} = 0 THEN NULL ELSE {_SENT[k][0]} END" if k in _SENT else "NULL") for k in CONFIG}
_VIEWS["configs"] = "SELECT p_partkey AS config_id, " + ", ".join(f"coalesce(CAST({x} AS {'INT' if CONFIG[k][0] == 'int' else 'DOUBLE' if CONFIG[k][0] == 'double' else 'VARCHAR'}), {CONFIG[k][1]!r}) AS {k}" for k, x in _CONFIG_SQL.items()) + f", {'+'.join(map(str, LAYER_SIZES))} AS layered_neurons FROM part"


def _configs(spark, sf):
    """Configurations read from dictionaries as JSON texts: unknown fields are passed over, missing ones have their defaults."""
    sent = F.to_json(F.struct(*[F.when(F.col("p_partkey") % every != 0, F.expr(x).cast(CONFIG[k][0])).alias(k) for k, (x, every) in _SENT.items()], F.lit(1).alias("unknown")))
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in CONFIG.items())
    read = T.table(spark, sf, "part").select(F.col("p_partkey").alias("config_id"), F.from_json(sent, f"{kinds}, layer_sizes array<int>").alias("c"))
    layers = F.coalesce("c.layer_sizes", F.array(*map(F.lit, LAYER_SIZES)))
    return read.select("config_id", *[F.coalesce(f"c.{k}", F.lit(x)).alias(k) for k, (_, x) in CONFIG.items()], F.aggregate(layers, F.lit(0), lambda a, n: a + n).alias("layered_neurons"))


@_query("SELECT config_id, " + ", ".join(f"round({k}, 6) AS {k}" if t == "double" else k for k, (t, _) in CONFIG.items()) + ", layered_neurons FROM configs", "configs")
def q_config_from_dict(spark, sf):
    return _six(_configs(spark, sf))


@_query(" UNION ALL ".join(f"SELECT config_id, '{k}' AS field, round({k}, 6)::DOUBLE AS given, round(least({hi}, {lo} + floor(round((greatest({lo}, least({hi}, CAST({k} AS DOUBLE))) - {lo}) / {step}, 6) + 0.5) * {step}), 6)::DOUBLE AS shown, ({k} BETWEEN {lo} AND {hi}) AS inside FROM configs" for k, lo, hi, step in SLIDERS), "configs")
def q_slider_domains(spark, sf):
    one = lambda k, lo, hi, step: F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("given"), display.snapped(F.col(k).cast("double"), lo, hi, step).alias("shown"), F.col(k).between(lo, hi).alias("inside"))
    return _six(_configs(spark, sf).select("config_id", F.explode(F.array(*[one(*s) for s in SLIDERS])).alias("s")).select("config_id", "s.*"))


@_query("SELECT 'neuron' AS part, id, NULL::BIGINT AS other, 'V = ' || printf('%.1f', v_rest) || ' mV, i_ext: ' || printf('%.1f', 0.0) AS tip FROM cells UNION ALL SELECT 'synapse', src_id, tgt_id, printf('%.3f', round(weight, 3)) || ' / ' || printf('%.2f', round(w.distance, 2)) || ' mm / ' || printf('%.1f', round(attenuation * 100, 1)) || '%' FROM wires w", "cells", "wires")
def q_tip_values(spark, sf):
    none = F.lit(None).cast("long")
    neurons = _cells(spark, sf).select(F.lit("neuron").alias("part"), "id", none.alias("other"), F.format_string("V = %.1f mV, i_ext: %.1f", "v_rest", F.lit(DEFAULTS["i_ext"])).alias("tip"))
    synapses = _wires(spark, sf).select(F.lit("synapse").alias("part"), F.col("src_id").alias("id"), F.col("tgt_id").alias("other"), F.format_string("%.3f / %.2f mm / %.1f%%", F.round("weight", 3), F.round("distance", 2), F.round(F.col("attenuation") * 100, 1)).alias("tip"))
    return neurons.unionByName(synapses)


# --- random edges by skips ------------------------------------------------------------------------

_P = 0.22


@_query(f"""b AS (SELECT id, network_id, row_number() OVER (PARTITION BY network_id ORDER BY id) - 1 AS rank, count(*) OVER (PARTITION BY network_id) AS size FROM neurons),
  s(network_id, id, own, block, width, k, pos) AS (SELECT network_id, id, rank, block, least(291, size - 1 - block * 291), 0, -1::BIGINT FROM b, unnest(range(0, CAST(ceil((size - 1) / 291.0) AS BIGINT))) u(block)
  UNION ALL SELECT network_id, id, own, block, width, k + 1, CAST(pos + floor(ln(1.0 - {_u('skip', 'id', 'block', 'k + 1')}) / ln(1.0 - {_P})) + 1 AS BIGINT) FROM s WHERE pos < width),
  h AS (SELECT network_id, id, block * 291 + pos + CASE WHEN block * 291 + pos >= own THEN 1 ELSE 0 END AS rank FROM s WHERE pos BETWEEN 0 AND width - 1)
  SELECT h.network_id, h.id AS src_id, b.id AS tgt_id FROM h JOIN b ON b.network_id = h.network_id AND b.rank = h.rank""".replace("b AS", "#b AS", 1), "neurons", recursive=True)  # fmt: skip
def q_topology_skips(spark, sf):
    return graph.random_edges_by_skips(T.neurons(spark, sf), _P)

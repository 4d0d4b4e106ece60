"""Work that small tables give is dealt over tasks, and products are not shuffled again."""

import re

from pyspark.sql import functions as F

from axonframe.functions.rng import below, uniform
from axonframe.operators import dynamics, graph
from axonframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_skips_join_blocks_and_not_edges(spark):
    nodes = spark.range(900).select("id", (F.col("id") % 2).alias("network_id"))
    got = graph.random_edges_by_skips(nodes, 0.3)
    plan = _plan(got)
    assert "hashpartitioning(network_id, block, 256)" in plan and "ShuffledHashJoin [network_id, block]" in plan and "hashpartitioning(network_id, rank" not in plan


def test_random_edges_are_dealt_in_tiles_and_drawn_as_before(spark):
    nodes = spark.range(60).select("id", (F.col("id") % 3).alias("network_id"))
    got = graph.random_edges(nodes, 0.22)
    assert "hashpartitioning(network_id, i, j, 256)" in _plan(got)
    a, b = nodes.select("network_id", F.col("id").alias("src_id")), nodes.select("network_id", F.col("id").alias("tgt_id"))
    want = a.join(b, "network_id").filter((F.col("src_id") != F.col("tgt_id")) & (uniform("er", "src_id", "tgt_id") < 0.22)).collect()
    assert sorted(got.collect()) == sorted(want)
    rows = spark.range(3000).select(F.concat_ws("|", F.lit("x"), "id").alias("text"), uniform("x", "id").alias("u"))
    for p in (-1.0, 0.0, 1e-12, 0.22, 0.5, 1.0, 2.0):
        assert rows.filter(below(p, F.col("text")) != (F.col("u") < p)).count() == 0


def test_pulses_place_edges_before_spikes_meet_them(spark):
    plan = _plan(Q.q_pulse_fanout(spark, SF))
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[(\w+)\]", plan)
    assert joins[0] == "src_id" and "round(tx" not in plan


def test_delivery_rounds_strength_by_wire(spark):
    plan = _plan(Q.q_spike_delivery(spark, SF))
    assert "round(t_ms," not in plan and "round(strength," not in plan


def test_folds_are_dealt_over_tasks(spark):
    assert dynamics._fold(spark.range(100).coalesce(1), 3, {"v": F.lit(0.0)}, lambda s, k: {"v": s["v"] + 1.0}, "id").rdd.getNumPartitions() == 64
    assert "RoundRobinPartitioning(64)" in _plan(Q.q_hh_trajectory(spark, SF))


def test_synapses_that_no_command_names_meet_no_scan(spark):
    from axonframe.operators import editlog

    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25), (2, 0, 0.75), (7, 0, 1.0)], "src_id long, tgt_id long, weight double")
    log = spark.createDataFrame([(0, "update_synapse", 0, 0, 1, 2.0), (3, "remove_neuron", 2, 0, 0, 0.0)], "seq long, op string, id long, src_id long, tgt_id long, weight double")
    got = editlog.synapse_versions(nodes, edges, log)
    assert "isnull(named)" in _plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == [(0, 1, -1, 0.5, -1, 0), (0, 1, -1, 2.0, 0, None), (1, 2, -1, 0.25, -1, 3), (2, 0, -1, 0.75, -1, 3)]


def test_skips_are_drawn_for_many_rows_at_once(spark):
    import pyarrow as pa

    from axonframe.functions.rng import Draws

    assert "MapInArrow" in _plan(graph.random_edges_by_skips(spark.range(9).select("id", (F.col("id") % 2).alias("network_id")), 0.3))
    for seed in ("skip", "long " * 12):
        rows = spark.range(300).select(F.concat_ws("|", F.lit(seed), "id").alias("head"), *[uniform(seed, "id", F.lit(k)).alias(f"u{k}") for k in (1, 99, 1000)]).toArrow()
        draws = Draws(rows["head"].combine_chunks().slice(5))
        for k in (1, 99, 1000):
            assert draws.at(k).tolist() == rows[f"u{k}"].to_pylist()[5:]

"""Ranks by ranges, random edges by skips, histories and sliders, against plain Python; and what the plans must not do."""

import random

import pytest
from pyspark.sql import functions as F

from axonframe.operators import display, evolution, graph, ranks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [64, 3, 1])
def test_rank_in_and_down(spark, ranges):
    draw = random.Random(2)
    rows = [(i, i % 3 if i > 40 else 0, float(draw.choice([0, 0, 0, 1.5, draw.random() * 9]))) for i in draw.sample(range(500), 130)]
    df = spark.createDataFrame(rows, "id long, network_id long, score double").repartition(5)
    groups = {n: [r for r in rows if r[1] == n] for n in {r[1] for r in rows}}
    up = {r[0]: k for g in groups.values() for k, r in enumerate(sorted(g))}
    down = {r[0]: k for g in groups.values() for k, r in enumerate(sorted(g, key=lambda r: (-r[2], -r[0])))}
    assert {r.id: (r.rank, r.size) for r in ranks.rank_in(df, ["network_id"], "id", ranges).collect()} == {i: (k, len(groups[n])) for i, n, _ in rows for k in [up[i]]}
    assert {r.id: (r.rank, r.size) for r in ranks.rank_down(df, ["network_id"], "score", "id", ranges).collect()} == {i: (k, len(groups[n])) for i, n, _ in rows for k in [down[i]]}
    assert ranks.rank_in(df.limit(0), ["network_id"], "id").count() == 0


def test_no_window_sorts_a_whole_network(spark):
    nodes = spark.range(50).select("id", (F.col("id") % 2).alias("network_id"), F.lit(1.0).alias("score"), F.lit(True).alias("excitatory"))
    spikes = nodes.select(F.col("id").alias("neuron_id"), F.lit(1.0).alias("t_ms"))
    for df in (graph.circle(nodes), display.raster(spikes, nodes), evolution.elites(nodes)):
        for line in _plan(df).splitlines():
            if "row_number" in line and "Window" in line:
                assert "range" in line


def test_random_edges_by_skips(spark):
    sizes = {0: 60, 1: 1, 2: 2, 3: 25}
    nodes = spark.createDataFrame([(1000 * n + 3 * i, n) for n, k in sizes.items() for i in range(k)], "id long, network_id long")
    got = graph.random_edges_by_skips(nodes, 0.1).collect()
    pairs = {(r.network_id, r.src_id, r.tgt_id) for r in got}
    assert len(pairs) == len(got) and all(a != b and a // 1000 == b // 1000 == n for n, a, b in pairs)
    hits = [sum(len(graph.random_edges_by_skips(nodes.filter("network_id = 0"), p, f"s{k}").collect()) for k in range(4)) / (4 * 60 * 59) for p in (0.02, 0.5)]
    assert abs(hits[0] - 0.02) < 0.006 and abs(hits[1] - 0.5) < 0.02  # four and more deviations
    places = [0] * 60  # every place is drawn alike, the first and the last ones too
    for k in range(6):
        for r in graph.random_edges_by_skips(nodes.filter("network_id = 0"), 0.3, f"p{k}").collect():
            places[r.tgt_id // 3] += 1
    assert all(60 < n < 155 for n in places), places
    assert graph.random_edges_by_skips(nodes, 1.0).count() == sum(k * (k - 1) for k in sizes.values())
    assert graph.random_edges_by_skips(nodes, 0.0).count() == 0


def test_skips_cross_blocks(spark):
    nodes = spark.range(400).select("id", F.lit(7).alias("network_id"))  # 399 candidates in blocks of 128
    got = graph.random_edges_by_skips(nodes, 0.5)
    assert abs(got.count() / (400 * 399) - 0.5) < 0.01
    late = got.filter("tgt_id >= 384").count() / (16 * 399)
    assert abs(late - 0.5) < 0.04


def test_ordered_history_fills_from_the_newest(spark):
    nodes = spark.createDataFrame([(1, -70.0), (2, -65.0), (3, -60.0)], "id long, v_rest double")
    samples = spark.createDataFrame([(1, k, float(k)) for k in range(9)] + [(2, 4, 1.0), (2, 2, 0.5), (9, 1, 1.0)], "id long, step long, v double").repartition(3)
    got = {}
    for r in display.ordered_history(nodes, samples, 4).orderBy("id", "slot").collect():
        got.setdefault(r.id, []).append(r.v)
    assert got == {1: [5.0, 6.0, 7.0, 8.0], 2: [-65.0, -65.0, 0.5, 1.0], 3: [-60.0] * 4}


def test_a_trace_is_cut_before_the_shuffle(spark):
    from axonframe.operators import activity

    samples = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = _plan(activity.trace_window(samples, "k", "t", 200))
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_sliders_snap(spark):
    rows = spark.createDataFrame([(-5.0, 0.05), (0.074, 0.07), (0.075, 0.08), (0.8, 0.8), (9.0, 0.8)], "x double, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in rows.select("want", display.snapped(F.col("x"), 0.05, 0.8, 0.01).alias("got")).collect())

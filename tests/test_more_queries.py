"""The twins that test_queries leaves out, the stream, and operators held against plain Python."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from axonframe.operators import activity, display, evolution, graph
from axonframe.plans import queries as Q

SF = "/root/testdata/sf0.001"
FIRST = set(sorted(set(Q.ORACLES) - {"q_stream_windows"})[::3])


def _text(v):
    return "null" if v is None or v != v else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(set(Q.ORACLES) - FIRST))
def test_other_twins(spark, db, name):
    got, want = Q.QUERIES[name](spark, SF), db.sql(Q.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(_text(r[c]) for c in columns) for r in got.collect())
    wanted = sorted(tuple(map(_text, r)) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert len(rows) == len(wanted)
    for x, y in zip(rows, wanted):  # a sum in another order may round a tie at four places the other way
        assert x == y or all(a == b or abs(float(a) - float(b)) < 1.01e-4 for a, b in zip(x, y))


def test_anchored_frames_step_by_step(spark):
    dt, every, sent, number, want = 0.3, 20.0, 0, 0, {}
    for k in range(700):  # a frame is sent at the first step that is 20 ms or more after the last one
        if (k - sent) * dt >= every - 1e-9:
            sent, number = k, number + 1
        want[k] = number
    times = spark.range(700).select("id", (F.col("id") * dt).alias("t"))
    got = {r.id: r.frame for r in times.select("id", display.anchored_frame(F.col("t"), dt, every).alias("frame")).collect()}
    assert got == want


def test_plasticity_waits_for_a_spike(spark):
    edges = spark.createDataFrame([(1, 2, 12.0), (2, 1, 0.5)], "src_id long, tgt_id long, weight double")
    spikes = spark.createDataFrame([(1, 5.0), (2, 9.0)], "neuron_id long, t_ms double")
    at = lambda t: {(r.src_id, r.tgt_id): r.weight for r in activity.plasticity(edges, activity.last_spikes(spikes, t), t).collect()}
    assert at(7.0) == {(1, 2): 12.0, (2, 1): 0.5}
    moved = at(9.0)
    assert moved[(1, 2)] == 10.0 and moved[(2, 1)] == pytest.approx(0.5 + 0.01 * 2.718281828 ** (-4 / 20))


def test_every_fitness_has_its_own_value(spark):
    rows = spark.createDataFrame([(1, 12.0, 24, 4.0), (2, 3.0, 6, 4.0)], "id long, rate double, n_spikes long, total_weight double")
    got = rows.agg(*[activity.fitness(n).alias(n) for n in activity.FITNESS]).first().asDict()
    assert got["max_firing_rate"] == 7.5 and got["target_10hz"] == -2.5 and got["target_20hz"] == -12.5
    assert got["efficiency"] == pytest.approx(30 / (4 + 1e-6)) and got["diversity"] == pytest.approx(4.5 / (7.5 + 1e-6))


def test_structural_step_prunes_and_grows(spark):
    counted = spark.createDataFrame([(0, 0, 5), (1, 0, 0), (2, 0, 4), (3, 1, 9)], "id long, network_id long, n_spikes long")
    edges = spark.createDataFrame([(0, 1, 1.0, 1.0, "ampa"), (0, 2, 1.0, 1.0, "ampa"), (2, 0, 0.01, 1.0, "ampa"), (1, 2, 1.0, 1.0, "ampa")], "src_id long, tgt_id long, weight double, distance double, syn_type string")
    nodes, left, report = evolution.structural_step(counted, edges, 1000.0)
    assert {r.id for r in nodes.collect()} == {0, 1, 2, 3} and report.agg(F.sum("pruned_neurons"), F.sum("added_neurons")).first() == (0, 0)
    nodes, left, report = evolution.structural_step(counted, edges, 1e6)
    assert {r.id for r in nodes.collect()} == {0, 2, 3, 4, 5}
    got = {(r.src_id, r.tgt_id) for r in left.collect()}
    assert got == {(0, 2), (0, 4), (2, 4), (3, 5)}
    assert {tuple(r) for r in report.collect()} == {(0, 1, 1, 1), (1, 0, 0, 1)}


def test_build_goes_by_topology(spark):
    ring = graph.build(spark, {"topology": "small_world", "n_neurons": 12, "sw_k": 2, "sw_beta": 0.0}).collect()
    assert {(r.src_id, r.tgt_id) for r in ring} == {(i, (i + s) % 12) for i in range(12) for s in (1, -1)}
    layers = graph.build(spark, {"topology": "layered", "layer_sizes": [2, 3], "connect_prob": 1.0}).collect()
    assert {(r.src_id, r.tgt_id) for r in layers} == {(a, b) for a in (0, 1) for b in (2, 3, 4)}

"""Rows that travel in packs come out as they went in, and only packs are shuffled."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from axonframe.functions import packs
from axonframe.plans import queries as Q
from axonframe.sources import tables as T

SF = "/root/testdata/sf0.001"


def _plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_packs_are_exact():
    ids, ts = np.array([5, -(2**63), 2**63 - 1, 0, 7]), np.array([-0.0, 0.1, -np.inf, 1e300, -3.5])
    got = packs.stretch(pa.py_buffer(packs.squeeze(ids, ts)), ids=(np.int64, 5), ts=(np.float64, 5))
    assert got["ids"].tolist() == ids.tolist() and got["ts"].tobytes() == ts.tobytes()
    rows = pa.table({"a": pa.array([1, None] * 10), "x": pa.array([0.5, None, np.inf, 0.5] * 5), "s": pa.array(["A", "B", None, "A"] * 5), "u": pa.array([k / 7 for k in range(20)])})
    two = pa.array([packs.pack(rows.slice(0, 8)), packs.pack(rows.slice(8))], pa.binary())
    assert packs.unpack(two).equals(rows)


def test_first_lines_by_all_that_orders_them(spark, tmp_path):
    """Lines of a pair that are equal in their first fields, or lack them, are told apart as in SQL."""
    fields = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_suppkey")
    lines = [
        (7, 1, 1, 5.0, 9.0, 0.1, "R", "F", 0), (7, 1, 4, 4.0, 9.0, 0.0, "A", "F", 0), (7, 1, 1, 5.0, 9.0, 0.05, "N", "O", 0), (7, 1, 1, 5.0, 8.0, 0.07, "R", "O", 0),
        (None, 1, 2, 1.0, 1.0, 0.01, "A", "F", 0), (9, 9, 2, 2.0, 1.0, 0.02, "N", "F", 0), (3, 1, 2, 3.0, 1.0, 0.03, "N", "O", 1), (3, 1, 2, 3.0, 1.0, 0.03, "N", "F", 1),
        (1, 1, 3, 3.0, 1.0, 0.03, "N", "O", 0), (1, 1, None, 3.0, 1.0, 0.03, "N", "O", 0), (1, 1, 1, 3.0, 1.0, 0.03, "N", "O", None), (1, 1, -1, 6.0, 1.0, 0.03, "N", "O", 2),
    ]
    pq.write_table(pa.table({f: [line[k] for line in lines] for k, f in enumerate(fields)}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": [0, 1, 2]}), tmp_path / "supplier.parquet")
    sql = Q._VIEWS["synapses"]
    for name in ("lineitem", "supplier"):
        sql = sql.replace(f"FROM {name}", f"FROM '{tmp_path}/{name}.parquet'")
    rounded = lambda rows: sorted((*r[:2], round(r[2], 9), round(r[3], 9), r[4]) for r in rows)
    assert rounded(T.synapses(spark, str(tmp_path)).collect()) == rounded(duckdb.sql(sql).fetchall())


def test_lines_and_trains_travel_in_packs(spark):
    plan = _plan(T.synapses(spark, SF))
    assert "SortAggregate" not in plan and "pack" in plan
    plan = _plan(Q.QUERIES["q_stdp_pairs"](spark, SF))
    tiles = plan[plan.index("hashpartitioning(block") :].split("\n")
    assert "Sort [block" in plan and "ts" not in re.search(r"Sort \[block.*", plan)[0] and any("pack" in x for x in tiles[:4])


@pytest.mark.parametrize("name", ["q_delivery_bins", "q_conductance_arrivals"])
def test_spikes_and_wires_travel_in_packs(spark, name):
    assert "(block, pack, at, n)" in _plan(Q.QUERIES[name](spark, SF))  # what is sorted and read by a block's task


def test_delay_queue_writes_spikes_and_not_arrivals(spark, tmp_path):
    """What timers let go is written once for a block, however many targets it reaches, and meets the wires that the queue began with."""
    from axonframe.streaming import delays

    wires = spark.range(3_000).selectExpr("id % 2 AS src_id", "id AS tgt_id", "CAST(id % 50 AS DOUBLE) AS delay_ms", "1.0D AS strength")
    spikes = spark.createDataFrame([(0, 0.0), (0, 10.5), (1, 10.25), (5, 11.0), (1, 200.0)], "neuron_id long, t_ms double")
    for _ in delays.feed(spark, spikes, f"{tmp_path}/in", 1, closing=True):
        delays.delayed_arrivals(spark, f"{tmp_path}/in", wires, f"{tmp_path}/home")
    got = delays.delayed_arrivals(spark, f"{tmp_path}/in", wires.limit(0), f"{tmp_path}/home")
    assert got.count() == got.select("tgt_id", "step").distinct().count() == 6_000
    written = spark.read.parquet(f"{tmp_path}/home/rows")
    assert "kick" not in written.columns and written.count() <= 2 * 64


@pytest.mark.parametrize("met", [3, 1 << 15])
def test_samples_of_a_sweep_meet_within_their_task(spark, monkeypatch, met):
    """Starts and ends are dealt, moments times frequencies are not: the last exchange has only what starts, ends or was carried."""
    import math
    import random

    from axonframe.operators import timeline

    monkeypatch.setattr(timeline, "_MET", met)
    draw = random.Random(met)
    rows = [(draw.randrange(3), draw.choice(["pulse", "ramp", "sinusoidal", "constant"]), 1.0 + draw.random(), 40.0, float(draw.randrange(1, 6)), float(draw.randrange(200)), 0.5) for _ in range(90)]
    rows += [(None, "pulse", 1.0, 2.0, 1.0, 0.0, 0.5), (1, "pulse", None, 2.0, 1.0, 7.0, 0.5), (1, "pulse", 1.0, 2.0, 1.0, None, 0.5)]
    stimuli = spark.createDataFrame(rows, "neuron_id long, stim_type string, amplitude double, duration_ms double, frequency double, start_t double, draw double")
    swept = timeline.superposition(stimuli, 50.0)
    assert _plan(swept).lstrip().startswith("AdaptiveSparkPlan") and "(neuron_id, freq, t, phase, level, slope, offset, cosine, sine, part), [neuron_id, t, current]" in _plan(swept)
    of = {"pulse": lambda a, d, f, x: a if x <= d else 0.0, "ramp": lambda a, d, f, x: a * x / d if x <= d else 0.0, "sinusoidal": lambda a, d, f, x: a * math.sin(2e-3 * math.pi * f * x), "constant": lambda a, d, f, x: a}
    known = [r for r in rows if r[0] is not None and r[5] is not None]
    at = {(r[0], r[5]) for r in known} | {(r[0], r[5] + r[3]) for r in known if r[1] in ("pulse", "ramp")}
    want = {(n, t): sum(of[k](a, d, f, t - s) for m, k, a, d, f, s, _ in known if m == n and a is not None and s <= t) for n, t in at}
    if met == 3:  # in this process, so that the limit holds
        dealt = spark.createDataFrame(timeline._stimulus_deltas(stimuli).dropna(subset=["neuron_id", "t"]).withColumn("part", F.lit(0)).collect()).coalesce(1).sort("neuron_id").toArrow()
        got = {(r["neuron_id"], r["t"]): r["current"] for b in timeline._swept(iter(dealt.to_batches(2))) for r in b.to_pylist()}
    else:
        got = {(r.neuron_id, r.t): r.current for r in swept.collect()}
    assert got == pytest.approx(want, abs=1e-9)

"""Spikes along edges within blocks of targets, against plain Python, and that their product is not shuffled."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonframe.operators import blocks
from axonframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(seed):
    draw = random.Random(seed)
    spikes = [(draw.randrange(6), draw.choice([draw.random() * 90, float(draw.randrange(90)), 5_000.0 + draw.randrange(40)])) for _ in range(300)]
    wires = [(s, g, draw.choice([0.0, 0.25, 3.0, 17.5]), draw.random()) for s in range(5) for g in range(7) if draw.random() < 0.8]
    return spikes + spikes[:20], wires  # some neurons fire twice at a moment


def _packed(spikes):
    ids, ts = zip(*spikes)
    return pa.RecordBatch.from_pydict({"ids": [list(ids)], "ts": [list(ts)]})


def _bins(spikes, wires):
    want = defaultdict(lambda: [0, 0.0])
    for i, t in spikes:
        for s, g, delay, strength in wires:
            if s == i:
                cell = want[g, max(math.floor(t) + 1, math.ceil(t + delay))]
                cell[0] += 1
                cell[1] += strength
    return {k: (n, round(x, 9)) for k, (n, x) in want.items()}


@pytest.mark.parametrize("n", [1, 5])
def test_binned_arrivals(spark, n):
    spikes, wires = _rows(n)
    odd = [(None, 3.0), (1, None)]
    s, w = spark.createDataFrame(spikes + odd, "neuron_id long, t_ms double"), spark.createDataFrame(wires, "src_id long, tgt_id long, delay_ms double, strength double")
    got = blocks.binned_arrivals(s, w, n).collect()
    assert {(r.tgt_id, r.step): (r.n, round(r.kick, 9)) for r in got} == _bins(spikes, wires) and len(got) == len(_bins(spikes, wires))
    assert blocks.binned_arrivals(s.limit(0), w, n).count() == blocks.binned_arrivals(s, w.limit(0), n).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_bins_by_chunks(monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    spikes, wires = _rows(chunk)
    spikes.sort(key=lambda x: x[1])
    table = pa.Table.from_pylist([dict(zip(("src_id", "tgt_id", "delay_ms", "strength"), w)) for w in wires])
    state, got = blocks._Bins(table), []
    for k in range(0, len(spikes), 50):
        got += state.take(_packed(spikes[k : k + 50]))
    rows = pa.Table.from_batches(got + list(state.end())).to_pylist()
    assert {(r["tgt_id"], r["step"]): (r["n"], round(r["kick"], 9)) for r in rows} == _bins(spikes, wires) and len(rows) == len(_bins(spikes, wires))


def test_delivery_bins_shuffles_no_product(spark):
    assert "hashpartitioning(tgt_id" not in _plan(Q.q_delivery_bins(spark, SF)).replace("hashpartitioning(src_id, tgt_id", "")


@pytest.mark.parametrize("chunk", [3, 1_000_000])
def test_conductances_are_the_direct_sum(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    spikes, edges = _rows(chunk)
    taus = {0: 2.0, 3: 150.0}
    wires = [(s, g, kind, delay, kick, taus[kind]) for s, g, delay, kick in edges for kind in taus if (s + g + kind) % 3]
    arrive = [(g, kind, t + delay, kick, tau) for i, t in spikes for s, g, kind, delay, kick, tau in wires if s == i]
    if chunk == 3:  # in this process, so that the chunk holds
        table = pa.Table.from_pylist([dict(zip(("src_id", "tgt_id", "kind", "delay_ms", "kick", "tau"), w)) for w in wires])
        state = blocks._Conductances(table)
        got = [tuple(r.values()) for b in [*state.take(_packed(sorted(spikes, key=lambda x: x[1]))), *state.end()] for r in b.to_pylist()]
    else:
        s, w = spark.createDataFrame(spikes, "neuron_id long, t_ms double"), spark.createDataFrame(wires, "src_id long, tgt_id long, kind int, delay_ms double, kick double, tau double")
        got = [tuple(r) for r in blocks.conductances(s, w, 4).collect()]
    assert sorted(r[:3] for r in got) == sorted({a[:3] for a in arrive})
    for g, kind, t, value in got:
        ages = [((t - at) / tau, kick) for j, k, at, kick, tau in arrive if (j, k) == (g, kind) and at <= t]
        assert value == pytest.approx(sum(c * x * math.exp(1 - x) for x, c in ages), abs=1e-9)


def test_conductance_arrivals_shuffle_no_product(spark):
    assert "hashpartitioning(tgt_id" not in _plan(Q.QUERIES["q_conductance_arrivals"](spark, SF)).replace("hashpartitioning(src_id, tgt_id", "")


@pytest.mark.parametrize("name", ["q_stdp_pairs", "q_stdp_run"])
def test_stdp_shuffles_no_product(spark, name):
    plan = _plan(Q.QUERIES[name](spark, SF))
    assert "hashpartitioning(block" in plan and "Window" not in plan


def test_as_of_pairs_without_trains(spark):
    from axonframe.operators import timeline

    edges = spark.createDataFrame([(1, 2), (2, 2), (3, None), (9, 1)], "src_id long, tgt_id long")
    spikes = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 7.5), (None, 8.0), (3, None)], "neuron_id long, t_ms double")
    assert [tuple(r) for r in timeline.asof_pairs(edges, spikes).collect()] == [(1, 2, 7.5, False, 2.5)]
    assert timeline.asof_pairs(edges, spikes.limit(0)).count() == 0


def test_stretches_give_each_arrival_once():
    """Arrivals made a stretch of steps at a time, as the delay queue lets them go, are all arrivals, and none comes before its stretch."""
    draw = random.Random(12)
    wires = [(draw.randrange(4), draw.randrange(6), draw.choice([-1.0, 0.0, 0.1, 7.0, 33.3, 120.5, draw.random() * 9]), draw.random()) for _ in range(60)]
    spikes = sorted((draw.choice([draw.randrange(300), draw.random() * 300]), draw.choice([s for s, *_ in wires])) for _ in range(200))
    table = pa.table(dict(zip(("src_id", "tgt_id", "delay_ms", "strength"), map(list, zip(*wires)))))
    ts, ids = np.array([t for t, _ in spikes], float), np.array([i for _, i in spikes])
    block, got, since = blocks.Stretches(table), {}, -np.inf
    for before in (0, 20, 100, 107, 240, 500):
        for part in block.between(ids, ts, np.full(len(ts), since), before):
            for tgt, step, n, kick in zip(*(part.column(c).to_pylist() for c in ("tgt_id", "step", "n", "kick"))):
                assert since <= step < before and (tgt, step) not in got
                got[tgt, step] = (n, round(kick, 9))
        assert block.open(ids, ts, before).tolist() == [any(max(math.floor(t) + 1, math.ceil(t + d)) >= before for s, _, d, _ in wires if s == i) for t, i in spikes]
        since = before
    want = {}
    for t, i in spikes:
        for s, g, d, k in wires:
            if s == i:
                n, kick = want.get(at := (g, max(math.floor(t) + 1, math.ceil(t + d))), (0, 0.0))
                want[at] = (n + 1, kick + k)
    assert got == {k: (n, round(x, 9)) for k, (n, x) in want.items()}


def test_delay_queue_meets_blocks_and_not_targets(spark, tmp_path):
    """A spike is sent once to each block, not over each wire, and its arrivals come back whole: one row for a target's step."""
    from axonframe.streaming import delays

    wires = spark.range(2_000).selectExpr("id % 1 AS src_id", "id AS tgt_id", "CAST(id % 50 AS DOUBLE) AS delay_ms", "1.0D AS strength")
    spikes = spark.createDataFrame([(0, 0.0), (0, 10.0), (0, 200.0)], "neuron_id long, t_ms double")
    for _ in delays.feed(spark, spikes, f"{tmp_path}/in", 2, closing=True):
        delays.delayed_arrivals(spark, f"{tmp_path}/in", wires, f"{tmp_path}/home")
    got = delays.delayed_arrivals(spark, f"{tmp_path}/in", wires, f"{tmp_path}/home")
    assert got.agg(F.sum("n")).first()[0] == 6_000 and got.count() == got.select("tgt_id", "step").distinct().count() == 6_000
    state = spark.read.format("statestore").option("stateVarName", "held").option("batchId", 0).load(f"{tmp_path}/home/offsets")
    assert 0 < state.count() <= blocks.BLOCKS

"""Scans over whole runs, streams with timers and restarts, and the log of edits, against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from axonframe.operators import display, editlog, timeline
from axonframe.streaming import delays


def _spikes(spark, rows):
    return spark.createDataFrame(rows, "neuron_id long, t_ms double")


def _trains(seed, neurons, n, step=0.5, span=400):
    draw = random.Random(seed)
    return sorted({(draw.randrange(neurons), draw.randrange(span) * step) for _ in range(n)})


# --- plasticity -----------------------------------------------------------------------------------


def _run_of_stdp(edges, spikes, up=0.01, down=0.012, tau=20.0):
    """The reference's loop: at each moment with a spike, every edge is moved and clamped."""
    last, weight, change, moved = {}, {e[:2]: e[2] for e in edges}, defaultdict(float), []
    for t in sorted({t for _, t in spikes}):
        fired = {i for i, at in spikes if at == t}
        last |= dict.fromkeys(fired, t)
        for s, g, _ in edges:
            if (s in fired) != (g in fired):
                pre = s in fired
                since = t - last.get(g if pre else s, -1e9)
                delta = up * math.exp(-since / tau) if pre else -down * math.exp(-since / tau)
                weight[s, g] += delta
                change[s, g] += delta
                if since < 1e8:
                    moved.append((s, g, t, pre, round(since, 6)))
            weight[s, g] = max(0.0, min(10.0, weight[s, g]))
    return moved, change, weight


@pytest.mark.parametrize("per_segment", [200_000, 7, 1])
def test_plasticity_of_a_run(spark, per_segment):
    draw = random.Random(3)
    edges = [(s, g, draw.choice([0.005, 0.5, 9.995, 12.0, -1.0])) for s in range(6) for g in range(7) if s != g]
    spikes = _trains(4, 6, 150) + [(0, t * 1.0) for t in range(190) if t % 3]  # neuron 0 is busy, 6 is silent
    moved, change, weight = _run_of_stdp(edges, set(spikes))
    e, s = spark.createDataFrame(edges, "src_id long, tgt_id long, weight double"), _spikes(spark, spikes)
    got = timeline.asof_pairs(e, s, per_segment).collect()
    assert sorted((r.src_id, r.tgt_id, r.t_ms, r.pre, round(r.since_other, 6)) for r in got) == sorted(moved)
    out = {(r.src_id, r.tgt_id): r for r in timeline.plasticity_run(e, s, per_segment=per_segment).collect()}
    assert set(out) == set(weight)
    for k, r in out.items():
        assert r.weight == pytest.approx(weight[k], abs=1e-9) and r.change == pytest.approx(change[k], abs=1e-9)


def test_plasticity_without_spikes(spark):
    e = spark.createDataFrame([(1, 2, 12.0)], "src_id long, tgt_id long, weight double")
    assert [tuple(r) for r in timeline.plasticity_run(e, _spikes(spark, [])).collect()] == [(1, 2, 0, 0.0, 12.0)]
    assert timeline.plasticity_run(e, _spikes(spark, [(9, 1.0)])).first().weight == 10.0


def test_plasticity_makes_no_product(spark):
    e = spark.createDataFrame([(1, 2, 1.0)], "src_id long, tgt_id long, weight double")
    plan = timeline.asof_pairs(e, _spikes(spark, [(1, 1.0), (2, 2.0)]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- stimuli --------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [10_000.0, 13.0])
def test_superposition(spark, width):
    draw = random.Random(1)
    kinds = ["constant", "pulse", "ramp", "sinusoidal", "random", "unknown"]
    rows = [(draw.randrange(4), draw.choice(kinds), draw.choice([0.0, 2.5, -3.0, 7.25]), draw.choice([0.0, 5.0, 40.0]), draw.choice([1.0, 5.0, 30.0]), float(draw.randrange(300)), draw.random()) for _ in range(160)]

    def current(kind, a, d, f, start, u, t):
        rel = t - start
        if rel < 0:
            return 0.0
        if kind in ("pulse", "ramp"):
            return 0.0 if rel > d else a if kind == "pulse" else a * rel / d if d > 0 else 0.0
        return {"constant": a, "sinusoidal": a * math.sin(2 * math.pi * f * rel * 1e-3), "random": a if u < f * 1e-3 else 0.0}.get(kind, 0.0)

    moments = {(n, s) for n, k, a, d, f, s, u in rows} | {(n, s + d) for n, k, a, d, f, s, u in rows if k == "pulse" or k == "ramp" and d > 0}
    want = {(n, t): sum(current(k, a, d, f, s, u, t) for m, k, a, d, f, s, u in rows if m == n) for n, t in moments}
    stimuli = spark.createDataFrame(rows, "neuron_id long, stim_type string, amplitude double, duration_ms double, frequency double, start_t double, draw double")
    got = {(r.neuron_id, r.t): r.current for r in timeline.superposition(stimuli, width).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_superposition_joins_no_moment_with_stimuli(spark):
    one = spark.createDataFrame([(1, "pulse", 1.0, 2.0, 1.0, 0.0, 0.5)] * 50, "neuron_id long, stim_type string, amplitude double, duration_ms double, frequency double, start_t double, draw double")
    got = timeline.superposition(one).collect()
    assert {(r.t, r.current) for r in got} == {(0.0, 50.0), (2.0, 50.0)} and len(got) == 2


def test_superposition_deals_its_rows_over_as_many_tasks_as_they_need(spark, monkeypatch):
    """Tasks follow the samples, moments times frequencies of a neuron, and not a fixed number of partitions."""
    rows = [(n, "sinusoidal", 1.0, 5.0, float(k % 5), float(k), 0.5) for n in range(20) for k in range(30)]
    stimuli = spark.createDataFrame(rows, "neuron_id long, stim_type string, amplitude double, duration_ms double, frequency double, start_t double, draw double")
    whole = {(r.neuron_id, r.t): r.current for r in timeline.superposition(stimuli).collect()}
    monkeypatch.setattr(timeline, "_SWEPT", 500)  # 20 neurons of 30 moments, each with 5 frequencies: 4,200 rows
    assert timeline._sweep_tasks(timeline._stimulus_deltas(stimuli)) == 9
    dealt = timeline.superposition(stimuli)
    assert {(r.neuron_id, r.t): r.current for r in dealt.collect()} == pytest.approx(whole, abs=1e-9) and len(whole) == 600
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 6 and ", 9), REPARTITION_BY_NUM" in plan


# --- conductances ---------------------------------------------------------------------------------


def test_conductance_scan_is_the_direct_sum(spark):
    draw = random.Random(2)
    kinds = {"fast": 2.0, "slow": 150.0}
    rows = [(draw.randrange(3), k, draw.choice([draw.random() * 50, draw.random() * 3_000, 40_000 + draw.random() * 300, 128.0, 0.0]), draw.random() * 3, kinds[k]) for k in kinds for _ in range(250)]
    got = timeline.conductance_scan(spark.createDataFrame(rows, "tgt_id long, syn_type string, t double, kick double, tau double")).collect()
    assert len(got) == len({r[:3] for r in rows})
    for r in got:
        ages = [((r.t - t) / tau, kick) for i, k, t, kick, tau in rows if (i, k) == (r.tgt_id, r.syn_type) and t <= r.t]
        assert r.g == pytest.approx(sum(c * x * math.exp(1 - x) for x, c in ages), abs=1e-9)


# --- running sums and as-of reads -----------------------------------------------------------------


@pytest.mark.parametrize("width", [1e6, 3.0])
def test_running_and_asof(spark, width):
    draw = random.Random(8)
    rows = sorted({(draw.randrange(3), draw.randrange(40)): draw.randrange(9) for _ in range(70)}.items())
    flat = [(k, t, n) for (k, t), n in rows]
    df = spark.createDataFrame(flat, "k long, t long, n long")
    got = {(r.k, r.t): r.n for r in timeline.running(df, ["k"], "t", ["n"], width).collect()}
    assert got == {(k, t): sum(m for j, u, m in flat if j == k and u <= t) for k, t, _ in flat}
    events = [(draw.randrange(4), t, f"e{t}" if t % 5 else None) for t in draw.sample(range(45), 20)]
    ev = spark.createDataFrame(events, "k long, t long, name string")
    for forward in (False, True):
        seen = {(r.k, r.t): r.name for r in timeline.asof(df, ev, "k", "t", ["name"], width, forward).collect()}
        for k, t, _ in flat:
            near = [(u, x) for j, u, x in events if j == k and (u > t if forward else u < t)]
            assert seen[k, t] == ((min if forward else max)(near)[1] if near else None)


# --- edits ----------------------------------------------------------------------------------------


def _replay(neurons, edges, log):
    """The edits by hand, one after the other; yields the graph after each command."""
    alive, synapses = list(neurons), [[s, g, -1, w] for s, g, w in edges]
    yield -1, set(alive), [tuple(x) for x in synapses]
    for seq, op, i, s, g, w in log:
        if op == "add_neuron" and i not in alive:
            alive.append(i)
        elif op == "remove_neuron":
            alive = [x for x in alive if x != i]
            synapses = [x for x in synapses if i not in x[:2]]
        elif op == "add_synapse" and s in alive and g in alive:
            synapses.append([s, g, seq, w])
        elif op == "remove_synapse":
            synapses = [x for x in synapses if x[:2] != [s, g]]
        elif op == "update_synapse":
            for x in synapses:
                if x[:2] == [s, g]:
                    x[3] = w
                    break
        yield seq, set(alive), [tuple(x) for x in synapses]


@pytest.mark.parametrize("segment", [1_000_000, 11])
def test_edit_log_at_every_command(spark, monkeypatch, segment):
    monkeypatch.setattr(editlog, "SEGMENT", segment)
    draw = random.Random(segment)
    ops = ["add_neuron", "remove_neuron"] + ["add_synapse"] * 5 + ["remove_synapse"] * 2 + ["update_synapse"] * 4
    log = [(2 * k, draw.choice(ops), draw.randrange(6), draw.randrange(5), draw.randrange(5), float(k)) for k in range(220)]
    neurons, edges = [0, 1, 2, 3], [(0, 1, 0.5), (1, 2, 0.25), (2, 2, 0.75)]
    nodes = spark.createDataFrame([(i,) for i in neurons], "id long")
    old = spark.createDataFrame(edges, "src_id long, tgt_id long, weight double")
    commands = spark.createDataFrame(log, "seq long, op string, id long, src_id long, tgt_id long, weight double").repartition(3)
    lives = editlog.neuron_versions(nodes, commands).collect()
    versions = editlog.synapse_versions(nodes, old, commands).collect()
    holds = lambda r, seq: r.valid_from <= seq and (r.valid_to is None or r.valid_to > seq)
    for seq, alive, synapses in _replay(neurons, edges, log):
        assert sorted(r.id for r in lives if holds(r, seq)) == sorted(alive)
        assert sorted((r.src_id, r.tgt_id, r.added, r.weight) for r in versions if holds(r, seq)) == sorted(synapses)
    empty = commands.filter("seq < 0")
    assert editlog.as_of(editlog.synapse_versions(nodes, old, empty), F.lit(5)).count() == 3


# --- frames ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("segment", [1e6, 2.0])
def test_frame_stats_step_by_step(spark, segment):
    spikes = [(i, t) for i, t in _trains(6, 5, 90) if i != 3] + [(99, 5.0)]
    nodes = [(0, 1, True, -60.0), (1, 1, False, -70.0), (2, 1, True, -65.5), (3, 1, True, 0.0), (4, 2, True, -50.0)]
    edges = [(0, 1, 1.0), (4, 0, 1.0), (1, 0, 1.0)]
    got = {(r.network_id, r.frame): r for r in display.frame_stats(spark.createDataFrame(nodes, "id long, network_id long, excitatory boolean, v double"), spark.createDataFrame(edges, "src_id long, tgt_id long, weight double"), _spikes(spark, spikes), segment=segment).collect()}
    home = {i: n for i, n, _, _ in nodes}
    assert set(got) == {(home[i], int(t // 20)) for i, t in spikes if i in home}
    for (network, frame), r in got.items():
        end, own = (frame + 1) * 20.0, [i for i, n in home.items() if n == network]
        counts = [sum(j == i and t < end for j, t in spikes) for i in own]
        rates = [c / end * 1000 for c in counts]
        mean = sum(rates) / len(rates)
        spread = math.sqrt(sum((x - mean) ** 2 for x in rates) / len(rates))
        assert (r.total_spikes, r.frame_spikes) == (sum(counts), sum(j in own and t // 20 == frame for j, t in spikes))
        assert r.firing == len({j for j, t in spikes if j in own and t // 20 == frame})
        assert r.mean_rate == pytest.approx(mean) and r.synchrony == pytest.approx(1.0 if len(own) < 2 else 1 - min(1, spread / (mean + 1e-6)), abs=1e-9)
        assert (r.n_neurons, r.n_synapses) == ((4, 2) if network == 1 else (1, 1))


# --- streams --------------------------------------------------------------------------------------


def _arrivals(spikes, wires):
    want = defaultdict(lambda: [0, 0.0])
    for i, t in spikes:
        for s, g, delay, strength in wires:
            if s == i:
                cell = want[g, max(math.floor(t) + 1, math.ceil(t + delay))]
                cell[0] += 1
                cell[1] += strength
    return {k: (n, round(x, 6)) for k, (n, x) in want.items()}


_WIRES = [(0, 1, 0.2, 1.0), (0, 2, 33.3, 0.5), (1, 2, 7.0, 0.25), (2, 0, 120.5, 2.0), (3, 9, 1.0, 1.0)]


def _wires(spark):
    return spark.createDataFrame(_WIRES, "src_id long, tgt_id long, delay_ms double, strength double")


def _got(df):
    return {(r.tgt_id, r.step): (r.n, round(r.kick, 6)) for r in df.collect()}


def test_delay_queue_holds_spikes_and_restarts(spark, tmp_path):
    spikes, path, home = sorted({(0, 0.0), *_trains(9, 3, 120)}), f"{tmp_path}/in", f"{tmp_path}/home"
    seen = []
    for k in delays.feed(spark, _spikes(spark, spikes), path, 4, closing=True):
        if k == 2:  # killed after its rows were written and before they counted
            with pytest.raises(Exception):
                delays.delayed_arrivals(spark, path, _wires(spark), home, fail_after=1)
        seen.append(_got(delays.delayed_arrivals(spark, path, _wires(spark), home)))
    want = _arrivals(spikes, _WIRES)
    clock = [max(t for _, t in spikes) * (k + 1) / 4 for k in range(4)]
    for now, rows in zip(clock, seen):  # nothing is let go before it arrives, by the clock of the stream
        assert all(step <= now for _, step in rows) and all(rows[k] == want[k] for k in rows)
    assert 0 < len(seen[0]) < len(seen[3]) < len(want)
    assert _got(delays.delayed_arrivals(spark, path, _wires(spark), home)) == want


def test_delay_queue_takes_late_rows_within_the_delay(spark, tmp_path):
    path, home = f"{tmp_path}/in", f"{tmp_path}/home"
    parts = [[(0, 1000.0), (0, 1900.0)], [(0, 1500.0), (1, 2500.0), (0, 100.0)], [(-1, 90_000_000.0)]]
    for rows in parts:
        _spikes(spark, rows).coalesce(1).write.mode("append").parquet(path)
        got = _got(delays.delayed_arrivals(spark, path, _wires(spark), home, late="1 second"))
    kept = [r for rows in parts[:2] for r in rows if r != (0, 100.0)]  # 1.8 s behind: dropped by the watermark
    assert got == _arrivals(kept, _WIRES)


def test_drain_gives_each_spike_once(spark, tmp_path):
    spikes, path, home = _trains(10, 5, 200), f"{tmp_path}/in", f"{tmp_path}/home"
    runs = []
    for k in delays.feed(spark, _spikes(spark, spikes), path, 3):
        if k == 1:
            with pytest.raises(Exception):
                delays.drain(spark, path, home, fail_after=1)
        runs.append([(r.neuron_id, r.t_ms) for r in delays.drain(spark, path, home).collect()])
        assert delays.drain(spark, path, home).count() == 0  # what was read is cleared
    assert sorted(sum(runs, [])) == sorted(spikes) and all(runs)
    kept = spark.read.parquet(f"{home}/rows").select("neuron_id", "t_ms").collect()
    assert sorted(map(tuple, kept)) == sorted(spikes)

"""Membrane and synapse dynamics: a fold over the steps within each row, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kernels
from ..functions.rng import gauss

D = lambda x: F.lit(float(x))


#: Tasks over which the rows of a fold are dealt: a row is small and its fold is long, so the input's partitions are too few.
_TASKS = 64


def _fold(df: DataFrame, steps: int, start: dict[str, Column], step, *keep: str) -> DataFrame:
    """``keep`` and the last state; ``step`` takes the state and the step's number and returns the next one."""
    names = list(start)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(*[c.alias(n) for n, c in start.items()]), lambda s, k: F.struct(*[c.alias(n) for n, c in step(s, k).items()]))
    return df.repartition(_TASKS).select(*keep, state.alias("s")).select(*keep, *[F.col(f"s.{n}").alias(n) for n in names])


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of named values, each evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body).getItem(0)


def izhikevich(df: DataFrame, steps: int, dt: float, *keep: str) -> DataFrame:
    """Quadratic neurons (izh_a, izh_b, izh_c, izh_d, v_rest, v_peak, current): (v, u, spikes) after so many steps."""

    def step(s, k):
        v = s["v"] + (0.04 * s["v"] * s["v"] + 5.0 * s["v"] + 140.0 - s["u"] + F.col("current") * 10.0) * dt
        u = s["u"] + F.col("izh_a") * (F.col("izh_b") * s["v"] - s["u"]) * dt
        fired = v >= F.col("v_peak")
        return {"v": F.when(fired, F.col("izh_c")).otherwise(v), "u": F.when(fired, u + F.col("izh_d")).otherwise(u), "spikes": s["spikes"] + F.when(fired, 1).otherwise(0).cast("long")}

    return _fold(df, steps, {"v": F.col("v_rest"), "u": F.col("izh_b") * F.col("v_rest"), "spikes": F.lit(0).cast("long")}, step, *keep)


def integrate_and_fire(df: DataFrame, steps: int, dt: float, *keep: str) -> DataFrame:
    """Leaky neurons (v_rest, v_reset, v_threshold, v_peak, tau_m, tau_ref, r_m, current): (v, ref, spikes)."""

    def step(s, k):
        v = s["v"] + (-(s["v"] - F.col("v_rest")) + F.col("r_m") * F.col("current")) / F.col("tau_m") * dt
        resting, fired = s["ref"] > 0, v >= F.col("v_threshold")
        return {
            "v": F.when(resting, F.col("v_reset")).when(fired, F.col("v_peak")).otherwise(v),
            "ref": F.when(resting, s["ref"] - dt).when(fired, F.col("tau_ref")).otherwise(s["ref"]),
            "spikes": s["spikes"] + F.when(~resting & fired, 1).otherwise(0).cast("long"),
        }

    return _fold(df, steps, {"v": F.col("v_rest"), "ref": D(0), "spikes": F.lit(0).cast("long")}, step, *keep)


def hodgkin_huxley(df: DataFrame, steps: int, dt: float, *keep: str) -> DataFrame:
    """Conductance neurons (v_rest, v_peak, c_m, g_*, e_*, current): (v, m, h, n, spikes)."""
    unit = lambda x: F.greatest(D(0), F.least(D(1), x))

    def step(s, k):
        v, m, h, n = (s[x] for x in "vmhn")
        r = kernels.hh_rates(v)
        na = F.col("g_na") * m * m * m * h * (v - F.col("e_na"))
        kk = F.col("g_k") * n * n * n * n * (v - F.col("e_k"))
        nv = v + (F.col("current") - na - kk - F.col("g_l") * (v - F.col("e_l"))) / F.col("c_m") * dt
        gate = lambda x, a, b: unit(x + (r[a] * (1.0 - x) - r[b] * x) * dt)
        return {"v": nv, "m": gate(m, "alpha_m", "beta_m"), "h": gate(h, "alpha_h", "beta_h"), "n": gate(n, "alpha_n", "beta_n"), "spikes": s["spikes"] + F.when((v < F.col("v_peak")) & (nv >= F.col("v_peak")), 1).otherwise(0).cast("long")}

    return _fold(df, steps, {"v": F.col("v_rest"), "m": D(0.05), "h": D(0.6), "n": D(0.32), "spikes": F.lit(0).cast("long")}, step, *keep)


def by_model(df: DataFrame, steps: int, dt: float) -> DataFrame:
    """(id, model, v, spikes): each neuron under its own model."""
    out = None
    for name, run in (("hh", hodgkin_huxley), ("lif", integrate_and_fire), ("izh", izhikevich)):
        part = df.filter(F.col("model") == name) if name != "izh" else df.filter(~F.col("model").isin("hh", "lif"))
        done = run(part, steps, dt, "id", "model").select("id", "model", "v", "spikes")
        out = done if out is None else out.unionByName(done)
    return out


def noisy_current(df: DataFrame, steps: int, seed: str = "noise") -> DataFrame:
    """(id, step, current): the current and a normal draw for each step, scaled by noise_level."""
    each = df.select("id", "current", "noise_level", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return each.select("id", "step", (F.col("current") + F.col("noise_level") * gauss(seed, "id", "step")).alias("current"))


def conductance(df: DataFrame, steps: int, dt: float, *keep: str) -> DataFrame:
    """Alpha conductance after one kick at step 1 (tau, g_max, kick): (g, dg, peak); the derivative moves first."""

    def step(s, k):
        dg = s["dg"] + (-2.0 * s["dg"] / F.col("tau") - s["g"] / (F.col("tau") * F.col("tau"))) * dt
        g = F.greatest(D(0), s["g"] + dg * dt)
        return {"g": g, "dg": dg, "peak": F.greatest(s["peak"], g)}

    return _fold(df, steps, {"g": D(0), "dg": F.col("kick") * F.col("g_max") * F.lit(2.718281828459045) / F.col("tau"), "peak": D(0)}, step, *keep)

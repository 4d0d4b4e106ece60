"""Column kernels of neurons, axons, synapses and stimuli."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .presets import STOPS


def _ratio(num: Column, den: Column, fallback: float) -> Column:
    return F.when(F.abs(den) < 1e-7, F.lit(fallback)).otherwise(F.try_divide(num, den))


def hh_rates(v: Column) -> dict[str, Column]:
    """Opening and closing rates of the three gates at potential ``v``."""
    return {
        "alpha_m": _ratio(0.1 * (v + 40.0), 1.0 - F.exp(-(v + 40.0) / 10.0), 1.0), "beta_m": 4.0 * F.exp(-(v + 65.0) / 18.0),
        "alpha_h": 0.07 * F.exp(-(v + 65.0) / 20.0), "beta_h": 1.0 / (1.0 + F.exp(-(v + 35.0) / 10.0)),
        "alpha_n": _ratio(0.01 * (v + 55.0), 1.0 - F.exp(-(v + 55.0) / 10.0), 0.1), "beta_n": 0.125 * F.exp(-(v + 65.0) / 80.0),
    }


def velocity(diameter: Column, myelinated: Column) -> Column:
    """Conduction velocity of an axon."""
    return F.when(myelinated, F.greatest(F.lit(1.0), 6.0 * diameter)).otherwise(F.greatest(F.lit(0.2), 0.57 * F.sqrt(diameter)))


def space_constant(diameter: Column, myelinated: Column) -> Column:
    return F.when(myelinated, 2.0).otherwise(0.5) * F.sqrt(F.greatest(F.lit(0.1), diameter))


def attenuation(distance: Column, length: Column) -> Column:
    return F.when(length <= 0, 0.0).otherwise(F.exp(-F.try_divide(distance, length)))


def delay(distance: Column, speed: Column) -> Column:
    return distance / F.greatest(speed, F.lit(0.001))


def stimulus(kind: Column, amplitude: Column, duration: Column, frequency: Column, rel: Column, draw: Column) -> Column:
    """Current of a stimulus ``rel`` ms after its start; ``draw`` is a uniform number for the random kind."""
    return (
        F.when(rel < 0, 0.0).when(kind == "constant", amplitude).when((kind == "pulse") & (rel <= duration), amplitude)
        .when((kind == "ramp") & (rel <= duration), F.coalesce(F.try_divide(amplitude * rel, duration), F.lit(0.0)))
        .when(kind == "sinusoidal", amplitude * F.sin(F.lit(2 * math.pi) * frequency * rel * 1e-3))
        .when((kind == "random") & (draw < frequency * 1e-3), amplitude).otherwise(0.0)
    )


def voltage_color(v: Column) -> Column:
    """The rgb() text of a potential, linear between the stops."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + 90) / 130.0))
    out = None
    for (t0, *a), (t1, *b) in zip(STOPS, STOPS[1:]):
        part = [F.floor(x + (t - t0) / (t1 - t0) * (y - x) + 0.5).cast("string") for x, y in zip(a, b)]
        text = F.concat(F.lit("rgb("), part[0], F.lit(","), part[1], F.lit(","), part[2], F.lit(")"))
        out = F.when(t <= t1, text) if out is None else out.when(t <= t1, text)
    return out

"""Movement cost of a step as Column expressions: seconds (or joules) by horizontal metres and climb."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the metabolic polynomial, highest power first; its value on the flat is the last one.
HERZOG = (1337.8, 278.19, -517.39, -78.199, 93.419, 19.825, 1.64)
SECONDS_PER_MINUTE, JOULES_PER_KCAL, M2_PER_HA = 60.0, 4184.0, 10_000.0


def _at_least(low: float, x: Column | float) -> Column:
    if not isinstance(x, Column):
        return F.lit(max(float(low), float(x)))
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), x))  # greatest alone skips nulls


def tobler_speed(slope: Column, base_kmh: float = 6.0, factor: float = 3.5, offset: float = 0.05, min_mps: float = 0.05) -> Column:
    """Walking speed in m/s by signed slope (rise over run)."""
    return _at_least(min_mps, F.lit(base_kmh) * F.exp(-factor * F.abs(slope + offset)) / 3.6)


def _tobler(h: Column, dz: Column, **p) -> Column:
    return h / tobler_speed(dz / h, **p)


def _naismith(h: Column, dz: Column, kmh: float = 5.0, ascent_m_per_h: float = 600.0) -> Column:
    return h * (3600.0 / (max(1e-4, kmh) * 1000.0)) + _at_least(0, dz) * (3600.0 / max(1e-4, ascent_m_per_h))


def _pandolf_speed(speed_mps: float) -> float:
    return max(0.05, speed_mps)


def _pandolf_time(h: Column, dz: Column, speed_mps: float = 5 / 3.6, **_) -> Column:
    return h / _pandolf_speed(speed_mps)


def _pandolf_energy(h: Column, dz: Column, body_kg: float = 70.0, load_kg: float = 0.0, terrain: float = 1.0, speed_mps: float = 5 / 3.6) -> Column:
    w, load, eta, v = max(1.0, body_kg), max(0.0, load_kg), max(0.1, terrain), _pandolf_speed(speed_mps)
    standing = 1.5 * w + 2.0 * (w + load) * (load / w) ** 2
    watts = F.lit(standing) + eta * (w + load) * (1.5 * v * v + 0.35 * v * (dz / h * 100.0))
    return _at_least(1.5 * w, watts) * h / v


def _herzog(h: Column, dz: Column, base_kmh: float = 5.0, min_mps: float = 0.05) -> Column:
    s = F.abs(dz) / h
    effort = F.lit(HERZOG[0])
    for c in HERZOG[1:]:
        effort = effort * s + c
    base = max(min_mps, base_kmh / 3.6)
    return h / _at_least(min_mps, base * HERZOG[-1] / _at_least(1e-9, effort))


def _conolly(h: Column, dz: Column, base_kmh: float = 5.0, ref_deg: float = 1.0, min_mps: float = 0.05) -> Column:
    ref = max(1e-9, math.tan(math.radians(max(0.1, ref_deg))))
    return h / max(min_mps, base_kmh / 3.6) * _at_least(1, F.abs(dz) / h / ref)


def _wheeled(h: Column, dz: Column, base_kmh: float = 4.0, critical_deg: float = 12.0, max_deg: float = 45.0, min_mps: float = 0.05, square: Callable[[Column], Column] = lambda x: x * x) -> Column:
    s, top = F.abs(dz) / h, max(1.0, min(89.0, max_deg))
    critical = max(1e-9, math.tan(math.radians(max(1.0, critical_deg))))
    speed = _at_least(min_mps, max(min_mps, base_kmh / 3.6) / (1.0 + square(s / critical)))
    return F.when(F.degrees(F.atan(s)) > top + 1e-9, F.lit(math.inf)).otherwise(h / speed)


TIME = {"tobler": _tobler, "naismith": _naismith, "pandolf": _pandolf_time, "herzog": _herzog, "conolly": _conolly, "wheeled": _wheeled}


def step_cost(model: str, horizontal: Column, climb: Column, mode: str = "time", **params) -> Column:
    """Cost of a step under a model; an unknown model is Naismith's, a step of no length costs nothing.

    ``mode`` is ``time`` (seconds) or ``energy`` (joules, for pandolf; other models have time only).
    """
    cost = _pandolf_energy if model == "pandolf" and mode == "energy" else TIME.get(model, _naismith)
    return F.when(horizontal <= 0, F.lit(0.0)).otherwise(cost(horizontal, climb, **params))


def _levels(limit: float, spans: list[tuple[float, float, float]], most: int) -> list[float]:
    """Multiples in spans (first, step, last) up to the limit."""
    if not (isinstance(limit, (int, float)) and math.isfinite(limit) and limit > 0):
        return []
    out: list[float] = []
    for first, step, last in spans:
        k = 0
        while (v := first + k * step) <= min(last, limit + 1e-6) and (last != math.inf or len(out) < most):
            out.append(v)
            k += 1
    return out


def isochrone_levels(max_minutes: float) -> list[float]:
    """Contour levels in minutes: every 15 to an hour, every 30 to three, then hourly; 60 at most."""
    return _levels(max_minutes, [(15, 15, 60), (90, 30, 180), (240, 60, math.inf)], 60)


def isoenergy_levels(max_kcal: float) -> list[float]:
    """Contour levels in kcal: steps of 50 to 600, 200 to 2000, then 500; 80 at most."""
    return _levels(max_kcal, [(50, 50, 600), (800, 200, 2000), (2500, 500, math.inf)], 80)

"""Scalar expressions: brightness domains, period derivatives, mass transfer, ephemerides."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.25
#: One unit of a period derivative in days per day; per-cycle units need the period.
PDOT_UNITS = {"d/d": 1.0, "s/s": 1.0, "s/yr": 1 / 86400 / YEAR, "ms/yr": 1e-3 / 86400 / YEAR, "d/yr": 1 / YEAR, "d/Myr": 1e-6 / YEAR}


def flux(mag: Column, zeropoint: float = 0.0) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (mag - F.lit(zeropoint)))


def flux_error(mag: Column, error: Column, zeropoint: float = 0.0) -> Column:
    return F.lit(0.4 * math.log(10.0)) * flux(mag, zeropoint) * error


def magnitude(value: Column, zeropoint: float = 0.0) -> Column:
    """Null where the flux is not positive."""
    return F.when(value > 0, -2.5 * F.log10(value) + F.lit(zeropoint))


def magnitude_error(value: Column, error: Column) -> Column:
    return F.when(value > 0, F.lit(2.5 / math.log(10.0)) * error / value)


def convert_pdot(value: Column, unit_from: str, unit_to: str, period: Column | None = None) -> Column:
    """Between d/d, s/s, s/yr, ms/yr, d/yr, d/Myr, d/cycle, s/cycle and 1/yr; the last three need the period in days.

    A period of zero gives NaN where it would divide, and zero where it multiplies.
    """
    for unit in (unit_from, unit_to):
        if unit not in PDOT_UNITS and period is None:
            raise ValueError(f"{unit} needs a period")
    size = PDOT_UNITS | {"d/cycle": 1.0, "s/cycle": 1 / 86400, "1/yr": 1 / YEAR}
    power = {"d/cycle": -1, "s/cycle": -1, "1/yr": 1}  # of the period
    n = power.get(unit_from, 0) - power.get(unit_to, 0)
    out = value * F.lit(size[unit_from]) / F.lit(size[unit_to])
    for _ in range(abs(n)):
        out = out * period if n > 0 else _per(out, period)
    return out


def _per(value: Column, period: Column) -> Column:
    """``value / period``; NaN for a period of zero, as nothing then says what it would be."""
    return F.when(period == 0, F.lit(float("nan"))).otherwise(value / F.nullif(period, F.lit(0.0)))


def mass_loss_rate(pdot: Column, period: Column, total_mass: Column) -> Column:
    """Solar masses per year for an isotropic wind: half the mass times the relative period change a year; NaN for a period of zero."""
    return _per(total_mass / 2 * pdot, period) * YEAR


def pdot_from_mass_loss(rate: Column, period: Column, total_mass: Column) -> Column:
    return 2 * rate * period / total_mass / YEAR


def mass_transfer_rate(pdot: Column, period: Column, donor: Column, accretor: Column) -> Column:
    """Conservative transfer, solar masses per year; null for equal masses."""
    return F.when(donor != accretor, pdot / period * YEAR / (3 * (1 / donor - 1 / accretor)))


def pdot_from_mass_transfer(rate: Column, period: Column, donor: Column, accretor: Column) -> Column:
    return rate * 3 * (1 / donor - 1 / accretor) * period / YEAR


def warp(dt: Column, a: Column, model: str = "constant") -> Column:
    """Time axis on which a drifting period is constant: linear (``log1p``) or exponential (``expm1``) drift."""
    bent = F.log1p(a * dt) / a if model == "constant" else -F.expm1(-a * dt) / a
    return F.when(a == 0, dt).otherwise(bent)


def period_at(dt: Column, period: Column, a: Column, model: str = "constant") -> Column:
    return period * (1 + a * dt) if model == "constant" else period * F.exp(a * dt)


def delay(dt: Column, a: Column, model: str = "constant") -> Column:
    """How late events run against a clock of the reference period: a/2 dt^2 to first order."""
    return dt - warp(dt, a, model)


def pdot_at(dt: Column, period: Column, a: Column, model: str = "constant") -> Column:
    """Rate of the period at dt."""
    return a * period if model == "constant" else a * period * F.exp(a * dt)


def fractional_change(start: Column, end: Column, a: Column, model: str = "constant") -> Column:
    """P(end) / P(start) - 1; null where the period passes through zero."""
    return (1 + a * end) / F.nullif(1 + a * start, F.lit(0.0)) - 1 if model == "constant" else F.expm1(a * (end - start))


def available_models() -> tuple[str, ...]:
    return ("constant", "exponential")


def phase(tau: Column, period: Column) -> Column:
    q = tau / period
    return q - F.floor(q)


def echelle(value: Column, spacing: float, reference: float = 0.0) -> Column:
    """Position within a spacing, from 0."""
    q = (value - F.lit(reference)) / F.lit(spacing)
    return (q - F.floor(q)) * F.lit(spacing)


def buoyancy_radius(mean_spacing: Column, ell: int = 1) -> Column:
    """Seconds, from an asymptotic period spacing in days."""
    return F.lit(math.sqrt(ell * (ell + 1.0)) * 86400.0) * mean_spacing


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def eccentric_anomaly(dt: Column, outer_period: Column | float, eccentricity: Column | float, periastron: Column | float, steps: int = 60) -> Column:
    """Kepler's equation by Newton's steps, each kept within the eccentricity of the mean anomaly, where the root is."""
    e = _column(eccentricity)
    m = 2 * math.pi * (dt - _column(periastron)) / _column(outer_period)
    m = m - 2 * math.pi * F.floor(m / (2 * math.pi))
    step = lambda x: F.least(F.greatest(x - (x - e * F.sin(x) - m) / (1 - e * F.cos(x)), m - e), m + e)
    return F.aggregate(F.array_repeat(F.lit(0), steps), m + e * F.sin(m), lambda x, _: step(x))


def ltte_delay(dt: Column, outer_period: Column | float, amplitude: Column | float, omega: Column | float, eccentricity: Column | float, periastron: Column | float) -> Column:
    """Light-time delay on an eccentric orbit (Irwin 1952), amplitude a sin i / c: two terms of the eccentric anomaly."""
    e, w = _column(eccentricity), _column(omega)
    x = eccentric_anomaly(dt, outer_period, e, periastron)
    return _column(amplitude) * (F.cos(w) * F.sqrt(1 - e * e) * F.sin(x) + F.sin(w) * F.cos(x))


def ltte_slope(dt: Column, outer_period: Column | float, amplitude: Column | float, omega: Column | float, eccentricity: Column | float, periastron: Column | float) -> Column:
    """Rate of ``ltte_delay``."""
    e, w = _column(eccentricity), _column(omega)
    x = eccentric_anomaly(dt, outer_period, e, periastron)
    turn = 2 * math.pi / _column(outer_period) / (1 - e * F.cos(x))
    return _column(amplitude) * (F.cos(w) * F.sqrt(1 - e * e) * F.cos(x) - F.sin(w) * F.sin(x)) * turn


"""NASA Standard Breakup Model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C


def ramp(x: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Linear between (x0, y0) and (x1, y1), constant outside."""
    inside = F.lit(y0) + F.lit(y1 - y0) * (x - F.lit(x0)) / F.lit(x1 - x0)
    return F.when(x <= x0, F.lit(y0)).when(x >= x1, F.lit(y1)).otherwise(inside)


def log_size(size: Column) -> Column:
    """log10 of a size; minus infinity at zero, where Spark's logarithm is null and a ramp is still at its lower end."""
    return F.when(size == 0, F.lit(float("-inf"))).otherwise(F.log10(size))


def specific_energy(projectile_kg: Column, v_rel: Column, target_kg: Column) -> Column:
    """Impact energy per gram of target, J/g."""
    return F.lit(500.0) * projectile_kg * v_rel * v_rel / target_kg


def impact_preview(projectile_kg: Column, v_rel: Column, target_kg: Column) -> Column:
    return specific_energy(projectile_kg, v_rel, F.greatest(target_kg, F.lit(1e-6)))


def mass_or_default(mass_kg: Column) -> Column:
    return F.when(mass_kg > 0, mass_kg).otherwise(F.lit(C.FALLBACK_MASS_KG))


def budgets(catastrophic: Column, target_kg: Column, projectile_kg: Column, v_rel: Column) -> tuple[Column, Column]:
    """Mass that target and projectile contribute to fragments."""
    ejecta = F.greatest(F.lit(0.0), projectile_kg * v_rel * v_rel - projectile_kg)
    return F.when(catastrophic, target_kg).otherwise(ejecta), projectile_kg


def expected_fragments(mass_kg: Column, lc_m: float) -> Column:
    count = F.lit(C.SBM_COEFFICIENT) * F.pow(mass_kg, F.lit(C.SBM_MASS_POWER)) * F.lit(lc_m**-C.SBM_EXPONENT)
    return F.when(mass_kg > 0, count).otherwise(F.lit(0.0))


def size_from_uniform(u: Column, lc_m: float, parent_m: Column) -> Column:
    """Inverse of the truncated power law on [lc, parent size]."""
    tail = F.pow(parent_m / F.lit(lc_m), F.lit(-C.SBM_EXPONENT))
    return F.lit(lc_m) * F.pow(F.lit(1.0) - u * (F.lit(1.0) - tail), F.lit(-1.0 / C.SBM_EXPONENT))


def area_to_mass_log(log_l: Column, size_m: Column, u_bridge: Column, u_mode: Column, z: Column) -> Column:
    """log10(A/m): two normal modes above 11 cm, one below 8 cm, a random choice between."""
    first = u_mode < ramp(log_l, *C.AM_ALPHA)
    mean = F.when(first, ramp(log_l, *C.AM_MU1)).otherwise(ramp(log_l, *C.AM_MU2))
    sigma = F.when(first, ramp(log_l, *C.AM_SIGMA1)).otherwise(ramp(log_l, *C.AM_SIGMA2))
    knee, base, slope = C.AM_SMALL_SIGMA
    small_sigma = F.lit(base) + F.lit(slope) * F.greatest(log_l - F.lit(knee), F.lit(0.0))
    weight = (size_m - F.lit(C.AM_SMALL_TO_M)) / F.lit(0.03)
    large = (size_m >= C.AM_LARGE_FROM_M) | ((size_m > C.AM_SMALL_TO_M) & (u_bridge < weight))
    return F.when(large, mean + sigma * z).otherwise(ramp(log_l, *C.AM_SMALL_MU) + small_sigma * z)


def ejection_speed_ms(chi: Column, z: Column, v_rel: Column) -> Column:
    """Log-normal ejection speed, never above the impact speed."""
    speed = F.pow(F.lit(10.0), F.lit(C.DV_SLOPE) * chi + F.lit(C.DV_OFFSET) + F.lit(C.DV_SIGMA) * z)
    return F.least(speed, v_rel * F.lit(1000.0))


def escapes(r: Column, v2: Column) -> Column:
    """Orbital energy is not negative."""
    return v2 * F.lit(0.5) - F.lit(C.MU_EARTH) / r >= 0

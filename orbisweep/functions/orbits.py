"""Orbital mechanics as column expressions.

Every function here takes a DataFrame and adds columns in stages. One stage reads the
columns of the stage before, so an intermediate value is computed once: Catalyst keeps
projections apart where merging them would repeat work, and all of them share one
whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from .vectors import cols, cross, dot, norm, scale, sub

R = ("x", "y", "z")
V = ("vx", "vy", "vz")


def julian_date(epoch_jd: float | Column, t_s: Column) -> Column:
    epoch = epoch_jd if isinstance(epoch_jd, Column) else F.lit(float(epoch_jd))
    return epoch + t_s / F.lit(C.SECONDS_PER_DAY)


def _series(terms, fn, angles) -> Column:
    total = None
    for coefficient, *multiples in terms:
        arg = None
        for k, angle in zip(multiples, angles):
            if k == 0:
                continue
            part = angle if k == 1 else angle * F.lit(float(k))
            arg = part if arg is None else arg + part
        term = F.lit(coefficient) * fn(arg)
        total = term if total is None else total + term
    return total


def with_moon(df: DataFrame, jd: Column, out=("mx", "my", "mz")) -> DataFrame:
    """Add the geocentric equatorial Moon position (km) at Julian date `jd`."""
    p = f"_{out[0]}_"
    keep = df.columns
    df = df.withColumn(p + "T", (jd - F.lit(2451545.0)) / F.lit(36525.0))
    angle = {
        name: F.pmod(F.lit(c0) + F.lit(c1) * F.col(p + "T"), F.lit(360.0))
        for name, (c0, c1) in C.MOON_ANGLES.items()
    }
    df = df.withColumns(
        {
            p + "lp": angle["lp"],
            **{p + n: angle[n] * F.lit(C.DEG) for n in ("d", "m", "mp", "f")},
        }
    )
    args = cols(p + "d", p + "m", p + "mp", p + "f")
    c0, c1 = C.OBLIQUITY_DEG
    df = df.withColumns(
        {
            p + "lon": (F.col(p + "lp") + _series(C.MOON_LONGITUDE_SIN, F.sin, args)) * F.lit(C.DEG),
            p + "lat": _series(C.MOON_LATITUDE_SIN, F.sin, args) * F.lit(C.DEG),
            p + "r": F.lit(C.MOON_DISTANCE_KM) + _series(C.MOON_DISTANCE_COS, F.cos, args),
            p + "e": (F.lit(c0) + F.lit(c1) * F.col(p + "T")) * F.lit(C.DEG),
        }
    )
    lon, lat, r, e = cols(p + "lon", p + "lat", p + "r", p + "e")
    df = df.withColumns(
        {
            p + "xe": r * F.cos(lat) * F.cos(lon),
            p + "ye": r * F.cos(lat) * F.sin(lon),
            p + "ze": r * F.sin(lat),
        }
    )
    xe, ye, ze = cols(p + "xe", p + "ye", p + "ze")
    return df.select(
        *keep,
        xe.alias(out[0]),
        (ye * F.cos(e) - ze * F.sin(e)).alias(out[1]),
        (ye * F.sin(e) + ze * F.cos(e)).alias(out[2]),
    )


def with_acceleration(df: DataFrame, r=R, moon=("mx", "my", "mz"), out=("ax", "ay", "az")) -> DataFrame:
    """Add point-mass, J2 and lunar (direct minus indirect) acceleration in km/s^2."""
    keep = df.columns
    p = f"_{out[0]}_"
    pos = cols(*r)
    m = cols(*moon)
    df = df.withColumns({p + "r2": dot(pos, pos), p + "m2": dot(m, m)})
    d = sub(m, pos)
    df = df.withColumns({p + "r1": F.sqrt(F.col(p + "r2")), p + "d2": dot(d, d)})
    r2, r1, d2, m2 = cols(p + "r2", p + "r1", p + "d2", p + "m2")
    df = df.withColumns(
        {
            p + "g": F.lit(-C.MU_EARTH) / (r2 * r1),
            p + "k": F.lit(1.5 * C.J2 * C.MU_EARTH * C.R_EARTH * C.R_EARTH) / (r2 * r2 * r1),
            p + "q": F.lit(5.0) * pos[2] * pos[2] / r2,
            p + "cd": F.lit(C.MU_MOON) / (d2 * F.sqrt(d2)),
            p + "cm": F.lit(C.MU_MOON) / (m2 * F.sqrt(m2)),
        }
    )
    g, k, q, cd, cm = cols(p + "g", p + "k", p + "q", p + "cd", p + "cm")
    polar = (1.0, 1.0, 3.0)
    return df.select(
        *keep,
        *[
            (pos[n] * g + k * pos[n] * (q - F.lit(polar[n])) + d[n] * cd - m[n] * cm).alias(out[n])
            for n in range(3)
        ],
    )


def with_elements(df: DataFrame) -> DataFrame:
    """Add osculating a, e, inc_deg, perigee_alt, apogee_alt and period_min."""
    keep = df.columns
    r, v = cols(*R), cols(*V)
    h = cross(r, v)
    df = df.withColumns(
        {"_r": norm(r), "_v2": dot(v, v), **dict(zip(("_hx", "_hy", "_hz"), h))}
    )
    hv = cols("_hx", "_hy", "_hz")
    vh = cross(v, hv)
    df = df.withColumns(
        {
            "_a": F.lit(-C.MU_EARTH) / (F.lit(2.0) * (F.col("_v2") / 2 - F.lit(C.MU_EARTH) / F.col("_r"))),
            "_h": norm(hv),
            **{
                f"_e{n}": vh[n] / F.lit(C.MU_EARTH) - r[n] / F.col("_r")
                for n in range(3)
            },
        }
    )
    df = df.withColumn("_e", norm(cols("_e0", "_e1", "_e2")))
    a, e = cols("_a", "_e")
    return df.select(
        *keep,
        a.alias("a"),
        e.alias("e"),
        F.degrees(F.acos(F.col("_hz") / F.col("_h"))).alias("inc_deg"),
        (a * (F.lit(1.0) - e) - F.lit(C.R_EARTH)).alias("perigee_alt"),
        (a * (F.lit(1.0) + e) - F.lit(C.R_EARTH)).alias("apogee_alt"),
        F.when(a > 0, F.lit(2 * C.PI) * F.sqrt(a * a * a / F.lit(C.MU_EARTH)) / 60)
        .otherwise(F.lit(0.0))
        .alias("period_min"),
    )


def altitude_km() -> Column:
    return norm(cols(*R)) - F.lit(C.R_EARTH)


def inclination_deg() -> Column:
    """Instantaneous inclination; 0 where the angular momentum vanishes."""
    h = cross(cols(*R), cols(*V))
    size = norm(h)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), h[2] / size))
    return F.when(size > 0, F.degrees(F.acos(cosine))).otherwise(F.lit(0.0))


def with_altitude_inclination(df: DataFrame) -> DataFrame:
    return df.withColumns({"alt_km": altitude_km(), "inc_deg": inclination_deg()})


def hermite_position(p0, m0, p1, m1, s: Column):
    """Cubic Hermite value on [0, 1]; `m0` and `m1` are derivatives with respect to s."""
    s2, s3 = s * s, s * s * s
    w = (2 * s3 - 3 * s2 + 1, s3 - 2 * s2 + s, 3 * s2 - 2 * s3, s3 - s2)
    return tuple(a * w[0] + b * w[1] + c * w[2] + d * w[3] for a, b, c, d in zip(p0, m0, p1, m1))


def hermite_derivative(p0, m0, p1, m1, s: Column):
    s2 = s * s
    w = (6 * s2 - 6 * s, 3 * s2 - 4 * s + 1, 6 * s - 6 * s2, 3 * s2 - 2 * s)
    return tuple(a * w[0] + b * w[1] + c * w[2] + d * w[3] for a, b, c, d in zip(p0, m0, p1, m1))


def interpolate_state(before, after, dt: Column, s: Column):
    """State inside a step, from (r, v) triples at both ends."""
    (r0, v0), (r1, v1) = before, after
    m0, m1 = scale(v0, dt), scale(v1, dt)
    velocity = tuple(d / dt for d in hermite_derivative(r0, m0, r1, m1, s))
    return hermite_position(r0, m0, r1, m1, s), velocity


def earth_occluded(camera, radius: float = C.R_EARTH) -> Column:
    """True behind the globe as seen from the unit direction `camera`."""
    pos = cols(*R)
    cam = tuple(F.lit(float(c)) for c in camera)
    along = dot(pos, cam)
    across = norm(tuple(p - along * c for p, c in zip(pos, cam)))
    return (along < 0) & (across < F.lit(radius))

"""From inertial positions to latitude, longitude and height on the WGS84 ellipsoid, as column expressions.

Two inertial frames are known: `teme`, in which element sets give their states (equator of date, mean equinox), and
`gcrs`, the frame of J2000 in which catalogues keep theirs. The second is carried to the date by precession and the four largest terms of
nutation (good to 0.5 arc seconds); polar motion and the difference of UT1 to UTC are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C

FRAMES = ("gcrs", "teme")


def centuries(jd: Column) -> Column:
    return (jd - F.lit(C.J2000_JD)) / F.lit(36525.0)


def sidereal_angle(jd: Column) -> Column:
    """Greenwich mean sidereal time in radians, in [0, 2 pi)."""
    t = centuries(jd)
    c0, c1, c2, c3 = C.SIDEREAL_SECONDS
    seconds = F.lit(c0) + F.lit(c1) * t + F.lit(c2) * t * t + F.lit(c3) * t * t * t
    return F.pmod(seconds, F.lit(86400.0)) * F.lit(2 * C.PI / 86400.0)


def _polynomial(t: Column, terms: tuple[float, ...]) -> Column:
    """Arc seconds (first, second, third power of t) as radians."""
    return (F.lit(terms[0]) * t + F.lit(terms[1]) * t * t + F.lit(terms[2]) * t * t * t) * F.lit(C.DEG / 3600.0)


def _turned(a: str, b: str, angle: Column) -> dict[str, Column]:
    """Coordinates a, b in axes turned by `angle` from a to b."""
    return {a: F.col(a) * F.cos(angle) + F.col(b) * F.sin(angle), b: F.col(b) * F.cos(angle) - F.col(a) * F.sin(angle)}


def with_earth_fixed(df: DataFrame, jd: Column, frame: str = "gcrs", out: tuple[str, str, str] = ("fx", "fy", "fz")) -> DataFrame:
    """Add the position in axes that turn with the Earth; `df` has x, y, z in km."""
    if frame not in FRAMES:
        raise ValueError(f"frame is one of {FRAMES}")
    keep = df.columns
    df = df.withColumns({"_jd": jd, "_x": F.col("x"), "_y": F.col("y"), "_z": F.col("z")})
    df = df.withColumns({"_t": centuries(F.col("_jd")), "_spin": sidereal_angle(F.col("_jd"))})
    if frame == "gcrs":
        t = F.col("_t")
        zeta, theta, last = (_polynomial(t, C.PRECESSION_ARCSEC[n]) for n in ("zeta", "theta", "z"))
        df = df.withColumns({"_zeta": zeta, "_theta": theta, "_last": last})
        df = df.withColumns(_turned("_x", "_y", -F.col("_zeta")))
        df = df.withColumns(_turned("_z", "_x", F.col("_theta")))
        df = df.withColumns(_turned("_x", "_y", -F.col("_last")))
        angles = {f"_n{k}": F.radians(F.lit(c0) + F.lit(c1) * t) for k, (c0, c1) in enumerate(C.NUTATION_ANGLES_DEG)}
        df = df.withColumns(angles)
        arg = lambda m: sum((F.lit(float(c)) * F.col(f"_n{k}") for k, c in enumerate(m) if c), F.lit(0.0))
        psi = sum((F.lit(c) * F.sin(arg(m)) for m, c, _ in C.NUTATION_ARCSEC), F.lit(0.0))
        eps = sum((F.lit(c) * F.cos(arg(m)) for m, _, c in C.NUTATION_ARCSEC), F.lit(0.0))
        c0, c1 = C.OBLIQUITY_DEG
        df = df.withColumns({"_psi": psi * F.lit(C.DEG / 3600.0), "_deps": eps * F.lit(C.DEG / 3600.0), "_eps": F.radians(F.lit(c0) + F.lit(c1) * t)})
        ce, se, psi, deps = F.cos("_eps"), F.sin("_eps"), F.col("_psi"), F.col("_deps")
        x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
        df = df.withColumns({
            "_x": x - (y * ce + z * se) * psi, "_y": y + x * ce * psi - z * deps, "_z": z + x * se * psi + y * deps,
            "_spin": F.col("_spin") + psi * ce,
        })
    df = df.withColumns(_turned("_x", "_y", F.col("_spin")))
    return df.select(*keep, *[F.col(c).alias(o) for c, o in zip(("_x", "_y", "_z"), out, strict=True)])


def with_geodetic(df: DataFrame, jd: Column, frame: str = "gcrs") -> DataFrame:
    """Add lat_deg, lon_deg in (-180, 180] and height_km above the ellipsoid of the position x, y, z (km).

    The inversion is closed: the foot of the perpendicular solves a quartic, taken by radicals without iteration. It holds
    everywhere but within 43 km of the centre, where the point is not unique and all three columns are null.
    """
    keep = df.columns
    a, e2 = C.WGS84_A_KM, C.WGS84_E2
    df = with_earth_fixed(df, jd, frame, ("_fx", "_fy", "_fz"))
    x, y, z = F.col("_fx"), F.col("_fy"), F.col("_fz")
    df = df.withColumns({"_w2": x * x + y * y})
    df = df.withColumns({"_p": F.col("_w2") / F.lit(a * a), "_q": F.lit((1 - e2) / (a * a)) * z * z})
    df = df.withColumn("_r", (F.col("_p") + F.col("_q") - F.lit(e2 * e2)) / 6)
    df = df.withColumn("_r", F.when(F.col("_r") > 0, F.col("_r")))
    df = df.withColumn("_s", F.lit(e2 * e2) * F.col("_p") * F.col("_q") / (F.lit(4.0) * F.col("_r") * F.col("_r") * F.col("_r")))
    df = df.withColumn("_c", F.cbrt(F.lit(1.0) + F.col("_s") + F.sqrt(F.col("_s") * (F.lit(2.0) + F.col("_s")))))
    df = df.withColumn("_u", F.col("_r") * (F.lit(1.0) + F.col("_c") + F.lit(1.0) / F.col("_c")))
    df = df.withColumn("_v", F.sqrt(F.col("_u") * F.col("_u") + F.lit(e2 * e2) * F.col("_q")))
    df = df.withColumn("_m", F.lit(e2) * (F.col("_u") + F.col("_v") - F.col("_q")) / (F.lit(2.0) * F.col("_v")))
    df = df.withColumn("_k", F.sqrt(F.col("_u") + F.col("_v") + F.col("_m") * F.col("_m")) - F.col("_m"))
    df = df.withColumn("_d", F.col("_k") * F.sqrt("_w2") / (F.col("_k") + F.lit(e2)))
    df = df.withColumn("_f", F.sqrt(F.col("_d") * F.col("_d") + z * z))
    lon = F.degrees(F.atan2(y, x))
    return df.select(
        *keep,
        F.degrees(F.lit(2.0) * F.atan2(z, F.col("_d") + F.col("_f"))).alias("lat_deg"),
        F.when(F.col("_r").isNotNull(), F.when(lon <= -180.0, F.lit(180.0)).otherwise(lon)).alias("lon_deg"),
        ((F.col("_k") + F.lit(e2 - 1.0)) / F.col("_k") * F.col("_f")).alias("height_km"),
    )

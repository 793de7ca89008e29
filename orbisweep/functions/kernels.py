"""NumPy forms of the dynamics, applied to Arrow batches inside tasks.

They hold no state and see one batch at a time; Spark decides what a batch is.
"""

from __future__ import annotations

import numpy as np

from .. import constants as C

_J2_FACTOR = 1.5 * C.J2 * C.MU_EARTH * C.R_EARTH * C.R_EARTH


def moon_position(jd):
    """Moon position(s) for a scalar or array Julian date, shape (3, ...)."""
    jd = np.asarray(jd, dtype=float)
    T = (jd - 2451545.0) / 36525.0
    a = {k: np.mod(c0 + c1 * T, 360.0) for k, (c0, c1) in C.MOON_ANGLES.items()}
    args = [np.radians(a[k]) for k in ("d", "m", "mp", "f")]

    def series(terms, fn):
        return sum(c * fn(sum(k * x for k, x in zip(ks, args) if k)) for c, *ks in terms)

    lon = np.radians(a["lp"] + series(C.MOON_LONGITUDE_SIN, np.sin))
    lat = np.radians(series(C.MOON_LATITUDE_SIN, np.sin))
    dist = C.MOON_DISTANCE_KM + series(C.MOON_DISTANCE_COS, np.cos)
    eps = np.radians(C.OBLIQUITY_DEG[0] + C.OBLIQUITY_DEG[1] * T)
    xe = dist * np.cos(lat) * np.cos(lon)
    ye = dist * np.cos(lat) * np.sin(lon)
    ze = dist * np.sin(lat)
    return np.stack([xe, ye * np.cos(eps) - ze * np.sin(eps), ye * np.sin(eps) + ze * np.cos(eps)])


def acceleration(r, moon):
    """Acceleration for positions (3, n); `moon` is (3, 1) or (3, n)."""
    sq = r * r
    r2 = sq[0] + sq[1]
    r2 += sq[2]
    inv2 = 1.0 / r2
    inv3 = inv2 * np.sqrt(inv2)
    k = inv3 * inv2
    k *= _J2_FACTOR
    f = inv2
    f *= sq[2]
    f *= 5.0
    f -= 1.0
    f *= k
    inv3 *= C.MU_EARTH
    f -= inv3
    d = moon - r
    np.multiply(d, d, out=sq)
    d2 = sq[0] + sq[1]
    d2 += sq[2]
    c = np.sqrt(d2)
    c *= d2
    np.divide(C.MU_MOON, c, out=c)
    d *= c
    m2 = moon[0] * moon[0] + moon[1] * moon[1] + moon[2] * moon[2]
    d -= moon * (C.MU_MOON / (m2 * np.sqrt(m2)))
    a = r * f
    k *= 2.0
    k *= r[2]
    a[2] -= k
    a += d
    return a


def rk4_step(r, v, dt, m0, m1, m2):
    """One Runge-Kutta step of states r, v of shape (3, n)."""
    half = 0.5 * dt
    a1 = acceleration(r, m0)
    v2 = v + half * a1
    a2 = acceleration(r + half * v, m1)
    v3 = v + half * a2
    a3 = acceleration(r + half * v2, m1)
    v4 = v + dt * a3
    a4 = acceleration(r + dt * v3, m2)
    v2 += v3
    v2 *= 2.0
    v2 += v
    v2 += v4
    v2 *= dt / 6.0
    v2 += r
    a2 += a3
    a2 *= 2.0
    a2 += a1
    a2 += a4
    a2 *= dt / 6.0
    a2 += v
    return v2, a2


def moon_for_steps(epoch_jd: float, t0, dt: float):
    """Moon at start, middle and end of the steps starting at t0 (scalar or array)."""
    t0 = np.asarray(t0, dtype=float)
    return tuple(
        moon_position(epoch_jd + (t0 + part * dt) / C.SECONDS_PER_DAY) for part in (0.0, 0.5, 1.0)
    )


def hermite(p0, m0, p1, m1, s):
    s2 = s * s
    s3 = s2 * s
    return (
        p0 * (2 * s3 - 3 * s2 + 1) + m0 * (s3 - 2 * s2 + s) + p1 * (3 * s2 - 2 * s3) + m1 * (s3 - s2)
    )


def hermite_rate(p0, m0, p1, m1, s):
    s2 = s * s
    return (
        p0 * (6 * s2 - 6 * s)
        + m0 * (3 * s2 - 4 * s + 1)
        + p1 * (6 * s - 6 * s2)
        + m1 * (3 * s2 - 2 * s)
    )


def golden_minimum(distance2, n: int, iterations: int = C.GOLDEN_ITERATIONS):
    """Golden-section minimum on [0, 1] for n independent functions at once."""
    lo, hi = np.zeros(n), np.ones(n)
    c, d = hi - C.GOLDEN * (hi - lo), lo + C.GOLDEN * (hi - lo)
    fc, fd = distance2(c), distance2(d)
    for _ in range(iterations):
        left = fc < fd
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
        probe = np.where(left, hi - C.GOLDEN * (hi - lo), lo + C.GOLDEN * (hi - lo))
        fp = distance2(probe)
        c, d, fc, fd = (
            np.where(left, probe, d),
            np.where(left, c, probe),
            np.where(left, fp, fd),
            np.where(left, fc, fp),
        )
    return 0.5 * (lo + hi)


#: Curves as nearly straight as this have one minimum, which Newton steps reach in a few rounds; others are searched by golden section.
STRAIGHT, NEWTON_ROUNDS, NEWTON_LAST = 0.05, 6, 1e-11


def curve_minimum(p0, m0, p1, m1):
    """Where on [0, 1] each of n Hermite curves (3, n) is nearest to the origin."""
    c2, c3 = 3.0 * (p1 - p0) - 2.0 * m0 - m1, 2.0 * (p0 - p1) + m0 + m1

    def dot(a, b):
        out = a[0] * b[0]
        out += a[1] * b[1]
        out += a[2] * b[2]
        return out

    # the slope of half the squared distance, as a polynomial of degree five
    d00, d01, d02, d03, d11, d12, d13, d22, d23, d33 = (
        dot(a, b) for a, b in ((p0, p0), (p0, m0), (p0, c2), (p0, c3), (m0, m0), (m0, c2), (m0, c3), (c2, c2), (c2, c3), (c3, c3)))
    slope = (d01, d11 + 2.0 * d02, 3.0 * (d12 + d03), 2.0 * d22 + 4.0 * d13, 5.0 * d23, 3.0 * d33)
    speed, b2, b3 = np.sqrt(d11), np.sqrt(d22), np.sqrt(d33)
    straight = 2.0 * b2 + 3.0 * b3 <= STRAIGHT * speed
    straight &= (np.sqrt(d00) + speed + b2 + b3) * (2.0 * b2 + 6.0 * b3) <= 2.0 * STRAIGHT * d11
    straight &= d11 > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.clip(-slope[0] / d11, 0.0, 1.0)
        last = s
        for _ in range(NEWTON_ROUNDS):
            g, h = slope[5] * s, 5.0 * slope[5] * s
            for k in (4, 3, 2, 1):
                g = (g + slope[k]) * s
                h = h + k * slope[k] if k == 1 else (h + k * slope[k]) * s
            g += slope[0]
            s, last = np.clip(s - g / h, 0.0, 1.0), s
        bent = np.flatnonzero(~(straight & (np.abs(s - last) <= NEWTON_LAST)))
    if len(bent):
        curve = tuple(c[:, bent] for c in (p0, m0, p1, m1))

        def distance2(at):
            p = hermite(*curve, at)
            return (p * p).sum(axis=0)

        s[bent] = golden_minimum(distance2, len(bent))
    return s

"""Geodetic points and element sets."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbisweep import constants as C
from orbisweep.functions import geodesy, sgp4
from orbisweep.sources import elements

# published test sets: r in km and v in km/s after some minutes (Spacetrack Report 3 and its revision of 2006)
PUBLISHED = [
    ("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667",
     0, (7022.46529266, -1400.08296755, 0.03995155), (1.893841015, 6.405893759, 4.534807250)),
    ("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667",
     360, (-7154.03120202, -3783.17682504, -3536.19412294), (4.741887409, -4.151817765, -2.093935425)),
    ("1 88888U          80275.98708465  .00073094  13844-3  66816-4 0    87", "2 88888  72.8435 115.9689 0086731  52.6988 110.5714 16.05824518  1058",
     0, (2328.96975262, -5995.22051338, 1719.97297192), (2.912073281, -0.983417956, -7.090816210)),
]


def test_published_states(spark):
    rows = spark.createDataFrame([(k, a, b, m) for k, (a, b, m, *_) in enumerate(PUBLISHED)], "k int, TLE_LINE1 string, TLE_LINE2 string, m int")
    decoded = elements.decode(rows)
    assert [r["status"] for r in decoded.collect()] == ["ok"] * len(PUBLISHED)
    e = F.col("elements")
    found = elements.with_states(decoded, e["epoch_day"], e["epoch_fraction"] + F.col("m") / 1440.0)
    for r in found.collect():
        _, _, _, position, velocity = PUBLISHED[r["k"]]
        np.testing.assert_allclose([r["x"], r["y"], r["z"]], position, atol=2e-6 if r["m"] else 1e-7)
        np.testing.assert_allclose([r["vx"], r["vy"], r["vz"]], velocity, atol=2e-9)
        assert r["reason"] == "ok"


def test_a_near_circular_orbit_agrees_with_its_mean_motion():
    n = np.array([15.5]) * sgp4.TURN / 1440
    state = lambda t: sgp4.states(n, [1e-5], [0.9], [0.3], [0.0], [0.0], [0.0], [t])
    r, v, why = state(0.0)
    ahead, behind = state(0.01)[0], state(-0.01)[0]
    np.testing.assert_allclose((ahead - behind) / 1.2, v, atol=2e-3)  # the velocity is the rate of the position
    assert why[0] == sgp4.OK


def test_faults_are_named_and_no_row_is_lost(spark):
    one, two = PUBLISHED[0][:2]
    from_body = lambda body: body + str(sum(int(c) if c.isdigit() else c == "-" for c in body) % 10)
    deep = from_body(two[:52] + " 2.00000000" + two[63:68])
    drop = from_body(one[:53] + " 99999+3" + one[61:68])
    lettered = (from_body(one[:2] + "Z9999" + one[7:68]), from_body(two[:2] + "Z9999" + two[7:68]))
    cases = [
        (one, two, "ok", "ok"), (None, two, "missing", "missing"), (one, "  ", "missing", "missing"), (one[:60], two, "length", "length"), (two, one, "line", "line"),
        (one, from_body(two[:2] + "00006" + two[7:68]), "line", "line"), (one[:68] + "4", two, "checksum", "checksum"),
        (one, from_body(two[:8] + " 3x.2682" + two[16:68]), "field", "field"), (one, deep, "ok", "deep"), (drop, two, "ok", "bad elements"), (*lettered, "ok", "ok"),
        (one + "  \r", two + " ", "ok", "ok"), (one[:18] + "é" + one[19:], two, "field", "field"), (one * 500, two, "length", "length"),
    ]
    # `elements`-like names and repeated rows do no harm
    rows = spark.createDataFrame([(k, a, b, "x") for k, (a, b, *_) in enumerate(cases)] + [(0, one, two, "x")], "k int, TLE_LINE1 string, TLE_LINE2 string, number string")
    e = F.col("elements")
    got = elements.with_states(elements.decode(rows), e["epoch_day"], e["epoch_fraction"] + 30.0).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["status"], r["reason"]) == cases[r["k"]][2:], r
        assert (r["x"] is None) == (r["reason"] != "ok")
    assert {r["elements"]["number"] for r in got if r["k"] == 10} == {339999}


def test_numbers_with_letters(spark):
    rows = spark.createDataFrame([("00005",), ("A0000",), ("J2931",), ("W1928",), ("I0000",), ("12 4",), ("",)], "t string")
    got = [r[0] for r in rows.select(elements.catalogue_number(F.col("t"))).collect()]
    assert got == [5, 100000, 182931, 301928, None, None, None]
    values = spark.createDataFrame([("28098-4",), ("-11606-4",), ("00000-0",), ("",), ("1+x",), ("+12345+1",)], "t string")
    assert [r[0] for r in values.select(elements.decimal_point_assumed(F.col("t"))).collect()] == [0.28098e-4, -0.11606e-4, 0.0, 0.0, None, 1.2345]


def forward(lat, lon, h):
    lat, lon = math.radians(lat), math.radians(lon)
    n = C.WGS84_A_KM / math.sqrt(1 - C.WGS84_E2 * math.sin(lat) ** 2)
    return (n + h) * math.cos(lat) * math.cos(lon), (n + h) * math.cos(lat) * math.sin(lon), (n * (1 - C.WGS84_E2) + h) * math.sin(lat)


def test_geodetic_points_invert_the_ellipsoid(spark, monkeypatch):
    monkeypatch.setattr(geodesy, "sidereal_angle", lambda jd: jd * 0)  # axes as they are
    points = [(lat, lon, h) for lat in (-90.0, -89.99999, -45.0, -1e-7, 0.0, 30.0, 89.0, 90.0) for lon in (-179.99999, 0.0, 90.0, 180.0) for h in (-5.0, 0.0, 400.0, 36000.0, 4e5)]
    rows = spark.createDataFrame([(k, *forward(*p)) for k, p in enumerate(points)], "k int, x double, y double, z double")
    for r in geodesy.with_geodetic(rows, F.lit(2451545.0), "teme").collect():
        lat, lon, h = points[r["k"]]
        assert abs(r["lat_deg"] - lat) < 1e-9 and abs(r["height_km"] - h) < 1e-8 * max(1.0, abs(h))
        assert -180 < r["lon_deg"] <= 180
        if abs(lat) < 90:
            assert abs((r["lon_deg"] - lon + 180) % 360 - 180) < 1e-9
    edge = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (-7000.0, -0.0, 0.0), (None, 1.0, 2.0)], "x double, y double, z double")
    got = [tuple(r)[3:] for r in geodesy.with_geodetic(edge, F.lit(2451545.0), "teme").collect()]
    assert got[0] == got[1] == (None, None, None) and got[2][1] == 180.0 and got[3][0] is None


def test_sidereal_time_and_frames(spark):
    one = spark.range(1)
    # 1987 April 10, 0h and 19:21 UT: Meeus, example 12
    got = one.select(geodesy.sidereal_angle(F.lit(2446895.5)), geodesy.sidereal_angle(F.lit(2446896.30625))).collect()[0]
    assert abs(math.degrees(got[0]) / 15 - (13 + 10 / 60 + 46.3668 / 3600)) < 1e-6
    assert abs(math.degrees(got[1]) - 128.7378734) < 1e-5
    far = spark.createDataFrame([(42164.0, 0.0, 0.0)], "x double, y double, z double")
    of = lambda frame: geodesy.with_earth_fixed(far, F.lit(2461252.5), frame).collect()[0]
    a, b = of("gcrs"), of("teme")
    apart = math.degrees(math.acos((a["fx"] * b["fx"] + a["fy"] * b["fy"] + a["fz"] * b["fz"]) / 42164.0**2))
    assert 0.35 < apart < 0.39  # precession of 26.6 years
    assert abs(math.hypot(a["fx"], a["fy"], a["fz"]) - 42164.0) < 1e-3
    with pytest.raises(ValueError):
        geodesy.with_earth_fixed(far, F.lit(0.0), "ecef")


def test_checksums_of_odd_lines_and_of_batches_cut_out_of_others(spark):
    lines = ["", "-9-1", "1" * 80, "é" * 67 + "56", "日本" + "7" * 70, None, " 5 ", "a-" * 40]
    slow = lambda t: None if t is None else sum(int(c) if c in "0123456789" else c == "-" for c in t[:68]) % 10
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, line string").repartition(1)
    got = {r.k: r.sum for r in rows.select("k", elements.checksum(F.col("line")).alias("sum")).collect()}
    assert got == {k: slow(t) for k, t in enumerate(lines)}
    cut = pa.array(lines).slice(2, 4)
    assert elements.checksum.func(cut).to_pylist() == [slow(t) for t in lines[2:6]]


def test_a_line_is_summed_once(spark, tmp_path):
    """Sums are the dear part of decoding: two lines, two sums, however often a plan reads them."""
    rows = spark.createDataFrame([("1 x", "2 y")], "TLE_LINE1 string, TLE_LINE2 string")
    plan = elements.decode(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("checksum(") in (2, 4) and plan.count("replace(") == 0  # each call, and once more as an output

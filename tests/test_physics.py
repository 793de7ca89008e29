"""Closed forms and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisweep import constants as C
from orbisweep.functions import dates, kernels, orbits, sbm, text
from orbisweep.operators import breakup as B, propagate, screen as S

SCHEMA = "idx bigint, x double, y double, z double, vx double, vy double, vz double, alive boolean"


def circular(a):
    return (0, a, 0.0, 0.0, 0.0, math.sqrt(C.MU_EARTH / a), 0.0, True)


def test_moon_matches_published_positions():
    assert kernels.moon_position(C.DEFAULT_EPOCH_JD) == pytest.approx([370594.064393, -117397.232745, -43196.744913], abs=1e-5)
    r = kernels.moon_position(2448724.5)
    assert np.linalg.norm(r) == pytest.approx(368453.794766, abs=1e-5)


def test_column_and_array_moon_agree(spark):
    row = orbits.with_moon(spark.createDataFrame([(2448724.5,)], "jd double"), F.col("jd")).first()
    assert (row.mx, row.my, row.mz) == pytest.approx(tuple(kernels.moon_position(2448724.5)), abs=1e-8)


def test_acceleration_forms_agree(spark):
    far = [1e12, 0.0, 0.0]
    got = kernels.acceleration(np.array([[7000.0], [0.0], [0.0]]), np.array(far)[:, None])
    assert got[0, 0] == pytest.approx(-0.008145670283877672, rel=1e-12)
    rows = spark.createDataFrame([circular(7000.0)], SCHEMA)
    row = orbits.with_acceleration(orbits.with_moon(rows, F.lit(C.DEFAULT_EPOCH_JD))).first()
    want = kernels.acceleration(np.array([[7000.0], [0.0], [0.0]]), kernels.moon_position(C.DEFAULT_EPOCH_JD)[:, None])
    assert (row.ax, row.ay, row.az) == pytest.approx(tuple(want[:, 0]), rel=1e-12)


def test_circular_orbit_elements(spark):
    row = orbits.with_elements(spark.createDataFrame([circular(7000.0)], SCHEMA)).first()
    assert row.a == pytest.approx(7000.0)
    assert row.e == pytest.approx(0.0, abs=1e-12)
    assert row.period_min == pytest.approx(97.14194396343358)


def test_integration_step_size_hardly_matters(spark):
    rows = spark.createDataFrame([circular(7000.0)], SCHEMA)
    a = propagate.advance(rows, C.DEFAULT_EPOCH_JD, 10.0, 0, 360).first()
    b = propagate.advance(rows, C.DEFAULT_EPOCH_JD, 2.0, 0, 1800).first()
    assert math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) < 1e-3


def test_breakup_numbers(spark):
    row = spark.range(1).select(
        sbm.specific_energy(F.lit(560.0), F.lit(11.7), F.lit(950.0)).alias("e"),
        sbm.expected_fragments(F.lit(1510.0), 0.1).alias("n"),
        sbm.expected_fragments(F.lit(2000.0), 0.01).alias("m"),
    ).first()
    assert row.e == pytest.approx(40346.526315789466)
    assert row.n == pytest.approx(1242.3178074581588)
    assert row.m == pytest.approx(78663.36071931891)


def test_pair_filter_outcomes(spark):
    cfg = S.ScreeningConfig()
    case = lambda dr, dv: S.pair_filter([F.lit(c) for c in dr], [F.lit(c) for c in dv], 10.0, cfg)
    row = spark.range(1).select(
        case((10.0, 0.0, 0.0), (-7.0, 0.0, 0.0)).alias("meets"),
        case((1.0, 0.0, 0.0), (7.0, 0.0, 0.0)).alias("leaves"),
        case((1.0, 0.0, 0.0), (0.001, 0.0, 0.0)).alias("together"),
        case((100.0, 0.0, 0.0), (0.0, 7.0, 0.0)).alias("far"),
    ).first()
    assert tuple(row) == ("REFINE", "REJECT", "CO_ORBITING", "REJECT")


def test_dates_and_texts(spark):
    row = spark.range(1).select(
        dates.to_jd(*[F.lit(v) for v in (2026, 8, 1, 10, 0, 0)]).alias("jd"),
        dates.jd_to_utc(F.lit(C.DEFAULT_EPOCH_JD)).alias("utc"),
        dates.jd_to_utc(F.lit(2461254.5 - 0.3 / 86400)).alias("midnight"),
        text.leading_int(F.lit("12abc")).alias("prefix"),
        text.leading_double(F.lit("1.5e3x")).alias("real"),
        text.trim_blanks(F.lit(" \ta b\r\n")).alias("trimmed"),
        text.csv_quote(F.lit('a"b,c')).alias("quoted"),
    ).first()
    assert row.jd == pytest.approx(C.DEFAULT_EPOCH_JD)
    assert row.utc == "2026-08-01 10:00:00 UTC"
    assert row.midnight.endswith("24:00:00 UTC")
    assert (row.prefix, row.real, row.trimmed, row.quoted) == (12, 1500.0, "a b", '"a""b,c"')


@pytest.mark.parametrize("seed", range(5))
def test_greedy_budget_matches_a_plain_loop(seed):
    draw = np.random.default_rng(seed)
    masses = draw.lognormal(0, 2, 400)
    budget, used, want = 150.0, 0.0, []
    for m in masses:
        ok = used + m <= budget
        used += m if ok else 0.0
        want.append(ok)
    assert B.take_within_budget(masses, budget)[0].tolist() == want


def test_a_ramp_holds_its_lower_end_down_to_size_zero(spark):
    sizes = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, None)], "k int, size double")
    rows = sizes.select("k", sbm.ramp(sbm.log_size(F.col("size")), *C.AM_MU1).alias("mu")).orderBy("k").collect()
    assert [r.mu for r in rows] == [C.AM_MU1[1], C.AM_MU1[3], None]


def test_interpolated_moon_paths_are_the_moon_at_few_evaluations(monkeypatch):
    span, jd0 = np.array([5400.0, 43_200.0, 40 * 86_400.0]), C.DEFAULT_EPOCH_JD
    at = np.linspace(0.0, 1.0, 181)
    want = np.stack([kernels.moon_position(jd0 + f * span / C.SECONDS_PER_DAY) for f in at])
    asked = []
    moon = kernels.moon_position
    monkeypatch.setattr(kernels, "moon_position", lambda jd: asked.append(np.size(jd)) or moon(jd))
    got = propagate._moon_paths(jd0, span, 181)
    assert np.abs(got - want).max() < 1e-4  # km; a Julian date has steps of 4e-5 s, in which the Moon moves as far
    assert sum(asked) == 2 * propagate.MOON_POINTS + 181

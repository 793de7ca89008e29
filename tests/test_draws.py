"""Counts, random numbers and mass budgets of breakups against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisweep.functions import debris, rng
from orbisweep.operators import breakup as B


@pytest.mark.parametrize("mean", [0.1, 2.5, 9.99, 10.0, 37.0, 1e3, 1e6])
def test_counts_follow_poisson(spark, mean):
    n = 20_000
    events = spark.range(n).select(F.col("id").alias("event"), F.lit(mean).alias("expected_fragments"))
    counts = np.array([r["drawn"] for r in B.with_count(events, B.BreakupConfig()).collect()])
    assert len(counts) == n and counts.min() >= 0
    assert abs(counts.mean() - mean) < 5 * math.sqrt(mean / n)
    p = lambda k: math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
    spread = math.sqrt(mean)
    edges = sorted({max(0, math.floor(mean + z * spread)) for z in np.linspace(-3, 3, 13)})
    below = np.array([math.fsum(p(k) for k in range(max(0, int(mean - 12 * spread)), e)) for e in edges])
    expected = np.diff(np.concatenate([[0.0], below, [1.0]])) * n
    seen = np.diff(np.concatenate([[0], [(counts < e).sum() for e in edges], [n]]))
    used = expected > 5
    chi2 = ((seen - expected)[used] ** 2 / expected[used]).sum()
    free = used.sum() - 1
    assert chi2 < free + 5 * math.sqrt(2 * max(free, 1)) + 5


def test_counts_of_odd_means_and_limits(spark):
    events = spark.createDataFrame([(1, 0.0), (2, -3.0), (3, None), (4, 1e-12), (5, 50.0)], "event long, expected_fragments double")
    got = {r["event"]: (r["drawn"], r["truncated"]) for r in B.with_count(events, B.BreakupConfig(max_fragments=7)).collect()}
    assert got[1] == got[2] == got[3] == got[4] == (0, 0) and got[5][0] == 7 and got[5][1] > 0
    assert B.with_count(events.limit(0), B.BreakupConfig()).count() == 0


def test_counts_do_not_depend_on_how_many_tries_are_looked_at(spark, monkeypatch):
    events = spark.range(3000).select(F.col("id").alias("event"), (F.lit(10.0) + F.col("id")).alias("expected_fragments"))
    many = {tuple(r) for r in B.with_count(events, B.BreakupConfig()).select("event", "drawn").collect()}
    monkeypatch.setattr(B, "TRIES", 1)  # a round for every number in which some event is rejected
    assert {tuple(r) for r in B.with_count(events, B.BreakupConfig()).select("event", "drawn").collect()} == many


def test_log_factorial(spark):
    k = [0, 1, 2, 5, 9, 10, 100, 10_000, 10_000_000]
    rows = spark.createDataFrame([(float(v),) for v in k], "k double").select("k", rng.log_factorial(F.col("k")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(math.lgamma(r["k"] + 1), rel=1e-13, abs=1e-11)


def test_numbers_are_those_of_the_columns(spark):
    rows = spark.range(1, 200).select(*[rng.uniform(rng.digest(3, F.lit(17), F.col("id"), s), w) for s in (1, 5) for w in (0, 1)]).collect()
    for s, at in ((1, 0), (5, 2)):
        for w, values in enumerate(debris.uniforms(3, 17, range(1, 200), s)):
            assert values.tolist() == [r[at + w] for r in rows]


def loop(rows):
    used, out = {}, set()
    for event, side, k, kg, budget in sorted(rows):
        if used.get((event, side), 0.0) + kg <= budget:
            used[event, side] = used.get((event, side), 0.0) + kg
            out.add((event, side, k))
    return out


@pytest.mark.parametrize("block", [3, 40, 1000])
def test_any_block_size_gives_the_plain_loop(spark, block):
    draw = np.random.default_rng(block)
    rows = []
    for event, n, budget in ((1, 700, 300.0), (2, 900, 1e9), (3, 500, 0.001), (4, 30, 5.0), (5, 800, 50.0)):
        masses = np.round(draw.pareto(1.2, n) * 2, 6) if event != 5 else np.full(n, 0.5)  # equal ones: ties with the budget
        rows += [(event, int(draw.integers(2)), k, float(m), budget) for k, m in enumerate(masses, 1)]
    frame = spark.createDataFrame([(e, s, k, m, b, "x") for e, s, k, m, b in rows], "event long, side int, k long, mass_kg double, budget double, block string")
    got = B.within_budget(frame.repartition(6), block)
    assert got.columns == frame.columns
    assert {(r["event"], r["side"], r["k"]) for r in got.collect()} == loop(rows)
    assert B.within_budget(frame.limit(0), block).count() == 0


def test_large_events_are_settled_in_blocks(spark, monkeypatch):
    """The same fragments whether an event is drawn in one task or in many."""
    parent = {"size_m": 4.0, "x": 7000.0, "y": 0.0, "z": 0.0, "vx": 0.0, "vy": 7.5, "vz": 0.0}
    event = {"event": 9, "t": 1.0, "remaining_s": 2.0, "v_rel_km_s": 10.0, "sbm_mass_kg": 130.0, "t_budget": 100.0, "p_budget": 30.0, "drawn": 5000,
             **{f"{s}_{c}": v for s in "tp" for c, v in parent.items()}}
    events = spark.createDataFrame([event])
    whole = {(r["side"], r["k"], r["mass_kg"]) for r in B.kept_fragments(events, B.BreakupConfig()).collect()}
    monkeypatch.setattr(B, "BLOCK", 300)
    monkeypatch.setattr(B.within_budget, "__defaults__", (300,))
    parts = {(r["side"], r["k"], r["mass_kg"]) for r in B.kept_fragments(events, B.BreakupConfig()).collect()}
    assert whole == parts and 0 < len(whole) < 5000

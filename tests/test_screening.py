"""Screening against comparing everything with everything."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from orbisweep import constants as C
from orbisweep.functions import kernels
from orbisweep.operators import cells, propagate, screen as S
from orbisweep.schemas import STATE

DT = 60.0
CFG = S.ScreeningConfig(threshold_km=150.0)


@pytest.fixture(scope="module")
def small(objects):
    return objects


@pytest.fixture(scope="module")
def brute(small):
    """Linear filter outcome of all pairs of one step, in NumPy."""
    pdf = small.select("idx", *STATE).orderBy("idx").toPandas()
    r, v = pdf[STATE[:3]].to_numpy(), pdf[STATE[3:]].to_numpy()
    idx = pdf["idx"].to_numpy()
    i, j = np.triu_indices(len(idx), 1)
    dr, dv = (r[j] - r[i]).T, (v[j] - v[i]).T
    out = S._linear_outcome(dr, dv, 0, DT, CFG, 1)
    return {(int(idx[a]), int(idx[b])): S.OUTCOMES[o] for a, b, o in zip(i[out > 0], j[out > 0], out[out > 0])}


def found(small, plan):
    states = propagate.step_states(small, C.DEFAULT_EPOCH_JD, DT, 0, 1)
    rows = S.near_pairs(states, DT, CFG, plan, 1).collect()
    assert len(rows) == len({(r.i, r.j) for r in rows})
    return {(r.i, r.j): r.outcome for r in rows}


@pytest.mark.parametrize("slots,width", [(1, 512.0), (1, 64.0), (4, 100.0), (16, 40.0)])
def test_any_grid_finds_exactly_the_near_pairs(small, brute, slots, width):
    assert len(brute) > 5
    assert found(small, S.GridPlan(slots, width, False, False)) == brute


def test_crowded_cells_in_blocks_give_the_same(small, brute, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 3)
    assert found(small, S.GridPlan(1, 2000.0, True, False)) == brute


def test_hash_and_merge_join_agree(small, brute):
    assert found(small, S.GridPlan(2, 300.0, False, False, 1e4)) == brute


def key(rows, digits=3):
    return sorted((r.i, r.j, round(r.t, 2), round(r.miss_km, digits)) for r in rows)


def test_step_length_does_not_change_approaches(small):
    run = lambda dt, steps: S.screen(small, C.DEFAULT_EPOCH_JD, dt, 0, steps, CFG).collect()
    a, b = run(60.0, 2), run(20.0, 6)
    pairs = lambda rows: {(r.i, r.j): r.miss_km for r in rows}
    assert len(a) > 2 and pairs(a).keys() == pairs(b).keys()
    assert all(abs(m - pairs(b)[k]) < 0.2 for k, m in pairs(a).items())


def test_copies_are_expanded_and_counted(spark, small):
    """A third of all rows being copies of one object changes nothing but the multiplicity."""
    rows = S.screen(small, C.DEFAULT_EPOCH_JD, DT, 0, 1, CFG).collect()
    hot = rows[0].i
    copies = small.where(F.col("idx") == hot).withColumn("idx", F.explode(F.sequence(F.lit(10**6), F.lit(10**6 + 699))))
    both = small.unionByName(copies.select(small.columns))
    plan = S.plan_for(both, DT, CFG)
    assert plan.copies
    got = S.screen(both, C.DEFAULT_EPOCH_JD, DT, 0, 1, CFG, plan).collect()
    with_hot = [r for r in rows if hot in (r.i, r.j)]
    assert len(got) == len(rows) + 700 * len(with_hot)
    assert all(r.i < r.j for r in got)
    base = S.screening_counts(small, C.DEFAULT_EPOCH_JD, DT, 0, 1, CFG).first()
    total = S.screening_counts(both, C.DEFAULT_EPOCH_JD, DT, 0, 1, CFG, plan).first()
    assert total.co_orbiting == (base.co_orbiting if base else 0) + 701 * 700 // 2


def test_dead_objects_take_no_part(small):
    rows = S.screen(small.withColumn("alive", F.lit(False)), C.DEFAULT_EPOCH_JD, DT, 0, 1, CFG).collect()
    assert rows == []


def test_candidate_count_matches_pairs_of_touching_cells(small):
    width = 900.0
    celled = cells.with_cell(small, width).select("idx", "cx", "cy", "cz").toPandas()
    c = celled[["cx", "cy", "cz"]].to_numpy()
    i, j = np.triu_indices(len(c), 1)
    want = int((np.abs(c[i] - c[j]).max(axis=1) <= 1).sum())
    got = cells.candidate_pairs(cells.occupancy(small, width)).agg(F.sum("pairs")).first()[0]
    assert got == want


def test_keys_round_trip(spark):
    rows = spark.createDataFrame([(-3, 0, 7), (1000, -1000, -1)], "a bigint, b bigint, c bigint")
    out = rows.withColumn("k", cells.pack(F.col("a"), F.col("b"), F.col("c"))).select(
        "a", "b", "c", *[u.alias(n) for u, n in zip(cells.unpack(F.col("k")), "xyz")]
    ).collect()
    assert all((r.a, r.b, r.c) == (r.x, r.y, r.z) for r in out)


def test_golden_section_finds_the_minimum():
    s = kernels.golden_minimum(lambda u: (u - np.array([0.25, 0.8])) ** 2, 2)
    assert s == pytest.approx([0.25, 0.8], abs=1e-7)


@pytest.mark.parametrize("times", [1, 60, 3600])
def test_rows_shuffled_for_an_object_do_not_grow_with_the_catalogue(small, times):
    """The plan for a catalogue of many times the objects still sends each object to a few regions."""
    cfg = S.ScreeningConfig(threshold_km=25.0)
    n = 150_000 * times
    level = lambda w: Row(objects=float(n), squares=n + n * n * (w / 10_000.0) ** 3, busiest=1.0 + n * (w / 10_000.0) ** 3, copies=1)
    plan = S.plan_grid({w: level(w) for w in S.PROBE_LEVELS_KM}, DT, cfg)
    rows, _ = S.region_rows(propagate.step_states(small, C.DEFAULT_EPOCH_JD, DT, 0, 1), DT, cfg, plan)
    assert rows.count() <= 8 * small.count()


def test_regions_of_any_width_find_exactly_the_near_pairs(small, brute, monkeypatch):
    for held, width in ((2, 100.0), (32_768, 250.0), (50, 5000.0)):
        monkeypatch.setattr(S, "HELD_ROWS", held)
        monkeypatch.setattr(S, "PAIR_ROWS", held)
        assert found(small, S.GridPlan(4, 50.0, False, False, width)) == brute


def test_sizes_that_travel_give_the_collisions_of_sizes_looked_up(small):
    cfg = S.ScreeningConfig(threshold_km=150.0, radius_scale=50_000.0)
    sizes = F.when(F.col("idx") % 5 != 0, F.col("size_m") * (F.col("idx") % 7))
    some = small.withColumn("size_m", sizes)
    got = S.screen(some, C.DEFAULT_EPOCH_JD, DT, 0, 2, cfg)
    want = S.with_collisions(got.drop("collision"), some, cfg)
    key = lambda r: (r[:3], str(r[3]))
    assert sorted(map(key, rows_of(got))) == sorted(map(key, rows_of(want)))
    assert {r[3] for r in rows_of(got)} == {True, False, None}


def rows_of(df):
    return [(r.step, r.i, r.j, r.collision) for r in df.collect()]


def _cloud_states(spark, rng, events=3, rows=300):
    """Clouds of two parents each 20 s after their breakup, a few rows off their paths, with some other objects among them."""
    out, idx = [], 0
    for event in range(events):
        at = np.array([7000.0 + 400 * event, 10.0, -5.0])
        for speed, miss in ((np.array([0.0, 7.5, 0.0]), 0.0), (np.array([0.5, 0.0, 7.4]), 2.0)):
            for k in range(rows):
                kick = rng.normal(0, 0.1, 3)
                r = at + miss + 20.0 * (speed + kick) + rng.normal(0, 0.5 if k % 50 == 0 else 1e-3, 3)
                out.append((idx, *map(float, r), *map(float, speed + kick), True, 1.0, event))
                idx += 1
    for _ in range(200):
        r, v = np.array([7000.0, 150.0, 20.0]) + rng.normal(0, 60, 3), rng.normal(0, 4, 3)
        out.append((idx, *map(float, r), *map(float, v), True, 1.0, -1))
        idx += 1
    return spark.createDataFrame(out, "idx long, x double, y double, z double, vx double, vy double, vz double, alive boolean, size_m double, event long")


@pytest.mark.parametrize("block", [50_000, 300])
def test_fragments_that_fly_apart_are_passed_over_and_nothing_else(spark, monkeypatch, block):
    objects = _cloud_states(spark, np.random.default_rng(3))
    states = S.step_states(objects, C.DEFAULT_EPOCH_JD, 60.0, 0, 1, carry=("size_m", "event"))
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    cfg, plan = S.ScreeningConfig(5.0, 1000.0), S.GridPlan(4, 64.0, block < 50_000, False, 256.0)
    parted, keys = S.region_rows(states, 60.0, cfg, plan)
    batches, plain = parted.toArrow().combine_chunks().to_batches(), parted.drop("event").toArrow().combine_chunks().to_batches()
    looked, outcome = [], S._linear_outcome
    monkeypatch.setattr(S, "_linear_outcome", lambda dr, *more: looked.append(dr.shape[1]) or outcome(dr, *more))

    def pairs(given):
        looked.clear()
        found = sorted((int(i), int(j)) for _, a, b, outcomes, *_ in S._near_in_regions(given, keys, 60.0, cfg, plan)
                       for i, j, o in zip(a, b, outcomes) if S.OUTCOMES[o] == S.REFINE)
        return found, sum(looked)

    (want, before), (got, after) = pairs(plain), pairs(batches)
    assert got == want and want
    if block == 50_000:
        assert after < before / 4


@pytest.mark.parametrize("swept,width,blocks", [(1, 512.0, False), (4, 300.0, False), (24, 5000.0, False), (4, 5000.0, True)])
def test_columns_find_exactly_the_near_pairs(small, brute, monkeypatch, swept, width, blocks):
    monkeypatch.setattr(S, "SWEPT_ROWS", 50)
    monkeypatch.setattr(S, "PAIR_ROWS", 50)
    monkeypatch.setattr(S, "BLOCK_ROWS", 30 if blocks else 50_000)
    assert found(small, S.GridPlan(4, 50.0, blocks, False, width, swept)) == brute


def _dense(rng, rows, fast):
    """One step of a dense catalogue with some rows of another speed, in batches of one region."""
    r, v = rng.uniform(7000.0, 7500.0, (3, rows)), rng.normal(0, 1, (3, rows))
    v *= 7.5 / np.sqrt((v * v).sum(axis=0))
    v[:, :fast] *= 4
    one = np.full(rows, 0)
    for _ in range(3):
        one = (one << C.KEY_BITS) | (7 + C.KEY_OFFSET)
    table = {"region": one, "step": np.zeros(rows, np.int32), "idx": np.arange(rows), **dict(zip(STATE, [*r, *v]))}
    return [pa.RecordBatch.from_arrays([pa.array(c) for c in table.values()], list(table))]


@pytest.mark.parametrize("fast", [0, 2])
def test_dense_rows_are_compared_in_columns_with_few_others(monkeypatch, fast):
    batches, cfg = _dense(np.random.default_rng(5), 4000, fast), S.ScreeningConfig(25.0)
    looked, outcome = [], S._linear_outcome
    monkeypatch.setattr(S, "_linear_outcome", lambda dr, *more: looked.append(dr.shape[1]) or outcome(dr, *more))

    def pairs(swept):
        looked.clear()
        plan = S.GridPlan(8, 64.0, False, False, 1024.0, swept)
        return sorted((int(i), int(j), int(o)) for _, a, b, o, *_ in S._near_in_regions(batches, ["step", "region"], DT, cfg, plan) for i, j, o in zip(a, b, o)), sum(looked)

    (want, boxes), (got, columns) = pairs(0), pairs(8)
    assert got == want and len(want) > 500
    assert fast or columns < 0.7 * boxes


def test_a_denser_catalogue_is_swept_in_shorter_sub_intervals():
    level = lambda n, w: Row(level=w, objects=n, squares=n * (1 + n * w**3 / 1e12), busiest=10, copies=1)
    plan = lambda n, clouds=False: S.plan_grid({w: level(n, w) for w in S.PROBE_LEVELS_KM}, DT, S.ScreeningConfig(25.0), clouds)
    assert 1 < plan(150_000).swept < plan(50_000_000).swept
    assert plan(50_000_000, True).swept == 0


def test_the_nearest_place_of_a_curve_is_that_of_golden_section():
    rng, n = np.random.default_rng(8), 5000
    p0 = rng.normal(size=(3, n)) * 300
    m0 = -p0 * rng.uniform(0.2, 3, n) + rng.normal(size=(3, n)) * 20
    bend = rng.choice([0.0, 0.5, 5.0, 80.0], n)
    p1, m1 = p0 + m0 + rng.normal(size=(3, n)) * bend, m0 + rng.normal(size=(3, n)) * bend
    p0[:, 0] = m0[:, 0] = p1[:, 0] = m1[:, 0] = 1.0  # stands still, then bends
    want = kernels.golden_minimum(lambda s: (kernels.hermite(p0, m0, p1, m1, s) ** 2).sum(axis=0), n)
    assert np.abs(kernels.curve_minimum(p0, m0, p1, m1) - want).max() < 1e-7

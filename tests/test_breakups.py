"""Breakups, fates and the batch run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from orbisweep import constants as C
from orbisweep.operators import breakup as B, fates, ordering, screen as S
from orbisweep.plans import queries as Q, simulate
from orbisweep.schemas import STATE


@pytest.fixture(scope="module")
def broken(spark):
    events = B.with_count(Q._events(spark, SF), Q.BREAKUP)
    return events, B.fragments_of(events, Q.BREAKUP)


def test_mass_is_never_exceeded(broken):
    events, fragments = broken
    used = fragments.groupBy("event", "side").agg(F.sum("mass_kg").alias("kg"), F.max("budget").alias("budget"))
    assert used.where("kg > budget * (1 + 1e-12)").count() == 0


def test_counts_follow_the_law(broken):
    events, _ = broken
    row = events.agg(F.sum("expected_fragments").alias("want"), F.sum("drawn").alias("got")).first()
    assert abs(row.got - row.want) < 5 * np.sqrt(row.want)


def test_sizes_follow_the_power_law(broken):
    events, _ = broken
    drawn = B.draw_fragments(events, Q.BREAKUP).where("side = 0").agg(
        F.count("*").alias("n"), F.count_if(F.col("size_m") > 0.2).alias("big")).first()
    assert drawn.n > 500
    assert drawn.big / drawn.n == pytest.approx(0.30566, abs=0.06)


def test_layout_does_not_change_the_draws(broken):
    events, fragments = broken
    again = B.fragments_of(events.repartition(7), Q.BREAKUP)
    assert fragments.count() == again.count()
    assert fragments.exceptAll(again).count() == 0


def parents(spark, rows):
    """Head-on pairs at 10 km/s with the given (t, i, j, mass_i, mass_j)."""
    out = []
    for t, i, j, mi, mj in rows:
        body = lambda k, m, v: (k, f"O{k}", m, 1.0, 7000.0, 0.0, 0.0, 0.0, v, 0.0)
        out.append((t, i, j, *body(i, mi, 5.0), *body(j, mj, -5.0), 10.0))
    ddl = "t double, i bigint, j bigint, " + ", ".join(
        f"{s}_{c} {k}" for s in "ij" for c, k in zip(B.PARENT, ["bigint", "string"] + ["double"] * 8)
    ) + ", remaining_s double"
    return spark.createDataFrame(out, ddl)


def test_fates_follow_time_order(spark):
    rows = [
        (2.0, 1, 2, 100.0, 100.0),  # loses to the earlier one
        (1.0, 2, 3, 100.0, 100.0),
        (3.0, 4, 5, 1000.0, 0.1),  # survivors can be hit again
        (4.0, 4, 6, 1000.0, 0.1),
        (5.0, 5, 6, 0.1, 0.1),  # both gone by then
    ]
    events, bodies = fates.resolve(parents(spark, rows), B.BreakupConfig())
    assert sorted(r.t for r in events.collect()) == [1.0, 3.0, 4.0]
    fate = {r.idx: (r.alive, r.mass_kg) for r in bodies.collect()}
    assert [k for k, (alive, _) in sorted(fate.items()) if alive] == [1, 4]
    assert fate[4][1] == pytest.approx(1000.0 - 2 * (0.1 * 100 - 0.1))


def test_fates_match_a_plain_loop(spark):
    draw = np.random.default_rng(3)
    mass = {k: float(m) for k, m in enumerate(draw.choice([0.1, 5.0, 500.0, 2000.0], 12))}
    rows = []
    for n in range(30):
        i, j = sorted(int(v) for v in draw.choice(12, 2, replace=False))
        rows.append((float(n), i, j, mass[i], mass[j]))
    left, alive, times = dict(mass), {k: True for k in mass}, []
    for t, i, j, _, _ in rows:
        if alive[i] and alive[j]:
            times.append(t)
            tgt, prj = (i, j) if left[i] >= left[j] else (j, i)
            alive[prj] = False
            if 500.0 * left[prj] * 100.0 / left[tgt] >= 40.0:
                alive[tgt] = False
            else:
                left[tgt] -= left[prj] * 100.0 - left[prj]
    events, bodies = fates.resolve(parents(spark, rows), B.BreakupConfig())
    assert sorted(r.t for r in events.collect()) == times
    assert all(r.alive == alive[r.idx] for r in bodies.collect())


def test_a_long_chain_takes_no_more_jobs(spark):
    """2,000 hits on one survivor, and a chain in which every object meets the next: as many jobs as for two hits."""
    def jobs(rows):
        spark.sparkContext.setJobGroup("fates", "", False)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fates"))
        events, bodies = fates.resolve(parents(spark, rows), B.BreakupConfig())
        out = events.count(), {r.idx: r.alive for r in bodies.collect()}
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("fates")) - before

    (n, alive), few = jobs([(1.0, 0, 1, 1e6, 1e-3), (2.0, 0, 2, 1e6, 1e-3)])
    assert n == 2 and alive == {0: True, 1: False, 2: False}
    (n, alive), many = jobs([(float(k), 0, k, 1e6, 1e-3) for k in range(1, 2001)])
    assert n == 2000 and alive[0] and not any(alive[k] for k in range(1, 2001))
    assert many <= few + 6  # some more for the larger graph's rounds, none per hit
    (n, _), _ = jobs([(float(k), k, k + 1, 100.0, 100.0) for k in range(500)])
    assert n == 250  # every second one: both objects of a hit are gone
    events, bodies = fates.resolve(parents(spark, [(1.0, 0, 1, 1.0, 1.0)]).limit(0), B.BreakupConfig())
    assert events.count() == 0 and bodies.count() == 0


def test_groups_reach_over_any_shape(spark):
    from orbisweep.operators.groups import connected

    chain = [(k, k + 1) for k in range(400)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    loose = [(5000, 5000), (None, 1), (7, None)]
    edges = spark.createDataFrame(chain + star + loose, "a long, b long")
    label = {r.node: r.label for r in connected(edges).collect()}
    assert len(label) == 401 + 300 + 1
    assert len({label[k] for k in range(401)}) == 1 and len({label[1000 + k] for k in range(300)}) == 1 and label[5000] == 5000
    assert len(set(label.values())) == 3 and connected(edges.limit(0)).count() == 0


def test_batches_do_not_change_a_run(spark, objects):
    def final(batch):
        cfg = simulate.RunConfig(duration_s=120.0, dt=60.0, batch_steps=batch, breakup=B.BreakupConfig(),
                                 screening=S.ScreeningConfig(radius_scale=30000.0))
        done = simulate.run(objects, cfg)
        rows = done.final.select("idx", "event", "alive", *[F.round(c, 6).alias(c) for c in STATE])
        return done, {tuple(r) for r in rows.collect()}

    one, a = final(1)
    many, b = final(2)
    assert one.breakups is not None and one.breakups.count() > 0
    assert a == b
    assert one.population == many.population


def test_row_numbers_and_ranks(spark):
    ids = spark.range(0, 300000, 3)
    out = ordering.row_numbers(ids, F.col("id"), "n", block=1 << 8)
    assert out.where("n <> id / 3").count() == 0
    ranked = ordering.ranked(ids.orderBy(F.xxhash64("id")), ["id"], "n")
    assert ranked.where("n <> id / 3").count() == 0


def test_few_small_events_are_dealt_to_many_tasks(spark):
    """Rows of events are small, each is much work: their bytes must not put them all into one task."""
    rows = B.with_count(Q._events(spark, "/root/testdata/sf0.01"), Q.BREAKUP)
    tasks = B.kept_fragments(rows, Q.BREAKUP).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4

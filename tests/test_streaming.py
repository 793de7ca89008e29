"""Streams give what the same question over the table gives."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from orbisweep.operators import analytics as A
from orbisweep.plans import queries as Q
from orbisweep.session import work_path
from orbisweep.sources import derived
from orbisweep.streaming import feeds


@pytest.fixture(scope="module")
def files(spark):
    """The event feed as four files in time order."""
    path = work_path(spark, "feed")
    events = derived.table(spark, SF, "events")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def same(a, b):
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


@pytest.fixture(scope="module")
def shuffled(spark):
    """The event feed as 40 files in no order at all."""
    path = work_path(spark, "shuffled")
    derived.table(spark, SF, "events").repartition(40, F.xxhash64("event_id")).write.parquet(path)
    return path


def test_hourly_windows_of_shuffled_files(spark, shuffled):
    stream = feeds.hourly_windows(feeds.open_events(spark, shuffled, 5).select("ts", "value"))
    got = feeds.newest(feeds.run_to_table(stream, "update", "hourly"), "hour")
    want = A.hourly(derived.table(spark, SF, "events"), Q._event_seconds())
    same(got.select("hour", "n", F.round("total", 4)), want.select("hour", "n", F.round("total", 4)))


def test_moving_average_of_shuffled_files(spark, shuffled):
    stream = feeds.ema_blocks(feeds.open_events(spark, shuffled, 5), "user_id", "ts", "event_id", "value", block_s=3600)
    got = feeds.ema_of_blocks(feeds.run_to_table(stream, "update", "ema"), "user_id")
    want = {}
    for r in sorted(derived.table(spark, SF, "events").select("user_id", "ts", "event_id", "value").collect(), key=lambda r: (r["ts"], r["event_id"])):
        e = want.get(r["user_id"], 0.0)
        want[r["user_id"]] = 0.9 * e + 0.1 * r["value"] if e > 0 else r["value"]
    assert {r["user_id"]: pytest.approx(r["ema"], rel=1e-9) for r in got.collect()} == want


def test_hourly_windows_over_several_batches(spark, files):
    stream = feeds.hourly_windows(feeds.open_events(spark, files, 1).select("ts", "value"), "40 days")
    got = feeds.newest(feeds.run_to_table(stream, "update", "hourly"), "hour")
    want = A.hourly(derived.table(spark, SF, "events"), Q._event_seconds())
    same(got.select("hour", "n", F.round("total", 4)), want.select("hour", "n", F.round("total", 4)))


def test_moving_average_keeps_its_state(spark, files):
    stream = feeds.ema_blocks(feeds.open_events(spark, files), "user_id", "ts", "event_id", "value")
    got = feeds.ema_of_blocks(feeds.run_to_table(stream, "update", "ema"), "user_id")
    want = A.ema_by_key(derived.table(spark, SF, "events"), "user_id", "ts", "event_id", "value")
    same(got.select("user_id", F.round("ema", 6)), want.select("user_id", F.round("ema", 6)))


def test_recent_events_expire(spark, files):
    life = 6 * 3600.0
    stream = feeds.recent_per_key(feeds.open_events(spark, files), "event_type", 5, life)
    got = feeds.run_to_table(stream, "update", "recent")
    last = got.groupBy("event_type").agg(F.max("batch").alias("batch"))
    got = got.join(last, ["event_type", "batch"]).select("event_type", "event_id", "place")
    same(got, feeds.recent_batch(derived.table(spark, SF, "events"), "event_type", 5, life))


def test_replay_one_file_at_a_time(spark, files):
    seen = []
    feeds.replay(spark, files, lambda rows, n: seen.append((n, rows.count())))
    assert [n for n, _ in seen] == [0, 1, 2, 3]
    assert sum(c for _, c in seen) == derived.table(spark, SF, "events").count()

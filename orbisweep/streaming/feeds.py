"""Continuously arriving events: hourly windows, a moving average, the most recent events.

Every query reads files as they arrive and writes one table per micro-batch below the shared
work folder, keyed by the batch number, so that a batch that is run again replaces its own
output. State and offsets are checkpointed in the same folder.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..operators import analytics as A
from ..session import work_path
from ..sources.derived import zoned

EPOCH_S = 1704067200.0


def open_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream over a folder of Parquet files, or over one file of a folder.

    The number of files per micro-batch bounds what one key can bring to its state at a time.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader = reader.option("pathGlobFilter", place.getName())
        path = place.getParent().toString()
    return zoned(reader.parquet(path))


def run_to_table(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Drain what is available and return all emitted rows with their `batch` number."""
    spark = stream.sparkSession
    out = work_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    handle = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", work_path(spark, label + "-offsets"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    handle.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The last emitted row of each key."""
    body = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*body), "batch").alias("r")).select(key, "r.*")


def hourly_windows(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Count and total per event-time hour; complete whatever the order in which events arrive.

    Without a lateness every hour stays in the state, one row each, and no event is late. An endless feed
    can name one: hours older than that leave the state, and events that come later still are lost.
    """
    timed = events.withWatermark("ts", lateness) if lateness else events
    return (
        timed.groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(((F.unix_seconds("w.start") - F.lit(int(EPOCH_S))) / 3600).cast("bigint").alias("hour"), "n", "total")
    )


def run_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = open_events(spark, f"{sf_dir.rstrip('/')}/events.parquet").select("ts", "value")
    return newest(run_to_table(hourly_windows(events), "update", "hourly"), "hour")


def ema_blocks(events: DataFrame, key: str, ts: str, tie: str, value: str, block_s: int = 60) -> DataFrame:
    """The rows of each key and short block of event time, kept as streaming state and emitted when they change.

    A block holds its rows because they may arrive in any order; what a block does to the average is worked out, and
    blocks are chained in event time, when the average is read (`run_ema`). A key is spread over its blocks.
    """
    block = A.time_block(ts, block_s)
    row = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    return events.groupBy(F.col(key).alias("key"), block.alias("block")).agg(F.collect_list(row).alias("items"))


def ema_of_blocks(emitted: DataFrame, key: str, keep: float = C.EMA_KEEP) -> DataFrame:
    """The average of each key after its last row, from the last emitted state of every block."""
    last = emitted.groupBy("key", "block").agg(F.max("batch").alias("batch"))
    rows = emitted.join(last, ["key", "block", "batch"]).withColumnRenamed("key", key)
    return A.ema_chain(rows, key, keep)


def run_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = open_events(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    stream = ema_blocks(events, "user_id", "ts", "event_id", "value")
    return ema_of_blocks(run_to_table(stream, "update", "ema"), "user_id")


def recent_per_key(events: DataFrame, key: str, n: int = C.RECENT_EVENTS, lifetime_s: float = C.EVENT_LIFETIME_S) -> DataFrame:
    """The last `n` events of each key that are younger than `lifetime_s`, newest first.

    Age is measured in event time against the newest event of the key. State never holds more
    than n rows per key.
    """

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"ts": state.get[0], "event_id": state.get[1]}) if state.exists else None
        for part in frames:
            part = pd.DataFrame({"ts": part["ts"].astype("int64"), "event_id": part["event_id"]})
            held = part if held is None else pd.concat([held, part])
            held = held.sort_values(["ts", "event_id"], ascending=False).head(n)
        held = held[held["ts"] > held["ts"].iloc[0] - int(lifetime_s * 1_000_000)]
        state.update((held["ts"].astype("int64").tolist(), held["event_id"].astype("int64").tolist()))
        yield pd.DataFrame({key: [k[0]] * len(held), "event_id": held["event_id"].to_numpy(), "place": range(1, len(held) + 1)})

    source = events.select(key, F.unix_micros("ts").alias("ts"), "event_id")
    return source.groupBy(key).applyInPandasWithState(
        update, f"{key} string, event_id bigint, place bigint", "ts array<bigint>, event_id array<bigint>",
        "update", GroupStateTimeout.NoTimeout,
    )


def recent_batch(events: DataFrame, key: str, n: int, lifetime_s: float) -> DataFrame:
    """The same report over a table: newest n per key and younger than the lifetime."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    newest_ts = events.groupBy(key).agg(F.max("ts").alias("_max"))
    fresh = events.join(newest_ts, key).where(
        F.unix_micros("ts") > F.unix_micros("_max") - F.lit(int(lifetime_s * 1_000_000))
    )
    # rank first, then cut: the window keeps only its top n rows per task
    return fresh.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n).select(
        key, "event_id", "place"
    )


def replay(spark: SparkSession, path: str, apply) -> None:
    """Feed snapshots one file at a time, in arrival order, to `apply(rows, batch_number)`."""
    stream = open_events(spark, path, files_per_trigger=1)
    stream.writeStream.foreachBatch(apply).option(
        "checkpointLocation", work_path(spark, "replay-offsets")
    ).trigger(availableNow=True).start().awaitTermination()

"""Run outputs: Parquet for our own readers, text for everybody else's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..schemas import STATE
from ..sources.feeds import format_catalog_line, has_elements

SNAPSHOT_NAMES = ["x_km", "y_km", "z_km", "vx", "vy", "vz"]


def write_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet; an earlier run's files are replaced."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def snapshot_rows(objects: DataFrame) -> DataFrame:
    """All objects, dead ones too, in the columns of a snapshot."""
    return objects.select(
        "id", *[F.col(c).alias(n) for c, n in zip(STATE, SNAPSHOT_NAMES)], F.col("alive").cast("int").alias("alive")
    )


def write_snapshots(snapshots: list[tuple[float, DataFrame]], path: str) -> None:
    """Snapshots of a run under one path, partitioned by number, with their instant."""
    for number, (t, objects) in enumerate(snapshots):
        rows = objects.select("idx", *objects.drop("idx").columns).withColumn("t_s", F.lit(float(t)))
        rows.write.mode("overwrite").parquet(f"{path}/snap={number}")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; texts that need it are quoted with doubled quotes."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_snapshot_text(objects: DataFrame, path: str, t: float) -> None:
    """Text snapshot: time comment, column header, then the rows in catalogue order.

    Sorting by range keeps every task at its own part of the order; the two leading lines sort
    before all objects.
    """
    shown = [F.col("id").cast("string"), *[F.format_string("%.9g", c) for c in STATE], F.col("alive").cast("int").cast("string")]
    head = objects.sparkSession.createDataFrame(
        [(-2, f"# t = {t:g} s"), (-1, "id," + ",".join(SNAPSHOT_NAMES) + ",alive")], "idx bigint, value string"
    )
    body = objects.select("idx", F.concat_ws(",", *shown).alias("value"))
    head.unionByName(body).orderBy("idx").select("value").write.mode("overwrite").text(path)


def write_conjunctions(named: DataFrame, path: str) -> None:
    out = named.orderBy("t_s", "i", "j").select(
        "t_s", "id1", "id2", "name1", "name2", "miss_km", "v_rel_km_s", F.col("collision").cast("int").alias("collision")
    )
    write_csv(out, path)


def write_breakups(report: DataFrame, path: str) -> None:
    """Appends, so that each committed batch of a long run can be followed."""
    report.write.mode("append").parquet(path)


def write_catalog(rows: DataFrame, path: str, epoch_iso: str) -> tuple[int, int]:
    """Catalogue text: header, one line per row in `norad_id` order, footer with the counts of written and failed rows.

    Rows without both element lines or without a state are failed and have no line. The counts are taken while the lines are
    written, so the rows are worked out once; the footer follows as the last part. Returns (written, failed).
    """
    spark = rows.sparkSession
    sound = has_elements() & F.col("x").isNotNull() & F.col("vx").isNotNull() & F.col("lat_deg").isNotNull()
    head = spark.createDataFrame([(-1, f"# Date de reference (epoch commun) : {epoch_iso}")], "place bigint, value string")
    body = rows.select(
        F.coalesce(F.col("norad_id").try_cast("bigint"), F.lit((1 << 63) - 1)).alias("place"),
        F.when(F.coalesce(sound, F.lit(False)), format_catalog_line()).alias("value"))
    counts = Observation()
    placed = head.unionByName(body).orderBy("place", "value").observe(
        counts, F.count_if((F.col("place") >= 0) & F.col("value").isNotNull()).alias("written"), F.count_if(F.col("value").isNull()).alias("failed"))
    placed.where(F.col("value").isNotNull()).select("value").write.mode("overwrite").text(path)
    written, failed = counts.get["written"], counts.get["failed"]
    # the row of the last of so many partitions goes to a file whose name comes after all others
    parts = len(spark.read.text(path).inputFiles()) + 1
    last = spark.range(0, parts, 1, parts).where(F.col("id") == parts - 1)
    text = f"# Total propages avec succes : {written}\n# Total echecs (TLE invalide/decaye) : {failed}"
    last.select(F.lit(text).alias("value")).write.mode("append").text(path)
    return written, failed

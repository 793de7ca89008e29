"""Snapshots, trajectories and Moon paths written by earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import text
from ..schemas import MOON_DDL, SNAPSHOT_DDL, STATE, TRAJECTORY_DDL
from .catalog import numbered_lines

TIME_PATTERN = r"t = *([-+0-9.eE]+)"


def read_time(spark: SparkSession, path: str) -> float | None:
    """Instant carried by the header comment of a text snapshot."""
    row = (
        spark.read.text(path)
        .where(F.col("value").startswith("#") & F.col("value").contains("t ="))
        .select(text.leading_double(F.regexp_extract("value", TIME_PATTERN, 1)).alias("t"))
        .first()
    )
    return row.t if row else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a text snapshot in file order, with `idx` as position."""
    lines = numbered_lines(spark, path).where(
        (F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("id,")
    )
    # lines above the first data row are the comment and the column header
    base = lines.agg(F.min("line_no").alias("base")).first().base or 0
    rows = F.from_csv("value", F.lit(SNAPSHOT_DDL)).alias("r")
    return lines.select((F.col("line_no") - F.lit(base)).alias("idx"), rows).select("idx", "r.*")


def read_output_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Any run output by column name; comment lines are skipped."""
    return spark.read.csv(path, schema=ddl, header=True, comment="#", quote='"', escape='"', enforceSchema=False)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return read_output_csv(spark, path, TRAJECTORY_DDL)


def read_moon_path(spark: SparkSession, path: str) -> DataFrame:
    return read_output_csv(spark, path, MOON_DDL)


def live_rows(rows: DataFrame) -> DataFrame:
    """Rows flagged alive; a missing flag counts as alive."""
    return rows.where(F.coalesce(F.col("alive"), F.lit(1)) == 1)


def list_snapshots(paths: DataFrame) -> DataFrame:
    """Order `path` by the number after the last underscore."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    listed = paths.where(name.startswith("snapshot_") & name.endswith(".csv"))
    number = F.coalesce(F.regexp_extract(name, r"_(\d+)[^_]*$", 1).try_cast("bigint"), F.lit(0))
    return listed.select("path", number.alias("number"))


def merge_snapshot(objects: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Lay snapshot rows over the loaded population by position.

    Adds `status`: matched, added (a fragment the population lacks), removed (a fragment the
    snapshot lacks), or an error: id_mismatch, missing_object, unexpected_object.
    """
    s = snapshot.select(
        F.col("idx"), F.col("id").alias("_id"),
        *[F.col(c).alias(f"_{n}") for c, n in zip(["x_km", "y_km", "z_km", "vx", "vy", "vz"], STATE)],
        (F.coalesce(F.col("alive"), F.lit(1)) != 0).alias("_alive"),
    )
    both = objects.join(s, "idx", "full_outer")
    here, there = F.col("id").isNotNull(), F.col("_id").isNotNull()
    status = (
        F.when(here & there & (F.col("id") == F.col("_id")), "matched")
        .when(here & there, "id_mismatch")
        .when(there & (F.col("_id") >= C.FRAGMENT_ID_BASE), "added")
        .when(there, "unexpected_object")
        .when(F.col("event") >= 0, "removed")
        .otherwise("missing_object")
    )
    fresh = ~here
    label = F.concat(F.lit("FRAG "), (F.col("_id") - C.FRAGMENT_ID_BASE).cast("string"))
    return both.withColumn("status", status).select(
        "idx",
        F.coalesce("id", "_id").alias("id"),
        F.when(fresh, label).otherwise(F.col("name")).alias("name"),
        F.when(fresh, F.lit("")).otherwise(F.col("country")).alias("country"),
        F.when(fresh, F.lit("SMALL")).otherwise(F.col("rcs")).alias("rcs"),
        F.when(fresh, F.lit("DEBRIS")).otherwise(F.col("type")).alias("type"),
        *[F.coalesce(f"_{c}", c).alias(c) for c in STATE],
        F.coalesce("_alive", "alive").alias("alive"),
        F.coalesce("size_m", F.lit(0.1)).alias("size_m"),
        F.coalesce("mass_kg", F.lit(0.0)).alias("mass_kg"),
        F.coalesce("area_to_mass", F.lit(0.0)).alias("area_to_mass"),
        F.coalesce("event", F.lit(0)).cast("bigint").alias("event"),
        "status",
    )


ERRORS = ["id_mismatch", "missing_object", "unexpected_object"]


def replay_snapshot(spark: SparkSession, objects: DataFrame, path: str) -> DataFrame:
    """Population as of the snapshot; a snapshot of another catalogue raises."""
    merged = merge_snapshot(objects, read_snapshot(spark, path))
    wrong = merged.where(F.col("status").isin(ERRORS)).limit(1).collect()
    if wrong:
        raise ValueError(f"{path} does not fit the loaded catalogue: {wrong[0].status} at {wrong[0].idx}")
    return merged.where("status != 'removed'").drop("status")


def trajectory_arrays(rows: DataFrame) -> DataFrame:
    """One row per object with its positions in time order.

    A trajectory is bounded by its number of samples, which the run fixes.
    """
    return rows.groupBy("id", "name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("t_s", "x_km", "y_km", "z_km"))),
            lambda p: F.struct(p.x_km.alias("x_km"), p.y_km.alias("y_km"), p.z_km.alias("z_km")),
        ).alias("points")
    )

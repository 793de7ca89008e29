"""Catalogue text: reader, epoch header, type map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import constants as C
from ..functions import dates, text
from ..schemas import STATE


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based position in the file.

    Splits are read in parallel. A line's place inside its split comes from the scan order;
    line counts of earlier splits are added from a table with one row per split.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_seq"),
        )
    )
    order = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("_file", "_start")
        .agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    )
    return lines.join(splits, ["_file", "_start"]).select(
        (F.col("_base") + F.col("_seq") - F.col("_first")).alias("line_no"), "value"
    )


def parse_catalog(lines: DataFrame) -> DataFrame:
    """`line_no, value` to objects with an `ok` flag; rows that are not ok were dropped.

    Comments and empty lines vanish. A row needs 17 fields and readable numbers.
    """
    value = F.col("value")
    fields = F.split(value, r"\|")
    # a separator at the very end opens no further field
    count = F.size(fields) - F.when(value.endswith("|"), 1).otherwise(0)
    # a one-element explode: filters on what is parsed below stay above it, so that a line is
    # split once and not once per field that a filter looks at
    rows = lines.where((value != "") & ~value.startswith("#")).select(
        "line_no", F.explode(F.array(F.struct(fields.alias("f"), count.alias("n")))).alias("s")
    ).select("line_no", "s.f", "s.n")
    item = lambda n: text.trim_blanks(F.get("f", F.lit(n)))
    parsed = rows.select(
        F.col("line_no").alias("idx"),
        "n",
        text.leading_int(item(0)).alias("id"),
        item(1).alias("name"),
        text.normalize_type(item(2)).alias("type"),
        item(4).alias("country"),
        item(5).alias("rcs"),
        *[text.leading_double(item(11 + n)).alias(c) for n, c in enumerate(STATE)],
    )
    readable = F.col("id").isNotNull()
    for c in STATE:
        readable = readable & F.col(c).isNotNull()
    out = parsed.select(
        "idx", "id", "name", "country", "rcs", "type", *STATE,
        F.lit(True).alias("alive"),
        text.size_from_rcs(F.col("rcs")).alias("size_m"),
        F.lit(0.0).alias("mass_kg"),
        F.lit(0.0).alias("area_to_mass"),
        F.lit(-1).cast("bigint").alias("event"),
        (readable & (F.col("n") >= C.CATALOG_MIN_FIELDS)).alias("ok"),
    )
    # the same boundary once more: a filter on `ok` looks at numbers that are there, and reads none again
    return out.select(F.explode(F.array(F.struct(*out.columns))).alias("o")).select("o.*")


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, one-row count of dropped lines); both stay lazy."""
    parsed = parse_catalog(numbered_lines(spark, path))
    return parsed.where("ok").drop("ok"), parsed.agg(F.count_if(~F.col("ok")).alias("dropped"))


def epoch_of_lines(lines: DataFrame) -> DataFrame:
    """One row `epoch_jd`: the first readable date among the leading comments, or the default."""
    head = lines.select(
        "line_no",
        F.col("value").startswith("#").alias("comment"),
        dates.epoch_from_header(F.col("value")).alias("jd"),
    )
    # the header ends at the first line that is not a comment
    return head.agg(
        F.min(F.when(~F.col("comment"), F.col("line_no"))).alias("body"),
        F.min_by("jd", F.when(F.col("comment") & F.col("jd").isNotNull(), F.col("line_no"))).alias("jd"),
        F.min(F.when(F.col("comment") & F.col("jd").isNotNull(), F.col("line_no"))).alias("at"),
    ).select(
        F.when(F.col("body").isNull() | (F.col("at") < F.col("body")), F.col("jd")).alias("jd")
    ).select(F.coalesce("jd", F.lit(C.DEFAULT_EPOCH_JD)).alias("epoch_jd"))


def read_epoch_jd(spark: SparkSession, path: str) -> float:
    return epoch_of_lines(numbered_lines(spark, path)).first().epoch_jd


def object_types(lines: DataFrame) -> DataFrame:
    """id text to type text as written; the last line of an id wins."""
    fields = F.split("value", r"\|")
    return (
        lines.where(~F.col("value").startswith("#") & (F.size(fields) > 2))
        .select(
            text.trim_blanks(F.get(fields, F.lit(0))).alias("id"),
            text.trim_blanks(F.get(fields, F.lit(2))).alias("type"),
            "line_no",
        )
        .groupBy("id")
        .agg(F.max_by("type", "line_no").alias("type"))
    )


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """`id, n` of ids that occur more than once."""
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_totals(ids: DataFrame) -> DataFrame:
    """One row: objects, unique ids and ids that occur more than once."""
    return ids.groupBy("id").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("objects"),
        F.count("*").alias("unique_ids"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
    )

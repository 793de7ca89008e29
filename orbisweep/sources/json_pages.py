"""Stored answers of a catalogue service: one JSON array of records per page or batch, failed ones set aside.

A page that is torn, empty or an error message costs its own records and nothing else: it shows up in the report and the others are
read. Pages are read by Spark, so they may lie in any store it reaches; a page is one row and must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STATUSES = ("ok", "empty", "error", "torn")


def read_pages(spark: SparkSession, path: str, number: str = r"([0-9]+)[^/0-9]*$") -> DataFrame:
    """(page, body): one row per file; the page is the last number in its name, null without one."""
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    return files.select(F.regexp_extract("_file", number, 1).try_cast("bigint").alias("page"), F.col("value").alias("body"))


def page_status(body: Column) -> Column:
    """`ok` for an array, `empty` for nothing, `error` for an object (what a service answers instead), `torn` for all else."""
    blank = F.length(F.trim(F.coalesce(body, F.lit("")), F.lit(" \t\r\n"))) == 0
    return (
        F.when(blank, "empty").when(F.json_array_length(body).isNotNull(), "ok")
        .when(F.json_object_keys(body).isNotNull(), "error").otherwise("torn")
    )


def parse_pages(pages: DataFrame, schema: str) -> DataFrame:
    """`pages` (page, body) with `status` and `records`, an array of `schema` (null unless the status is `ok`).

    Fields that are missing or of another type are null; records that are no objects become null fields.
    """
    marked = pages.select("page", F.explode(F.array(F.struct(page_status(F.col("body")).alias("status"), "body"))).alias("p"))
    parsed = F.from_json("p.body", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    return marked.select("page", "p.status", F.when(F.col("p.status") == "ok", parsed).alias("records"))


def records(parsed: DataFrame) -> DataFrame:
    """Records of the good pages with page and pos, their place in it from 0."""
    return parsed.where("status = 'ok'").select("page", F.posexplode("records").alias("pos", "r")).select("page", "pos", "r.*")


def report(parsed: DataFrame) -> DataFrame:
    """Per page: status and number of records, 0 for failed ones."""
    return parsed.select("page", "status", F.when(F.col("status") == "ok", F.size("records")).otherwise(0).cast("bigint").alias("records"))

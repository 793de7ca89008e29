"""Cross-site boilerplate: lines that stand on many different sites.

The sites of a line are counted by a HyperLogLog sketch per line hash; sketches of tasks merge by aggregation, so a line on a third
of all pages costs one sketch per task. A line whose estimate is clear of the threshold by more than `margin` is
settled; for those near it the distinct sites are counted exactly. Lines of at least `sites` sites are removed.

Lines are compared without white space at their ends. Lines of fewer than `least_chars` characters, blank ones included, are
never removed: fragments so short meet by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, packed

SKETCH_BITS = 10  # 1.04 / sqrt(2^10) = 3.3 % standard error
MARGIN = 0.2  # six standard errors


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", "")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, text: str, site: str, row_key: Column, least_chars: int) -> DataFrame:
    """One row per long enough line: row_key, at (line number), line (a hash), site. A null site is a site."""
    rows = docs.select(row_key.alias("row_key"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"),
                       F.posexplode(split_lines(F.col(text))).alias("at", "value"))
    rows = rows.withColumn("value", _trimmed(F.col("value"))).where(F.char_length("value") >= least_chars)
    return rows.select("row_key", "at", F.xxhash64("value").alias("line"), "site")


def spread(found: DataFrame, sites: int, margin: float = MARGIN, bits: int = SKETCH_BITS) -> DataFrame:
    """(line, n_sites) of the lines with at least `sites` distinct sites; n_sites is an estimate where it is clear of the
    threshold, and exact near it."""
    estimated = materialize(
        found.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(bits)).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - margin)),
        "line-sites",
    )
    clear = estimated.where(F.col("estimate") > sites * (1 + margin)).select("line", F.col("estimate").alias("n_sites"))
    near = estimated.where(F.col("estimate") <= sites * (1 + margin)).select("line")
    # distinct (line, site) first, then a count: neither step holds a line's sites in one place
    exact = found.join(near, "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("n_sites")).where(
        F.col("n_sites") >= sites)
    return clear.unionByName(exact)


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = 5,
                        least_chars: int = 15) -> DataFrame:
    """`docs` with the boilerplate lines cut from the text, and n_lines and n_removed, in place of columns of these names.

    Null and empty texts stay as they are, with no lines. Repeated rows are treated alike. A text whose lines all go becomes
    empty. Columns keep their values otherwise. An empty table gives an empty result.
    """
    row_key = F.xxhash64(F.col(key), F.col(text))
    found = occurrences(docs, text, site, row_key, least_chars)
    lines = materialize(spread(found, sites), "boilerplate")
    cut = found.join(lines.select("line"), "line", "left_semi").groupBy("row_key").agg(F.collect_set("at").alias("__cut"))
    keyed = docs.select(packed(docs, ("n_lines", "n_removed")).alias("doc"), F.col(text).alias("__text"), row_key.alias("row_key"))
    joined = keyed.join(cut, "row_key", "left").withColumn("__lines", split_lines(F.col("__text")))
    kept = F.array_join(F.filter("__lines", lambda _, i: ~F.array_contains("__cut", i)), "\n")
    some = F.col("__cut").isNotNull()
    has = F.char_length(F.coalesce(F.col("__text"), F.lit(""))) > 0
    names = joined.schema["doc"].dataType.names
    return joined.select(
        *[F.when(some, kept).otherwise(F.col("__text")).alias(text) if c == text else F.col(f"doc.`{c}`") for c in names],
        F.when(has, F.size("__lines")).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce(F.size("__cut"), F.lit(0)).cast("long").alias("n_removed"),
    )

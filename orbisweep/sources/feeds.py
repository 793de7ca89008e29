"""From satellite catalogue pages and element-set history to a catalogue at one epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import text

EPOCH_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def first_rows(rows: DataFrame, key: str, number: str, ties: list[str], body: list[str]) -> DataFrame:
    """`body` of the row of each key with the smallest `number`; among those, with the smallest `ties`.

    A hash aggregation over keys and numbers finds the smallest; it is joined back, which Spark does without moving the rows
    where keys repeat often enough for the result to be small. Only the few rows left are aggregated whole.
    """
    least = rows.groupBy(key).agg(F.min(number).alias("_least")).withColumnRenamed(key, "_key")
    left = rows.join(least, (F.col(key) == F.col("_key")) & (F.col(number) == F.col("_least")))
    return left.groupBy(key).agg(F.min_by(F.struct(*body), F.struct(*ties)).alias("r")).select(key, "r.*")


def dedupe_satcat(pages: DataFrame) -> DataFrame:
    """First record of each id in page order."""
    clean = pages.withColumn("NORAD_CAT_ID", text.trim_blanks(F.col("NORAD_CAT_ID"))).where(
        F.col("NORAD_CAT_ID").isNotNull()
    )
    record = ["OBJECT_TYPE", "RCS_SIZE", "RCSVALUE", "OBJECT_ID", "COUNTRY"]
    return first_rows(clean, "NORAD_CAT_ID", "page", ["pos"], record)


def request_window(target: Column, days: int = C.GP_WINDOW_DAYS) -> tuple[Column, Column]:
    """Start and end dates of the history request, day granular."""
    end = F.to_date(target)
    return F.date_sub(end, days), end


def parse_epoch(records: DataFrame) -> DataFrame:
    """Add `norad_id` and `epoch_ts`; the fraction of a second is cut off, anything but date, T and time is null.

    The one-element explode is a boundary: filters on what was parsed do not parse again.
    """
    text_ = F.substring_index("EPOCH", ".", 1)
    whole = (F.length(text_) == 19) & text_.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T")
    parsed = F.struct(text.trim_blanks(F.col("NORAD_CAT_ID")).alias("norad_id"), F.when(whole, text_.try_cast("timestamp")).alias("epoch_ts"))
    return records.select("*", F.explode(F.array(parsed)).alias("_parsed")).select(*records.columns, "_parsed.norad_id", "_parsed.epoch_ts")


def window_filter(records: DataFrame, target: Column, days: int = C.GP_WINDOW_DAYS) -> DataFrame:
    start, end = request_window(target, days)
    day = F.to_date("epoch_ts")
    return parse_epoch(records).where((day >= start) & (day <= end))


def latest_before(records: DataFrame, target: Column, tie: list[str]) -> DataFrame:
    """The newest record at or before the target of each id; ties go to the smallest `tie`.

    An id that holds a third of the history costs no more than any other.
    """
    parsed = parse_epoch(records).where(
        F.col("norad_id").isNotNull() & F.col("epoch_ts").isNotNull() & (F.col("epoch_ts") <= target)
    )
    body = [c for c in parsed.columns if c not in ("norad_id", "NORAD_CAT_ID")]
    return first_rows(parsed.withColumn("_age", -F.unix_micros("epoch_ts")), "norad_id", "_age", tie, body)


def skip_counts(records: DataFrame, target: Column) -> DataFrame:
    """Records that are malformed, in the future, or usable."""
    bad = F.col("norad_id").isNull() | F.col("epoch_ts").isNull()
    late = ~bad & (F.col("epoch_ts") > target)
    return parse_epoch(records).agg(
        F.count_if(bad).alias("skipped_bad"),
        F.count_if(F.coalesce(late, F.lit(False))).alias("skipped_future"),
        F.count_if(F.coalesce(~bad & ~late, F.lit(False))).alias("usable"),
    )


def join_metadata(latest: DataFrame, satcat: DataFrame) -> DataFrame:
    """Attach catalogue attributes; whatever is missing becomes an empty text."""
    names = {
        "OBJECT_TYPE": "object_type", "OBJECT_ID": "intl_designator", "COUNTRY": "country",
        "RCS_SIZE": "rcs_size", "RCSVALUE": "rcs_value",
    }
    meta = satcat.select(
        F.col("NORAD_CAT_ID").alias("norad_id"), *[F.col(k).alias(v) for k, v in names.items()]
    )
    joined = latest.join(meta, "norad_id", "left")
    return joined.withColumns({v: F.coalesce(v, F.lit("")) for v in names.values()})


def format_catalog_line() -> Column:
    """One catalogue row; expects a geodetic point and a state next to the metadata."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    return F.concat_ws(
        " | ",
        "norad_id", F.trim("OBJECT_NAME"), "object_type", "intl_designator", "country",
        "rcs_size", "rcs_value", "EPOCH",
        fixed("lat_deg", 4), fixed("lon_deg", 4), fixed("alt_km", 2),
        *[fixed(c, 3) for c in ("x", "y", "z")],
        *[fixed(c, 5) for c in ("vx", "vy", "vz")],
        F.format_string("%.2f", F.coalesce(F.col("INCLINATION").try_cast("double"), F.lit(float("nan")))),
        F.format_string("%.2f", F.coalesce(F.col("PERIOD").try_cast("double"), F.lit(float("nan")))),
        "TLE_LINE1", "TLE_LINE2",
    )


def has_elements() -> Column:
    """Both element lines present and not empty."""
    return (F.length(F.coalesce("TLE_LINE1", F.lit(""))) > 0) & (F.length(F.coalesce("TLE_LINE2", F.lit(""))) > 0)

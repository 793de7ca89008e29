"""Text helpers of the catalogue and report formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C

BLANKS = " \t\r\n"
INT_PREFIX = r"^([+-]?[0-9]+)"
REAL_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:nan|inf(?:inity)?))"


def trim_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def leading_int(c: Column) -> Column:
    """Leading integer of a text such as '12abc'; NULL without one or outside 32 bits."""
    return F.regexp_extract(c, INT_PREFIX, 1).try_cast("int").cast("bigint")


def leading_double(c: Column) -> Column:
    return F.regexp_extract(c, REAL_PREFIX, 1).try_cast("double")


def normalize_type(c: Column) -> Column:
    return F.when(c.isin(C.OBJECT_TYPES), c).otherwise(F.lit("UNKNOWN"))


def rcs_key(c: Column) -> Column:
    return F.when(c.isin("SMALL", "MEDIUM", "LARGE"), c).otherwise(F.lit("NONE"))


def size_from_rcs(c: Column) -> Column:
    size = F.lit(C.SIZE_DEFAULT_M)
    for name, metres in C.SIZE_BY_RCS_M.items():
        size = F.when(c == name, F.lit(metres)).otherwise(size)
    return size


def rcs_from_area(area: Column) -> Column:
    return F.when(area < 0.1, "SMALL").when(area < 1.0, "MEDIUM").otherwise("LARGE")


def display_category(kind: Column, event: Column) -> Column:
    return F.when(event >= 0, F.lit(C.FRAGMENT_CATEGORY)).otherwise(kind)


def contains_ci(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def format_distance(km: Column) -> Column:
    return F.when(km < 1.0, F.format_string("%.0f m", km * 1000)).otherwise(
        F.format_string("%.2f km", km)
    )

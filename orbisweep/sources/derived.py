"""A deterministic orbit catalogue derived from the star-schema tables.

The tables hold no orbits, so every order becomes one object on a circular orbit whose four
angles and altitude follow from its key by modular arithmetic. The same arithmetic runs in any
SQL engine, which is what makes independent checks possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import text
from ..operators.masses import area_column, default_mass_column
from ..operators.propagate import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; timestamps without zone are taken as UTC session time."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return zoned(rows)


def zoned(rows: DataFrame) -> DataFrame:
    naive = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else rows


def _angle(k: Column, factor: int, modulus: int, full: float) -> Column:
    return F.radians(F.lit(full) * (F.pmod(k * F.lit(factor), F.lit(modulus)) / F.lit(float(modulus))))


def _kind(priority: Column) -> Column:
    return (
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.lit("PAYLOAD"))
        .when(priority == "3-MEDIUM", F.lit("DEBRIS"))
        .when(priority == "4-NOT SPECIFIED", F.lit("ROCKET BODY"))
        .otherwise(F.lit("UNKNOWN"))
    )


def _radar_class(k: Column) -> Column:
    return (
        F.when(k % 4 == 0, F.lit("SMALL"))
        .when(k % 4 == 1, F.lit("MEDIUM"))
        .when(k % 4 == 2, F.lit("LARGE"))
        .otherwise(F.lit(""))
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue at its epoch: one live object per order, with default masses."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    angles = orders.select(
        k.alias("idx"),
        F.concat(F.lit("OBJ "), k.cast("string")).alias("name"),
        F.concat(F.lit("C"), F.pmod("o_custkey", F.lit(25)).cast("string")).alias("country"),
        _radar_class(k).alias("rcs"),
        _kind(F.col("o_orderpriority")).alias("type"),
        (F.lit(6678.137) + F.pmod(k * F.lit(7919), F.lit(10007)) / F.lit(10007.0) * F.lit(1500.0)).alias("_a"),
        _angle(k, 104729, 9973, 180.0).alias("_i"),
        _angle(k, 1299709, 9949, 360.0).alias("_o"),
        _angle(k, 15485863, 9941, 360.0).alias("_u"),
    )
    trig = angles.select(
        "idx", "name", "country", "rcs", "type", "_a",
        F.sqrt(F.lit(C.MU_EARTH) / F.col("_a")).alias("_s"),
        *[f(c).alias(n) for f, c, n in [
            (F.cos, "_i", "_ci"), (F.sin, "_i", "_si"), (F.cos, "_o", "_co"),
            (F.sin, "_o", "_so"), (F.cos, "_u", "_cu"), (F.sin, "_u", "_su"),
        ]],
    )
    a, s = F.col("_a"), F.col("_s")
    ci, si, co, so, cu, su = (F.col(n) for n in ("_ci", "_si", "_co", "_so", "_cu", "_su"))
    kind, rcs = F.col("type"), F.col("rcs")
    mass = default_mass_column(rcs, kind)
    state = [
        (a * (co * cu - so * su * ci)).alias("x"),
        (a * (so * cu + co * su * ci)).alias("y"),
        (a * (su * si)).alias("z"),
        (s * (-(co * su) - so * cu * ci)).alias("vx"),
        (s * (co * cu * ci - so * su)).alias("vy"),
        (s * (cu * si)).alias("vz"),
    ]
    # a one-element explode stands for the boundary that a stored catalogue would have: without
    # it, every filter on a coordinate would repeat the trigonometry above
    placed = trig.select("idx", "name", "country", "rcs", "type", F.explode(F.array(F.struct(*state))).alias("o"))
    return placed.select(
        "idx",
        F.col("idx").alias("id"),
        "name",
        "country",
        "rcs",
        "type",
        "o.*",
        F.lit(True).alias("alive"),
        text.size_from_rcs(rcs).alias("size_m"),
        mass.alias("mass_kg"),
        (area_column(rcs) / mass).alias("area_to_mass"),
        F.lit(-1).cast("bigint").alias("event"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue part-way through a run: some objects are fragments, some are gone."""
    k = F.col("idx")
    return objects(spark, sf_dir).withColumns(
        {
            "event": F.when(k % 11 == 0, k % 40).otherwise(F.lit(-1)).cast("bigint"),
            "alive": k % 13 != 0,
        }
    )


def sinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with radii scaled between 0.9 and 1.1, so that some lie below ground."""
    factor = F.lit(0.9) + F.pmod(F.col("idx"), F.lit(200)) / F.lit(1000.0)
    return objects(spark, sf_dir).withColumns({c: F.col(c) * factor for c in ("x", "y", "z")})


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue text lines (`value`), with comments, blanks, and malformed rows among them."""
    o = objects(spark, sf_dir)
    k = F.col("idx")
    full = F.concat_ws(
        " | ",
        F.when(k % 101 == 0, F.lit("n/a")).otherwise(k.cast("string")),
        "name",
        F.when(F.col("type") == "UNKNOWN", F.lit("TBA")).otherwise(F.col("type")),
        F.lit("1998-067A"),
        "country",
        "rcs",
        F.lit(""),
        F.lit("2026-07-31T00:00:00"),
        F.lit("0.0000"),
        F.lit("0.0000"),
        F.format_string("%.2f", F.lit(400.0)),
        *[F.format_string("%.3f", c) for c in ("x", "y", "z")],
        *[F.format_string("%.5f", c) for c in ("vx", "vy", "vz")],
        F.lit("nan"),
        F.lit("92.90"),
        F.lit("1 00000U"),
        F.lit("2 00000"),
    )
    value = (
        F.when(k % 103 == 0, F.concat(F.lit("# note "), k.cast("string")))
        .when(k % 107 == 0, F.lit(""))
        .when(k % 97 == 0, F.concat(k.cast("string"), F.lit(" | short | row")))
        .otherwise(full)
    )
    # a one-element explode keeps the readers' filters from repeating the whole text expression
    return o.select(k.alias("line_no"), F.explode(F.array(value)).alias("value"))


def gp_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-set history: one record per line item; some are malformed or lack elements."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", F.col("l_shipdate").cast("timestamp").alias("at"))
    epoch = F.replace(F.col("at").cast("string"), F.lit(" "), F.lit("T"))  # whole seconds: `yyyy-MM-dd HH:mm:ss`
    return lines.select(
        F.when(n % 71 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("l_partkey"))).cast("string").alias("NORAD_CAT_ID"),
        F.when(n % 67 == 0, F.lit("unknown")).otherwise(F.concat(epoch, F.lit(".250000"))).alias("EPOCH"),
        F.concat(F.lit("OBJ "), F.col("l_partkey")).alias("OBJECT_NAME"),
        F.when(n % 61 == 0, F.lit(None)).otherwise(F.concat(F.lit("1 "), F.col("l_orderkey"))).cast("string").alias("TLE_LINE1"),
        F.concat(F.lit("2 "), F.col("l_linenumber")).alias("TLE_LINE2"),
        F.format_string("%.2f", "l_quantity").alias("INCLINATION"),
        F.format_string("%.2f", F.col("l_tax") * 100 + 90).alias("PERIOD"),
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
    )


def satcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite catalogue pages; every seventh part shows up again on a later page."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    copies = F.when(k % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return part.select(
        k.cast("string").alias("NORAD_CAT_ID"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.element_at(
            F.array(*[F.lit(t) for t in C.OBJECT_TYPES]), (k % 4 + 1).cast("int"))).alias("OBJECT_TYPE"),
        _radar_class(k).alias("RCS_SIZE"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.format_string("%.1f", "p_retailprice")).alias("RCSVALUE"),
        F.col("p_brand").alias("OBJECT_ID"),
        F.col("p_type").alias("COUNTRY"),
        F.explode(copies).alias("copy"),
        k.alias("pos"),
    ).select(
        "NORAD_CAT_ID", "OBJECT_TYPE", "RCS_SIZE", "RCSVALUE", "OBJECT_ID",
        F.when(F.col("copy") == 1, F.concat(F.lit("LATE "), F.col("COUNTRY"))).otherwise(F.col("COUNTRY")).alias("COUNTRY"),
        (F.floor(F.col("pos") / 500) + F.col("copy")).cast("bigint").alias("page"),
        "pos",
    )


def satcat_json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The satellite catalogue as a service sends it: pages of JSON text, some torn, some error messages."""
    record = F.struct("pos", "NORAD_CAT_ID", "OBJECT_TYPE", "RCS_SIZE", "RCSVALUE", "OBJECT_ID", "COUNTRY")
    pages = satcat(spark, sf_dir).groupBy("page").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("body"))
    body = F.col("body")
    return pages.select(
        "page",
        F.when(F.col("page") % 7 == 3, F.substring(body, F.lit(1), F.length(body) - 9))
        .when(F.col("page") % 11 == 5, F.lit('{"error": "limit reached"}')).when(F.col("page") % 13 == 6, F.lit("")).otherwise(body).alias("body"),
    )


def element_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-line elements, one set per line item: most are sound, some are deep-space, some have one fault each."""
    from . import elements

    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    number = F.lpad(F.pmod("l_partkey", F.lit(100000)).cast("string"), 5, "0")
    day = F.dayofyear("l_shipdate") + F.pmod(n, F.lit(9973)) / F.lit(10000.0)
    drag = F.concat(F.lit(" "), (F.lit(10000) + F.pmod(n * 13, F.lit(80000))).cast("string"), F.lit("-4"))
    shifted = lambda factor, modulus: F.format_string("%8.4f", F.pmod(n * F.lit(factor), F.lit(modulus)) / F.lit(10000.0))
    motion = F.when(n % 47 == 0, F.lit(2.0)).otherwise(F.lit(11.0)) + F.pmod(n * 7919, F.lit(45_000_000)) / F.lit(1e7)
    one = F.concat(
        F.lit("1 "), number, F.lit("U 98067A   "), F.date_format("l_shipdate", "yy"), F.format_string("%012.8f", day),
        F.lit("  .00001000  00000-0 "), drag, F.lit(" 0 "), F.lpad(F.pmod(n, F.lit(1000)).cast("string"), 4, " "))
    two = F.concat(
        F.lit("2 "), number, F.lit(" "), shifted(104729, 1_799_000), F.lit(" "), shifted(1299709, 3_600_000), F.lit(" "),
        F.lpad(F.pmod(n * 31, F.lit(150_000)).cast("string"), 7, "0"), F.lit(" "), shifted(15485863, 3_600_000), F.lit(" "),
        shifted(611953, 3_600_000), F.lit(" "), F.format_string("%11.8f", motion), F.lpad(F.pmod(n, F.lit(100000)).cast("string"), 5, " "))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    rows = spread(items, by=("l_orderkey", "l_linenumber")).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", n.alias("n"), one.alias("a"), two.alias("b"))
    # a one-element explode keeps the texts from being built again for each of their digits
    rows = rows.select("l_orderkey", "l_linenumber", "l_quantity", "n", F.explode(F.array(F.struct("a", "b"))).alias("s"))
    a, b = F.col("s.a"), F.col("s.b")
    wrong = F.when(F.col("n") % 53 == 0, 1).otherwise(0)
    line1 = F.concat(a, F.pmod(elements.checksum(a) + wrong, F.lit(10)).cast("string"))
    line2 = F.concat(b, elements.checksum(b).cast("string"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("n") % 61 != 0, F.when(F.col("n") % 59 == 0, F.substring(line1, 1, 60)).otherwise(line1)).alias("TLE_LINE1"),
        F.when(F.col("n") % 67 == 0, F.concat(F.lit("3"), F.substring(line2, 2, 68))).otherwise(line2).alias("TLE_LINE2"),
    )

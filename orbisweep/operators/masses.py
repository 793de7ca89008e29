"""Mass table: defaults, overrides from a file, and assignment to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import text
from ..schemas import MASS_DDL


def default_mass_table(spark: SparkSession) -> DataFrame:
    """The 16 default cells."""
    rows = [
        (rcs, kind, kg)
        for rcs, masses in C.MASS_TABLE_KG.items()
        for kind, kg in zip(C.OBJECT_TYPES, masses)
    ]
    return spark.createDataFrame(rows, MASS_DDL)


def default_mass_column(rcs: Column, kind: Column) -> Column:
    """The default cell as an expression: 16 fixed cells need no join."""
    cells = F.create_map(
        *[
            F.lit(v)
            for r, masses in C.MASS_TABLE_KG.items()
            for t, kg in zip(C.OBJECT_TYPES, masses)
            for v in (f"{r}/{t}", kg)
        ]
    )
    return F.element_at(cells, F.concat(text.rcs_key(rcs), F.lit("/"), text.normalize_type(kind)))


def area_column(rcs: Column) -> Column:
    key = text.rcs_key(rcs)
    area = F.lit(C.AREA_BY_RCS_M2["NONE"])
    for name in ("SMALL", "MEDIUM", "LARGE"):
        area = F.when(key == name, F.lit(C.AREA_BY_RCS_M2[name])).otherwise(area)
    return area


def parse_mass_lines(lines: DataFrame) -> DataFrame:
    """`line_no, value` text to cells with a validity flag."""
    value = F.rtrim("value", F.lit("\r"))
    fields = F.split(value, ",", 4)
    return (
        lines.withColumn("value", value)
        .where((F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("rcs,"))
        .select(
            "line_no",
            "value",
            F.get(fields, F.lit(0)).alias("rcs"),
            F.get(fields, F.lit(1)).alias("type"),
            F.coalesce(text.leading_double(F.ltrim(F.get(fields, F.lit(2)))), F.lit(0.0)).alias("mass_kg"),
        )
        .withColumn(
            "ok",
            F.coalesce(
                F.col("rcs").isin(C.RCS_CLASSES) & F.col("type").isin(C.OBJECT_TYPES) & (F.col("mass_kg") > 0),
                F.lit(False),
            ),
        )
    )


def override_masses(defaults: DataFrame, cells: DataFrame) -> DataFrame:
    """Valid cells replace defaults; the last line wins where a cell is repeated."""
    latest = (
        cells.where("ok")
        .groupBy("rcs", "type")
        .agg(F.max_by("mass_kg", "line_no").alias("file_kg"))
    )
    return defaults.join(latest, ["rcs", "type"], "left").select(
        "rcs", "type", F.coalesce("file_kg", "mass_kg").alias("mass_kg")
    )


def load_mass_table(spark: SparkSession, path: str) -> DataFrame:
    """Defaults overridden by a `rcs,type,mass_kg` file; the first bad line fails the load."""
    from ..sources.catalog import numbered_lines

    cells = parse_mass_lines(numbered_lines(spark, path))
    bad = cells.where("NOT ok").orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0].line_no}: invalid mass cell: {bad[0].value}")
    return override_masses(default_mass_table(spark), cells)


def assign_masses(objects: DataFrame, masses: DataFrame) -> DataFrame:
    """Mass and area-to-mass of catalogue rows; fragments keep their own.

    The mass table has 16 rows by construction, so broadcasting it is bounded.
    """
    columns = objects.columns
    cells = masses.select(
        F.col("rcs").alias("_rcs"), F.col("type").alias("_type"), F.col("mass_kg").alias("_kg")
    )
    joined = objects.join(
        F.broadcast(cells),
        (text.rcs_key(F.col("rcs")) == F.col("_rcs")) & (text.normalize_type(F.col("type")) == F.col("_type")),
        "left",
    )
    catalogue = F.col("event") < 0
    return joined.withColumns(
        {
            "mass_kg": F.when(catalogue, F.col("_kg")).otherwise(F.col("mass_kg")),
            "area_to_mass": F.when(catalogue, area_column(F.col("rcs")) / F.col("_kg")).otherwise(
                F.col("area_to_mass")
            ),
        }
    ).select(columns)

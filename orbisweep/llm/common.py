"""What the corpus operators share: tables, scratch tables, and numbering without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import session
from ..session import work_path

__all__ = ["materialize", "work_path", "table", "numbered", "packed", "unpacked", "discard"]
#: Spark's own setting: shuffle files go when the query that wrote them ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """A written table in the shared folder in place of `df`; the shuffles behind it leave no files."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return session.materialize(df, label)
    finally:
        conf.set(_CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by `materialize` that nothing reads any more."""
    for table_ in tables:
        for file in table_.inputFiles()[:1]:  # all files of a table lie in one folder
            folder = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def packed(docs: DataFrame, without: tuple[str, ...] | list[str] = (), keep: list[str] | None = None) -> Column:
    """The columns of `docs` as one struct, so that none of their names meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in without])


def unpacked(df: DataFrame, name: str) -> list[Column]:
    """The columns of a struct made by `packed`."""
    return [F.col(f"{name}.`{c}`") for c in df.schema[name].dataType.names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(laid: DataFrame, keys: list[str], part: str, order: list[Column], out: str, value: Column | None = None) -> DataFrame:
    """Exclusive running sum of `value` (default: 1 per row) per key, over a settled table.

    `part` splits each key into parts that are numbered on their own on top of the totals of the
    parts before, so that a key with most of the rows is spread over as many tasks as it has
    parts. The frame must be a written table (`materialize`): the totals and the rows are read
    separately and have to agree. Keys and parts are never null; window and join so share one shuffle.
    """
    step = F.lit(1).cast("bigint") if value is None else value.cast("bigint")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*keys, part).agg(F.sum(step).alias("__total"))
        .select(*keys, part, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    )
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    columns = [c for c in laid.columns if c != out]
    inner = laid.withColumn("__inner", F.coalesce(F.sum(step).over(within), F.lit(0)))
    return inner.join(offsets, [*keys, part]).select(*columns, (F.col("__inner") + F.col("__offset")).alias(out))

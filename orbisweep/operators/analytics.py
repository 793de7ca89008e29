"""Reports, filters and lookups over a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import orbits, text
from ..functions.vectors import cols, dot, norm, sub
from ..schemas import STATE


# --- filters --------------------------------------------------------------------------


def visible(
    objects: DataFrame,
    categories: list[str] | None = None,
    alt_km: tuple[float, float] = (0.0, 1_000_000.0),
    inc_deg: tuple[float, float] = (0.0, 180.0),
    search: str = "",
    tracked: DataFrame | None = None,
) -> DataFrame:
    """Objects that pass every switch; ranges include both ends.

    `tracked` is a table of idx; with it only those objects pass.
    """
    rows = objects.where("alive")
    if search:
        rows = rows.where(
            text.contains_ci(F.col("name"), search) | F.col("id").cast("string").contains(search)
        )
    rows = rows.withColumn("category", text.display_category(F.col("type"), F.col("event")))
    if categories is not None:
        rows = rows.where(F.col("category").isin(categories))
    rows = orbits.with_altitude_inclination(rows).where(
        F.col("alt_km").between(*alt_km) & F.col("inc_deg").between(*inc_deg)
    )
    if tracked is not None:
        rows = rows.join(tracked.select("idx"), "idx", "left_semi")
    return rows


def category_counts(shown: DataFrame) -> DataFrame:
    """Shown objects per category and in total, in one pass."""
    return (
        shown.rollup("category").agg(F.count("*").alias("n"))
        .select(F.coalesce("category", F.lit("ALL")).alias("category"), "n")
    )


def regime_counts(objects: DataFrame) -> DataFrame:
    """Objects per altitude regime; a shared boundary counts in both."""
    rows = orbits.with_altitude_inclination(objects.where("alive"))
    counts = rows.agg(
        *[F.count_if(F.col("alt_km").between(lo, hi)).alias(name) for name, (lo, hi) in C.REGIMES_KM.items()]
    )
    return counts.select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("regime"), F.col(n).alias("n")) for n in C.REGIMES_KM
        ])).alias("r")
    ).select("r.*")


def pick_nearest(shown: DataFrame, origin, direction, radius_km: float) -> DataFrame:
    """The first object a ray meets, each object being a ball of `radius_km`."""
    size = sum(d * d for d in direction) ** 0.5
    unit = [F.lit(d / size) for d in direction]
    to = sub([F.lit(float(o)) for o in origin], cols("x", "y", "z"))
    b = dot(to, unit)
    disc = b * b - dot(to, to) + F.lit(float(radius_km) ** 2)
    inside = dot(to, to) < F.lit(float(radius_km) ** 2)
    rows = shown.withColumns({"_b": b, "_disc": disc, "_in": inside}).where("_disc >= 0")
    near = -F.col("_b") - F.sqrt("_disc")
    far = -F.col("_b") + F.sqrt("_disc")
    rows = rows.withColumn("distance", F.when(F.col("_in"), far).otherwise(near)).where("distance >= 0")
    return rows.agg(F.min_by(F.struct("idx", "id", "name", "distance"), F.struct("distance", "idx")).alias("o")).where(
        "o IS NOT NULL"
    ).select("o.*")


# --- aggregates -----------------------------------------------------------------------


def miss_histogram(conjunctions: DataFrame, threshold_km: float | None = None) -> DataFrame:
    """Cumulative counts below fixed distances, up to the screening threshold."""
    bins = [b for b in C.MISS_BINS_KM if threshold_km is None or b <= threshold_km]
    counts = conjunctions.agg(*[F.count_if(F.col("miss_km") < b).alias(f"b{n}") for n, b in enumerate(bins)])
    return counts.select(
        F.explode(F.array(*[
            F.struct(F.lit(b).alias("below_km"), F.col(f"b{n}").alias("n")) for n, b in enumerate(bins)
        ])).alias("r")
    ).select("r.*")


def closest_approach(conjunctions: DataFrame) -> DataFrame:
    row = F.struct("i", "j", "t", "miss_km", "v_rel_km_s")
    return conjunctions.agg(F.min_by(row, F.struct("miss_km", "t", "i", "j")).alias("r")).where(
        "r IS NOT NULL"
    ).select("r.*")


def conjunction_totals(conjunctions: DataFrame) -> DataFrame:
    return conjunctions.agg(
        F.count("*").alias("conjunctions"), F.count_if("collision").alias("collisions")
    )


def catalog_fate(final: DataFrame, initial: DataFrame) -> DataFrame:
    """Catalogue objects below ground, destroyed, and the largest change of semi-major axis."""
    axis = lambda df, out: orbits.with_elements(df.select("idx", "id", "alive", "event", *STATE)).withColumnRenamed("a", out)
    start = axis(initial, "a0").select("idx", "a0")
    end = axis(final.where("event < 0"), "a1")
    radius = norm(cols("x", "y", "z"))
    sunk = radius < F.lit(C.R_EARTH)
    change = F.when(F.col("alive"), F.abs(F.col("a1") - F.col("a0")))
    return end.join(start, "idx").withColumns({"_da": change, "_sunk": sunk}).agg(
        F.count_if(~F.col("alive") & F.col("_sunk")).alias("lost"),
        F.count_if(~F.col("alive") & ~F.col("_sunk")).alias("destroyed"),
        F.max("_da").alias("max_da_km"),
        # the first in catalogue order where several changed most
        F.min_by("id", F.when(F.col("_da").isNotNull(), F.struct((-F.col("_da")).alias("d"), "idx"))).alias("max_da_id"),
    )


def rcs_type_pivot(objects: DataFrame) -> DataFrame:
    kinds = C.OBJECT_TYPES
    return (
        objects.groupBy(text.rcs_key(F.col("rcs")).alias("rcs")).pivot("type", kinds).agg(F.count(F.lit(1)))
        .select("rcs", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k.lower().replace(" ", "_")) for k in kinds])
    )


def plot_extent(points: DataFrame) -> DataFrame:
    """Half-width of a cube that holds all points with a margin."""
    reach = F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))
    return points.agg((F.max(reach) * F.lit(1.05)).alias("extent_km"))


def snapshot_types(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Attach object types by id; unknown or empty becomes UNKNOWN."""
    known = types.select(F.col("id").alias("_id"), F.col("type").alias("_type"))
    return rows.join(known, F.col("id").cast("string") == F.col("_id"), "left").withColumn(
        "type", F.coalesce(F.nullif(F.col("_type"), F.lit("")), F.lit("UNKNOWN"))
    ).drop("_id", "_type")


def sample_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Reproducible sample without replacement, all rows if there are fewer.

    The order is a digest of seed and row, so it does not depend on the layout of the data, and
    the limit becomes a top-n per task.
    """
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("idx").cast("string")).cast("binary")), "idx").limit(n)


# --- time series ----------------------------------------------------------------------


def hourly(events: DataFrame, t_s: Column) -> DataFrame:
    """Tumbling hours: events per hour with count and total of `value`."""
    return events.groupBy(F.floor(t_s / F.lit(3600.0)).cast("bigint").alias("hour")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def cumulative(hours: DataFrame, columns: list[str]) -> DataFrame:
    """Running totals by hour; there is one row per hour, so one window holds them."""
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hours.select("hour", *columns, *[F.sum(c).over(w).alias(f"cum_{c}") for c in columns])


def recent(events: DataFrame, n: int = C.RECENT_EVENTS) -> DataFrame:
    """The newest n events: a top-n in every task, then one merge."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def time_block(ts: str, block_s: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(block_s)).cast("bigint")


def ema_by_key(rows: DataFrame, key: str, ts: str, tie: str, value: str, keep: float = C.EMA_KEEP, block_s: int = 60) -> DataFrame:
    """Exponential moving average per key after its last row, seeded with the first positive value.

    Values are durations, never negative. Rows are folded per key and block of `block_s` seconds, then blocks are chained
    (`ema_chain`): a key with a third of the rows is spread over its blocks.
    """
    row = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    blocks = rows.groupBy(key, time_block(ts, block_s).alias("block")).agg(F.collect_list(row).alias("items"))
    return ema_chain(blocks, key, keep)


def ema_chain(blocks: DataFrame, key: str, keep: float = C.EMA_KEEP, fan: int = 64) -> DataFrame:
    """(key, block, items) -> key, ema.

    A block acts on the average as e -> a*e + b once it is seeded, and gives `e` if it is not. Such steps compose, so blocks are
    folded `fan` at a time, level by level; no array is longer than that, however long a key's history is.
    """
    fresh = F.lit(1.0 - keep)

    def add_row(acc, r):
        seeded = F.when(acc.e > 0, F.lit(keep) * acc.e + fresh * r.v).otherwise(r.v)
        return F.struct((acc.a * F.lit(keep)).alias("a"), (acc.b * F.lit(keep) + fresh * r.v).alias("b"), seeded.alias("e"))

    def add_block(acc, r):
        return F.struct((r.a * acc.a).alias("a"), (r.a * acc.b + r.b).alias("b"), F.when(acc.e > 0, r.a * acc.e + r.b).otherwise(r.e).alias("e"))

    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("e"))
    level = blocks.select(key, "block", F.aggregate(F.array_sort("items"), start, add_row).alias("f")).select(key, "block", "f.*")
    for _ in range(4):  # 64^4 minutes are 32 years
        level = level.groupBy(key, F.floor(F.col("block") / F.lit(fan)).alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("block", "a", "b", "e"))).alias("steps")
        ).select(key, F.col("_up").alias("block"), F.aggregate("steps", start, add_block).alias("f")).select(key, "block", "f.*")
    steps = F.array_sort(F.collect_list(F.struct("block", "a", "b", "e")))
    return level.groupBy(key).agg(F.aggregate(steps, start, add_block, lambda acc: acc.e).alias("ema"))

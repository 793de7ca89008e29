"""The uniform grid: cell size, keys, occupancy, candidate counts and neighbourhoods."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions.vectors import cols, norm, sub
from .ordering import prefix_sum

# the 13 neighbours after a cell in lexicographic order: with the cell itself, every pair of
# touching cells comes up once
FORWARD = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]


def cell_size(states: DataFrame, dt: float, threshold_km: float, by: tuple[str, ...] = ()) -> DataFrame:
    """`cell_km`, one row (or one per `by`): wide enough that a close approach within `dt` stays in touching cells."""
    vrel = F.lit(2.0) * F.coalesce(F.max(norm(cols("vx", "vy", "vz"))), F.lit(0.0))
    return states.where("alive").groupBy(*by).agg(
        F.greatest(
            F.lit(C.MIN_CELL_KM),
            vrel * F.lit(dt) + F.lit(threshold_km) + F.lit(C.GRAVITY_GRADIENT) * vrel * F.lit(dt**3),
        ).alias("cell_km")
    )


def cell_index(c: Column, cell_km: float | Column) -> Column:
    width = cell_km if isinstance(cell_km, Column) else F.lit(float(cell_km))
    return F.floor(c / width).cast("bigint")


def pack(ix: Column, iy: Column, iz: Column) -> Column:
    """Three cell coordinates as one 63-bit key."""
    shifted = [(c + F.lit(C.KEY_OFFSET)).cast("bigint") for c in (ix, iy, iz)]
    return (
        F.shiftleft(shifted[0], 2 * C.KEY_BITS)
        .bitwiseOR(F.shiftleft(shifted[1], C.KEY_BITS))
        .bitwiseOR(shifted[2])
    )


def unpack(key: Column) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << C.KEY_BITS) - 1).cast("bigint")
    return tuple(
        F.shiftright(key, n * C.KEY_BITS).bitwiseAND(mask) - F.lit(C.KEY_OFFSET) for n in (2, 1, 0)
    )


def with_cell(df: DataFrame, cell_km: float | Column) -> DataFrame:
    df = df.withColumns({f"c{a}": cell_index(F.col(a), cell_km) for a in "xyz"})
    return df.withColumn("cell_key", pack(*cols("cx", "cy", "cz")))


def occupancy(df: DataFrame, cell_km: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Objects per occupied cell; combined on the map side, so a crowded cell is cheap."""
    return (
        with_cell(df.where("alive"), cell_km).groupBy(*by, "cell_key").agg(F.count("*").alias("n"))
    )


def occupancy_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("objects"),
        F.count("*").alias("cells"),
        F.coalesce(F.max("n"), F.lit(0)).alias("busiest"),
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("inner_pairs"),
    )


def candidate_pairs(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidate pairs per cell: inside it, and with its 13 forward neighbours.

    Works on one row per occupied cell. The pairs themselves are never produced, so the cost
    follows the number of cells and not the square of the objects in one of them.
    """
    ix, iy, iz = unpack(F.col("cell_key"))
    steps = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in o]) for o in FORWARD])
    reach = counts.select(
        *by, F.col("cell_key").alias("home"), F.col("n").alias("n_home"),
        ix.alias("_x"), iy.alias("_y"), iz.alias("_z"), F.explode(steps).alias("_o"),
    ).select(
        *by, "home", "n_home",
        pack(*[F.col(c) + F.col("_o")[k] for k, c in enumerate(("_x", "_y", "_z"))]).alias("cell_key"),
    )
    across = (
        reach.join(counts, [*by, "cell_key"])
        .groupBy(*by, F.col("home").alias("cell_key"))
        .agg(F.sum(F.col("n_home") * F.col("n")).alias("across"))
    )
    return counts.join(across, [*by, "cell_key"], "left").select(
        *by, "cell_key", "n",
        (F.expr("n * (n - 1) div 2") + F.coalesce("across", F.lit(0))).alias("pairs"),
    )


def cell_offsets(counts: DataFrame) -> DataFrame:
    """Where each cell's objects begin if objects are laid out in key order."""
    return prefix_sum(counts, F.col("cell_key"), F.col("n"), "begin", block=1 << C.KEY_BITS)


def neighbourhood(df: DataFrame, cell_km: float, seeds: DataFrame) -> DataFrame:
    """Objects in the cell of each seed object and in the 26 cells around it.

    Each seed opens 27 keys; the objects meet them in one equi-join.
    """
    offsets = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in o]) for o in product((-1, 0, 1), repeat=3)])
    around = with_cell(seeds, cell_km).select(
        F.col("idx").alias("seed"), "cx", "cy", "cz", F.explode(offsets).alias("_o")
    ).select(
        "seed", pack(*[F.col(c) + F.col("_o")[k] for k, c in enumerate(("cx", "cy", "cz"))]).alias("cell_key")
    )
    return with_cell(df, cell_km).join(around, "cell_key")


def occupied_cells(visible: DataFrame, cell_km: float) -> DataFrame:
    return with_cell(visible, cell_km).select("cell_key", "cx", "cy", "cz").distinct()


def nearest_cells(occupied: DataFrame, cell_km: float, eye, limit: int = C.NEAREST_CELLS) -> DataFrame:
    """The occupied cells whose centres are closest to a point."""
    centre = [(c + F.lit(0.5)) * F.lit(float(cell_km)) for c in cols("cx", "cy", "cz")]
    gap = norm(sub(centre, [F.lit(float(e)) for e in eye]))
    return occupied.withColumn("dist_km", gap).orderBy("dist_km", "cell_key").limit(limit)

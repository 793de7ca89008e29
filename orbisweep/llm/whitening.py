"""PCA whitening of embeddings by mixed-precision refinement.

Entries are put on an integer grid, so sums and products over all vectors are exact whatever the order of tasks. Three
passes over the distinct vectors: their count and sums; products of what is left after taking an integer near the mean
from every entry; the covariance of the result, as a measure of it. A task sends a few short arrays a pass, summed by
row number on the executors; the driver gets d rows of d numbers, d the dimension.

The covariance is known as a fraction of integers. Its eigenvectors start from a float32 solver; steps after Ogita and
Aishima, matrix products in extended precision, correct them all at once. Eigenvalues too close for a step to tell apart are a
cluster: the shifted covariance is projected on it, scaled up and solved on its own, and the steps go on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this are no grid numbers: they and their sums would leave the range of a long.
LARGEST = 1 << 61
WIDE = np.longdouble


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat entries as doubles, each row's first entry and each row's length; rows that do not count have length -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        bad = bad | ~np.isfinite(values) | ~(np.abs(values * SCALE) < LARGEST)
    starts = np.cumsum(lengths) - lengths
    wrong = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(bad, out=wrong[1:])
    usable = (wrong[starts + lengths] == wrong[starts]) & (lengths > 0)
    return values, starts, np.where(usable, lengths, -1)


def _grid(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and grid vectors, without the offset, of the rows that count."""
    values, starts, lengths = _values(column)
    rows = np.flatnonzero(lengths == dimension)
    picked = values[starts[rows][:, None] + np.arange(dimension)] if len(rows) else np.zeros((0, dimension))
    return rows, np.floor(picked * SCALE).astype(np.int64)


def _packed(grid: np.ndarray) -> list[bytes]:
    """One string of bytes per vector, in the narrowest width that holds its entries: equal for equal vectors."""
    top = np.abs(grid).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(grid)
    for lower, upper, kind in ((-1, 1 << 14, "<i2"), ((1 << 14), 1 << 30, "<i4"), (1 << 30, 1 << 62, "<i8")):
        chosen = np.flatnonzero((top > lower) & (top <= upper))
        if len(chosen):
            body, width = grid[chosen].astype(kind).tobytes(), grid.shape[1] * np.dtype(kind).itemsize
            for k, row in enumerate(chosen):
                out[row] = body[k * width: (k + 1) * width]
    return out


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.zeros((len(values), dimension), np.int64)
    widths = np.array([len(v) // dimension for v in values], np.int64)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        out[chosen] = np.frombuffer(b"".join(values[i] for i in chosen), f"<i{width}").reshape(-1, dimension)
    return out


class _Sums:
    """Exact sums of integer arrays: in longs while they fit, else in Python's integers."""

    def __init__(self, shape):
        self.near, self.far, self.bound = np.zeros(shape, np.int64), None, 0

    def add(self, part: np.ndarray, bound: int) -> None:
        """`part` is an int64 or object array with no entry above `bound`."""
        if part.dtype == object or self.bound + bound >= 1 << 62:
            self.far = self.near.astype(object) if self.far is None else self.far + self.near.astype(object)
            self.near, self.bound = np.zeros_like(self.near), 0
        if part.dtype == object:
            self.far = self.far + part
        else:
            self.near, self.bound = self.near + part, self.bound + bound

    def total(self) -> np.ndarray:
        return self.near if self.far is None else self.far + self.near.astype(object)


#: Partial sums as decimal strings, which hold integers of any size.
PART = "i int, n long, sums array<string>"


def _part(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([[str(v) for v in r[2].tolist()] for r in rows], pa.list_(pa.string()))], ["i", "n", "sums"])


def _numbers(row) -> np.ndarray:
    return np.array([int(v) for v in row["sums"]], object)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            n, sums = found.get(r["i"], (0, 0))
            found[r["i"]] = n + r["n"], sums + _numbers(r)
    if found:
        yield _part([(i, n, sums) for i, (n, sums) in found.items()])


def _gathered(parts: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(count, exact sums) by row number; the rows are as many as their numbers, whatever the data."""
    found = parts.repartition("i").mapInArrow(_added, PART).collect()
    return {r["i"]: (r["n"], _numbers(r).tolist()) for r in found}


SPREAD = 64  # partial vector sums meet in so many rows


def _vector_sums(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, first = _Sums(dimension), 0, 0
        for batch in batches:
            grid = _unpacked(batch["x"], dimension)
            if not len(grid):
                continue
            first = first or int(np.abs(grid[0]).sum()) + 1
            n += len(grid)
            top = int(np.abs(grid).max())
            part = grid.sum(axis=0) if top * len(grid) < 1 << 62 else grid.astype(object).sum(axis=0)
            sums.add(part, top * len(grid))
        if n:
            yield _part([(first % SPREAD, n, sums.total())])

    return run


def _product_sums(dimension: int, centre: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, at = _Sums((dimension, dimension)), 0, np.array(centre, np.int64)
        for batch in batches:
            away = _unpacked(batch["x"], dimension) - at
            n += len(away)
            top = int(np.abs(away).max(initial=0))
            if top >= 1 << 25:
                wide = away.astype(object)
                sums.add(wide.T @ wide, 0)
                continue
            step = max(1, (1 << 52) // max(1, top * top))  # products of doubles stay exact
            for lo in range(0, len(away), step):
                some = away[lo: lo + step].astype(np.float64)
                sums.add((some.T @ some).astype(np.int64), top * top * len(some))
        if n:
            total = sums.total()
            yield _part([(i, n, total[i]) for i in range(dimension)])

    return run


class Whitening(NamedTuple):
    """n vectors with sums S (offset included); the kept components, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues e
    vectors: np.ndarray  # one component a column
    explained: np.ndarray


def _products(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What X'X lacks to the identity, and X'AX."""
    s = x.T @ (a @ x)
    return np.eye(x.shape[1], dtype=WIDE) - x.T @ x, (s + s.T) / 2


def _clusters(values: np.ndarray, within: float) -> list[np.ndarray]:
    """Runs of sorted eigenvalues, neighbours at most `within` apart, of two or more."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > within) + 1
    return [part for part in np.split(order, cut) if len(part) > 1]


def refined_eigenvectors(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric `a`, in extended precision.

    A float32 solver gives the start. A step takes R = I - X'X and S = X'AX, reads eigenvalues s_ii / (1 - r_ii) and
    corrects X by X E with e_ij = (s_ij + l_j r_ij) / (l_j - l_i), which squares the error. Where l_i and l_j
    differ by less than what the step cannot see (twice the off-diagonal of S and |A| |R|), e_ij = r_ij / 2 only
    makes the columns orthogonal, and the cluster they form is solved on its own: its projected block, shifted by its mean and
    scaled to 1, has eigenvalues far apart again.
    """
    a = np.asarray(a, WIDE)
    size = float(np.max(np.abs(a), initial=0))
    if not size:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / WIDE(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    norm = float(np.sqrt((a * a).sum()))
    unit = float(np.finfo(WIDE).eps)
    seen = 32 * unit * max(norm, 1.0)  # rounding of the products
    for _ in range(rounds):
        r, s = _products(x, a)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        if float(np.abs(off).max()) <= seen and float(np.abs(r).max()) <= seen:
            break
        blind = 2 * (float(np.sqrt((off * off).sum())) + norm * float(np.sqrt((r * r).sum())))
        gap = values[None, :] - values[:, None]  # l_j - l_i
        close = np.abs(gap) <= blind
        x = x + x @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        for group in _clusters(np.asarray(values, np.float64), blind):
            if float(np.abs(off[np.ix_(group, group)]).max()) > seen:
                _solve_cluster(a, x, group, unit)
    r = _products(x, a)[0]
    x = x + x @ r / 2  # nearest columns at right angles, which keeps what they span
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * WIDE(size), x[:, order]


def _solve_cluster(a: np.ndarray, x: np.ndarray, group: np.ndarray, unit: float) -> None:
    """Turns the columns `group` of x to the eigenvectors of `a` seen from their span."""
    part = x[:, group]
    mean = ((part * (a @ part)).sum(axis=0) / (part * part).sum(axis=0)).mean()
    block = part.T @ (a @ part - mean * part)  # A shifted before it is multiplied: what is left is the cluster's own spread
    block = (block + block.T) / 2
    spread = np.abs(block).max()
    if float(spread) > 4 * unit:
        x[:, group] = part @ np.linalg.eigh((block / spread).astype(np.float64))[1].astype(WIDE)


def _wide(number: int) -> np.longdouble:
    """An integer of any size in extended precision: its leading bits exactly, the rest as a second term."""
    shift = max(0, abs(number).bit_length() - 60)
    high = number >> shift
    return np.ldexp(WIDE(high), shift) + np.ldexp(WIDE(number - (high << shift) >> max(0, shift - 60)), max(0, shift - 60))


def dimension_of(vectors: DataFrame, column: str = "embedding") -> int:
    """The commonest length of a usable vector, of equally common ones the largest; 0 without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, counts = np.unique(_values(batch["v"])[2], return_counts=True)
            yield pa.RecordBatch.from_pydict({"size": pa.array(lengths, pa.int64()), "rows": pa.array(counts, pa.int64())})

    found = vectors.select(F.col(column).alias("v")).mapInArrow(run, "size long, rows long").where("size > 0")
    top = found.groupBy("size").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def fit_list(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Each distinct grid vector once, as bytes; copies meet in the task that reads them before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array(_packed(_grid(batch["v"], dimension)[1]), pa.binary())})

    return vectors.select(F.col(column).alias("v")).mapInArrow(run, "x binary").distinct()


def fit(fit_rows: DataFrame, dimension: int, components: int = 16) -> Whitening | None:
    """Mean and leading components of a written fit list. Components whose eigenvalue is no more than rounding (fewer
    vectors than dimensions, dimensions that depend on each other) are left out; None without rows."""
    parts = _gathered(fit_rows.mapInArrow(_vector_sums(dimension), PART))
    n = sum(p[0] for p in parts.values())
    if not n:
        return None
    sums = [sum(p[1][k] for p in parts.values()) for k in range(dimension)]
    centre = [s // n for s in sums]
    products = _gathered(fit_rows.mapInArrow(_product_sums(dimension, centre), PART))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    # n^2 V = n * sum (x - c)(x - c)' - rest rest', in integers
    exact = np.array([[_wide(n * products[i][1][j] - rest[i] * rest[j]) for j in range(dimension)] for i in range(dimension)], WIDE)
    cov = exact / _wide(n) / _wide(n)
    values, vectors = refined_eigenvectors(cov)
    trace = np.trace(cov)
    kept = int(np.sum(values[:components] > max(values[0], 0) * dimension * np.finfo(np.float64).eps))
    share = values[:kept] / trace if trace > 0 else values[:0]
    return Whitening(n, [s + n * OFFSET for s in sums], values[:kept].astype(np.float64), vectors[:, :kept].astype(np.float64), share.astype(np.float64))


def _projection(model: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer centre, what is left of the mean, and the columns to multiply with."""
    centre = [s // model.n - OFFSET for s in model.sums]
    rest = [(s - model.n * (s // model.n)) / model.n for s in model.sums]
    return np.array(centre, np.int64), np.array(rest), model.vectors / np.sqrt(model.values)


def _whitened(grid: np.ndarray, projection) -> np.ndarray:
    centre, rest, columns = projection
    return ((grid - centre).astype(np.float64) - rest) @ columns


def identity_error(fit_rows: DataFrame, dimension: int, model: Whitening) -> float:
    """The largest entry of |covariance of the whitened fit list - identity|."""
    projection, size = _projection(model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            white = _whitened(_unpacked(batch["x"], dimension), projection)
            if not len(white):
                continue
            m, here = white.mean(axis=0), len(white)
            away, apart = white - m, m - mean
            spread = spread + away.T @ away + np.outer(apart, apart) * (n * here / (n + here))
            n, mean = n + here, mean + apart * (here / (n + here))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(spread + n * np.outer(mean, mean))), pa.array([mean * n] * size)],
                ["i", "n", "products", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                t = totals.setdefault(r["i"], [0, 0.0, 0.0])
                t[0], t[1], t[2] = t[0] + r["n"], t[1] + np.array(r["products"]), t[2] + np.array(r["sums"])
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([t[0] for t in totals.values()], pa.int64()),
                 pa.array([t[1] for t in totals.values()]), pa.array([t[2] for t in totals.values()])], ["i", "n", "products", "sums"])

    if not size:
        return 0.0
    schema = "i int, n long, products array<double>, sums array<double>"
    rows = sorted(fit_rows.mapInArrow(run, schema).repartition("i").mapInArrow(added, schema).collect(), key=lambda r: r["i"])
    mean = np.array(rows[0]["sums"]) / model.n  # of centred values: rounding only
    cov = np.array([r["products"] for r in rows]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(size)).max())


def _deviations(grid: np.ndarray, model: Whitening) -> list[int | None]:
    n, sums = model.n, [s - model.n * OFFSET for s in model.sums]
    top = max([abs(s) for s in sums], default=0) + n * int(np.abs(grid).max(initial=0))
    if grid.shape[1] * top * top < 1 << 62:
        away = n * grid - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * grid.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (int(v) for v in (away * away).sum(axis=1))]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 16) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds a null, NaN or infinite entry or one beyond 2^61 / 64, or has another
    length than most (`dimension_of`) are left out. Repeated rows and null keys are kept, copies count once in the
    fit. Components without spread are left out, so equal vectors alone, like an empty table, give no rows. deviation is
    null where it exceeds a long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    dimension = dimension_of(vectors, column)
    if not dimension:
        return spark.createDataFrame([], OUT)
    rows = materialize(fit_list(vectors, dimension, column), "fit-list")
    model = fit(rows, dimension, components)
    error = identity_error(rows, dimension, model)
    discard(rows)
    projection, size = _projection(model), len(model.values)
    if not size:
        return spark.createDataFrame([], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, grid = _grid(batch["v"], dimension)
            white = _whitened(grid, projection)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch["key"].take(pa.array(np.repeat(kept, size))), "component": pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(kept))),
                "n": pa.array(np.full(len(kept) * size, model.n)), "deviation": pa.array(_deviations(grid, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(kept)), size))),
                "whitened": pa.array(white.ravel()), "explained": pa.array(np.tile(model.explained, len(kept))),
                "identity_error": pa.array(np.full(len(kept) * size, error)),
            })

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("v")).mapInArrow(run, OUT)

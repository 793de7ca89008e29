"""Multi-step propagation: NumPy inside Arrow batches, one pass over the objects.

Objects do not influence each other between collisions, so a run of many steps is a map over
objects. Every task steps its own batches through time; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import kernels
from ..schemas import STATE, STATE_DDL

CHUNK = 8192  # objects stepped together: enough to hide call overhead, few enough for the caches
EMIT_ROWS = 65536


def spread(df: DataFrame, tasks: int | None = None, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """At least `tasks` partitions (default: one per core): few input files must not mean few tasks.

    Looks at the list of input files only; nothing runs while a plan is built.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= tasks else df.repartition(tasks, *by)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _chunks(batches, limit: int = CHUNK):
    for batch in batches:
        idx = _column(batch, "idx")
        alive = _column(batch, "alive").astype(bool)
        state = np.stack([_column(batch, c) for c in STATE]).astype(float)
        # equal parts, so that no short rest pays the call overhead alone
        parts = max(1, math.ceil(len(idx) / limit))
        size = max(1, math.ceil(len(idx) / parts))
        for lo in range(0, len(idx), size):
            cut = slice(lo, lo + size)
            yield idx[cut], alive[cut].copy(), np.ascontiguousarray(state[:3, cut]), np.ascontiguousarray(state[3:, cut])


def _advance(r, v, alive, dt, moons):
    """Step live objects; returns new arrays and updates `alive` for those below ground."""
    m0, m1, m2 = (m[:, None] for m in moons)
    nr, nv = kernels.rk4_step(r, v, dt, m0, m1, m2)
    if not alive.all():
        nr = np.where(alive, nr, r)
        nv = np.where(alive, nv, v)
    alive &= (nr * nr).sum(axis=0) >= C.R_EARTH * C.R_EARTH
    return nr, nv


def _moon_table(epoch_jd, dt, first_step, steps):
    """Moon at start, middle and end of each step: three small arrays per run."""
    t0 = (first_step + np.arange(steps)) * dt
    return kernels.moon_for_steps(epoch_jd, t0, dt)


def step_states(objects: DataFrame, epoch_jd: float, dt: float, first_step: int, steps: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Start-of-step state of every object that is still alive at the end of the step.

    Columns: step, idx, x..vz. `carry` names extra columns of numbers to keep; a null double becomes NaN.
    """
    moons = _moon_table(epoch_jd, dt, first_step, steps)
    names = ["step", "idx", *STATE, *carry]

    def run(batches):
        for batch in batches:
            extra_all = [_column(batch, c) for c in carry]
            start = 0
            for idx, alive, r, v in _chunks([batch]):
                extra = [e[start : start + len(idx)] for e in extra_all]
                start += len(idx)
                parts, rows = [], 0
                for n in range(steps):
                    if not alive.any():
                        break
                    nr, nv = _advance(r, v, alive, dt, tuple(m[:, n] for m in moons))
                    keep = slice(None) if alive.all() else alive
                    ids = idx[keep]
                    parts.append(
                        [np.full(len(ids), first_step + n, dtype=np.int32), ids,
                         *[a[keep] for a in r], *[a[keep] for a in v], *[e[keep] for e in extra]]
                    )
                    rows += len(ids)
                    r, v = nr, nv
                    if rows >= EMIT_ROWS:
                        yield _batch(parts, names)
                        parts, rows = [], 0
                if rows:
                    yield _batch(parts, names)

    source = objects.where("alive").select("idx", "alive", *STATE, *carry)
    # never null: expressions over these columns compile without null checks
    ddl = ", ".join(["step int", "idx bigint", *STATE_DDL.split(", "), *[f"{c} {source.schema[c].dataType.simpleString()}" for c in carry]])
    return spread(source).mapInArrow(run, ddl.replace(",", " NOT NULL,") + " NOT NULL")


def _batch(parts, names):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([p[n] for p in parts])) for n in range(len(names))], names=names
    )


def advance(objects: DataFrame, epoch_jd: float, dt: float, first_step: int, steps: int) -> DataFrame:
    """Objects after `steps` steps; all other columns stay as they are.

    Only state and `alive` go to Python and back.
    """
    moons = _moon_table(epoch_jd, dt, first_step, steps)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for series in batches:
            live, state = series[0].to_numpy().astype(bool), np.stack([c.to_numpy() for c in series[1:]]).astype(float)
            moved, still = np.empty_like(state), np.empty_like(live)
            parts = max(1, math.ceil(len(live) / CHUNK))
            size = max(1, math.ceil(len(live) / parts))
            for lo in range(0, len(live), size):
                cut = slice(lo, lo + size)
                r, v, alive = np.ascontiguousarray(state[:3, cut]), np.ascontiguousarray(state[3:, cut]), live[cut].copy()
                for n in range(steps):
                    if not alive.any():
                        break
                    r, v = _advance(r, v, alive, dt, tuple(m[:, n] for m in moons))
                moved[:3, cut], moved[3:, cut], still[cut] = r, v, alive
            yield pd.DataFrame({**dict(zip(STATE, moved)), "alive": still})

    # not deterministic only in name: a filter on the outcome must not run the steps a second time
    step = F.pandas_udf(run, STATE_DDL + ", alive boolean").asNondeterministic()
    out = spread(objects).withColumn("_moved", step("alive", *STATE))
    changed = {*STATE, "alive"}
    return out.select(*[F.col(f"_moved.{c}").alias(c) if c in changed else F.col(c) for c in objects.columns])


def step_rows(df: DataFrame, epoch_jd: float, t: str, duration: str) -> DataFrame:
    """Move every row's state by its own duration from its own instant, in one step.

    `t` and `duration` name columns in seconds; rows with no duration left stay as they are. A
    Runge-Kutta step written as nested expressions would be copied into every filter that
    Catalyst pushes below it, so the arithmetic runs on Arrow batches instead.
    """
    columns = df.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            r = np.stack([_column(batch, c) for c in STATE[:3]]).astype(float)
            v = np.stack([_column(batch, c) for c in STATE[3:]]).astype(float)
            h = _column(batch, duration).astype(float)
            # rows of one breakup share instant and duration
            times, place = np.unique(np.stack([_column(batch, t).astype(float), h]), axis=1, return_inverse=True)
            jd = epoch_jd + times[0] / C.SECONDS_PER_DAY
            moons = [kernels.moon_position(jd + f * times[1] / C.SECONDS_PER_DAY)[:, place] for f in (0.0, 0.5, 1.0)]
            nr, nv = kernels.rk4_step(r, v, h, *moons)
            moved = dict(zip(STATE, np.concatenate([np.where(h > 0, nr, r), np.where(h > 0, nv, v)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(moved[c]) if c in moved else batch.column(batch.schema.get_field_index(c)) for c in columns],
                names=columns,
            )

    return df.mapInArrow(run, df.schema)


def sample_states(objects: DataFrame, epoch_jd: float, dt: float, steps: int, every: int, first_step: int = 0, include_start: bool = True) -> DataFrame:
    """States at every `every`-th step of a run: step, t_s, idx, x..vz, alive."""
    moons = _moon_table(epoch_jd, dt, first_step, steps)
    names = ["step", "t_s", "idx", *STATE, "alive"]

    def rows(step, idx, r, v, alive):
        return [np.full(len(idx), step, dtype=np.int32), np.full(len(idx), step * dt), idx, *r, *v, alive.copy()]

    def run(batches):
        for idx, alive, r, v in _chunks(batches):
            parts, count = [], 0
            if include_start:
                parts.append(rows(first_step, idx, r, v, alive))
            for n in range(steps):
                r, v = _advance(r, v, alive, dt, tuple(m[:, n] for m in moons))
                if (first_step + n + 1) % every == 0:
                    parts.append(rows(first_step + n + 1, idx, r, v, alive))
                    count += len(idx)
                if count >= EMIT_ROWS:
                    yield _batch(parts, names)
                    parts, count = [], 0
            if parts:
                yield _batch(parts, names)

    ddl = "step int, t_s double, idx bigint, " + STATE_DDL + ", alive boolean"
    return spread(objects.select("idx", "alive", *STATE)).mapInArrow(run, ddl)


def kill_below_ground(objects: DataFrame) -> DataFrame:
    """Re-entry: whatever is below the surface is no longer alive."""
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return objects.withColumn("alive", F.col("alive") & (F.sqrt(r2) >= F.lit(C.R_EARTH)))


#: Spans up to which the Moon's path follows from this many points to the last bits of a double (its fastest term turns 0.4 rad in half a day).
MOON_SPAN_S, MOON_POINTS = 43_200.0, 16


def _moon_paths(jd0: float, span: np.ndarray, places: int) -> np.ndarray:
    """Moon at `places` equal places from the start to the end of each object's span (seconds): (places, 3, n).

    Interpolated from Chebyshev points for spans up to `MOON_SPAN_S`, worked out at every place for longer ones.
    """
    at = np.linspace(0.0, 1.0, places)
    out = np.empty((places, 3, len(span)))
    short = span <= MOON_SPAN_S
    if short.any():
        angle = np.pi * (np.arange(MOON_POINTS) + 0.5) / MOON_POINTS
        knots = 0.5 - 0.5 * np.cos(angle)
        gap = at[:, None] - knots
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (-1.0) ** np.arange(MOON_POINTS) * np.sin(angle) / gap
            share /= share.sum(axis=1, keepdims=True)
        share = np.where((gap == 0).any(axis=1, keepdims=True), gap == 0, share)
        known = kernels.moon_position(jd0 + knots[:, None] * span[short] / C.SECONDS_PER_DAY)
        out[:, :, short] = np.einsum("pk,ckn->pcn", share, known, optimize=True)
    for k in range(places) if not short.all() else ():
        out[k][:, ~short] = kernels.moon_position(jd0 + at[k] * span[~short] / C.SECONDS_PER_DAY)
    return out


def orbit_samples(objects: DataFrame, epoch_jd: float, t_s: float, samples: int) -> DataFrame:
    """One full revolution of every object in `samples` steps of its own period.

    Columns: idx, points (array of x, y, z), r_min, r_max, perigee_alt, apogee_alt,
    eccentricity. Objects without a closed orbit of at most 40 days give no row.
    """
    max_minutes = 60.0 * 24.0 * 40.0
    jd0 = epoch_jd + t_s / C.SECONDS_PER_DAY

    def run(batches):
        # whole paths are held, so fewer objects at a time
        for idx, _, r, v in _chunks(batches, 1024):
            rn = np.sqrt((r * r).sum(axis=0))
            a = -C.MU_EARTH / (2.0 * ((v * v).sum(axis=0) / 2.0 - C.MU_EARTH / rn))
            with np.errstate(invalid="ignore"):
                minutes = np.where(a > 0, 2.0 * np.pi * np.sqrt(a**3 / C.MU_EARTH) / 60.0, 0.0)
            ok = (minutes > 0) & (minutes <= max_minutes)
            if not ok.any():
                continue
            idx, r, v = idx[ok], r[:, ok], v[:, ok]
            dt = minutes[ok] * 60.0 / samples
            path = np.empty((len(idx), samples + 1, 3))
            moons = _moon_paths(jd0, dt * samples, 2 * samples + 1)
            for k in range(samples + 1):
                path[:, k, :] = r.T
                if k == samples:
                    break
                r, v = kernels.rk4_step(r, v, dt, *moons[2 * k : 2 * k + 3])
            radius = np.sqrt((path * path).sum(axis=2))
            lo, hi = radius.min(axis=1), radius.max(axis=1)
            flat = path.reshape(-1, 3)
            points = pa.StructArray.from_arrays([pa.array(flat[:, n]) for n in range(3)], names=["x", "y", "z"])
            offsets = pa.array(np.arange(0, len(flat) + 1, samples + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(idx), pa.ListArray.from_arrays(offsets, points), pa.array(lo), pa.array(hi),
                 pa.array(lo - C.R_EARTH), pa.array(hi - C.R_EARTH), pa.array((hi - lo) / (hi + lo))],
                names=["idx", "points", "r_min", "r_max", "perigee_alt", "apogee_alt", "eccentricity"],
            )

    ddl = (
        "idx bigint, points array<struct<x: double, y: double, z: double>>, r_min double, r_max double, "
        "perigee_alt double, apogee_alt double, eccentricity double"
    )
    return spread(objects.select("idx", "alive", *STATE)).mapInArrow(run, ddl)

"""Breakups: from collisions to events to fragments.

`events` has one row per breakup with the two parents side by side: columns t_* belong to the
heavier one (the target), p_* to the projectile, each with idx, name, mass_kg, size_m and the
state x..vz at the instant of the collision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import constants as C
from ..functions import debris, rng, sbm
from ..functions.vectors import cols, cross, dot, norm, scale, sub
from ..schemas import OBJECT_COLUMNS, STATE
from ..session import materialize
from .ordering import prefix_sum
from .propagate import step_rows

PARENT = ["idx", "name", "mass_kg", "size_m", *STATE]


@dataclass(frozen=True)
class BreakupConfig:
    lc_m: float = C.DEFAULT_LC_M
    catastrophic_j_per_g: float = C.CATASTROPHIC_J_PER_G
    seed: int = 1
    #: At most so many fragments per event; what that cuts is reported. None: as many as the model draws.
    max_fragments: int | None = None


def order_parents(pairs: DataFrame) -> DataFrame:
    """Columns i_* and j_* to t_* (the heavier, i on a tie) and p_*."""
    i_heavier = F.col("i_mass_kg") >= F.col("j_mass_kg")
    pick = lambda first, a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rest = [c for c in pairs.columns if c[:2] not in ("i_", "j_")]
    return pairs.select(
        *rest,
        *[pick(i_heavier, f"i_{c}", f"j_{c}").alias(f"t_{c}") for c in PARENT],
        *[pick(i_heavier, f"j_{c}", f"i_{c}").alias(f"p_{c}") for c in PARENT],
    )


def with_energy(events: DataFrame, cfg: BreakupConfig) -> DataFrame:
    """Add v_rel, specific energy, class, the two mass budgets and the expected count."""
    vt, vp = cols("t_vx", "t_vy", "t_vz"), cols("p_vx", "p_vy", "p_vz")
    out = events.withColumn("v_rel_km_s", norm(sub(vt, vp)))
    mt, mp, v = cols("t_mass_kg", "p_mass_kg", "v_rel_km_s")
    out = out.withColumn("energy_j_per_g", sbm.specific_energy(mp, v, mt))
    out = out.withColumn("catastrophic", F.col("energy_j_per_g") >= F.lit(cfg.catastrophic_j_per_g))
    bt, bp = sbm.budgets(F.col("catastrophic"), mt, mp, v)
    out = out.withColumns({"t_budget": bt, "p_budget": bp})
    out = out.withColumn("sbm_mass_kg", F.col("t_budget") + F.col("p_budget"))
    return out.withColumn("expected_fragments", sbm.expected_fragments(F.col("sbm_mass_kg"), cfg.lc_m))


def dealt(events: DataFrame, *keys: str) -> DataFrame:
    """Events dealt out to every task the session shuffles into.

    Rows of events are few and small, but each is much work, so their bytes must not decide on the number of tasks.
    """
    spark = events.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return events.repartition(tasks, *(keys or ("event",)))


def with_count(events: DataFrame, cfg: BreakupConfig) -> DataFrame:
    """Add `drawn`, the Poisson number of fragments, and `truncated`, how many a configured limit cut; written down.

    Tries are numbered and `TRIES` of them looked at together; the first accepted one counts. An event without any goes on with the
    next numbers, which happens once in 10^20 events.
    """
    left, first, done = materialize(events, "counting"), 0, None
    while True:
        rows = left.select("event", F.col("expected_fragments").alias("mean"))
        large = F.col("mean") >= rng.SMALL_MEAN
        tries = dealt(rows.where(large)).select("event", "mean", F.explode(F.sequence(F.lit(first), F.lit(first + TRIES - 1))).alias("try"))
        tries = tries.withColumn("d", rng.digest(cfg.seed, F.col("event"), F.col("try"), 0))
        tried = rng.with_poisson_try(tries, F.col("mean"), rng.uniform(F.col("d"), 0), rng.uniform(F.col("d"), 1), "n")
        counts = tried.where("n IS NOT NULL").groupBy("event").agg(F.min_by("n", "try").alias("_n"))
        u = rng.uniform(rng.digest(cfg.seed, F.col("event"), F.lit(0), 0), 0)
        inverted = rows.where(~large & (F.col("mean") > 0)).select("event", rng.poisson_inverted(F.col("mean"), u).alias("_n"))
        none = rows.where(~(F.col("mean") > 0) | F.col("mean").isNull()).select("event", F.lit(0).cast("bigint").alias("_n"))
        part = materialize(left.join(counts.union(inverted).union(none), "event", "left"), "events")
        counted = part.where("_n IS NOT NULL")
        done = counted if done is None else done.unionByName(counted)
        if part.where("_n IS NULL").isEmpty():
            break
        left, first = part.where("_n IS NULL").drop("_n"), first + TRIES
    drawn = F.col("_n") if cfg.max_fragments is None else F.least("_n", F.lit(cfg.max_fragments).cast("bigint"))
    return done.withColumns({"drawn": drawn, "truncated": F.col("_n") - drawn}).drop("_n")


#: Tries of a Poisson count that are looked at together.
TRIES = 32
#: Draws of an event that one task makes and settles against the budgets in one go; larger events are cut into such blocks.
BLOCK = 1 << 16
FRAGMENT = (
    "event long, t double, remaining_s double, k long, side int, budget double, size_m double, area_to_mass double, mass_kg double, "
    "rcs string, x double, y double, z double, vx double, vy double, vz double"
)
_NEEDED = ["event", "t", "remaining_s", "v_rel_km_s", "sbm_mass_kg", *[f"{s}_{c}" for s in "tp" for c in ("budget", "size_m", *STATE)]]
_NAMES = [part.split(" ")[0] for part in FRAGMENT.split(", ")]
_KINDS = {"event": pa.int64(), "k": pa.int64(), "side": pa.int32(), "rcs": pa.string()}


def _drawn(cfg: BreakupConfig, budgeted: bool):
    """Over rows of events with `first` and `last`: the fragments in between; with `budgeted` those that the budgets can pay for."""
    seed, lc = cfg.seed, cfg.lc_m

    def run(batches):
        for batch in batches:
            for event in batch.to_pylist():
                used = [0.0, 0.0]
                for lo in range(event["first"], event["last"] + 1, BLOCK):
                    found = debris.draw(event, lo, min(event["last"], lo + BLOCK - 1), seed, lc)
                    n = len(found["k"])
                    if budgeted:
                        keep = np.zeros(n, bool)
                        for side, budget in enumerate((event["t_budget"], event["p_budget"])):
                            mine = np.flatnonzero(found["side"] == side)
                            keep[mine], used[side] = take_within_budget(found["mass_kg"][mine], budget, used[side])
                        found, n = {c: v[keep] for c, v in found.items()}, int(keep.sum())
                    found |= {c: np.full(n, event[c]) for c in ("event", "t", "remaining_s")}
                    yield pa.RecordBatch.from_arrays([pa.array(found[c], _KINDS.get(c, pa.float64())) for c in _NAMES], _NAMES)

    return run


def draw_fragments(events: DataFrame, cfg: BreakupConfig) -> DataFrame:
    """Every fragment of counted events, before mass budget and escape are applied.

    One row per (event, k): side (0 target, 1 projectile), size, A/m, mass and birth state.
    A large event is dealt out in blocks of draws to many tasks. Random numbers come from digests, so it does not matter to which.
    """
    size = F.lit(BLOCK)
    blocks = events.where("drawn > 0").select(
        *_NEEDED, "drawn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("drawn") - 1) / size))).alias("_block"))
    first = F.col("_block") * size + 1
    parts = blocks.select(*_NEEDED, "_block", first.alias("first"), F.least(F.col("drawn"), first + size - 1).alias("last"))
    return dealt(parts, "event", "_block").mapInArrow(_drawn(cfg, False), FRAGMENT)


def take_within_budget(masses: np.ndarray, budget: float, used: float = 0.0) -> tuple[np.ndarray, float]:
    """Greedy running sum: skip an item that would exceed the budget, go on with the rest.

    Returns which items are taken and the sum after them; `used` is the sum before.
    """
    taken, start = np.zeros(len(masses), dtype=bool), 0
    while start < len(masses):
        # everything up to the first item that does not fit is taken at once
        total = np.cumsum(np.concatenate(([used], masses[start:])))[1:]
        over = np.flatnonzero(total > budget)
        stop = start + (over[0] if len(over) else len(total))
        taken[start:stop] = True
        if stop > start:
            used = float(total[stop - start - 1])
        # skip what cannot fit any more
        rest = np.flatnonzero(masses[stop:] + used <= budget)
        if not len(rest):
            break
        start = stop + rest[0]
    return taken, used


def _fold_budget(batches):
    """Over fragments sorted by event, side and k: those that the rest of the budget (`room`) can pay for."""
    parent, used = None, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = {n: batch[n].to_numpy(zero_copy_only=False) for n in ("event", "side", "mass_kg", "room")}
        change = np.flatnonzero((np.diff(table["event"]) != 0) | (np.diff(table["side"]) != 0)) + 1
        taken = np.zeros(batch.num_rows, dtype=bool)
        for lo, hi in zip([0, *change], [*change, batch.num_rows]):
            this = (table["event"][lo], table["side"][lo])
            if this != parent:
                parent, used = this, 0.0
            taken[lo:hi], used = take_within_budget(table["mass_kg"][lo:hi], table["room"][lo], used)
        yield batch.select(["event", "side", "k", "mass_kg"]).filter(pa.array(taken))


def within_budget(fragments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Keep the fragments their parent's mass can pay for, in drawing order; an event may have any number of fragments.

    Draws are summed in blocks. Blocks that fit as a whole before the first one that does not are taken as they are, wherever their rows
    lie. That one block is opened and walked; what it leaves of the budget rules out, in all tasks at once, every
    later fragment that is heavier, most of them. This is repeated on what is left until every parent's rest fits in one block, which
    is walked. So no task holds more than a block of one parent, and the rounds are few: each leaves less than the lightest refused
    fragment of its block.
    """
    key = ["event", "side"]
    walk = lambda rows: rows.repartition(*key).sortWithinPartitions(*key, "k").mapInArrow(_fold_budget, "event long, side int, k long, mass_kg double")
    settled = materialize(fragments, "draws")
    live = settled.select(*key, "k", "mass_kg", F.col("budget").alias("room"))
    taken = []
    while True:
        counts = live.groupBy(*key).agg(F.count("*").alias("n"))
        long_ = materialize(counts.where(F.col("n") > block).select(*key), "long")
        if long_.isEmpty():
            taken.append(walk(live).select(*key, "k"))
            break
        taken.append(walk(live.join(long_, key, "left_anti")).select(*key, "k"))
        rest = materialize(live.join(long_, key, "left_semi").withColumn("block", F.floor(F.col("k") / F.lit(block))), "live")
        sums = rest.groupBy(*key, "block").agg(F.sum("mass_kg").alias("kg"), F.first("room").alias("room"))
        so_far = F.sum("kg").over(Window.partitionBy(*key).orderBy("block"))
        totals = sums.withColumn("total", so_far)
        stop = totals.groupBy(*key).agg(
            F.min(F.when(F.col("total") > F.col("room"), F.col("block"))).alias("opened"),
            F.coalesce(F.max(F.when(F.col("total") <= F.col("room"), F.col("total"))), F.lit(0.0)).alias("spent"))
        marked = rest.join(stop, key)
        taken.append(marked.where(F.col("opened").isNull() | (F.col("block") < F.col("opened"))).select(*key, "k"))
        opened = marked.where("block = opened").withColumn("room", F.col("room") - F.col("spent"))
        walked = materialize(walk(opened.select(*key, "k", "mass_kg", "room")), "walked")
        taken.append(walked.select(*key, "k"))
        used = walked.groupBy(*key).agg(F.sum("mass_kg").alias("used"))
        later = marked.where("block > opened").join(used, key, "left").withColumn("room", F.col("room") - F.col("spent") - F.coalesce("used", F.lit(0.0)))
        live = materialize(later.where("mass_kg <= room").select(*key, "k", "mass_kg", "room"), "live")
    kept = taken[0]
    for more in taken[1:]:
        kept = kept.union(more)
    return settled.join(kept, [*key, "k"], "left_semi")


def kept_fragments(events: DataFrame, cfg: BreakupConfig) -> DataFrame:
    """Fragments of counted events that their parents can pay for, at birth.

    An event of at most `BLOCK` draws is drawn and settled in one task, without a shuffle of its fragments; a larger one
    in many (`within_budget`).
    """
    one = events.where((F.col("drawn") > 0) & (F.col("drawn") <= BLOCK)).select(*_NEEDED, F.lit(1).cast("bigint").alias("first"), F.col("drawn").alias("last"))
    kept = dealt(one).mapInArrow(_drawn(cfg, True), FRAGMENT)
    large = events.where(F.col("drawn") > BLOCK)
    return kept if large.isEmpty() else kept.unionByName(within_budget(draw_fragments(large, cfg)))


def register(spark: SparkSession, cfg: BreakupConfig, name: str = "breakup_fragments") -> None:
    """A table function for SQL: `SELECT * FROM name(TABLE(SELECT *, 1L AS first, drawn AS last FROM events))`.

    Takes counted events, gives the fragments their parents can pay for, at birth. It works in the tasks that hold the events, block in and
    block out; each row is a whole event.
    """
    draw = _drawn(cfg, True)

    class Fragments:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from draw([rows])

    spark.udtf.register(name, F.arrow_udtf(Fragments, returnType=FRAGMENT))


def mark_escapes(fragments: DataFrame) -> DataFrame:
    r, v = norm(cols("x", "y", "z")), cols("vx", "vy", "vz")
    return fragments.withColumn("escaped", sbm.escapes(r, dot(v, v)))


def number_fragments(fragments: DataFrame) -> DataFrame:
    """Add `seq` inside the event and `serial` over all events, both from 0.

    Windows stay inside one event; event totals are summed over the much smaller event list.
    """
    seq = (F.row_number().over(Window.partitionBy("event").orderBy("k")) - 1).cast("bigint")
    totals = fragments.groupBy("event").agg(F.count("*").alias("_n"))
    offsets = prefix_sum(totals, F.col("event"), F.col("_n"), "_before").select("event", "_before")
    return (
        fragments.withColumn("seq", seq).join(offsets, "event")
        .withColumn("serial", F.col("seq") + F.col("_before")).drop("_before")
    )


def settle(fragments: DataFrame, epoch_jd: float) -> DataFrame:
    """Carry fragments from birth to the end of the step in one Runge-Kutta step."""
    return step_rows(fragments, epoch_jd, "t", "remaining_s")


def fragments_of(events: DataFrame, cfg: BreakupConfig) -> DataFrame:
    """Fragments of counted events that their parents can pay for, at birth and written down.

    `escaped` flags the unbound ones.
    """
    return materialize(mark_escapes(kept_fragments(events, cfg)), "fragments")


def as_objects(fragments: DataFrame, epoch_jd: float, first_idx: int, first_id: int) -> DataFrame:
    """Fragments that stay in orbit as rows of the population."""
    kept = settle(number_fragments(fragments.where("NOT escaped")), epoch_jd)
    name = F.concat(F.lit("FRAG "), F.col("event").cast("string"), F.lit("-"), F.col("seq").cast("string"))
    alive = norm(cols("x", "y", "z")) >= F.lit(C.R_EARTH)
    return kept.select(
        (F.col("serial") + F.lit(first_idx)).alias("idx"),
        (F.col("serial") + F.lit(first_id)).alias("id"),
        name.alias("name"), F.lit("").alias("country"), "rcs", F.lit("DEBRIS").alias("type"),
        *STATE, alive.alias("alive"), "size_m", "mass_kg", "area_to_mass", "event",
    ).select(OBJECT_COLUMNS)


def event_report(events: DataFrame, fragments: DataFrame) -> DataFrame:
    """One line per breakup with what became of its fragments."""
    per_event = fragments.groupBy("event").agg(
        F.count_if(~F.col("escaped")).alias("fragments"),
        F.sum(F.when(~F.col("escaped"), F.col("mass_kg")).otherwise(0.0)).alias("fragments_mass_kg"),
        F.count_if("escaped").alias("escaped"),
    )
    return events.join(per_event, "event", "left").select(
        "event", "t", F.col("t_idx").alias("target_idx"), F.col("p_idx").alias("projectile_idx"),
        F.col("t_name").alias("target_name"), F.col("p_name").alias("projectile_name"),
        "catastrophic", "v_rel_km_s", "energy_j_per_g",
        F.col("t_mass_kg").alias("target_mass_kg"), F.col("p_mass_kg").alias("projectile_mass_kg"),
        "sbm_mass_kg", "expected_fragments", "truncated",
        F.coalesce("fragments", F.lit(0)).alias("fragments"),
        F.coalesce("fragments_mass_kg", F.lit(0.0)).alias("fragments_mass_kg"),
        F.coalesce("escaped", F.lit(0)).alias("escaped"),
        F.col("t_x").alias("px"), F.col("t_y").alias("py"), F.col("t_z").alias("pz"),
    )


def with_ids(report: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds target_id and projectile_id, as texts; empty for a projectile that is no object."""
    ids = lambda side: objects.select(F.col("idx").alias(f"{side}_idx"), F.col("id").cast("string").alias(f"{side}_id"))
    return report.join(ids("target"), "target_idx", "left").join(ids("projectile"), "projectile_idx", "left").withColumns(
        {f"{side}_id": F.coalesce(f"{side}_id", F.lit("")) for side in ("target", "projectile")}
    )


def breakup_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("events"),
        F.count_if("catastrophic").alias("catastrophic"),
        F.coalesce(F.sum("escaped"), F.lit(0)).alias("escaped"),
        F.coalesce(F.sum("fragments"), F.lit(0)).alias("fragments"),
    )


def impact_geometry(targets: DataFrame, mass_kg: float, v_rel: float, cfg: BreakupConfig, event_col: str = "event") -> DataFrame:
    """A made-up projectile for each target row: the target's velocity turned about the local
    vertical until the relative speed is `v_rel`.

    Returns event rows with the heavier body as target; the side of the crossing is random.
    """
    r, v = cols("x", "y", "z"), cols("vx", "vy", "vz")
    rows = targets.withColumn("_r", norm(r))
    up = scale(r, F.lit(1.0) / F.col("_r"))
    rows = rows.withColumns(dict(zip(("_kx", "_ky", "_kz"), up)))
    k = cols("_kx", "_ky", "_kz")
    rows = rows.withColumn("_kv", dot(k, v))
    horizontal = norm(tuple(a - b * F.col("_kv") for a, b in zip(v, k)))
    rows = rows.withColumn("_vh2", F.lit(2.0) * horizontal)
    angle = F.when(F.lit(v_rel) >= F.col("_vh2"), F.lit(C.PI)).otherwise(
        F.lit(2.0) * F.asin(F.lit(v_rel) / F.col("_vh2"))
    )
    coin = rng.uniform(rng.digest(cfg.seed, F.col(event_col), F.lit(0), 9), 0) < 0.5
    rows = rows.withColumn("_th", F.when(coin, -angle).otherwise(angle))
    c, s = F.cos("_th"), F.sin("_th")
    turned = tuple(
        a * c + w * s + b * F.col("_kv") * (F.lit(1.0) - c) for a, w, b in zip(v, cross(k, v), k)
    )
    size = F.lit(float(np.cbrt(mass_kg / C.PROJECTILE_DENSITY_KG_M3)))
    pairs = rows.select(
        F.col(event_col).alias("event"), "t", F.lit(0.0).alias("remaining_s"),
        *[F.col(n).alias(f"i_{n}") for n in ("idx", "name")],
        sbm.mass_or_default(F.col("mass_kg")).alias("i_mass_kg"),
        F.col("size_m").alias("i_size_m"),
        *[F.col(n).alias(f"i_{n}") for n in STATE],
        F.lit(None).cast("bigint").alias("j_idx"), F.lit("PROJECTILE").alias("j_name"),
        F.lit(float(mass_kg)).alias("j_mass_kg"), size.alias("j_size_m"),
        *[F.col(n).alias(f"j_{n}") for n in ("x", "y", "z")],
        *[w.alias(f"j_{n}") for n, w in zip(("vx", "vy", "vz"), turned)],
    )
    return order_parents(pairs)

"""Command line of the batch run: python -m orbisweep.cli CATALOG [HOURS] [DT] [OUTPUT_S] [IDS] [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, functions as F

from .functions import orbits
from .operators import analytics as A, breakup as B, masses as M, propagate, screen as S
from .plans import simulate
from .session import build_session
from .sinks import outputs
from .sources import catalog


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="orbisweep")
    p.add_argument("catalog")
    p.add_argument("hours", nargs="?", type=float, default=24.0)
    p.add_argument("dt", nargs="?", type=float, default=10.0)
    p.add_argument("output_s", nargs="?", type=float, default=0.0)
    p.add_argument("ids", nargs="?", default="", help="comma-separated ids to track")
    p.add_argument("--out", default="output")
    p.add_argument("--screen", action="store_true")
    p.add_argument("--conj-km", type=float, help="threshold in km (implies --screen)")
    p.add_argument("--radius-scale", type=float, default=1.0)
    p.add_argument("--min-vrel", type=float, default=10.0, help="m/s")
    p.add_argument("--threads", type=int, default=0, help="local cores, 0 = all; a cluster sets its own")
    p.add_argument("--gpu", action="store_true", help="accepted for compatibility; implies --screen")
    p.add_argument("--breakup", action="store_true")
    p.add_argument("--lc", type=float, default=0.1)
    p.add_argument("--masses")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--impact", type=int)
    p.add_argument("--impact-mass", type=float, default=10.0)
    p.add_argument("--impact-vrel", type=float, default=10.0)
    p.add_argument("--impact-at", type=float, default=0.0, help="hours")
    p.add_argument("--master", help="Spark master; local by default")
    a = p.parse_args(argv)
    a.breakup = a.breakup or a.impact is not None
    a.screen = a.screen or a.gpu or a.breakup or a.conj_km is not None
    return a


def run_config(a: argparse.Namespace, epoch_jd: float) -> simulate.RunConfig:
    impact = None
    if a.impact is not None:
        impact = simulate.Impact(a.impact, a.impact_mass, a.impact_vrel, a.impact_at * 3600.0)
    screening = S.ScreeningConfig(5.0 if a.conj_km is None else a.conj_km, a.radius_scale, a.min_vrel * 1e-3)
    return simulate.RunConfig(
        duration_s=a.hours * 3600.0, dt=a.dt, epoch_jd=epoch_jd,
        screening=screening if a.screen else None, threshold_is_explicit=a.conj_km is not None,
        breakup=B.BreakupConfig(lc_m=a.lc, seed=a.seed) if a.breakup else None, impact=impact,
        output_every_s=track_every_s(a) if a.ids and a.breakup else 0.0 if a.ids else a.output_s,
    )


def track_every_s(a: argparse.Namespace) -> float:
    return a.output_s or 60.0


def tracked_path(objects: DataFrame, ids: list[int], cfg: simulate.RunConfig, every_s: float, done: simulate.Run) -> DataFrame:
    """t_s, id, name, x_km, y_km, z_km of the tracked objects, from the start on.

    A run with breakups tells them from its own states, so that what became of an object shows; without breakups nothing disturbs
    an object and only the tracked ones are propagated again.
    """
    mine = F.col("id").isin(ids)
    shown = ["t_s", "id", "name", *[F.col(c).alias(f"{c}_km") for c in "xyz"]]
    if not cfg.breakup:
        tracked = objects.where(mine)
        path = propagate.sample_states(tracked, cfg.epoch_jd, cfg.dt, cfg.steps, max(1, int(every_s / cfg.dt)))
        return path.join(tracked.select("idx", "id", "name"), "idx").select(*shown)
    at = lambda t, rows: rows.where(mine).withColumn("t_s", F.lit(float(t))).select(*shown)
    path = at(0.0, done.initial)
    for t, rows in done.snapshots:
        path = path.unionByName(at(t, rows))
    return path


def moon_path(path: DataFrame, epoch_jd: float) -> DataFrame:
    """t_s, x_km, y_km, z_km of the Moon at the instants of a path."""
    times = path.select("t_s").distinct()
    return orbits.with_moon(times, orbits.julian_date(epoch_jd, F.col("t_s")), ("x_km", "y_km", "z_km")).select("t_s", "x_km", "y_km", "z_km")


def main(argv: list[str] | None = None) -> int:
    a = parse(argv)
    spark = build_session(a.master or f"local[{a.threads or '*'}]")
    objects, dropped = catalog.load_catalog(spark, a.catalog)
    table = M.load_mass_table(spark, a.masses) if a.masses else M.default_mass_table(spark)
    objects = M.assign_masses(objects, table)
    cfg = run_config(a, catalog.read_epoch_jd(spark, a.catalog))
    lost = dropped.first().dropped
    if lost:
        print(f"{lost} lines dropped")
    done = simulate.run(objects, cfg)
    outputs.write_table(done.final, f"{a.out}/final_state")
    if a.ids:
        path = tracked_path(objects, [int(v) for v in a.ids.split(",")], cfg, track_every_s(a), done)
        outputs.write_csv(path.orderBy("t_s", "id"), f"{a.out}/trajectories")
        outputs.write_csv(moon_path(path, cfg.epoch_jd).orderBy("t_s"), f"{a.out}/moon")
    else:
        outputs.write_snapshots(done.snapshots, f"{a.out}/snapshots")
    A.catalog_fate(done.final, done.initial).show()
    if done.conjunctions is not None:
        named = S.with_names(done.conjunctions, done.final)
        outputs.write_conjunctions(named, f"{a.out}/conjunctions")
        A.conjunction_totals(done.conjunctions).show()
        A.miss_histogram(done.conjunctions, done.threshold_km).show()
        A.closest_approach(done.conjunctions).show()
    if cfg.breakup:
        outputs.write_csv(simulate.population_table(spark, done), f"{a.out}/population")
        if done.breakups is not None:
            outputs.write_table(done.breakups, f"{a.out}/breakups")
            B.breakup_totals(done.breakups).show()
            done.breakups.orderBy("event").show(20)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""One query per operator over the given tables; keys are the names used for checking.

Positions are rounded to metres, speeds and angles to six decimals, so that engines that differ
in the last bits of a sine agree on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import dates, geodesy, orbits, sbm, text
from ..functions.vectors import cols, dot, norm
from ..operators import analytics as A, breakup as B, cells, fates, masses, ordering, propagate, screen as S
from ..schemas import SATCAT_DDL, STATE
from ..session import materialize
from ..sources import catalog, derived, elements, feeds, json_pages, snapshots
from . import simulate

QUERIES = {}

EPOCH = C.DEFAULT_EPOCH_JD
GRID_KM = 165.032
STEP_S = 60.0
SCREEN_DT, SCREEN_STEPS = 60.0, 2
SCREEN = S.ScreeningConfig(threshold_km=25.0, radius_scale=2500.0)
TARGET = "1999-06-15 12:00:00"
FRAGMENT_ROWS = 1_000_000_000


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rnd(c, digits: int) -> Column:
    """Rounded, with negative zero folded into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def state_columns(prefix: str = "") -> list[Column]:
    return [rnd(prefix + c, 3).alias(prefix + c) for c in STATE[:3]] + [
        rnd(prefix + c, 6).alias(prefix + c) for c in STATE[3:]
    ]


def with_epoch_moon(df: DataFrame) -> DataFrame:
    return orbits.with_moon(df, F.lit(EPOCH))


# --- sources --------------------------------------------------------------------------


@query
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.parse_catalog(derived.catalog_lines(spark, sf)).where("ok")
    return rows.select(
        "idx", "id", "name", "type", "country", "rcs", "size_m",
        *[rnd(c, 3).alias(c) for c in STATE[:3]], *[rnd(c, 5).alias(c) for c in STATE[3:]],
    )


@query
def catalog_dropped(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.parse_catalog(derived.catalog_lines(spark, sf))
    return rows.agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("dropped"))


def _header_lines(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(F.lit("# Date de reference (epoch commun) : "), stamp, F.lit("+00:00"))
    return derived.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, F.lit("# Colonnes")).otherwise(line).alias("value")
    )


@query
def epoch_jd(spark: SparkSession, sf: str) -> DataFrame:
    found = dates.epoch_from_header(F.col("value"))
    return _header_lines(spark, sf).select(
        "event_id", rnd(F.coalesce(found, F.lit(EPOCH)), 6).alias("epoch_jd")
    )


@query
def object_type_map(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.object_types(derived.catalog_lines(spark, sf))


def _snapshot(spark, sf):
    rows = derived.objects(spark, sf)
    state = [F.col(c).alias(n) for c, n in zip(STATE, ["x_km", "y_km", "z_km", "vx", "vy", "vz"])]
    flag = F.when(F.col("idx") % 13 == 0, 0).when(F.col("idx") % 17 != 0, 1)
    own = rows.select("idx", "id", *state, flag.alias("alive"))
    fresh = derived.table(spark, sf, "customer").select(
        (F.col("c_custkey") + F.lit(FRAGMENT_ROWS)).alias("idx"),
        (F.col("c_custkey") + F.lit(C.FRAGMENT_ID_BASE)).alias("id"),
        *[(F.col("c_acctbal") + n).alias(c) for n, c in enumerate(["x_km", "y_km", "z_km", "vx", "vy", "vz"])],
        F.lit(1).alias("alive"),
    )
    return own.unionByName(fresh)


def _population_with_fragments(spark, sf):
    rows = derived.objects(spark, sf)
    extra = derived.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + F.lit(FRAGMENT_ROWS)).alias("idx"),
        (F.col("s_suppkey") + F.lit(C.FRAGMENT_ID_BASE)).alias("id"),
        "s_name", "s_acctbal",
    )
    fixed = {
        "country": F.lit(""), "rcs": F.lit("MEDIUM"), "type": F.lit("DEBRIS"), "alive": F.lit(True),
        "size_m": F.lit(0.3), "mass_kg": F.lit(2.0), "area_to_mass": F.lit(0.1),
        "event": F.lit(3).cast("bigint"), "name": F.col("s_name"),
        **{c: F.col("s_acctbal") for c in STATE},
    }
    return rows.unionByName(extra.withColumns(fixed).select(rows.columns))


@query
def snapshot_replay(spark: SparkSession, sf: str) -> DataFrame:
    merged = snapshots.merge_snapshot(_population_with_fragments(spark, sf), _snapshot(spark, sf))
    return merged.select(
        "idx", "id", "name", "rcs", "status", F.col("alive").cast("int").alias("alive"),
        "size_m", "event", rnd("x", 3).alias("x"),
    )


@query
def snapshot_scan(spark: SparkSession, sf: str) -> DataFrame:
    live = snapshots.live_rows(_snapshot(spark, sf))
    pos = cols("x_km", "y_km", "z_km")
    return live.select("id", rnd(norm(pos) - F.lit(C.R_EARTH), 3).alias("alt_km"))


@query
def snapshot_listing(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(
        F.col("s_suppkey") % 9 == 0, F.concat(F.lit("output/final_"), "s_suppkey", F.lit(".csv"))
    ).otherwise(F.concat(F.lit("output/snapshot_"), "s_suppkey", F.lit(".csv")))
    return snapshots.list_snapshots(derived.table(spark, sf, "supplier").select(path.alias("path")))


@query
def mass_table_override(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = derived.table(spark, sf, "part").select(
        k.alias("line_no"),
        F.when(k % 10 == 0, F.concat(F.lit("# "), "p_name"))
        .otherwise(F.concat_ws(
            ",",
            F.element_at(F.array(*[F.lit(r) for r in C.RCS_CLASSES]), (k % 4 + 1).cast("int")),
            F.element_at(F.array(*[F.lit(t) for t in C.OBJECT_TYPES]), (F.col("p_size") % 4 + 1).cast("int")),
            F.concat(F.col("p_size").cast("string"), F.lit(".5\r")),
        )).alias("value"),
    )
    return masses.override_masses(masses.default_mass_table(spark), masses.parse_mass_lines(lines))


@query
def satcat_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.dedupe_satcat(derived.satcat(spark, sf))


def _pages(spark, sf):
    return json_pages.parse_pages(derived.satcat_json_pages(spark, sf), SATCAT_DDL.replace(" string", ": string"))


@query
def satcat_json(spark: SparkSession, sf: str) -> DataFrame:
    """First record of each id over the pages that arrived whole."""
    return feeds.dedupe_satcat(json_pages.records(_pages(spark, sf)))


@query
def satcat_page_report(spark: SparkSession, sf: str) -> DataFrame:
    return json_pages.report(_pages(spark, sf))


@query
def gp_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    target = F.to_timestamp(F.lit(TARGET))
    rows = feeds.window_filter(derived.gp_history(spark, sf), target)
    return rows.where("norad_id IS NOT NULL").select("norad_id", "EPOCH", "l_orderkey", "l_linenumber")


@query
def asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.latest_before(
        derived.gp_history(spark, sf), F.to_timestamp(F.lit(TARGET)), ["l_orderkey", "l_linenumber"]
    )
    return rows.select("norad_id", "EPOCH", "l_orderkey", "l_linenumber")


@query
def asof_skip_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.skip_counts(derived.gp_history(spark, sf), F.to_timestamp(F.lit(TARGET)))


def _latest_with_metadata(spark, sf):
    latest = feeds.latest_before(
        derived.gp_history(spark, sf), F.to_timestamp(F.lit(TARGET)), ["l_orderkey", "l_linenumber"]
    )
    # ids ending in 3 are kept under another name in this catalogue: records without a match
    other = F.when(F.col("NORAD_CAT_ID").endswith("3"), F.concat(F.lit("X"), "NORAD_CAT_ID")).otherwise(F.col("NORAD_CAT_ID"))
    known = feeds.dedupe_satcat(derived.satcat(spark, sf)).withColumn("NORAD_CAT_ID", other)
    return feeds.join_metadata(latest, known)


@query
def tle_metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    return _latest_with_metadata(spark, sf).select(
        "norad_id", "object_type", "intl_designator", "country", "rcs_size", "rcs_value"
    )


@query
def catalog_format(spark: SparkSession, sf: str) -> DataFrame:
    state = derived.objects(spark, sf).select(F.col("idx").cast("string").alias("norad_id"), *STATE)
    placed = geodesy.with_geodetic(state, dates.timestamp_to_jd(F.to_timestamp(F.lit(TARGET)))).withColumnRenamed("height_km", "alt_km")
    rows = _latest_with_metadata(spark, sf).where(feeds.has_elements()).join(placed, "norad_id")
    return rows.select("norad_id", feeds.format_catalog_line().alias("line"))


@query
def geodetic_point(spark: SparkSession, sf: str) -> DataFrame:
    rows = geodesy.with_geodetic(derived.objects(spark, sf).select("idx", *STATE), F.lit(EPOCH))
    return rows.select("idx", rnd("lat_deg", 4).alias("lat_deg"), rnd("lon_deg", 4).alias("lon_deg"), rnd("height_km", 3).alias("height_km"))


def _decoded(spark, sf):
    # decoding is many expressions a row: methods beyond this size stay interpreted on HotSpot, smaller ones compile
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return elements.decode(derived.element_sets(spark, sf))


@query
def element_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _decoded(spark, sf)
    fields = ["number", "designator", "epoch_day", "epoch_fraction", "drag", "inclination", "node", "eccentricity", "perigee", "anomaly", "motion", "revolution"]
    digits = {"epoch_fraction": 6, "drag": 9, "eccentricity": 7, "inclination": 4, "node": 4, "perigee": 4, "anomaly": 4, "motion": 8}
    return rows.select(
        "l_orderkey", "l_linenumber", "status",
        *[(rnd(F.col("elements")[n], digits[n]) if n in digits else F.col("elements")[n]).alias(n) for n in fields])


@query
def element_line_faults(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query
def element_states(spark: SparkSession, sf: str) -> DataFrame:
    """Every set carried as many hours past its epoch as its line item has pieces."""
    rows = _decoded(spark, sf)
    e = F.col("elements")
    at = (F.col("l_quantity") / F.lit(24.0)).cast("double")
    found = elements.with_states(rows, e["epoch_day"], e["epoch_fraction"] + at)
    found = elements.located(found, e["epoch_day"] + e["epoch_fraction"] + at)
    return found.select(
        "l_orderkey", "l_linenumber", "reason", *state_columns(), rnd("lat_deg", 4).alias("lat_deg"), rnd("lon_deg", 4).alias("lon_deg"), rnd("height_km", 3).alias("height_km"))


@query
def id_batches(spark: SparkSession, sf: str) -> DataFrame:
    ids = derived.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return ordering.id_batches(ids, F.col("id"), C.GP_BATCH_SIZE)


@query
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = derived.satcat(spark, sf).select(F.col("NORAD_CAT_ID").alias("id"))
    return catalog.duplicate_ids(ids)


@query
def duplicate_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.duplicate_totals(derived.satcat(spark, sf).select(F.col("NORAD_CAT_ID").alias("id")))


# --- projections ----------------------------------------------------------------------


@query
def type_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("type") == "UNKNOWN", F.lit("TBA")).otherwise(F.col("type"))
    return derived.objects(spark, sf).select(
        "idx", text.normalize_type(raw).alias("type"), text.rcs_key(F.col("rcs")).alias("rcs_key")
    )


@query
def moon_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.table(spark, sf, "events").select("event_id", dates.timestamp_to_jd(F.col("ts")).alias("jd"))
    return orbits.with_moon(rows, F.col("jd")).select("event_id", *[rnd(c, 2).alias(c) for c in ("mx", "my", "mz")])


@query
def moon_path(spark: SparkSession, sf: str) -> DataFrame:
    hours = derived.table(spark, sf, "events").select(
        (F.floor(F.unix_seconds("ts") / 3600) * 3600 - F.lit(1704067200)).cast("double").alias("t_s")
    ).distinct()
    return orbits.with_moon(hours, orbits.julian_date(EPOCH, F.col("t_s")), ("x_km", "y_km", "z_km")).select(
        "t_s", *[rnd(c, 2).alias(c) for c in ("x_km", "y_km", "z_km")]
    )


@query
def acceleration(spark: SparkSession, sf: str) -> DataFrame:
    rows = orbits.with_acceleration(with_epoch_moon(derived.objects(spark, sf)))
    return rows.select("idx", *[rnd(c, 12).alias(c) for c in ("ax", "ay", "az")])


@query
def rk4_step(spark: SparkSession, sf: str) -> DataFrame:
    moved = propagate.advance(derived.objects(spark, sf), EPOCH, STEP_S, 0, 1)
    return moved.select("idx", *state_columns())


@query
def propagate_state(spark: SparkSession, sf: str) -> DataFrame:
    duration = F.pmod(F.col("idx"), F.lit(61)).cast("double") - F.lit(1.0)
    rows = derived.objects(spark, sf).withColumns({"t": F.col("idx") % 1000 * 10.0, "h": duration})
    return propagate.step_rows(rows.select("idx", "t", "h", *STATE), EPOCH, "t", "h").select("idx", *state_columns())


@query
def orbital_elements(spark: SparkSession, sf: str) -> DataFrame:
    factor = F.lit(0.97) + F.pmod(F.col("idx"), F.lit(50)) / F.lit(1000.0)
    rows = derived.objects(spark, sf).withColumns({c: F.col(c) * factor for c in ("vx", "vy", "vz")})
    return orbits.with_elements(rows).select(
        "idx", rnd("a", 3).alias("a"), rnd("e", 6).alias("e"), rnd("inc_deg", 4).alias("inc_deg"),
        rnd("perigee_alt", 3).alias("perigee_alt"), rnd("apogee_alt", 3).alias("apogee_alt"),
        rnd("period_min", 6).alias("period_min"),
    )


@query
def alt_inc(spark: SparkSession, sf: str) -> DataFrame:
    return orbits.with_altitude_inclination(derived.sinking(spark, sf)).select(
        "idx", rnd("alt_km", 3).alias("alt_km"), rnd("inc_deg", 4).alias("inc_deg")
    )


@query
def hermite_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    before = derived.objects(spark, sf).select("idx", *STATE)
    rows = before.select("*", F.lit(0.0).alias("t"), F.lit(STEP_S).alias("h"), *[F.col(c).alias(f"b{c}") for c in STATE])
    moved = propagate.step_rows(rows, EPOCH, "t", "h")
    s = F.pmod(F.col("idx"), F.lit(101)) / F.lit(100.0)
    pos, vel = orbits.interpolate_state(
        (cols("bx", "by", "bz"), cols("bvx", "bvy", "bvz")), (cols("x", "y", "z"), cols("vx", "vy", "vz")),
        F.lit(STEP_S), s,
    )
    return moved.select(
        "idx", *[rnd(c, 3).alias(n) for c, n in zip(pos, STATE[:3])], *[rnd(c, 6).alias(n) for c, n in zip(vel, STATE[3:])]
    )


@query
def format_distance(spark: SparkSession, sf: str) -> DataFrame:
    km = F.col("value") / 100.0 + F.lit(0.00025)
    return derived.table(spark, sf, "events").select("event_id", text.format_distance(km).alias("text"))


@query
def csv_quote(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "events").select("event_id", text.csv_quote(F.col("props")).alias("quoted"))


@query
def to_jd(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    jd = dates.to_jd(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))
    return derived.table(spark, sf, "events").select("event_id", rnd(jd, 6).alias("jd"))


@query
def jd_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    jd = F.lit(2460310.5) + F.col("event_id") * F.lit(0.0625) + F.lit(0.00001)
    return derived.table(spark, sf, "events").select("event_id", dates.jd_to_utc(jd).alias("utc"))


@query
def ramp(spark: SparkSession, sf: str) -> DataFrame:
    x = sbm.log_size(F.col("value") / 100.0)
    shapes = {"alpha": C.AM_ALPHA, "mu1": C.AM_MU1, "sigma1": C.AM_SIGMA1, "mu2": C.AM_MU2, "sigma2": C.AM_SIGMA2}
    return derived.table(spark, sf, "events").select(
        "event_id", *[rnd(sbm.ramp(x, *shape), 9).alias(n) for n, shape in shapes.items()]
    )


@query
def orbit_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = propagate.orbit_samples(derived.objects(spark, sf), EPOCH, 0.0, 90)
    return rows.select(
        "idx", F.size("points").cast("bigint").alias("n_points"),
        *[rnd(c, 3).alias(c) for c in ("r_min", "r_max", "perigee_alt", "apogee_alt")],
        rnd("eccentricity", 6).alias("eccentricity"),
    )


# --- filters and lookups --------------------------------------------------------------


@query
def reentry(spark: SparkSession, sf: str) -> DataFrame:
    rows = propagate.kill_below_ground(derived.sinking(spark, sf))
    return rows.select("idx", F.col("alive").cast("int").alias("alive"))


@query
def viewer_filter(spark: SparkSession, sf: str) -> DataFrame:
    tracked = derived.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"))
    shown = A.visible(
        derived.population(spark, sf), ["PAYLOAD", "DEBRIS", "FRAGMENTS"], (400.0, 1600.0), (20.0, 120.0), "j 1", tracked
    )
    return shown.select("idx", "name", "category", rnd("alt_km", 3).alias("alt_km"), rnd("inc_deg", 4).alias("inc_deg"))


@query
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    names = derived.table(spark, sf, "part").select("p_partkey", "p_name")
    return names.where(text.contains_ci(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.category_counts(A.visible(derived.population(spark, sf)))


@query
def regime_counts(spark: SparkSession, sf: str) -> DataFrame:
    factor = F.lit(1.0) + F.pmod(F.col("idx"), F.lit(6)).cast("double")
    rows = derived.objects(spark, sf).withColumns({c: F.col(c) * factor for c in ("x", "y", "z")})
    return A.regime_counts(rows)


@query
def occlusion(spark: SparkSession, sf: str) -> DataFrame:
    hidden = orbits.earth_occluded((0.6, 0.48, 0.64))
    return derived.objects(spark, sf).select("idx", hidden.cast("int").alias("hidden"))


@query
def pick_nearest(spark: SparkSession, sf: str) -> DataFrame:
    hit = A.pick_nearest(derived.objects(spark, sf), (20000.0, 1000.0, -3000.0), (-1.0, -0.05, 0.15), 400.0)
    return hit.select("idx", "id", "name", rnd("distance", 3).alias("distance"))


@query
def impact_target(spark: SparkSession, sf: str) -> DataFrame:
    # ids made to repeat: the last index of each wins
    rows = derived.objects(spark, sf).withColumn("id", F.col("idx") % 500)
    return simulate.impact_target(rows, 123).select("idx", "id", "name", *state_columns())


@query
def snapshot_types(spark: SparkSession, sf: str) -> DataFrame:
    known = catalog.object_types(derived.catalog_lines(spark, sf))
    return A.snapshot_types(_snapshot(spark, sf).select("id"), known)


@query
def assign_masses(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.population(spark, sf).withColumns({"mass_kg": F.lit(0.25), "area_to_mass": F.lit(0.5)})
    out = masses.assign_masses(rows, masses.default_mass_table(spark))
    return out.select("idx", "mass_kg", rnd("area_to_mass", 9).alias("area_to_mass"))


# --- grid -----------------------------------------------------------------------------


@query
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.with_cell(derived.objects(spark, sf), GRID_KM).select("idx", "cx", "cy", "cz", "cell_key")


@query
def cell_unpack(spark: SparkSession, sf: str) -> DataFrame:
    keyed = cells.with_cell(derived.objects(spark, sf), GRID_KM)
    return keyed.select("idx", *[c.alias(n) for c, n in zip(cells.unpack(F.col("cell_key")), ("ux", "uy", "uz"))])


@query
def cell_size(spark: SparkSession, sf: str) -> DataFrame:
    return cells.cell_size(derived.objects(spark, sf), 10.0, 5.0).select(rnd("cell_km", 6).alias("cell_km"))


@query
def cell_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return cells.occupancy(derived.population(spark, sf), GRID_KM)


@query
def cell_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cells.occupancy_summary(cells.occupancy(derived.population(spark, sf), GRID_KM))


@query
def cell_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return cells.cell_offsets(cells.occupancy(derived.objects(spark, sf), GRID_KM))


@query
def grid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cells.candidate_pairs(cells.occupancy(derived.objects(spark, sf), GRID_KM))


@query
def cell_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.objects(spark, sf)
    seeds = rows.join(derived.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx")), "idx", "left_semi")
    return cells.neighbourhood(rows, 400.0, seeds).select("seed", "idx")


@query
def occupied_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.occupied_cells(A.visible(derived.population(spark, sf)), GRID_KM)


@query
def nearest_cells(spark: SparkSession, sf: str) -> DataFrame:
    seen = cells.occupied_cells(A.visible(derived.population(spark, sf)), GRID_KM)
    near = cells.nearest_cells(seen, GRID_KM, (20000.0, 1000.0, -3000.0))
    return near.select("cell_key", rnd("dist_km", 3).alias("dist_km"))


# --- screening ------------------------------------------------------------------------


def _plan(spark, sf):
    return S.plan_for(derived.objects(spark, sf), SCREEN_DT, SCREEN)


def _states(spark, sf):
    return propagate.step_states(derived.objects(spark, sf), EPOCH, SCREEN_DT, 0, SCREEN_STEPS)


def _conjunctions(spark, sf):
    return S.screen(derived.objects(spark, sf), EPOCH, SCREEN_DT, 0, SCREEN_STEPS, SCREEN)


@query
def pair_filter(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.near_pairs(_states(spark, sf), SCREEN_DT, SCREEN, _plan(spark, sf), SCREEN_STEPS)
    return pairs.select(F.col("step").cast("bigint").alias("step"), "i", "j", "outcome")


@query
def tca_refine(spark: SparkSession, sf: str) -> DataFrame:
    # a threshold far out keeps every refined pair whose minimum lies inside the step
    found = S.approaches(_states(spark, sf), EPOCH, SCREEN_DT, SCREEN, _plan(spark, sf), SCREEN_STEPS, keep_km=1e9)
    return found.select(
        F.col("step").cast("bigint").alias("step"), "i", "j", rnd("t", 2).alias("t"),
        rnd("miss_km", 6).alias("miss_km"), rnd("v_rel_km_s", 5).alias("v_rel_km_s"),
    )


@query
def conjunctions(spark: SparkSession, sf: str) -> DataFrame:
    named = S.with_names(_conjunctions(spark, sf), derived.objects(spark, sf))
    return named.orderBy("t_s", "i", "j").select(
        rnd("t_s", 2).alias("t_s"), "id1", "id2", "name1", "name2", rnd("miss_km", 6).alias("miss_km"),
        rnd("v_rel_km_s", 5).alias("v_rel_km_s"), F.col("collision").cast("int").alias("collision"),
    )


@query
def collisions(spark: SparkSession, sf: str) -> DataFrame:
    return _conjunctions(spark, sf).where("collision").select("i", "j", rnd("miss_km", 6).alias("miss_km"))


@query
def miss_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.miss_histogram(_conjunctions(spark, sf), SCREEN.threshold_km)


@query
def closest_approach(spark: SparkSession, sf: str) -> DataFrame:
    return A.closest_approach(_conjunctions(spark, sf)).select(
        "i", "j", rnd("t", 2).alias("t"), rnd("miss_km", 6).alias("miss_km"), rnd("v_rel_km_s", 5).alias("v_rel_km_s")
    )


@query
def conjunction_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.conjunction_totals(_conjunctions(spark, sf))


@query
def screening_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per step: candidates of the uniform grid, refined pairs and pairs that fly together."""
    rows = derived.objects(spark, sf)
    states = propagate.step_states(rows, EPOCH, SCREEN_DT, 0, SCREEN_STEPS).withColumn("alive", F.lit(True))
    widths = cells.cell_size(states, SCREEN_DT, SCREEN.threshold_km, ("step",))  # one row per step
    gridded = states.join(F.broadcast(widths), "step")
    candidates = cells.candidate_pairs(cells.occupancy(gridded, F.col("cell_km"), ("step",)), ("step",)).groupBy("step").agg(
        F.sum("pairs").alias("candidates")
    )
    counts = S.screening_counts(rows, EPOCH, SCREEN_DT, 0, SCREEN_STEPS, SCREEN)
    return candidates.join(counts, "step", "left").select(
        F.col("step").cast("bigint").alias("step"), "candidates",
        F.coalesce("refined", F.lit(0)).alias("refined"), F.coalesce("co_orbiting", F.lit(0)).alias("co_orbiting"),
    )


@query
def screening_report(spark: SparkSession, sf: str) -> DataFrame:
    """The run's totals: candidates in all and per step, refined pairs, the most pairs that fly together in a step."""
    return screening_stats(spark, sf).agg(
        F.count("*").alias("steps"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), rnd(F.avg("candidates"), 4).alias("mean_candidates"),
        F.coalesce(F.sum("refined"), F.lit(0)).alias("refined"), F.coalesce(F.max("co_orbiting"), F.lit(0)).alias("most_co_orbiting"),
    )


@query
def collision_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return S.collision_envelope_km(derived.population(spark, sf), 100.0)


# --- runs -----------------------------------------------------------------------------


@query
def final_state(spark: SparkSession, sf: str) -> DataFrame:
    done = propagate.advance(derived.sinking(spark, sf), EPOCH, STEP_S, 0, 3)
    return done.select("idx", *state_columns(), F.col("alive").cast("int").alias("alive"))


def _trajectories(spark, sf):
    rows = derived.objects(spark, sf)
    tracked = rows.join(
        derived.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx")), "idx", "left_semi"
    )
    path = propagate.sample_states(tracked, EPOCH, STEP_S, 3, 1)
    who = tracked.select("idx", "id", "name")
    return path.join(who, "idx").select(
        "t_s", "id", "name", *[rnd(c, 3).alias(f"{c}_km") for c in ("x", "y", "z")]
    )


@query
def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    return _trajectories(spark, sf)


@query
def trajectory_arrays(spark: SparkSession, sf: str) -> DataFrame:
    rows = snapshots.trajectory_arrays(_trajectories(spark, sf))
    return rows.select(
        "id", "name", F.size("points").cast("bigint").alias("n_points"),
        F.element_at("points", 1).x_km.alias("first_x"), F.element_at("points", -1).x_km.alias("last_x"),
    )


@query
def plot_extent(spark: SparkSession, sf: str) -> DataFrame:
    return A.plot_extent(derived.objects(spark, sf)).select(rnd("extent_km", 3).alias("extent_km"))


@query
def catalog_fate(spark: SparkSession, sf: str) -> DataFrame:
    start = derived.sinking(spark, sf)
    done = propagate.advance(start, EPOCH, STEP_S, 0, 3).withColumn(
        "alive", F.col("alive") & (F.col("idx") % 13 != 0)
    )
    return A.catalog_fate(done, start).select(
        "lost", "destroyed", rnd("max_da_km", 4).alias("max_da_km"), "max_da_id"
    )


@query
def population_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Objects left at every second step of a run, the start included."""
    rows = propagate.sample_states(derived.sinking(spark, sf), EPOCH, STEP_S, 4, 2)
    return rows.groupBy("t_s").agg(F.count("*").alias("objects"), F.count_if("alive").alias("alive"))


@query
def population(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.population_counts(derived.population(spark, sf))


# --- breakups -------------------------------------------------------------------------

BREAKUP = B.BreakupConfig()


def _parents(spark, sf):
    """One breakup per supplier: two objects picked by its key."""
    k = F.col("s_suppkey")
    rows = derived.table(spark, sf, "supplier").select(
        k.alias("event"), (F.pmod(k * 7, F.lit(60)).cast("double")).alias("t"), (k * 5 + 1).alias("i"), (k * 7 + 3).alias("j")
    ).withColumn("remaining_s", F.lit(60.0) - F.col("t"))
    body = derived.objects(spark, sf).select(*B.PARENT)
    for side in ("i", "j"):
        rows = rows.join(body.select(*[F.col(c).alias(f"{side}_{c}") for c in B.PARENT]), F.col(side) == F.col(f"{side}_idx"))
    return rows.drop("i", "j")


def _events(spark, sf):
    return B.with_energy(B.order_parents(_parents(spark, sf)), BREAKUP)


@query
def breakup_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(
        "event", F.col("t_idx").alias("target"), F.col("p_idx").alias("projectile"),
        rnd("v_rel_km_s", 6).alias("v_rel_km_s"), rnd("energy_j_per_g", 3).alias("energy_j_per_g"),
        F.col("catastrophic").cast("int").alias("catastrophic"), rnd("sbm_mass_kg", 4).alias("sbm_mass_kg"),
        rnd("expected_fragments", 4).alias("expected_fragments"),
    )


@query
def impact_energy(spark: SparkSession, sf: str) -> DataFrame:
    v = F.pmod(F.col("idx"), F.lit(15)) + F.lit(0.5)
    return derived.objects(spark, sf).select(
        "idx", rnd(sbm.impact_preview(F.lit(10.0), v, F.col("mass_kg")), 4).alias("energy_j_per_g")
    )


@query
def size_inverse_cdf(spark: SparkSession, sf: str) -> DataFrame:
    u = F.pmod(F.col("idx") * 7919, F.lit(10007)) / F.lit(10007.0)
    return derived.objects(spark, sf).select(
        "idx", rnd(sbm.size_from_uniform(u, 0.1, F.col("size_m")), 9).alias("fragment_m")
    )


@query
def escape_filter(spark: SparkSession, sf: str) -> DataFrame:
    boost = F.lit(1.0) + F.pmod(F.col("idx"), F.lit(80)) / F.lit(100.0)
    v = tuple(F.col(c) * boost for c in ("vx", "vy", "vz"))
    rows = derived.objects(spark, sf).select("idx", sbm.escapes(norm(cols("x", "y", "z")), dot(v, v)).cast("int").alias("escaped"))
    return rows


def _counted(spark, sf):
    return B.with_count(_events(spark, sf), BREAKUP)


def _fragments(spark, sf):
    return B.fragments_of(_counted(spark, sf), BREAKUP)


@query
def breakup_draws(spark: SparkSession, sf: str) -> DataFrame:
    drawn = B.draw_fragments(_counted(spark, sf), BREAKUP)
    return drawn.groupBy("event").agg(
        F.count("*").alias("n"), rnd(F.sum("size_m"), 5).alias("size_sum"), rnd(F.max("mass_kg"), 5).alias("heaviest")
    )


@query
def mass_budget(spark: SparkSession, sf: str) -> DataFrame:
    kept = B.kept_fragments(_counted(spark, sf), BREAKUP)
    return kept.groupBy("event", F.col("side").cast("bigint").alias("side")).agg(
        F.count("*").alias("n"), rnd(F.sum("mass_kg"), 4).alias("mass_kg")
    )


@query
def breakup_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _fragments(spark, sf).select(
        "event", "k", F.col("side").cast("bigint").alias("side"), "rcs", rnd("size_m", 6).alias("size_m"),
        rnd("mass_kg", 5).alias("mass_kg"), rnd("vx", 5).alias("vx"), rnd("vy", 5).alias("vy"), rnd("vz", 5).alias("vz"),
        F.col("escaped").cast("int").alias("escaped"),
    )


@query
def breakup_fragments_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the table function, from SQL."""
    B.dealt(_counted(spark, sf)).createOrReplaceTempView("breakups_counted")
    B.register(spark, BREAKUP)
    return spark.sql(
        """SELECT event, k, CAST(side AS bigint) AS side, rcs, round(size_m, 6) + 0d AS size_m, round(mass_kg, 5) + 0d AS mass_kg,
             round(vx, 5) + 0d AS vx, round(vy, 5) + 0d AS vy, round(vz, 5) + 0d AS vz
           FROM breakup_fragments(TABLE(SELECT *, 1L AS first, drawn AS last FROM breakups_counted WHERE drawn > 0))""")


@query
def fragment_ids(spark: SparkSession, sf: str) -> DataFrame:
    kept = B.number_fragments(_fragments(spark, sf).where("NOT escaped"))
    return kept.select("event", "k", "seq", (F.col("serial") + F.lit(C.FRAGMENT_ID_BASE)).alias("id"))


@query
def fragment_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.as_objects(_fragments(spark, sf), EPOCH, FRAGMENT_ROWS, C.FRAGMENT_ID_BASE)
    return rows.select(
        "idx", "id", "name", "rcs", F.col("alive").cast("int").alias("alive"), "event",
        *[rnd(c, 2).alias(c) for c in STATE[:3]], *[rnd(c, 5).alias(c) for c in STATE[3:]],
    )


@query
def breakup_events(spark: SparkSession, sf: str) -> DataFrame:
    events = _counted(spark, sf)
    report = B.event_report(events, B.fragments_of(events, BREAKUP))
    return report.select(
        "event", "target_idx", "projectile_idx", "target_name", "projectile_name",
        F.col("catastrophic").cast("int").alias("catastrophic"), "fragments",
        rnd("fragments_mass_kg", 3).alias("fragments_mass_kg"), "escaped",
    )


@query
def breakup_log(spark: SparkSession, sf: str) -> DataFrame:
    """Breakups under the ids of the objects; a made-up projectile has none."""
    events = _counted(spark, sf)
    log = B.with_ids(B.event_report(events, B.fragments_of(events, BREAKUP)), derived.objects(spark, sf))
    return log.select(rnd("t", 3).alias("t_s"), "event", "target_id", "projectile_id", "fragments", "escaped", "truncated")


@query
def breakup_totals(spark: SparkSession, sf: str) -> DataFrame:
    events = _counted(spark, sf)
    return B.breakup_totals(B.event_report(events, B.fragments_of(events, BREAKUP)))


@query
def impact_geometry(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.objects(spark, sf).withColumns({"event": F.col("idx"), "t": F.lit(0.0)})
    out = B.impact_geometry(rows, 10.0, 9.5, BREAKUP)
    heavy = F.col("p_idx").isNull()
    pick = lambda c: F.when(heavy, F.col(f"p_{c}")).otherwise(F.col(f"t_{c}"))
    return out.select(
        "event", heavy.cast("int").alias("object_is_target"), *[rnd(pick(c), 6).alias(c) for c in STATE[3:]]
    )


@query
def collision_parents(spark: SparkSession, sf: str) -> DataFrame:
    hits = materialize(_conjunctions(spark, sf).where("collision").select("step", "t", "i", "j"), "hits")
    before, found = derived.objects(spark, sf), []
    for n in range(SCREEN_STEPS):
        after = propagate.advance(before, EPOCH, SCREEN_DT, n, 1)
        found.append(fates.collision_parents(hits.where(F.col("step") == n).drop("step"), before, after, n * SCREEN_DT, SCREEN_DT))
        before = after
    out = reduce(DataFrame.unionByName, found)
    return out.select(
        "i", "j", *[rnd(f"{p}_{c}", 2).alias(f"{p}_{c}") for p in "ij" for c in STATE[:3]],
        *[rnd(f"{p}_{c}", 4).alias(f"{p}_{c}") for p in "ij" for c in STATE[3:]],
    )


@query
def collision_fates(spark: SparkSession, sf: str) -> DataFrame:
    """Several suppliers strike the same objects in one step; time decides who is left."""
    k = F.col("s_suppkey")
    rows = derived.table(spark, sf, "supplier").select(
        (F.pmod(k * 37, F.lit(6001)) / F.lit(100.0)).alias("t"),
        (k - F.pmod(k, F.lit(5))).alias("i"), (k + F.lit(100_000_000) + F.pmod(k, F.lit(2))).alias("j"),
    )
    body = derived.objects(spark, sf).select(*B.PARENT)
    side = lambda n: body.select(*[F.col(c).alias(f"{n}_{c}") for c in B.PARENT])
    parents = (
        rows.join(side("i"), F.col("i") == F.col("i_idx"))
        .join(side("j"), F.col("j") - F.lit(100_000_000) == F.col("j_idx"))
        .withColumns({"j_idx": F.col("j"), "remaining_s": F.lit(60.0) - F.col("t"),
                      "j_mass_kg": F.lit(0.01) * (F.pmod("j_idx", F.lit(7)) + 1)})
    )
    _, bodies = fates.resolve(parents, BREAKUP)
    return bodies.select("idx", F.col("alive").cast("int").alias("alive"), rnd("mass_kg", 6).alias("mass_kg"))


@query
def cascade_run(spark: SparkSession, sf: str) -> DataFrame:
    """A short run with breakups: what became of the population after each hour."""
    cfg = simulate.RunConfig(
        duration_s=120.0, dt=60.0, screening=S.ScreeningConfig(radius_scale=1000.0), breakup=BREAKUP,
        impact=simulate.Impact(object_id=7),
    )
    outcome = simulate.run(derived.objects(spark, sf), cfg)
    return outcome.final.groupBy("event", "alive").agg(F.count("*").alias("n"), rnd(F.sum("mass_kg"), 3).alias("mass_kg"))


# --- reports over time ----------------------------------------------------------------


@query
def rcs_type_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return A.rcs_type_pivot(derived.objects(spark, sf))


def _event_seconds() -> Column:
    return F.unix_micros("ts") / F.lit(1e6) - F.lit(1704067200.0)


@query
def hourly_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    hours = A.hourly(derived.table(spark, sf, "events"), _event_seconds())
    return hours.select("hour", "n", rnd("total", 4).alias("total"))


@query
def cascade_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    hours = A.hourly(derived.table(spark, sf, "events"), _event_seconds())
    return A.cumulative(hours, ["n", "total"]).select("hour", "n", "cum_n", rnd("cum_total", 3).alias("cum_total"))


@query
def ema_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return A.ema_by_key(rows, "user_id", "ts", "event_id", "value").select("user_id", rnd("ema", 6).alias("ema"))


@query
def recent_events(spark: SparkSession, sf: str) -> DataFrame:
    return A.recent(derived.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")).select(
        "event_id", "user_id", "event_type"
    )


@query
def aged_events(spark: SparkSession, sf: str) -> DataFrame:
    """The last events of each type that are younger than a lifetime, here hours for seconds: the feed is sparse."""
    from ..streaming import feeds as live

    return live.recent_batch(derived.table(spark, sf, "events"), "event_type", C.RECENT_EVENTS, C.EVENT_LIFETIME_S * 3600)


@query
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return A.sample_rows(derived.objects(spark, sf).select("idx", "name"), 500, 42)


@query
def hourly_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly report computed by a streaming query over the event feed."""
    from ..streaming import feeds as live

    return live.run_hourly(spark, sf).select("hour", "n", rnd("total", 4).alias("total"))


@query
def ema_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The moving average kept as streaming state per user."""
    from ..streaming import feeds as live

    return live.run_ema(spark, sf).select("user_id", rnd("ema", 6).alias("ema"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue, one integration step, altitude and inclination, counts per category and regime."""
    rows = derived.objects(spark, sf).select("idx", "type", "event", "alive", *STATE)
    shown = orbits.with_altitude_inclination(propagate.advance(rows, EPOCH, STEP_S, 0, 1).where("alive"))
    regime = F.lit("OTHER")
    for name, (lo, hi) in reversed(C.REGIMES_KM.items()):
        regime = F.when(F.col("alt_km").between(lo, hi), name).otherwise(regime)
    return (
        shown.withColumns({"category": text.display_category(F.col("type"), F.col("event")), "regime": regime})
        .groupBy("category", "regime")
        .agg(F.count("*").alias("n"), rnd(F.avg("alt_km"), 3).alias("mean_alt_km"), rnd(F.avg("inc_deg"), 4).alias("mean_inc_deg"))
    )


@query
def category_regimes(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)

"""Text readers, writers and the command line on small files."""

import pytest
from pyspark.sql import functions as F

from orbisweep import cli, constants as C
from orbisweep.operators import masses
from orbisweep.sinks import outputs
from orbisweep.sources import catalog, snapshots

ROW = "{id} | {name} | {type} | 1998-067A | US | {rcs} |  | 2026-07-31 | 0 | 0 | 0 | {x} | 0.0 | 0.0 | 0.0 | {v} | 0.0 | nan | 92.9 | 1 L | 2 L"


def catalog_text():
    rows = [
        "# Etat orbital",
        "# Date de reference (epoch commun) : 2026-08-01T10:00:00+00:00",
        ROW.format(id=25544, name='ISS "ZARYA", MAIN', type="PAYLOAD", rcs="LARGE", x=6778.137, v=7.668),
        "bad",
        "row | with | few | fields",
        "",
        ROW.format(id=7, name="SMALL ONE", type="TBA", rcs="SMALL", x="7000.5", v=7.5),
        "# Total : 2",
    ]
    return "\n".join(rows) + "\n"


@pytest.fixture()
def path(tmp_path):
    file = tmp_path / "catalog.txt"
    file.write_text(catalog_text())
    return str(file)


def test_catalog_reader(spark, path):
    rows, dropped = catalog.load_catalog(spark, path)
    got = rows.orderBy("idx").collect()
    assert [r.id for r in got] == [25544, 7]
    assert got[0].name == 'ISS "ZARYA", MAIN'
    assert [(r.type, r.size_m) for r in got] == [("PAYLOAD", 4.0), ("UNKNOWN", 0.2)]
    assert dropped.first().dropped == 2
    assert catalog.read_epoch_jd(spark, path) == pytest.approx(C.DEFAULT_EPOCH_JD)


def test_epoch_defaults_without_header(spark, tmp_path):
    file = tmp_path / "plain.txt"
    file.write_text("1 | A\n# (epoch commun) : 2020-01-01T00:00:00\n")
    assert catalog.read_epoch_jd(spark, str(file)) == C.DEFAULT_EPOCH_JD


def test_line_numbers_over_many_splits(spark, tmp_path):
    file = tmp_path / "long.txt"
    file.write_text("".join(f"line {n}\n" for n in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = catalog.numbered_lines(spark, str(file)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r.line_no, r.value) for r in rows) == [(n, f"line {n}") for n in range(5000)]


def test_mass_table(spark, tmp_path):
    good = tmp_path / "masses.csv"
    good.write_text("# typical\r\nrcs,type,mass_kg\r\nLARGE,PAYLOAD,750\r\nLARGE,PAYLOAD,800\r\n")
    table = {(r.rcs, r.type): r.mass_kg for r in masses.load_mass_table(spark, str(good)).collect()}
    assert len(table) == 16 and table["LARGE", "PAYLOAD"] == 800.0 and table["SMALL", "DEBRIS"] == 0.5
    bad = tmp_path / "bad.csv"
    bad.write_text("rcs,type,mass_kg\nLARGE,PAYLOAD,-1\n")
    with pytest.raises(ValueError, match="line 1"):
        masses.load_mass_table(spark, str(bad))


def test_snapshot_round_trip(spark, objects, tmp_path):
    out = str(tmp_path / "snap")
    outputs.write_snapshot_text(objects, out, 120.0)
    assert snapshots.read_time(spark, out) == 120.0
    lines = catalog.numbered_lines(spark, out)
    assert lines.count() == objects.count() + 2
    merged = snapshots.merge_snapshot(objects, objects.select(
        "idx", "id", *[F.col(c).alias(n) for c, n in zip(("x", "y", "z", "vx", "vy", "vz"), outputs.SNAPSHOT_NAMES)],
        F.lit(1).alias("alive")))
    assert merged.where("status <> 'matched'").count() == 0


def test_snapshot_of_another_catalogue_is_refused(spark, objects, tmp_path):
    file = tmp_path / "snapshot_0.csv"
    file.write_text("# t = 5 s\nid,x_km,y_km,z_km,vx,vy,vz,alive\n99,1,2,3,4,5,6,1\n")
    with pytest.raises(ValueError, match="does not fit"):
        snapshots.replay_snapshot(spark, objects, str(file))


def test_csv_quotes_survive(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 1, 'a "b", c', 1.0, 2.0, 3.0)], "t_s double, id bigint, name string, x_km double, y_km double, z_km double")
    outputs.write_csv(rows, str(tmp_path / "t"))
    back = snapshots.read_trajectories(spark, str(tmp_path / "t")).first()
    assert back.name == 'a "b", c'


def test_options():
    a = cli.parse(["c.txt", "2", "30", "--impact", "7", "--min-vrel", "20"])
    assert a.screen and a.breakup
    cfg = cli.run_config(a, 0.0)
    assert cfg.steps == 240 and cfg.screening.min_encounter_speed == 0.02 and not cfg.threshold_is_explicit
    assert not cli.parse(["c.txt", "--radius-scale", "3"]).screen
    with pytest.raises(SystemExit):
        cli.parse(["c.txt", "--nonsense"])


def test_a_torn_page_costs_its_own_records(spark, tmp_path):
    from orbisweep.sources import json_pages

    bodies = {
        1: '[{"NORAD_CAT_ID": "5", "COUNTRY": "US", "extra": [1]}, {"NORAD_CAT_ID": 25544}]', 2: '[{"NORAD_CAT_ID": "7"}, {"NORAD_CAT',
        3: '{"error": "limit"}', 4: " ", 5: "[]", 6: "<html>", 7: '[{"NORAD_CAT_ID": "9"}, null, 3]', 8: '[{"NORAD_CAT_ID": "5"}]x',
    }
    for page, body in bodies.items():
        (tmp_path / f"satcat_{page}.json").write_text(body)
    parsed = json_pages.parse_pages(json_pages.read_pages(spark, str(tmp_path)), "NORAD_CAT_ID: string, COUNTRY: string")
    status = {r.page: (r.status, r.records) for r in json_pages.report(parsed).collect()}
    assert {p: s for p, (s, _) in status.items()} == {1: "ok", 2: "torn", 3: "error", 4: "empty", 5: "ok", 6: "torn", 7: "ok", 8: status[8][0]}
    assert status[1][1] == 2 and status[5][1] == 0 and status[2][1] == 0
    got = {(r.page, r.pos, r.NORAD_CAT_ID, r.COUNTRY) for r in json_pages.records(parsed.where("page < 7")).collect()}
    assert got == {(1, 0, "5", "US"), (1, 1, "25544", None)}
    assert json_pages.report(parsed.where("page > 99")).count() == 0


def test_catalogue_file_with_footer_round_trip(spark, tmp_path):
    from orbisweep.sinks import outputs
    from orbisweep.sources import catalog

    names = ["norad_id", "OBJECT_NAME", "object_type", "intl_designator", "country", "rcs_size", "rcs_value", "EPOCH", "lat_deg", "lon_deg",
             "alt_km", "x", "y", "z", "vx", "vy", "vz", "INCLINATION", "PERIOD", "TLE_LINE1", "TLE_LINE2"]
    row = lambda k, one="1 A", x=7000.0: (str(k), f" O{k} ", "PAYLOAD", "1998-067A", "US", "LARGE", "", "2026-07-31T00:00:00", 1.0, 2.0, 400.0, x, 0.0, 0.0, 0.0, 7.5, 0.0, "51.6", "92.9", one, "2 B")
    data = [row(k) for k in range(300, 0, -1)] + [row(900, None), row(901, ""), row(902, x=None)]
    schema = ", ".join(f"{n} {'double' if n in ('lat_deg', 'lon_deg', 'alt_km', 'x', 'y', 'z', 'vx', 'vy', 'vz') else 'string'}" for n in names)
    path = str(tmp_path / "catalogue")
    assert outputs.write_catalog(spark.createDataFrame(data, schema).repartition(5), path, "2026-07-31T00:00:00+00:00") == (300, 3)
    parts = sorted(f for f in (tmp_path / "catalogue").iterdir() if f.suffix == ".txt" and f.stat().st_size)
    lines = [line for f in parts for line in f.read_text().splitlines()]
    assert lines[0].startswith("# Date de reference") and lines[-2:] == ["# Total propages avec succes : 300", "# Total echecs (TLE invalide/decaye) : 3"]
    assert [int(line.split(" | ")[0]) for line in lines[1:-2]] == list(range(1, 301))
    objects, dropped = catalog.load_catalog(spark, path)
    assert objects.count() == 300 and dropped.first().dropped == 0


def test_tracked_objects_follow_the_run_and_the_moon_its_instants(spark, tmp_path):
    from orbisweep.plans import simulate
    from orbisweep.sinks import outputs
    from orbisweep.sources import snapshots

    at = lambda x: spark.createDataFrame([(1, 7, "A", x, 0.0, 0.0), (2, 8, "B", x + 5, 0.0, 0.0)], "idx long, id long, name string, x double, y double, z double")
    a = cli.parse(["c.txt", "1", "30", "0", "7", "--breakup"])
    cfg = cli.run_config(a, C.DEFAULT_EPOCH_JD)
    assert cfg.output_every_s == 60.0 and cli.run_config(cli.parse(["c.txt", "1", "30", "0", "7"]), 0.0).output_every_s == 0.0
    done = simulate.Run(initial=at(1.0), final=at(9.0), snapshots=[(60.0, at(2.0)), (120.0, at(2.5))])
    path = cli.tracked_path(at(1.0), [7, 99], cfg, 60.0, done)
    assert sorted(tuple(r) for r in path.collect()) == [(0.0, 7, "A", 1.0, 0.0, 0.0), (60.0, 7, "A", 2.0, 0.0, 0.0), (120.0, 7, "A", 2.5, 0.0, 0.0)]
    outputs.write_csv(cli.moon_path(path, cfg.epoch_jd).orderBy("t_s"), str(tmp_path / "moon"))
    read = snapshots.read_moon_path(spark, str(tmp_path / "moon")).collect()
    assert sorted(r.t_s for r in read) == [0.0, 60.0, 120.0]
    assert all(350_000 < (r.x_km**2 + r.y_km**2 + r.z_km**2) ** 0.5 < 410_000 for r in read)

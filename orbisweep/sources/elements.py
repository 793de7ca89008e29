"""Two-line element sets: decoding of the fixed columns, and states by SGP4."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from ..functions import geodesy, sgp4

LINE = 69
#: First column (from 1) and width.
FIELDS_1 = {"number": (3, 5), "class": (8, 1), "designator": (10, 8), "year": (19, 2), "day": (21, 12),
            "n_dot": (34, 10), "n_ddot": (45, 8), "drag": (54, 8), "set_no": (65, 4)}
FIELDS_2 = {"number": (3, 5), "inclination": (9, 8), "node": (18, 8), "eccentricity": (27, 7), "perigee": (35, 8),
            "anomaly": (44, 8), "motion": (53, 11), "revolution": (64, 5)}
#: Numbers above 99,999 begin with a letter: A is 10; I and O are not used.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
STATUSES = ("missing", "length", "line", "checksum", "field", "ok")


def _cut(line: Column, field: tuple[int, int]) -> Column:
    return F.trim(F.substring(line, *field))


_WORTH = np.array([c - 48 if 48 <= c < 58 else int(c == 45) for c in range(256)], np.int64)


@F.arrow_udf(T.IntegerType())
def checksum(line: pa.Array) -> pa.Array:
    """Sum of the digits of the first 68 columns, a minus sign counting 1, modulo 10.

    One pass over the bytes of a batch of lines; ten replacements in each line took most of a query's time.
    """
    if len(line) == 0:
        return pa.array([], pa.int32())
    given = line.is_valid().to_numpy(zero_copy_only=False)
    text = line.cast(pa.large_string())
    _, places, octets = text.buffers()
    place = np.frombuffer(places, np.int64)[text.offset : text.offset + len(text) + 1]
    octets = np.frombuffer(octets, np.uint8)[: place[-1]] if octets is not None else np.zeros(0, np.uint8)
    stop = np.minimum(place[:-1] + (LINE - 1), place[1:])
    if (octets >= 128).any():  # columns are characters, not bytes
        starts = np.append(np.flatnonzero((octets & 192) != 128), len(octets))
        after = np.searchsorted(starts, place[:-1]) + (LINE - 1)
        stop = np.minimum(starts[np.minimum(after, len(starts) - 1)], place[1:])
    total = np.concatenate(([0], np.cumsum(_WORTH[octets])))
    return pa.array(((total[stop] - total[place[:-1]]) % 10).astype(np.int32), mask=~given)


def _stripped(line: Column) -> Column:
    """Without white space at the end; the search for it is left out where there is none."""
    line = F.coalesce(line, F.lit(""))
    ends = F.substring(line, -1, 1).isin(" ", "\t", "\r", "\n")
    return F.when(ends, F.rtrim(line, F.lit(" \t\r\n"))).otherwise(line)


def catalogue_number(text: Column) -> Column:
    """Number of an object from its five columns; null if it is none."""
    place = F.instr(F.lit(LETTERS), F.substring(text, 1, 1)) + F.lit(9)
    lettered = F.when(place >= 10, place.cast("bigint") * 10_000 + F.substring(text, 2, 4).try_cast("bigint"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).when(text.rlike("^[A-HJ-NP-Z][0-9]{4}$"), lettered)


def decimal_point_assumed(text: Column) -> Column:
    """`-12345-3` as -0.12345e-3; null if it is no such number."""
    parts = lambda n: F.regexp_extract(text, r"^([+-]?)([0-9]+)([+-][0-9])$", n)
    value = F.concat(F.when(parts(1) == "-", F.lit("-")).otherwise(F.lit("")), F.lit("0."), parts(2), F.lit("e"), parts(3)).try_cast("double")
    return F.when(text == "", F.lit(0.0)).otherwise(value)


def decode(records: DataFrame, line1: str = "TLE_LINE1", line2: str = "TLE_LINE2") -> DataFrame:
    """`records` with a struct `elements` and a `status`.

    elements: number, designator, epoch_day (Julian day of the epoch's midnight), epoch_fraction, n_dot, n_ddot, drag,
    inclination, node, perigee, anomaly (degrees), eccentricity, motion (turns a day), revolution. It is null unless the status is `ok`; of several
    faults the first of `STATUSES` is named. No row is dropped.
    """
    a, b = (_stripped(F.col(c)) for c in (line1, line2))
    raw = records.withColumn("_lines", F.struct(a.alias("a"), b.alias("b")))
    a, b = F.col("_lines.a"), F.col("_lines.b")
    one = {n: _cut(a, f) for n, f in FIELDS_1.items()}
    two = {n: _cut(b, f) for n, f in FIELDS_2.items()}
    number = catalogue_number(one["number"])
    year = one["year"].try_cast("int")
    full_year = F.when(year >= 57, year + 1900).otherwise(year + 2000)
    day = one["day"].try_cast("double")
    first = F.unix_date(F.make_date(full_year, F.lit(1), F.lit(1))).cast("double") + F.lit(2440587.5)
    plain = lambda text: text.try_cast("double")
    fields = {
        "number": number, "designator": one["designator"],
        "epoch_day": first + F.floor(day) - F.lit(1.0), "epoch_fraction": day - F.floor(day),
        "n_dot": plain(one["n_dot"]), "n_ddot": decimal_point_assumed(one["n_ddot"]), "drag": decimal_point_assumed(one["drag"]),
        "inclination": plain(two["inclination"]), "node": plain(two["node"]),
        "eccentricity": F.concat(F.lit("0."), two["eccentricity"]).try_cast("double"),
        "perigee": plain(two["perigee"]), "anomaly": plain(two["anomaly"]), "motion": plain(two["motion"]),
        "revolution": F.coalesce(two["revolution"].try_cast("bigint"), F.lit(0)),
    }
    parsed = raw.withColumn("_fields", F.struct(*[c.alias(n) for n, c in fields.items()]))
    given = lambda line: F.length(line) > 0
    agrees = (F.substring(a, 1, 2) == "1 ") & (F.substring(b, 1, 2) == "2 ") & (one["number"] == two["number"])
    sound = (F.substring(a, LINE, 1) == checksum(a).cast("string")) & (F.substring(b, LINE, 1) == checksum(b).cast("string"))
    whole = [F.col(f"_fields.{n}").isNotNull() for n in fields]
    readable = whole[0]
    for test in whole[1:]:
        readable = readable & test
    status = (
        F.when(~(given(a) & given(b)), "missing").when((F.length(a) != LINE) | (F.length(b) != LINE), "length")
        .when(~agrees, "line").when(~sound, "checksum").when(~readable | (F.col("_fields.motion") <= 0), "field").otherwise("ok")
    )
    columns = [F.col(f"`{c}`") for c in records.columns]
    named = parsed.withColumn("status", status)  # a column of its own: it is read twice
    return named.select(*columns, F.when(F.col("status") == "ok", F.col("_fields")).alias("elements"), "status")


def with_states(decoded: DataFrame, jd_day: Column, jd_fraction: Column) -> DataFrame:
    """Decoded records with x..vz (km, km/s; frame `teme`) at a Julian date given in two parts, and `reason`.

    Rows without elements keep their status as the reason; deep-space sets (periods of 225 minutes and more), elements that the theory
    has no answer for and objects that have come down say so and have null states.
    """
    e = F.col("elements")
    minutes = ((jd_day - e["epoch_day"]) + (jd_fraction - e["epoch_fraction"])) * F.lit(1440.0)
    turn = F.lit(2 * C.PI)
    args = [e["motion"] * turn / 1440.0, e["eccentricity"], *[F.radians(e[n]) for n in ("inclination", "node", "perigee", "anomaly")], e["drag"], minutes]
    rows = decoded.withColumns({f"_a{k}": c for k, c in enumerate(args)})
    names = [f"_a{k}" for k in range(len(args))]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in decoded.schema])
    for n in ("x", "y", "z", "vx", "vy", "vz"):
        out = out.add(n, T.DoubleType())
    out = out.add("reason", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch[n].to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
            r, v, why = sgp4.states(*values)
            missing = np.isnan(r[:, 0])
            status = np.array(batch["status"].to_pylist(), object)
            reason = np.where(status == "ok", np.array(sgp4.REASONS, object)[why], status)
            kept = [batch.column(k) for k, n in enumerate(batch.schema.names) if n not in names]
            kept += [pa.array(column, mask=missing) for column in (*r.T, *v.T)] + [pa.array(reason.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(kept, [f.name for f in out])

    return rows.mapInArrow(run, out)


def located(states: DataFrame, jd: Column) -> DataFrame:
    """States of `with_states` with lat_deg, lon_deg and height_km."""
    return geodesy.with_geodetic(states, jd, "teme")

"""Civil dates and Julian days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C

UNIX_EPOCH_JD = 2440587.5


def to_jd(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Gregorian civil time (UTC) to Julian Day; NULL for an impossible date."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    date = text.try_cast("date")
    days = F.unix_date(date).cast("double")
    fraction = (hour + minute / F.lit(60.0) + second / F.lit(3600.0)) / F.lit(24.0)
    return days + F.lit(UNIX_EPOCH_JD) + fraction


def timestamp_to_jd(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(86400e6) + F.lit(UNIX_EPOCH_JD)


def jd_to_utc(jd: Column) -> Column:
    """Text form rounded to the second; the last half second of a day shows as 24:00:00."""
    day = F.floor(jd + F.lit(0.5))
    seconds = F.floor((jd + F.lit(0.5) - day) * F.lit(86400.0) + F.lit(0.5)).cast("int")
    date = F.date_from_unix_date((day - F.lit(2440588)).cast("int"))
    return F.concat(
        F.date_format(date, "yyyy-MM-dd"),
        F.format_string(
            " %02d:%02d:%02d UTC",
            (seconds / 3600).cast("int"),
            F.pmod((seconds / 60).cast("int"), F.lit(60)),
            F.pmod(seconds, F.lit(60)),
        ),
    )


EPOCH_PATTERN = r"epoch commun\) : *(\d+)-(\d+)-(\d+)T(\d+):(\d+):(\d+)"


def epoch_from_header(line: Column) -> Column:
    """Julian Day of the reference date carried by a header comment, NULL without one."""
    part = [F.regexp_extract(line, EPOCH_PATTERN, n).try_cast("int") for n in range(1, 7)]
    return F.when(line.contains(C.EPOCH_MARKER) & part[0].isNotNull(), to_jd(*part))

"""Time columns. No function reads the clock: the moment of evaluation is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed

LOCAL_ZONE = "Europe/Istanbul"


def parse_iso(c: Column) -> Column:
    """Timestamp from ISO text; text without an offset is UTC (the session zone); unreadable text is null."""
    text = c.cast("string")
    iso = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,6})?)?)?([+-]\d{2}:?\d{2}|Z)?)?$"
    return F.when(text.rlike(iso), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def local_stamp(c: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd HH:mm:ss")


def utc_stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)


def duration_text(c: Column, fallback: str = "-") -> Column:
    """`X dk Y sn`; negative values count as zero."""
    seconds = F.bround(c.try_cast("double"), 0).cast("bigint")
    total = F.when(seconds < 0, F.lit(0)).otherwise(seconds)
    minutes = F.floor(total / 60)
    tail = F.concat((total % 60).cast("string"), F.lit(" sn"))
    return F.coalesce(
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" dk "), tail)).otherwise(tail), F.lit(fallback)
    )


def relative_time(c: Column, as_of: Column) -> Column:
    s = F.greatest(F.floor(seconds_between(as_of, c)), F.lit(0)).cast("bigint")

    def unit(size, word):
        return F.concat(F.floor(s / size).cast("string"), F.lit(f" {word} önce"))

    return (
        F.when(c.isNull(), F.lit("-"))
        .when(s < 10, F.lit("az önce"))
        .when(s < 60, unit(1, "sn"))
        .when(s < 3600, unit(60, "dk"))
        .when(s < 86400, unit(3600, "sa"))
        .otherwise(unit(86400, "gün"))
    )


def quiet_hours(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """True in the hours in which no health alert is sent."""
    hour = F.hour(F.from_utc_timestamp(c, zone))
    return (hour >= fixed.QUIET_FROM_HOUR) | (hour < fixed.QUIET_TO_HOUR)


def within_hours(c: Column, as_of: Column, hours: int = 24) -> Column:
    """At or after `as_of - hours`; null timestamps are out."""
    return F.coalesce(c >= as_of - F.expr(f"interval {int(hours)} hours"), F.lit(False))

"""Column functions on times; all of them on TIMESTAMP_NTZ or UTC sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, with its fraction."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def midpoint(a: Column, b: Column) -> Column:
    half = F.floor(F.timestamp_diff("MICROSECOND", a, b) / 2).cast("long")
    return F.timestamp_add("MICROSECOND", half, a)


def _dated(year: Column, text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})\s*$", k).try_cast("int")
    return F.call_function("try_make_timestamp_ntz", year, part(1), part(2), part(3), part(4), F.lit(0).cast("decimal(8,6)"))


def yearless(text: Column, near: Column) -> Column:
    """MM/DD HH:MM in the year that brings it nearest to `near`; the earliest year wins ties, days that a year lacks don't compete."""
    return yearless_candidates(text, near)[0]["at"]


def yearless_candidates(text: Column, near: Column) -> Column:
    """Candidates of three years as array<struct<off (days), year, at>>, nearest first."""

    def candidate(delta: int) -> Column:
        at = _dated(F.year(near) + delta, text)
        return F.when(at.isNotNull(), F.struct((F.abs(F.timestamp_diff("MICROSECOND", near, at)) / F.lit(8.64e10)).alias("off"), (F.year(near) + delta).alias("year"), at.alias("at")))

    found = F.array_sort(F.array_compact(F.array(*(candidate(d) for d in (-1, 0, 1)))))
    return F.when(F.size(found) > 0, found)


def yearless_margin(text: Column, near: Column) -> Column:
    """Days by which the nearest year beats the next; NULL with fewer than two candidates."""
    found = yearless_candidates(text, near)
    return F.get(found, F.lit(1))["off"] - F.get(found, F.lit(0))["off"]


def grid(start: Column, end: Column, minutes: int) -> Column:
    """Wall-clock ticks in [start, end), as an array; empty if there is none."""
    step = minutes * 60_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda x: F.timestamp_diff("MICROSECOND", epoch, x)
    first, stop = F.ceil(at(start) / step).cast("long"), F.ceil(at(end) / step).cast("long") - 1
    ticks = F.when(first <= stop, F.sequence(first, stop)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(ticks, lambda k: F.timestamp_add("MICROSECOND", k * step, epoch))


def cyclic(at: Column) -> dict[str, Column]:
    """Sine and cosine of the hour, and the day of the week from Monday = 0."""
    angle = F.lit(2 * math.pi / 24) * F.hour(at)
    return {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "weekday": F.weekday(at)}


def hour_bin(at: Column, hours: int = 6) -> Column:
    return F.floor(F.hour(at) / hours).cast("int")


def canonical(at: Column) -> Column:
    """ISO 8601 in UTC; a fraction only where there is one."""
    fraction = F.rtrim(F.date_format(at, "SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))

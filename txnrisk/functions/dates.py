"""Calendar columns of zone-free timestamps. Nothing here passes through the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day(ts: Column) -> Column:
    return ts.cast("date")


def date_key(date: Column) -> Column:
    """yyyyMMdd as int."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def key_to_date(key: Column) -> Column:
    return F.make_date(
        F.floor(key / 10000).cast("int"),
        F.floor(key / 100).cast("int") % 100,
        key % 100,
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01T00:00 of a zone-free timestamp."""
    seconds = F.unix_date(day(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = F.date_part(F.lit("SECOND"), ts) * 1000000
    return seconds * 1000000 + fraction.cast("bigint")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Of zone-free timestamps: exact microseconds, total seconds first, then minutes."""
    gap = later - earlier
    parts = {p: F.extract(F.lit(p), gap) for p in ("DAY", "HOUR", "MINUTE", "SECOND")}
    whole = parts["DAY"].cast("bigint") * 86400 + parts["HOUR"] * 3600 + parts["MINUTE"] * 60
    micros_between = whole * 1000000 + (parts["SECOND"] * 1000000).cast("bigint")
    return micros_between.cast("double") / F.lit(1e6) / F.lit(60.0)

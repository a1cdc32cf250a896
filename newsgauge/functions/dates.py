"""Time expressions. Every clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DAY_MS = 86_400_000
#: The last day of each bucket.
FRESH, RECENT, STALE = 7, 30, 90
BUCKETS = ("NO_COVERAGE", "FRESH", "RECENT", "STALE", "DORMANT")


def _millis(x: Column) -> Column:
    return F.unix_millis(x.cast("timestamp"))


def days_since(published: Column | str, now: Column) -> Column:
    """Whole days elapsed, future dates 0, null for null."""
    at = col(published)
    elapsed = F.floor((_millis(now) - _millis(at)) / F.lit(DAY_MS))
    return F.when(at.isNotNull(), F.greatest(F.lit(0), elapsed)).cast("bigint")


def bucket(days: Column) -> Column:
    return (
        F.when(days.isNull(), "NO_COVERAGE")
        .when(days <= FRESH, "FRESH")
        .when(days <= RECENT, "RECENT")
        .when(days <= STALE, "STALE")
        .otherwise("DORMANT")
    )


def describe(days: Column) -> Column:
    return (
        F.when(days.isNull(), "no coverage found")
        .when(days == 0, "mentioned today")
        .when(days == 1, "last mentioned yesterday")
        .otherwise(F.concat(F.lit("last mentioned "), days.cast("string"), F.lit(" days ago")))
    )


def month(published: Column | str) -> Column:
    return F.date_format(col(published), "yyyy-MM")


def days_before(now: Column, days: int) -> Column:
    return now.cast("timestamp") - F.make_dt_interval(F.lit(days))


def relative_or_iso(x: Column | str, now: Column) -> Column:
    """``-3d`` is three days before now; anything else is read as a timestamp, null if it is none."""
    raw = F.trim(col(x))
    days = F.regexp_extract(raw, r"^(-?\d+)d$", 1)
    moved = now.cast("timestamp") + F.make_dt_interval(F.nullif(days, F.lit("")).cast("int"))
    return F.when(days != "", moved).otherwise(F.try_to_timestamp(raw))


def compact_stamp(x: Column | str) -> Column:
    """14 digits with or without separators, else any timestamp that Spark reads, else null."""
    raw = F.trim(col(x))
    digits = F.regexp_replace(raw, r"[TZ]", "")
    return F.coalesce(
        F.when(digits.rlike(r"^\d{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))), F.try_to_timestamp(raw)
    )


def format_stamp(x: Column) -> Column:
    return F.date_format(x, "yyyyMMddHHmmss")


def mail_date(x: Column | str) -> Column:
    """Dates such as ``Mon, 03 Feb 2025 10:00:00 GMT``; null if unreadable."""
    rest = F.regexp_replace(F.trim(col(x)), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(rest),
    )

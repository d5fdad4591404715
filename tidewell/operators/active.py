"""Active users and devices, day counters, and their sketch form."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import blank_to_null
from tidewell.functions.times import between, day_calendar, day_key, month_calendar, month_key, whole_days

# The levels counted as errors.
ERROR_LEVELS = ["error", "fatal"]
# 2^14 registers: the size and error (about 0.8%) of the usual counter sketches.
SKETCH_LG_K = 14


def activity(events: DataFrame, logs: DataFrame) -> DataFrame:
    """Error events and logs as one activity frame; ids trimmed, blank ids null."""

    def part(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            "ts",
            F.lit(kind).alias("kind"),
            "level",
            blank_to_null(F.col("distinct_id")).alias("distinct_id"),
            blank_to_null(F.col("device_id")).alias("device_id"),
        )

    return part(events, "event").unionByName(part(logs, "log"))


def _in_days(rows: DataFrame, first: date, last: date) -> DataFrame:
    return between(rows, f"{first} 00:00:00", f"{last} 23:59:59.999999")


def _distinct_by(rows: DataFrame, key: Column, name: str, who: str) -> DataFrame:
    return (
        rows.filter(F.col(who).isNotNull())
        .groupBy(key.alias(name))
        .agg(F.count_distinct(who).alias("active"))
    )


def active_by_day(
    rows: DataFrame, start: str | datetime, end: str | datetime, who: str = "distinct_id"
) -> DataFrame:
    """Distinct users (or devices) per UTC day, days without activity as 0."""
    first, last = whole_days(start, end)
    counts = _distinct_by(_in_days(rows, first, last), day_key(F.col("ts")), "day", who)
    return (
        day_calendar(rows.sparkSession, first, last)
        .join(counts, "day", "left")
        .select("day", F.coalesce("active", F.lit(0)).alias("active"))
    )


def active_by_month(rows: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    """Distinct users per calendar month, whole months from start's to end's."""
    first, last = whole_days(start, end)
    month_end = (last.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    in_range = _in_days(rows, first.replace(day=1), month_end)
    counts = _distinct_by(in_range, month_key(F.col("ts")), "month", "distinct_id")
    return (
        month_calendar(rows.sparkSession, first, last)
        .join(counts, "month", "left")
        .select("month", F.coalesce("active", F.lit(0)).alias("active"))
    )


def _totals(rows: DataFrame) -> DataFrame:
    """Counters per user first (combined before the shuffle), then over the users."""
    is_event = F.col("kind") == "event"
    per_user = rows.groupBy("distinct_id").agg(
        F.count_if(~is_event).alias("logs"),
        F.count_if(is_event).alias("events"),
        F.count_if(is_event & F.col("level").isin(ERROR_LEVELS)).alias("errors"),
    )
    return per_user.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("logs", "events", "errors")],
        F.count("distinct_id").alias("users"),
    )


def metrics_today(rows: DataFrame, now: str | datetime) -> DataFrame:
    """Logs, error events, errors among those events, and users of the UTC day of `now`."""
    day, _ = whole_days(now, now)
    return _totals(_in_days(rows, day, day))


def metrics_total(rows: DataFrame) -> DataFrame:
    return _totals(rows).select("logs", "events", "users")


def daily_sketches(rows: DataFrame) -> DataFrame:
    """(day, sketch): a mergeable distinct-user sketch per day, combined before the shuffle."""
    return (
        rows.filter(F.col("distinct_id").isNotNull())
        .groupBy(day_key(F.col("ts")).alias("day"))
        .agg(F.hll_sketch_agg("distinct_id", SKETCH_LG_K).alias("sketch"))
    )


def active_from_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.select("day", F.hll_sketch_estimate("sketch").alias("active"))


def total_from_sketches(sketches: DataFrame) -> DataFrame:
    """Users of all days: the union of the daily sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))

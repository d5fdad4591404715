"""Top event names by event count, with distinct users."""

from __future__ import annotations

from functools import reduce
from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import like_pattern, present
from tidewell.functions.times import as_datetime, between, ordered

DEFAULT_LIMIT = 20


def row_limit(limit: int | None, default: int, most: int | None = None) -> int:
    """The rows of a top list or page; more than ``most``, if given, is an error."""
    rows = default if not limit or limit <= 0 else limit
    if most is not None and rows > most:
        raise ValueError(f"at most {most} rows can be asked for, not {rows}")
    return rows


def _ranked(per_user: DataFrame, limit: int | None, q: str) -> DataFrame:
    """(name, distinct_id, events) -> top names; one row per user, so users is a plain count."""
    if q.strip():
        per_user = per_user.filter(F.col("name").ilike(like_pattern(q)))
    return (
        per_user.groupBy("name")
        .agg(F.sum("events").alias("events"), F.count("distinct_id").alias("users"))
        .orderBy(F.desc("events"), "name")
        .limit(row_limit(limit, DEFAULT_LIMIT))
    )


def _per_user(rows: DataFrame, q: str = "") -> DataFrame:
    if q.strip():
        rows = rows.filter(F.col("name").ilike(like_pattern(q)))
    return rows.groupBy("name", "distinct_id").agg(F.count(F.lit(1)).alias("events"))


def top_events(
    track: DataFrame, start: str | datetime, end: str | datetime, limit: int | None = None, q: str = ""
) -> DataFrame:
    """From raw track events in [start, end].

    Counting per (name, user) first spreads a hot name over its users and is combined before
    each of the two shuffles.
    """
    return _ranked(_per_user(between(track, start, end), q), limit, "")


def _daily_users(daily: DataFrame, first_day: str, last_day: str) -> DataFrame:
    return (
        daily.filter(F.col("day").between(first_day, last_day))
        .groupBy("name", "distinct_id")
        .agg(F.sum("events").alias("events"))
    )


def top_events_daily(
    daily: DataFrame, start: str | datetime, end: str | datetime, limit: int | None = None, q: str = ""
) -> DataFrame:
    """From the daily rollup: whole UTC days, the time of day is ignored."""
    start, end = ordered(start, end)
    return _ranked(_daily_users(daily, f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}"), limit, q)


def top_events_hybrid(
    track: DataFrame,
    daily: DataFrame,
    start: str | datetime,
    end: str | datetime,
    limit: int | None = None,
    q: str = "",
) -> DataFrame:
    """Exact over [start, end]: raw rows for the two edge days, the rollup for the days between."""
    start, end = as_datetime(start), as_datetime(end)
    second_day = datetime.combine(start.date(), time.min) + timedelta(days=1)
    last_day = datetime.combine(end.date(), time.min)
    if last_day - second_day < timedelta(days=1):
        raise ValueError("the range needs at least one whole day between its edge days")
    left = _per_user(between(track, start, second_day, end_open=True))
    right = _per_user(between(track, last_day, end))
    middle = _daily_users(
        daily, f"{second_day:%Y-%m-%d}", f"{last_day - timedelta(days=1):%Y-%m-%d}"
    )
    return _merged_top([left, right, middle], limit, q)


def _merged_top(parts: list[DataFrame], limit: int | None, q: str) -> DataFrame:
    merged = reduce(DataFrame.unionByName, parts).groupBy("name", "distinct_id").agg(F.sum("events").alias("events"))
    return _ranked(merged, limit, q)


def combined_top(track: DataFrame, daily: DataFrame, limit: int | None = None, q: str = "") -> DataFrame:
    """Over some raw rows and some days of the rollup that do not overlap."""
    days = daily.groupBy("name", "distinct_id").agg(F.sum("events").alias("events"))
    return _merged_top([_per_user(track), days], limit, q)


def logs_as_track(logs: DataFrame) -> DataFrame:
    """Log rows of level `event` with a user, in the columns of track events."""
    return logs.filter((F.col("level") == "event") & present(F.col("distinct_id"))).select(
        "project_id", "ts", "ingest_id", F.col("message").alias("name"), "distinct_id", "device_id",
        *[c for c in ("day",) if c in logs.columns],
    )


def top_events_from_logs(
    logs: DataFrame, start: str | datetime, end: str | datetime, limit: int | None = None, q: str = ""
) -> DataFrame:
    return top_events(logs_as_track(logs), start, end, limit, q)


def top_events_auto(
    daily: DataFrame,
    track: DataFrame,
    logs: DataFrame,
    start: str | datetime,
    end: str | datetime,
    limit: int | None = None,
    q: str = "",
) -> DataFrame:
    """The first source with a row in range: rollup, then raw track events, then logs.

    The probes stop at the first row they find.
    """
    first, last = ordered(start, end)

    def found(rows: DataFrame) -> bool:
        return not (rows.filter(F.col("name").ilike(like_pattern(q))) if q.strip() else rows).isEmpty()

    if found(daily.filter(F.col("day").between(f"{first:%Y-%m-%d}", f"{last:%Y-%m-%d}"))):
        return top_events_daily(daily, start, end, limit, q)
    if found(between(track, start, end)):
        return top_events(track, start, end, limit, q)
    return top_events_from_logs(logs, start, end, limit, q)

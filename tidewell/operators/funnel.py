"""Ordered funnels: how many users reach each step in order."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.skew import WINDOW_ROWS, checked_broadcast, hot_keys
from tidewell.functions.text import WHITESPACE, present
from tidewell.functions.times import as_datetime, between, days_back
from tidewell.operators.top_events import logs_as_track


def clean_steps(raw: str | list[str], max_steps: int | None = None, max_bytes: int | None = None) -> list[str]:
    """Trimmed names, blanks dropped, first of each spelling; more steps or bytes than allowed are an error."""
    parts = raw.split(",") if isinstance(raw, str) else raw
    steps: dict[str, str] = {}
    for part in parts:
        name = part.strip(WHITESPACE)
        if max_bytes is not None and len(name.encode()) > max_bytes:
            raise ValueError(f"a step has at most {max_bytes} bytes")
        if name:
            steps.setdefault(name.lower(), name)
    if max_steps is not None and len(steps) > max_steps:
        raise ValueError(f"a funnel has at most {max_steps} steps")
    return list(steps.values())


def within_seconds(within: timedelta | None, longest: timedelta | None = None) -> int | None:
    if within is None:
        return None
    if within <= timedelta(0):
        raise ValueError("the time between the first and a later step has to be positive")
    if longest is not None and within > longest:
        raise ValueError(f"the time between the first and a later step is at most {longest}")
    return max(1, int(within.total_seconds()))


def check_range(
    start: str | datetime,
    end: str | datetime,
    now: str | datetime | None = None,
    retention_days: int = 0,
    longest: timedelta | None = None,
) -> None:
    """Refuse ranges that are inverted, too long, or partly deleted by the retention policy."""
    start, end = as_datetime(start), as_datetime(end)
    if end < start:
        raise ValueError("the range ends before it starts")
    if longest is not None and end - start > longest:
        raise ValueError(f"the range is longer than {longest}")
    if now is not None and retention_days > 0 and start < days_back(now, retention_days):
        raise ValueError("the start is older than the retention cutoff of the source table")


def step_rows(track: DataFrame, steps: list[str], start: str | datetime, end: str | datetime) -> DataFrame:
    """(distinct_id, ts, step) of the rows that can matter; the name filter reaches the scan."""
    step = F.lit(None).cast("int")
    for number in range(len(steps), 0, -1):
        step = F.when(F.col("name") == steps[number - 1], number).otherwise(step)
    return (
        between(track, start, end)
        .filter(F.col("name").isin(steps) & present(F.col("distinct_id")))
        .select("distinct_id", "ts", step.alias("step"))
    )


def _reach(step: int, after: Column | None) -> Column:
    hit = F.col("step") == step
    if after is not None:
        hit = hit & (F.col("ts") >= after)
    return F.min(F.when(hit, F.col("ts")))


def _times_by_window(rows: DataFrame, steps: int) -> DataFrame:
    """All steps on one exchange: each window reuses the partitioning by user."""
    user = Window.partitionBy("distinct_id")
    for i in range(1, steps + 1):
        after = F.col(f"t{i - 1}") if i > 1 else None
        rows = rows.withColumn(f"t{i}", _reach(i, after).over(user))
    return rows.groupBy("distinct_id").agg(*[F.first(f"t{i}").alias(f"t{i}") for i in range(1, steps + 1)])


def _times_by_minimum(rows: DataFrame, steps: int) -> DataFrame:
    """For few users with very many rows: one combined minimum per step, no shuffle of the rows.

    Each step joins the times so far to the rows, by broadcast if they are counted to be few. The step-1 rows stay in,
    so that a user who stops early keeps a row.
    """
    times = rows.filter(F.col("step") == 1).groupBy("distinct_id").agg(F.min("ts").alias("t1"))
    for i in range(2, steps + 1):
        so_far = [f"t{j}" for j in range(1, i)]
        times = (
            rows.filter(F.col("step").isin(1, i))
            .join(checked_broadcast(times), "distinct_id")
            .groupBy("distinct_id", *so_far)
            .agg(_reach(i, F.col(f"t{i - 1}")).alias(f"t{i}"))
        )
    return times


def funnel_times(
    track: DataFrame,
    steps: list[str],
    start: str | datetime,
    end: str | datetime,
    within: timedelta | None = None,
    hot_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per user who did step 1: the time of each step, null from the first miss on.

    t1 is the first step-1 time in range and each later time the first one not before the
    previous step. `within` counts from t1. As the times never decrease, a step outside the bound
    can be cut afterwards.
    """
    k = len(steps)
    rows = step_rows(track, steps, start, end)
    hot = checked_broadcast(hot_keys(rows, "distinct_id", hot_rows))
    times = _times_by_window(rows.join(hot, "distinct_id", "left_anti"), k).unionByName(
        _times_by_minimum(rows.join(hot, "distinct_id", "left_semi"), k)
    )
    times = times.filter(F.col("t1").isNotNull())
    seconds = within_seconds(within)
    if seconds is None:
        return times
    last = F.timestamp_micros(F.unix_micros("t1") + seconds * 1_000_000)
    return times.select(
        "distinct_id", "t1", *[F.when(F.col(f"t{i}") <= last, F.col(f"t{i}")).alias(f"t{i}") for i in range(2, k + 1)]
    )


def funnel(
    track: DataFrame,
    steps: str | list[str],
    start: str | datetime,
    end: str | datetime,
    within: timedelta | None = None,
    now: str | datetime | None = None,
    retention_days: int = 0,
    hot_rows: int = WINDOW_ROWS,
    longest: timedelta | None = None,
) -> DataFrame:
    """(step_no, step, users) for each step; no users gives zeros."""
    names = clean_steps(steps)
    if len(names) < 2:
        raise ValueError("at least 2 steps are required")
    check_range(start, end, now, retention_days, longest)
    times = funnel_times(track, names, start, end, within, hot_rows)
    counts = times.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(1, len(names) + 1)])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i}").alias("users"))
                    for i, name in enumerate(names, 1)
                ]
            )
        )
    )


def with_conversion(steps: DataFrame) -> DataFrame:
    """Step-over-step conversion and drop-off; the window runs over one row per step."""
    previous = F.lag("users").over(Window.orderBy("step_no"))
    return steps.select(
        "step_no",
        "step",
        "users",
        F.when(F.col("step_no") == 1, 1.0)
        .when(previous > 0, F.col("users") / previous)
        .otherwise(0.0)
        .alias("conversion"),
        F.when((F.col("step_no") > 1) & (previous > 0), previous - F.col("users"))
        .otherwise(0)
        .alias("dropoff"),
    )


def funnel_source(
    track: DataFrame,
    logs: DataFrame,
    steps: list[str],
    start: str | datetime,
    end: str | datetime,
    source: str = "auto",
) -> tuple[DataFrame, str]:
    """The rows a funnel runs on. `auto` takes track events if any step occurs there in range."""
    wanted = source.strip().lower()
    if wanted in ("", "auto"):
        probe = between(track, start, end).filter(F.col("name").isin(clean_steps(steps)))
        wanted = "logs" if probe.isEmpty() else "track_events"
    if wanted in ("track_events", "track"):
        return track, "track_events"
    if wanted == "logs":
        return logs_as_track(logs), "logs"
    raise ValueError(f"no funnel source is called {source!r}")

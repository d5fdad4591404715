"""Calendar keys, buckets and range filters (session time zone UTC)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats of calendar keys.
DAY, MONTH = "yyyy-MM-dd", "yyyy-MM"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def as_datetime(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def moment(value: str | datetime) -> Column:
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, DAY)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, MONTH)


def bucket_key(ts: Column, granularity: str | None) -> Column:
    """day, week (its Monday) or month key; 'all' when time is not a dimension."""
    if granularity is None:
        return F.lit("all")
    if granularity == "week":
        return F.date_format(F.date_trunc("week", ts), DAY)
    return {"day": day_key, "month": month_key}[granularity](ts)


def interval_start(ts: Column, interval: str) -> Column:
    """Start of the 1m / 1h / 1d bucket; an unknown interval reads as one hour."""
    unit = {"1m": "minute", "1d": "day"}.get(interval, "hour")
    return F.date_trunc(unit, ts)


def micros_text(ts: Column) -> Column:
    return F.date_format(ts, MICROS)


def between(
    df: DataFrame,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    *,
    end_open: bool = False,
) -> DataFrame:
    """Rows with start <= ts <= end (< end if `end_open`).

    A stored table also carries its `day` partition column: the same range on `day` is added,
    because Spark does not infer partition pruning from a range on `ts`.
    """
    if start is not None:
        start = as_datetime(start)
        df = df.filter(F.col("ts") >= moment(start))
        if "day" in df.columns:
            df = df.filter(F.col("day") >= F.lit(start.strftime("%Y-%m-%d")))
    if end is not None:
        end = as_datetime(end)
        df = df.filter(F.col("ts") < moment(end) if end_open else F.col("ts") <= moment(end))
        if "day" in df.columns:
            df = df.filter(F.col("day") <= F.lit(end.strftime("%Y-%m-%d")))
    return df


def ordered(start: str | datetime, end: str | datetime) -> tuple[datetime, datetime]:
    start, end = as_datetime(start), as_datetime(end)
    return (end, start) if end < start else (start, end)


def whole_days(start: str | datetime, end: str | datetime) -> tuple[date, date]:
    start, end = ordered(start, end)
    return start.date(), end.date()


def day_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row per day: column `day`."""
    span = (last - first).days + 1
    return spark.range(span).select(
        F.date_format(F.date_add(F.lit(first), F.col("id").cast("int")), DAY).alias("day")
    )


def month_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row per calendar month: column `month`."""
    span = (last.year - first.year) * 12 + last.month - first.month + 1
    return spark.range(span).select(
        F.date_format(F.add_months(F.lit(first.replace(day=1)), F.col("id").cast("int")), MONTH).alias(
            "month"
        )
    )


def days_back(now: str | datetime, days: int) -> datetime:
    return as_datetime(now) - timedelta(days=days)

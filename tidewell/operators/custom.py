"""Ad-hoc event analysis by time, event name and one property."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.times import as_datetime, between, bucket_key, ordered

# What a request may ask for.
ANALYSIS_TYPES = ["event", "property"]
METRICS = ["count_events", "count_users"]
GRANULARITIES = ["day", "week", "month"]
PROPERTY_KEY = re.compile(r"[a-z0-9_.-]+")
MAX_DIMENSIONS, DEFAULT_DAYS = 2, 13
MAX_RANGE = timedelta(days=180)


@dataclass
class Analysis:
    start: datetime
    end: datetime
    granularity: str = "day"
    metric: str = "count_events"
    dimensions: list[str] = field(default_factory=lambda: ["time"])
    property_key: str = ""
    events: list[str] = field(default_factory=list)
    properties: dict[str, list[str]] = field(default_factory=dict)

    @property
    def by_time(self) -> bool:
        return "time" in self.dimensions

    @property
    def by_event(self) -> bool:
        return "event" in self.dimensions

    @property
    def by_property(self) -> bool:
        return "property" in self.dimensions and self.property_key != ""


def _choice(value: str | None, allowed: list[str], what: str, default: str | None = None) -> str:
    value = (value or "").strip().lower() or default
    if value not in allowed:
        raise ValueError(f"invalid {what} (expected {'|'.join(allowed)})")
    return value


def _safe_key(key: str) -> str:
    if not PROPERTY_KEY.fullmatch(key):
        raise ValueError(f"invalid property key {key!r}")
    return key


def _dimensions(tokens: list[str]) -> tuple[list[str], str]:
    if len(tokens) > MAX_DIMENSIONS:
        raise ValueError("too many group_by dimensions (max 2)")
    found, key = [], ""
    for token in (t.strip().lower() for t in tokens):
        if token.startswith("property:"):
            wanted = _safe_key(token.removeprefix("property:").strip())
            if key not in ("", wanted):
                raise ValueError("only one property dimension is supported")
            key, token = wanted, "property"
        elif token not in ("", "time", "event"):
            raise ValueError(f"invalid group_by token {token!r}")
        if token and token not in found:
            found.append(token)
    return found or ["time"], key


def _moment(text: str | None, default: datetime) -> datetime:
    if not text or not text.strip():
        return default
    value = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return value.replace(tzinfo=None) - (value.utcoffset() or timedelta(0))


def parse_request(request: dict | str, now: str | datetime) -> Analysis:
    """Check a request (a dict or its saved JSON) and fill its defaults.

    The analysis type and the target property are checked but do not change the result.
    """
    req = json.loads(request) if isinstance(request, str) else request
    _choice(req.get("analysis_type"), ANALYSIS_TYPES, "analysis_type")
    times = req.get("time_range") or {}
    end = _moment(times.get("end"), as_datetime(now))
    start = _moment(times.get("start"), end - timedelta(days=DEFAULT_DAYS))
    start, end = ordered(start, end)
    if end - start > MAX_RANGE:
        raise ValueError("time range too large (max 180d)")
    dimensions, key = _dimensions(req.get("group_by") or [])
    target, wanted = req.get("target") or {}, req.get("filter") or {}
    names = [*(target.get("events") or []), *(wanted.get("events") or [])]
    properties = {k: list(f.get("values") or []) for k, f in (wanted.get("properties") or {}).items()}
    return Analysis(
        start,
        end,
        _choice(times.get("granularity"), GRANULARITIES, "granularity", "day"),
        _choice((req.get("metric") or {}).get("type"), METRICS, "metric.type", "count_events"),
        dimensions,
        key,
        [n.strip() for n in names if n.strip()],
        {_safe_key(k): v for k, v in properties.items() if v},
    )


def property_text(key: str) -> Column:
    """Text of one top-level key of `fields`; a dot in the key is part of the key."""
    return F.get_json_object("fields", f"$['{key}']")


def custom_events(logs: DataFrame, ask: Analysis) -> DataFrame:
    """(bucket, event_name, prop_value, events, users) over log rows of level `event`.

    A blank distinct id counts as one user. Counting per user first keeps both numbers exact and
    spreads a hot bucket or name over its users.
    """
    rows = between(logs, ask.start, ask.end).filter(F.col("level") == "event")
    if ask.events:
        rows = rows.filter(F.col("message").isin(ask.events))
    for key, values in ask.properties.items():
        rows = rows.filter(property_text(key).isin(values))
    keys = [
        bucket_key(F.col("ts"), ask.granularity if ask.by_time else None).alias("bucket"),
        (F.col("message") if ask.by_event else F.lit("")).alias("event_name"),
        (property_text(ask.property_key) if ask.by_property else F.lit("")).alias("prop_value"),
    ]
    per_user = rows.groupBy(*keys, "distinct_id").agg(F.count(F.lit(1)).alias("events"))
    counted = per_user.groupBy("bucket", "event_name", "prop_value").agg(
        F.sum("events").alias("events"), F.count("distinct_id").alias("users")
    )
    return counted.withColumn("prop_value", F.coalesce("prop_value", F.lit("")))


def custom_series(rows: DataFrame, ask: Analysis) -> DataFrame:
    """(series, name, bucket, value, total): points of each named series in long form.

    The total sums the points, for users as well, so it is not distinct across buckets.
    """
    parts = []
    if ask.by_event:
        parts.append(F.when(F.col("event_name") != "", F.concat(F.lit("event="), F.col("event_name"))))
    if ask.by_property:
        parts.append(F.when(F.col("prop_value") != "", F.concat(F.lit("property="), F.col("prop_value"))))
    joined = F.concat_ws("|", *parts) if parts else F.lit("")
    series = F.when(joined == "", "all").otherwise(joined)
    if ask.by_event and not ask.by_property:
        name = F.col("event_name")
    elif ask.by_property and not ask.by_event:
        name = F.col("prop_value")
    else:
        name = series
    value = F.col("users" if ask.metric == "count_users" else "events")
    points = rows.groupBy(series.alias("series"), name.alias("name"), "bucket").agg(F.sum(value).alias("value"))
    # A series has at most one point per bucket of the range.
    whole = Window.partitionBy("series", "name")
    return points.withColumn("total", F.sum("value").over(whole))


def series_points(long_form: DataFrame) -> DataFrame:
    """One row per series with its points in time order (bounded by the buckets of 180 days)."""
    point = F.struct(F.col("bucket").alias("time"), F.col("value"))
    return long_form.groupBy("series", "name", "total").agg(
        F.sort_array(F.collect_list(point)).alias("points")
    )

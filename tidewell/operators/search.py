"""Lookups and log search."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import all_of, contains_pattern, has_word, present
from tidewell.functions.times import between, moment
from tidewell.operators.top_events import row_limit

# Default page sizes of the listings.
EVENT_PAGE, LOG_PAGE, SEARCH_PAGE, RUN_PAGE, DELIVERY_PAGE = 50, 100, 50, 50, 50
# Characters of context around a hit.
CONTEXT = 30
# Field names of a search and the JSON key or column behind them.
JSON_FIELDS = ["environment", "service", "tag"]
COLUMN_FIELDS = {
    "level": "level", "trace_id": "trace_id", "traceid": "trace_id",
    "span_id": "span_id", "spanid": "span_id", "message": "message",
}
HIT = ["id", "ts", "level", "trace_id", "span_id", "message", "fields"]


def newest(df: DataFrame, limit: int | None, page: int, most: int | None = None) -> DataFrame:
    """Newest first, the id as tie-break; a top-N, so no full sort."""
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(row_limit(limit, page, most))


def recent_events(events: DataFrame, limit: int | None = None, most: int | None = None) -> DataFrame:
    return newest(events.select("id", "ts", "level", "title"), limit, EVENT_PAGE, most)


def event_by_id(events: DataFrame, project_id: int | list[int], event_id: str | int) -> DataFrame:
    """The event, if one of the projects that the caller may read has it."""
    projects = project_id if isinstance(project_id, list) else [project_id]
    return events.filter(F.col("project_id").isin(projects) & (F.col("id") == event_id)).select("id", "data")


def log_hits(logs: DataFrame) -> DataFrame:
    """The returned columns; empty fields read as null."""
    fields = F.when(~F.col("fields").isin("null", "{}"), F.col("fields"))
    return logs.withColumn("fields", fields).select(*HIT)


def log_filters(
    logs: DataFrame,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    trace_id: str = "",
    level: str = "",
) -> DataFrame:
    rows = between(logs, start, end)
    if trace_id:
        rows = rows.filter(F.col("trace_id") == trace_id)
    if level:
        rows = rows.filter(F.col("level") == level)
    return rows


def query_words(q: str) -> list[str]:
    """The distinct words of a query, as the text of a row is cut into words."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", q.lower())))


def match_all_words(q: str) -> Column:
    """Message and fields together hold every word of the query; no words match nothing."""
    words = query_words(q)
    if not words:
        return F.lit(False)
    low = F.lower(F.concat_ws(" ", "message", "fields"))
    return all_of([has_word(low, w) for w in words])


def match_substring(q: str) -> Column:
    """Substring of the message or of the fields, ignoring case; % and _ are wildcards."""
    pattern = contains_pattern(q)
    return F.col("message").ilike(pattern) | F.col("fields").ilike(pattern)


def search_logs(
    logs: DataFrame,
    q: str = "",
    mode: str = "",
    limit: int | None = None,
    most: int | None = None,
    **filters: str | datetime | None,
) -> DataFrame:
    """Log hits, newest first. Mode '' or 'fts' looks for words, any other mode for a substring."""
    rows = log_filters(logs, **filters)
    if q:
        words = mode.strip().lower() in ("", "fts")
        rows = rows.filter(match_all_words(q) if words else match_substring(q))
    return newest(log_hits(rows), limit, LOG_PAGE, most)


def search_field(name: str, columns: list[str]) -> Column:
    """The column behind a field name; unknown names are an error."""
    low = name.strip().lower()
    if low in JSON_FIELDS:
        return F.get_json_object("fields", f"$['{low}']")
    if low in COLUMN_FIELDS:
        return F.col(COLUMN_FIELDS[low])
    if name in columns:
        return F.col(name)
    raise ValueError(f"unknown search field {name!r}")


def predicate(field: Column, op: str, value: object = None) -> Column:
    """One structured filter; an unknown operator reads as equality."""
    match op.lower():
        case "neq":
            return field != value
        case "contains":
            return field.ilike(contains_pattern(str(value)))
        case "in":
            return field.isin(list(value))
        case "exists":
            return present(field)
        case "not_exists":
            return field.isNull() | (field == "")
        case _:
            return field == value


def search(
    logs: DataFrame,
    filters: list[tuple[str, str, object]] = (),
    keywords: list[str] = (),
    start: str | datetime | None = None,
    end: str | datetime | None = None,
) -> DataFrame:
    """All rows that pass every filter (field, op, value) and hold every keyword."""
    conditions = [predicate(search_field(f, logs.columns), op, value) for f, op, value in filters]
    conditions += [F.col("message").ilike(contains_pattern(k)) for k in keywords]
    return between(logs, start, end).filter(all_of(conditions))


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("total"))


def page(
    hits: DataFrame,
    number: int = 1,
    size: int | None = None,
    sort: str = "ts",
    ascending: bool = False,
    most: int | None = None,
) -> DataFrame:
    """One page of hits. The cost grows with the page number; for deep pages use page_after."""
    size = row_limit(size, SEARCH_PAGE, most)
    by = F.asc if ascending else F.desc
    offset = (max(number, 1) - 1) * size
    return log_hits(hits).orderBy(by(sort), by("id")).offset(offset).limit(size)


def page_after(
    hits: DataFrame, ts: str | datetime, row_id: int | str, size: int | None = None, most: int | None = None
) -> DataFrame:
    """The next newest-first page after the last row (ts, id) of the previous one."""
    older = (F.col("ts") < moment(ts)) | ((F.col("ts") == moment(ts)) & (F.col("id") < row_id))
    return newest(log_hits(hits.filter(older)), size, SEARCH_PAGE, most)


def facets(hits: DataFrame) -> DataFrame:
    """Hits per level."""
    return hits.groupBy("level").agg(F.count(F.lit(1)).alias("count"))


def highlight(hits: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds `snippets`: the first hit of each keyword with 30 characters on both sides."""
    low = F.lower("message")
    cuts = []
    for word in keywords:
        at = F.locate(word.lower(), low) if word else F.lit(0)
        first = F.greatest(at - CONTEXT, F.lit(1))
        cuts.append(F.when(at > 0, F.substring("message", first, at + len(word) + CONTEXT - first)))
    return hits.withColumn("snippets", F.array_compact(F.array(*cuts)))


def list_deliveries(
    deliveries: DataFrame,
    status: str = "",
    channel: str = "",
    rule_id: int | None = None,
    limit: int | None = None,
    most: int | None = None,
) -> DataFrame:
    rows = deliveries
    if status:
        rows = rows.filter(F.col("status") == status)
    if channel:
        rows = rows.filter(F.col("channel_type") == channel)
    if rule_id:
        rows = rows.filter(F.col("rule_id") == rule_id)
    return rows.orderBy(F.desc("id")).limit(row_limit(limit, DELIVERY_PAGE, most))


def list_monitor_runs(runs: DataFrame, monitor_id: int, limit: int | None = None, most: int | None = None) -> DataFrame:
    own = runs.filter(F.col("monitor_id") == monitor_id)
    return own.orderBy(F.desc("id")).limit(row_limit(limit, RUN_PAGE, most))

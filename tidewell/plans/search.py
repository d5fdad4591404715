"""Lookups and log search over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.times import micros_text
from tidewell.operators import search
from tidewell.plans.model_sql import CONV_LOGS, DOC_LOGS, errors, micros
from tidewell.plans.registry import query
from tidewell.sources import tables

AT = micros("ts")


def _shown(hits):
    return hits.withColumn("ts", micros_text(F.col("ts")))


def _brief(hits):
    return _shown(hits).select("id", "ts", "level")


@query(
    "recent_events",
    f"WITH {errors()} SELECT id, {AT} AS ts, level, title FROM error_events e ORDER BY e.ts DESC, id DESC LIMIT 50",
)
def _(spark, sf):
    return _shown(search.recent_events(tables.error_events(spark, sf)))


@query("event_by_id", f"WITH {errors(3)} SELECT id, data FROM error_events WHERE project_id = 1 + (SELECT user_id % 3 FROM events WHERE event_id = 417) AND id = 417")
def _(spark, sf):
    return search.event_by_id(tables.error_events(spark, sf, 3), [1, 2, 3], 417)


DOC_HITS = f"SELECT id, {AT} AS ts, level FROM logs l"
CONV_HITS = f"SELECT id, {AT} AS ts, level FROM logs l"


@query(
    "search_logs_filters",
    f"""WITH {CONV_LOGS} {CONV_HITS} WHERE level = 'info' AND l.ts >= TIMESTAMP '2024-01-01 00:01:40'
      AND l.ts <= TIMESTAMP '2024-01-02 12:00:00' ORDER BY l.ts DESC, id DESC LIMIT 100""",
)
def _(spark, sf):
    logs = tables.conversation_logs(spark, sf)
    return _brief(search.search_logs(logs, start="2024-01-01 00:01:40", end="2024-01-02 12:00:00", level="info"))


@query(
    "search_logs_trace",
    f"WITH {CONV_LOGS} {CONV_HITS} WHERE trace_id = '7' ORDER BY l.ts DESC, id DESC LIMIT 100",
)
def _(spark, sf):
    return _brief(search.search_logs(tables.conversation_logs(spark, sf), trace_id="7"))


@query(
    "search_logs_fts",
    f"""WITH {DOC_LOGS} {DOC_HITS}
      WHERE list_has_all(regexp_extract_all(lower(message || ' ' || fields), '[\\p{{L}}\\p{{N}}]+'), ['the', 'src1', 'un'])
      ORDER BY l.ts DESC, id DESC LIMIT 100""",
)
def _(spark, sf):
    return _brief(search.search_logs(tables.document_logs(spark, sf), "The src1, UN"))


@query(
    "search_logs_like",
    f"""WITH {DOC_LOGS} {DOC_HITS} WHERE message ILIKE '%th_re%of%' OR fields ILIKE '%th_re%of%'
      ORDER BY l.ts DESC, id DESC LIMIT 200""",
)
def _(spark, sf):
    return _brief(search.search_logs(tables.document_logs(spark, sf), "th_re%of", mode="like", limit=200))


@query(
    "log_hit_projection",
    f"""WITH {CONV_LOGS} SELECT id, {AT} AS ts, level, trace_id, span_id, message, nullif(fields, '{{}}') AS fields FROM logs""",
)
def _(spark, sf):
    return _shown(search.log_hits(tables.conversation_logs(spark, sf)))


FILTERS = [
    ("level", "neq", "info"),
    ("Service", "in", ["src1", "src2", "src3"]),
    ("message", "contains", "th"),
    ("service", "exists", None),
    ("environment", "not_exists", None),
]
FILTER_SQL = """level <> 'info' AND service IN ('src1', 'src2', 'src3') AND message ILIKE '%th%' AND service <> ''"""


@query("search_predicates", f"WITH {DOC_LOGS} {DOC_HITS} WHERE {FILTER_SQL}")
def _(spark, sf):
    return _brief(search.search(tables.document_logs(spark, sf), FILTERS))


@query(
    "search_field_map",
    f"WITH {CONV_LOGS} {CONV_HITS} WHERE trace_id = '3' AND coalesce(span_id, '') <> '2' AND span_id IS NOT NULL",
)
def _(spark, sf):
    logs = tables.conversation_logs(spark, sf)
    return _brief(search.search(logs, [("traceId", "", "3"), ("spanid", "neq", "2"), ("tag", "not_exists", None)]))


KEYWORD_SQL = "message ILIKE '%the%' AND message ILIKE '%is%'"


@query("search_keywords", f"WITH {DOC_LOGS} {DOC_HITS} WHERE {KEYWORD_SQL}")
def _(spark, sf):
    return _brief(search.search(tables.document_logs(spark, sf), keywords=["the", "IS"]))


@query("search_total", f"WITH {DOC_LOGS} SELECT COUNT(*) AS total FROM logs WHERE {FILTER_SQL} AND {KEYWORD_SQL}")
def _(spark, sf):
    return search.total(search.search(tables.document_logs(spark, sf), FILTERS, ["the", "is"]))


@query(
    "search_page",
    f"WITH {DOC_LOGS} {DOC_HITS} WHERE {KEYWORD_SQL} ORDER BY l.ts DESC, id DESC LIMIT 40 OFFSET 80",
)
def _(spark, sf):
    return _brief(search.page(search.search(tables.document_logs(spark, sf), keywords=["the", "is"]), 3, 40))


@query(
    "search_page_after",
    f"""WITH {DOC_LOGS} {DOC_HITS} WHERE {KEYWORD_SQL} AND l.ts < TIMESTAMP '2024-01-01 05:00:00'
      ORDER BY l.ts DESC, id DESC LIMIT 40""",
)
def _(spark, sf):
    hits = search.search(tables.document_logs(spark, sf), keywords=["the", "is"])
    return _brief(search.page_after(hits, "2024-01-01 05:00:00", 300, 40))


@query("search_facets", f"WITH {DOC_LOGS} SELECT level, COUNT(*) AS count FROM logs WHERE {KEYWORD_SQL} GROUP BY level")
def _(spark, sf):
    return search.facets(search.search(tables.document_logs(spark, sf), keywords=["the", "is"]))


def _snippet(word: str) -> str:
    at = f"strpos(lower(message), '{word}')"
    first = f"greatest(1, {at} - 30)"
    return f"CASE WHEN {at} > 0 THEN substr(message, {first}, {at} + {len(word)} + 30 - {first}) END"


@query(
    "search_highlight",
    f"""WITH {DOC_LOGS} SELECT id, concat_ws(' ... ', {_snippet('the')}, {_snippet('is')}) AS snippets FROM logs
      WHERE message ILIKE '%the%' """,
)
def _(spark, sf):
    hits = search.search(tables.document_logs(spark, sf), keywords=["the"])
    return search.highlight(hits, ["the", "IS"]).select("id", F.array_join("snippets", " ... ").alias("snippets"))

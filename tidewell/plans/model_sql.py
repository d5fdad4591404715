"""SQL common table expressions: the model tables over the given tables, for the checks."""

from __future__ import annotations


def project(n: int) -> str:
    return "CAST(1 AS BIGINT)" if n == 1 else f"CAST(1 + user_id % {n} AS BIGINT)"


def track(n: int = 1) -> str:
    return f"""track_events AS (
      SELECT {project(n)} AS project_id, ts, CAST(event_id AS VARCHAR) AS ingest_id,
             event_type AS name, CAST(user_id AS VARCHAR) AS distinct_id,
             'd' || user_id AS device_id
      FROM events)"""


def logs(n: int = 1) -> str:
    return f"""logs AS (
      SELECT event_id AS id, {project(n)} AS project_id, ts,
             CAST(event_id AS VARCHAR) AS ingest_id, 'event' AS level,
             CAST(user_id AS VARCHAR) AS distinct_id, 'd' || user_id AS device_id,
             event_type AS message, props AS fields
      FROM events)"""


LEVEL = "CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END"
OS = "['iOS 17', 'Android 14', 'Windows 11'][1 + user_id % 3]"
BROWSER = "['Chrome 120', 'Safari 17', 'Firefox 121', 'Edge 119'][1 + user_id % 4]"
IP = "((user_id * 2654435761) % 4294967296)"


def errors(n: int = 1) -> str:
    return f"""error_events AS (
      SELECT event_id AS id, {project(n)} AS project_id, ts, {LEVEL} AS level,
             CAST(user_id AS VARCHAR) AS distinct_id, 'd' || user_id AS device_id,
             {OS} AS os, {BROWSER} AS browser, event_type AS title,
             '{{"event_id":"' || event_id || '","message":"' || event_type || '","level":"' ||
             {LEVEL} || '","user":{{"id":"' || user_id || '"}},"extra":' || props || '}}' AS data,
             {IP} AS ip
      FROM events)"""


GEO = f"""geo_ranges AS (
      SELECT n_nationkey * {(1 << 32) // 25} AS lo,
             n_nationkey * {(1 << 32) // 25} + {(1 << 32) // 25 - 1} AS hi,
             'C' || n_nationkey AS country, r_name AS region, n_name AS city,
             'AS' || (n_nationkey % 7) AS asn_org
      FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation)
      JOIN region ON n_regionkey = r_regionkey)"""

DOC_LOGS = """logs AS (
      SELECT d.doc_id AS id, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS ts,
             CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warn' ELSE 'info' END AS level,
             text AS message,
             '{"lang":"' || lang || '","service":"' || source || '"}' AS fields,
             lang, source AS service
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CONV_LOGS = """logs AS (
      SELECT conv_id * 100 + turn AS id,
             TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + turn) AS ts,
             CASE WHEN role = 'user' THEN 'info' ELSE 'debug' END AS level,
             CAST(conv_id AS VARCHAR) AS trace_id,
             CASE WHEN turn > 0 THEN CAST(turn AS VARCHAR) END AS span_id,
             text AS message,
             CASE WHEN turn % 2 = 0 THEN '{"role":"' || role || '"}' ELSE '{}' END AS fields
      FROM conversations)"""

PROBES = """probes AS (
      SELECT event_id AS id, CAST(user_id % 5 AS BIGINT) AS monitor_id, ts,
             round(value, 2) AS elapsed_ms, event_type <> 'error' AS success
      FROM events)"""


def micros(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"

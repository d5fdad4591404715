"""Monitors over the events, pages and customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.times import micros_text
from tidewell.operators import alert_rules, monitors, search
from tidewell.plans.model_sql import PROBES, micros
from tidewell.plans.registry import query
from tidewell.sources import tables

START, END = "2024-01-05 06:00:00", "2024-01-20 18:30:00"
IN_RANGE = f"ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'"


def _metrics(spark, sf):
    """Readings with the value as a number, as text, missing, or not numeric."""
    n, value = F.col("event_id"), F.format_string("%.2f", F.col("value"))
    shown = (
        F.when(n % 5 == 0, F.concat(F.lit('"'), value, F.lit('"')))
        .when(n % 5 == 1, '"high"')
        .when(n % 5 == 2, "true")
        .otherwise(value)
    )
    inner = F.when(n % 7 == 0, "{}").otherwise(F.concat(F.lit('{"load":'), shown, F.lit("}")))
    return tables.load(spark, sf, "events").select(
        n.cast("string").alias("row_id"), F.lit(1).alias("project_id"), F.col("ts"),
        F.concat(F.lit('{"cpu":'), inner, F.lit("}")).alias("data"),
    )


GOOD = "event_id % 7 <> 0 AND event_id % 5 NOT IN (1, 2)"


def _threshold_sql(bad: str, op: str, severity: str) -> str:
    return f"""SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN {bad} THEN '{severity}' ELSE 'info' END AS severity,
        CASE WHEN {bad} THEN 'firing' ELSE 'resolved' END AS status,
        CASE WHEN {bad} THEN 'metric_threshold violated: field=cpu.load value=' ||
            CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || ' op={op}'
          ELSE 'metric_threshold ok' END AS message
      FROM (SELECT event_id, round(value, 2) AS value FROM events WHERE {GOOD})"""


def _verdicts(signals):
    return signals.select("row_id", "severity", "status", "message")


@query("metric_threshold", _threshold_sql("value > 40", ">", "warn"))
def _(spark, sf):
    config = {"field": "cpu.load", "op": ">", "value": 40, "severityOnViolation": " warn "}
    return _verdicts(monitors.metric_threshold(_metrics(spark, sf), config).rows)


@query("metric_threshold_between", _threshold_sql("(value < 5 OR value > 60)", "between", "error"))
def _(spark, sf):
    config = {"field": "cpu.load", "op": "between", "min": 5, "max": 60}
    return _verdicts(monitors.metric_threshold(_metrics(spark, sf), config).rows)


@query(
    "metric_threshold_rejects",
    f"""SELECT CASE WHEN event_id % 7 = 0 THEN 'metric field cpu.load not found' ELSE 'metric field cpu.load is not numeric' END AS reason,
        COUNT(*) AS n FROM events WHERE NOT ({GOOD}) GROUP BY 1""",
)
def _(spark, sf):
    rejects = monitors.metric_threshold(_metrics(spark, sf), {"field": "cpu.load", "op": "<=", "value": 1}).rejects
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _payload_rows(spark, sf):
    n = F.col("event_id")
    data = F.concat(
        F.lit('{"title":" '), F.col("event_type"), F.lit(' "'),
        F.when(n % 2 == 0, F.concat(F.lit(',"message":"m'), n, F.lit('"'))).otherwise(',"message":"  "'),
        F.when(n % 3 == 0, ',"severity":"fatal"').when(n % 3 == 1, ',"level":"warn"').otherwise(""),
        F.when(n % 4 == 0, ',"status":"resolved","source":" EVENTS "').otherwise(""),
        F.lit(',"labels":{"user":'), F.col("user_id"), F.lit("}}"),
    )
    return tables.load(spark, sf, "events").select(
        n.cast("string").alias("row_id"), F.lit(1).alias("project_id"), F.col("ts"), data.alias("data")
    )


SIGNALS = """SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN event_id % 4 = 0 THEN 'events' ELSE 'logs' END AS source,
        ['fatal', 'warn', 'info'][1 + event_id % 3] AS severity, CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'firing' END AS status,
        event_type AS title, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE event_type END AS message"""


@query("signals_from_rows", f"{SIGNALS}, CAST(user_id AS VARCHAR) AS label FROM events")
def _(spark, sf):
    rows = monitors.signals_from_rows(_payload_rows(spark, sf))
    return rows.select("row_id", "source", "severity", "status", "title", "message", F.col("labels")["user"].alias("label"))


def _monitors(spark, sf):
    """One monitor per nation."""
    return tables.load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.lit(7).alias("project_id"), F.col("n_name").alias("name"),
        F.lit(" log_basic ").alias("detector_type"),
    )


def _bare_signals(spark, sf):
    """Signals with blanks where their monitor has to fill in."""
    n = F.col("row_id").cast("bigint")
    rows = monitors.signals_from_rows(_payload_rows(spark, sf))
    return rows.withColumns(
        {
            "monitor_id": (n % 25).cast("int"),
            "project_id": F.when(n % 2 == 0, 0).otherwise(F.col("project_id")),
            "source_type": F.lit(""),
            "severity": F.when(n % 3 == 0, " ").otherwise(F.col("severity")),
            "message": F.when(n % 5 == 0, "").otherwise(F.col("message")),
            "run_at": F.lit("2024-02-01 00:00:00").cast("timestamp"),
            "occurred_at": F.when(n % 4 != 0, F.col("occurred_at")),
            "fields": F.when(n % 6 != 0, '{"a":1,"monitor_id":"x"}'),
        }
    )


@query(
    "normalize_signals",
    f"""SELECT CAST(event_id AS VARCHAR) AS row_id, CAST(CASE WHEN event_id % 2 = 0 THEN 7 ELSE 1 END AS INTEGER) AS project_id,
        'log_basic' AS source_type, ['info', 'warn', 'info'][1 + event_id % 3] AS severity,
        CASE WHEN event_id % 5 = 0 THEN n_name WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE event_type END AS message,
        {micros("CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END")} AS occurred_at,
        CASE WHEN event_id % 6 = 0 THEN '{{' ELSE '{{"a":1,' END || '"monitor_id":' || n_nationkey || ',"monitor_name":"' || n_name || '"}}' AS fields
      FROM events JOIN nation ON n_nationkey = event_id % 25""",
)
def _(spark, sf):
    rows = monitors.normalize_signals(_bare_signals(spark, sf), _monitors(spark, sf))
    return rows.select(
        "row_id", "project_id", "source_type", "severity", "message", micros_text(F.col("occurred_at")).alias("occurred_at"), "fields"
    )


@query(
    "signal_inputs",
    """SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN event_id % 4 = 0 THEN 'events' ELSE 'logs' END AS source,
        ['fatal', 'warn', 'info'][1 + event_id % 3] AS level,
        CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE event_type END AS message,
        '{"labels":{"user":"' || user_id || '"},"signal_status":"' || CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'firing' END ||
          '","source_type":"log_basic","x":1}' AS fields FROM events""",
)
def _(spark, sf):
    rows = monitors.signals_from_rows(_payload_rows(spark, sf)).withColumn("fields", F.lit('{"x":1,"labels":"gone"}'))
    inputs = alert_rules.with_fields(alert_rules.inputs_from_signals(rows))
    return inputs.select("row_id", "source", "level", "message", alert_rules.fields_json().alias("fields"))


PAGE_ERROR = "page_id % 11 = 0"
PAGE_CODE = "[200, 204, 404, 500][1 + page_id % 4]"


@query(
    "classify_http_results",
    f"""WITH p AS (SELECT page_id, html, {PAGE_ERROR} AS failed, {PAGE_CODE} AS code, page_id % 40 AS days FROM pages),
      v AS (SELECT *, CASE WHEN failed THEN 'http_check failed: timeout'
          WHEN html <> '' AND NOT contains(html, 'the') THEN 'body does not contain expected substring'
          WHEN code NOT IN (200, 204) THEN 'non-2xx status code: ' || code
          WHEN days < 15 THEN 'certificate expiring soon: days_left=' || days || '.00 < min=15' END AS problem FROM p)
      SELECT CAST(page_id AS VARCHAR) AS row_id, CASE WHEN problem IS NULL THEN 'info' ELSE 'error' END AS severity,
        CASE WHEN problem IS NULL THEN 'resolved' ELSE 'firing' END AS status, coalesce(problem, 'http_check ok') AS message FROM v""",
)
def _(spark, sf):
    n = F.col("page_id")
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 204, 404, 500)]), (n % 4 + 1).cast("int"))
    rows = tables.load(spark, sf, "pages").select(
        n.cast("string").alias("row_id"), F.lit(1).alias("project_id"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("ts"),
        "url", F.lit("GET").alias("method"), n.alias("elapsed_ms"), F.when(n % 11 == 0, "timeout").alias("error"),
        code.alias("status_code"), F.col("html").alias("body"), (n % 40).cast("double").alias("cert_days_left"),
    )
    return _verdicts(monitors.classify_http(rows, {"expectBodySubstring": "the", "minTlsValidDays": 15}))


@query(
    "classify_tcp_results",
    """SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity,
        CASE WHEN event_type = 'error' THEN 'firing' ELSE 'resolved' END AS status,
        CASE WHEN event_type = 'error' THEN 'tcp_check failed: refused' ELSE 'tcp_check ok' END AS message,
        'TCP h' || user_id || ':443' AS title, event_type <> 'error' AS success FROM events""",
)
def _(spark, sf):
    rows = tables.load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("row_id"), F.lit(1).alias("project_id"), F.col("ts"),
        F.concat(F.lit("h"), F.col("user_id")).alias("host"), F.lit(443).alias("port"), F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", "refused").alias("error"),
    )
    signals = monitors.classify_tcp(rows)
    success = F.get_json_object("fields", "$.success").cast("boolean").alias("success")
    return signals.select("row_id", "severity", "status", "message", "title", success)


RESULTS = "list_filter(['a' || c_custkey % 3, 'B' || c_custkey % 2, 'x'], lambda v: v <> 'a0')"


@query(
    "classify_dns_results",
    f"""WITH r AS (SELECT c_custkey, {RESULTS} AS results, c_custkey % 9 = 0 AS failed FROM customer),
      m AS (SELECT *, list_filter([' A1', 'b1 '], lambda v: NOT list_contains(list_transform(results, lambda r: lower(r)), lower(trim(v)))) AS missing FROM r)
      SELECT CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN failed OR len(missing) > 0 THEN 'error' ELSE 'info' END AS severity,
        CASE WHEN failed OR len(missing) > 0 THEN 'firing' ELSE 'resolved' END AS status,
        CASE WHEN failed THEN 'dns_check A d' || c_custkey || ' failed: nxdomain'
          WHEN len(missing) > 0 THEN 'dns_check: expected value ' || missing[1] || ' not found in results [' || array_to_string(results, ' ') || ']'
          ELSE 'dns_check A d' || c_custkey || ' ok' END AS message FROM m""",
)
def _(spark, sf):
    return _verdicts(monitors.classify_dns(_lookups(spark, sf, "A"), {"expectValues": [" A1", "b1 "]}))


def _lookups(spark, sf, record_type):
    n = F.col("c_custkey")
    results = F.filter(
        F.array(F.concat(F.lit("a"), n % 3), F.concat(F.lit("B"), n % 2), F.lit("x")), lambda v: v != "a0"
    )
    return tables.load(spark, sf, "customer").select(
        n.cast("string").alias("row_id"), F.lit(1).alias("project_id"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("ts"),
        F.concat(F.lit("d"), n).alias("domain"), F.lit(record_type).alias("record_type"), results.alias("results"),
        n.alias("elapsed_ms"), F.when(n % 9 == 0, "nxdomain").alias("error"),
    )


@query(
    "classify_dns_cname",
    f"""WITH r AS (SELECT c_custkey, {RESULTS} AS results, c_custkey % 9 = 0 AS failed FROM customer)
      SELECT CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN failed OR NOT suffix(lower(results[1]), '1') THEN 'error' ELSE 'info' END AS severity,
        CASE WHEN failed OR NOT suffix(lower(results[1]), '1') THEN 'firing' ELSE 'resolved' END AS status,
        CASE WHEN failed THEN 'dns_check CNAME d' || c_custkey || ' failed: nxdomain'
          WHEN NOT suffix(lower(results[1]), '1') THEN 'dns_check: CNAME mismatch, expected 1, got [' || array_to_string(results, ' ') || ']'
          ELSE 'dns_check CNAME d' || c_custkey || ' ok' END AS message FROM r""",
)
def _(spark, sf):
    return _verdicts(monitors.classify_dns(_lookups(spark, sf, "CNAME"), {"expectCNAME": "1"}))


@query(
    "classify_cert_results",
    """WITH c AS (SELECT c_custkey AS n, c_custkey % 40 - 10 AS days, c_custkey % 4 AS chain, c_custkey % 5 = 0 AS own,
          c_custkey % 13 = 0 AS failed FROM customer),
      v AS (SELECT *, CASE WHEN failed THEN 'ssl_check connection failed: reset' WHEN chain = 0 THEN 'no peer certificates found'
          WHEN n % 6 = 0 THEN 'expected SAN WWW.x not found' WHEN own THEN 'certificate is self-signed'
          WHEN days < 0 THEN 'certificate expired on ' || strftime(TIMESTAMP '2024-01-15' + to_days(CAST(days AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ')
          WHEN days < 14 THEN 'certificate expiring soon: days_left=' || days || '.0 < min=14' END AS problem FROM c)
      SELECT CAST(n AS VARCHAR) AS row_id,
        CASE WHEN problem IS NOT NULL THEN 'error' WHEN chain < 2 AND NOT own THEN 'warning' ELSE 'info' END AS severity,
        CASE WHEN problem IS NULL THEN 'resolved' ELSE 'firing' END AS status, coalesce(problem, 'ssl_check ok') AS message FROM v""",
)
def _(spark, sf):
    n, ts = F.col("c_custkey"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    rows = tables.load(spark, sf, "customer").select(
        n.cast("string").alias("row_id"), F.lit(1).alias("project_id"), ts.alias("ts"), F.concat(F.lit("h"), n).alias("host"),
        F.lit(443).alias("port"), F.when(n % 13 == 0, "reset").alias("error"), (n % 4).alias("chain_length"),
        F.timestamp_micros(F.unix_micros(ts) + (n % 40 - 10) * 86_400_000_000).alias("not_after"),
        (n % 5 == 0).alias("is_self_signed"),
        F.when(n % 6 == 0, F.array(F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("www.X"))).alias("sans"),
    )
    return _verdicts(monitors.classify_certs(rows, {"minValidDays": 14, "expectedSANs": ["y", "WWW.x"]}))


@query(
    "typed_results",
    """SELECT CAST(event_id % 25 AS INTEGER) AS monitor_id, 'log_basic' AS detector_type,
        '{"user":"' || user_id || '","severity":"' || ['fatal', 'warn', 'info'][1 + event_id % 3] || '","status":"' ||
          CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'firing' END || '"}' AS tags FROM events""",
)
def _(spark, sf):
    signals = monitors.signals_from_rows(_payload_rows(spark, sf))
    signals = signals.withColumn("monitor_id", (F.col("row_id").cast("bigint") % 25).cast("int"))
    return monitors.typed_results(signals, "log_basic").select("monitor_id", "detector_type", "tags")


@query(
    "query_results",
    f"""WITH {PROBES} SELECT id, elapsed_ms FROM probes WHERE monitor_id = 3 AND {IN_RANGE} ORDER BY ts DESC, id DESC LIMIT 1000""",
)
def _(spark, sf):
    rows = monitors.query_results(tables.probe_results(spark, sf), "http_check", 1, 3, START, END)
    return rows.select("id", F.get_json_object("data", "$.elapsed_ms").cast("double").alias("elapsed_ms"))


def _bucketed(df, *values):
    return df.select(micros_text(F.col("bucket")).alias("bucket"), *[F.round(v, 4).alias(v) for v in values])


AVG = "round(AVG(elapsed_ms), 4)"
RATE = "round(100.0 * COUNT(*) FILTER (success) / COUNT(*), 4)::DOUBLE"


def _bucket_sql(unit: str, values: str) -> str:
    return f"""WITH {PROBES} SELECT {micros(f"date_trunc('{unit}', ts)")} AS bucket, {values} FROM probes
      WHERE {IN_RANGE} GROUP BY 1"""


@query("avg_by_bucket", _bucket_sql("hour", f"{AVG} AS value"))
def _(spark, sf):
    rows = monitors.avg_by_bucket(tables.probe_results(spark, sf), "http_check", 1, "elapsed_ms", START, END, "2h")
    return _bucketed(rows, "value")


@query("success_rate", _bucket_sql("day", f"{RATE} AS value"))
def _(spark, sf):
    return _bucketed(monitors.success_rate(tables.probe_results(spark, sf), "http_check", 1, START, END, "1d"), "value")


@query("probe_summary", _bucket_sql("minute", f"{AVG} AS elapsed_ms, {RATE} AS success_rate"))
def _(spark, sf):
    rows = monitors.probe_summary(tables.probe_results(spark, sf), "http_check", 1, START, END, "1m")
    return _bucketed(rows, "elapsed_ms", "success_rate")


RUNS = """runs AS (
      SELECT CAST(user_id % 5 AS INTEGER) AS monitor_id, date_trunc('hour', ts) AS run_at, COUNT(*) FILTER (event_type <> 'error') AS signals,
        CASE WHEN COUNT(*) FILTER (event_type = 'error') > 0 THEN 'timeout' ELSE '' END AS error FROM events GROUP BY 1, 2)"""


def _runs(spark, sf):
    rows = tables.load(spark, sf, "events").select(
        (F.col("user_id") % 5).cast("int").alias("monitor_id"), F.date_trunc("hour", F.col("ts")).alias("run_at"),
        F.lit("http_check").alias("detector_type"), "event_type",
    )
    bad = F.col("event_type") == "error"
    return monitors.run_summary(rows.filter(~bad), rows.filter(bad).withColumn("error", F.lit(" timeout")), 0)


@query(
    "run_summary",
    f"""WITH {RUNS} SELECT monitor_id, {micros('run_at')} AS run_at, CASE WHEN error = '' THEN 'success' ELSE 'failed' END AS status,
        signals AS signal_count, error, CASE WHEN error = '' THEN '{{"detectorType":"http_check","intervalSec":60,"signals":' || signals || '}}'
          ELSE '{{"detectorType":"http_check"}}' END AS result FROM runs""",
)
def _(spark, sf):
    return _runs(spark, sf).withColumn("run_at", micros_text(F.col("run_at")))


@query(
    "list_monitor_runs",
    f"WITH {RUNS} SELECT {micros('run_at')} AS run_at, signals AS signal_count FROM runs r WHERE monitor_id = 2 ORDER BY r.run_at DESC LIMIT 50",
)
def _(spark, sf):
    runs = _runs(spark, sf).withColumn("id", F.unix_seconds("run_at"))
    return search.list_monitor_runs(runs, 2).select(micros_text(F.col("run_at")).alias("run_at"), "signal_count")

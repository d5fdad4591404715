"""Monitors over recorded measurements: classification into signals, results, summaries.

Nothing here opens a connection: probes are recorded elsewhere, one row per run, and judged here.
A signal has the columns of SIGNAL; `labels` is a map of text, `fields` is JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.payload import is_text, members, plain_text, read_once, value_at
from tidewell.functions.skew import BROADCAST_ROWS, lookup_join
from tidewell.functions.text import any_of, blank_to_null, normal, strip
from tidewell.functions.times import between, interval_start
from tidewell.operators.ingest import Split, split_by_reason

SIGNAL = [
    "row_id", "project_id", "source", "source_type", "severity", "status",
    "title", "message", "labels", "fields", "occurred_at",
]
# Comparison operators of a metric rule, and result page sizes.
COMPARISONS = [">", "<", ">=", "<="]
DEFAULT_RESULTS = 1000
FIRING, RESOLVED = "firing", "resolved"


def number_text(value: Column) -> Column:
    """A double as shortest text: 5 rather than 5.0."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _judged(df: DataFrame, failures: list[tuple[Column, Column]], ok: str) -> DataFrame:
    """Severity, status and message; of several failures the last one gives the message."""
    message = F.lit(ok)
    for failed, text in failures:
        message = F.when(failed, text).otherwise(message)
    bad = F.coalesce(any_of([failed for failed, _ in failures]), F.lit(False))
    return df.withColumns(
        {
            "severity": F.when(bad, "error").otherwise("info"),
            "status": F.when(bad, FIRING).otherwise(RESOLVED),
            "message": message,
        }
    )


def _signals(df: DataFrame, source_type: str, title: Column, labels: dict[str, Column], fields: Column) -> DataFrame:
    pairs = [c for key, value in labels.items() for c in (F.lit(key), value.cast("string"))]
    return df.select(
        "row_id", "project_id", F.lit("logs").alias("source"), F.lit(source_type).alias("source_type"),
        "severity", "status", title.alias("title"), "message", F.create_map(*pairs).alias("labels"),
        F.to_json(fields).alias("fields"), F.col("ts").alias("occurred_at"),
    )


def check_metric(config: dict) -> None:
    op = str(config.get("op", "")).strip()
    if not str(config.get("field", "")).strip():
        raise ValueError("field is required")
    if op == "between":
        if config.get("min") is None or config.get("max") is None or config["min"] > config["max"]:
            raise ValueError("between needs min <= max")
    elif op not in COMPARISONS:
        raise ValueError(f"unsupported op: {op}")
    elif config.get("value") is None:
        raise ValueError("value is required for comparison op")


def metric_threshold(df: DataFrame, config: dict) -> Split:
    """Compare one number of `data` (JSON text) with a limit: one signal per row.

    `between` is violated outside [min, max]. Rows without the field or without a number in it
    are rejected.
    """
    check_metric(config)
    field, op = config["field"].strip(), config["op"].strip()
    found = value_at(F.try_parse_json("data"), *field.split("."))
    kind = F.schema_of_variant("_v")
    numeric = is_text(F.col("_v")) | (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    rows = read_once(df, _v=found).withColumn("value", F.when(numeric, plain_text(F.col("_v")).try_cast("double")))
    reason = F.when(F.col("_v").isNull(), f"metric field {field} not found").when(
        F.col("value").isNull(), f"metric field {field} is not numeric"
    )
    split = split_by_reason(rows, reason)
    value = F.col("value")
    violated = {
        ">": lambda: value > config["value"],
        "<": lambda: value < config["value"],
        ">=": lambda: value >= config["value"],
        "<=": lambda: value <= config["value"],
        "between": lambda: (value < config["min"]) | (value > config["max"]),
    }[op]()
    text = F.concat(F.lit(f"metric_threshold violated: field={field} value="), number_text(value), F.lit(f" op={op}"))
    judged = _judged(split.rows, [(violated, text)], "metric_threshold ok")
    severity = str(config.get("severityOnViolation") or "").strip() or "error"
    judged = judged.withColumn("severity", F.when(F.col("status") == FIRING, severity).otherwise("info"))
    bounds = [F.lit(float(config[k])).alias(k) for k in ("max", "min") if config.get(k) is not None]
    fields = F.struct(
        F.lit(field).alias("field"), *bounds, F.lit(op).alias("op"),
        F.lit("metric_threshold").alias("source_type"), value.alias("value"),
    )
    signals = _signals(judged, "metric_threshold", F.lit(f"Metric threshold {field}"), {"field": F.lit(field)}, fields)
    return Split(signals, split.rejects.drop("_v", "value"))


def signals_from_rows(df: DataFrame) -> DataFrame:
    """Any JSON payload (`data`) as a signal, with defaults for what it leaves out."""
    names = ["source", "severity", "level", "status", "title", "message", "labels"]
    doc = F.try_parse_json("data")
    rows = read_once(df, _p=members(doc, *names))
    part = {n: blank_to_null(F.when(F.col(f"_p.{n}").isNotNull(), plain_text(F.col(f"_p.{n}")))) for n in names}
    labels = F.transform_values(
        F.try_variant_get(F.col("_p.labels"), "$", "map<string,variant>"), lambda _, v: strip(plain_text(v))
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    title = F.coalesce(part["title"], F.lit(""))
    return rows.select(
        "row_id", "project_id",
        F.lower(F.coalesce(part["source"], F.lit("logs"))).alias("source"),
        F.lit("log_basic").alias("source_type"),
        F.coalesce(part["severity"], part["level"], F.lit("info")).alias("severity"),
        F.coalesce(part["status"], F.lit(FIRING)).alias("status"),
        title.alias("title"),
        F.coalesce(part["message"], title).alias("message"),
        F.coalesce(labels, none).alias("labels"),
        F.col("data").alias("fields"),
        F.col("ts").alias("occurred_at"),
    )


def normalize_signals(signals: DataFrame, monitors: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Fill what a detector left blank from its monitor; note the monitor in the fields.

    `signals` has monitor_id and run_at besides SIGNAL; `monitors` has id, project_id, name and
    detector_type.
    """
    side = monitors.select(
        F.col("id").alias("monitor_id"), F.col("project_id").alias("_project"), F.col("name").alias("_name"),
        F.col("detector_type").alias("_type"),
    )
    rows = lookup_join(signals, side, ["monitor_id"], "inner", None, max_rows)

    def filled(name: str, default: Column) -> Column:
        return F.when(blank_to_null(F.col(name)).isNull(), default).otherwise(F.col(name))

    rest = F.map_filter(
        F.coalesce(
            F.try_variant_get(F.try_parse_json("fields"), "$", "map<string,variant>"),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")),
        ),
        lambda k, _: ~k.isin("monitor_id", "monitor_name"),
    )
    noted = F.create_map(
        F.lit("monitor_id"), F.col("monitor_id").cast("variant"), F.lit("monitor_name"), F.col("_name").cast("variant")
    )
    return rows.select(
        "row_id", "monitor_id",
        F.when(F.col("project_id") > 0, F.col("project_id")).otherwise(F.col("_project")).alias("project_id"),
        filled("source", F.lit("logs")).alias("source"),
        filled("source_type", strip(F.col("_type"))).alias("source_type"),
        filled("severity", F.lit("info")).alias("severity"),
        filled("status", F.lit(FIRING)).alias("status"),
        "title",
        filled("message", strip(F.col("_name"))).alias("message"),
        "labels",
        F.to_json(F.to_variant_object(F.map_concat(rest, noted))).alias("fields"),
        F.coalesce("occurred_at", "run_at").alias("occurred_at"),
    )


def classify_http(df: DataFrame, config: dict) -> DataFrame:
    """Responses (url, method, elapsed_ms, error, status_code, body, cert_days_left) as signals."""
    expected, part = config.get("expectStatus") or [], config.get("expectBodySubstring") or ""
    min_days = config.get("minTlsValidDays") or 0
    code, answered = F.col("status_code"), F.col("error").isNull()
    if expected:
        bad_code = (~code.isin(expected), F.concat(F.lit("unexpected status code: got="), code))
    else:
        bad_code = ((code < 200) | (code >= 300), F.concat(F.lit("non-2xx status code: "), code))
    bad_body = (F.col("body") != "") & ~F.contains(F.col("body"), F.lit(part)) if part else F.lit(False)
    soon = F.col("cert_days_left") < min_days if min_days > 0 else F.lit(False)
    soon = answered & F.coalesce(soon, F.lit(False))
    text = F.format_string(f"certificate expiring soon: days_left=%.2f < min={min_days}", F.col("cert_days_left").cast("double"))
    judged = _judged(
        df,
        [
            (soon, text),
            (answered & bad_code[0], bad_code[1]),
            (answered & bad_body, F.lit("body does not contain expected substring")),
            (~answered, F.concat(F.lit("http_check failed: "), "error")),
        ],
        "http_check ok",
    )
    fields = F.struct(
        F.when(soon, True).alias("cert_expiring_soon"), F.when(answered, F.col("cert_days_left")).alias("cert_days_left"),
        "elapsed_ms", "error", F.when(answered & bad_body, part).alias("expected_substring"), "method",
        F.lit("http_check").alias("source_type"), F.when(answered, code).alias("status_code"),
        (F.col("status") != FIRING).alias("success"), "url",
    )
    title = F.concat(F.lit("HTTP "), "method", F.lit(" "), "url")
    return _signals(judged, "http_check", title, {"url": F.col("url"), "method": F.col("method")}, fields)


def classify_tcp(df: DataFrame, config: dict | None = None) -> DataFrame:
    """Connection attempts (host, port, elapsed_ms, error) as signals."""
    judged = _judged(df, [(F.col("error").isNotNull(), F.concat(F.lit("tcp_check failed: "), "error"))], "tcp_check ok")
    fields = F.struct(
        "elapsed_ms", "error", "host", "port", F.lit("tcp_check").alias("source_type"),
        (F.col("status") != FIRING).alias("success"),
    )
    title = F.concat(F.lit("TCP "), "host", F.lit(":"), F.col("port").cast("string"))
    return _signals(judged, "tcp_check", title, {"host": F.col("host"), "port": F.col("port")}, fields)


def classify_dns(df: DataFrame, config: dict) -> DataFrame:
    """Lookups (domain, record_type, results, elapsed_ms, error) as signals.

    Every expected value must be among the results, ignoring case and outer blanks.
    """
    answered = F.col("error").isNull()
    head = F.concat(F.lit("dns_check "), "record_type", F.lit(" "), "domain")
    got = F.concat(F.lit("["), F.concat_ws(" ", "results"), F.lit("]"))
    results = F.transform("results", normal)
    missing = F.filter(
        F.array(*[F.lit(v) for v in config.get("expectValues") or []]).cast("array<string>"),
        lambda v: ~F.array_contains(results, normal(v)),
    )
    cname = (config.get("expectCNAME") or "").lower()
    first = F.lower(F.coalesce(F.get("results", F.lit(0)), F.lit("")))
    mismatch = (F.col("record_type") == "CNAME") & ~first.endswith(cname) if cname else F.lit(False)
    if cname:
        mismatch = mismatch | ((F.col("record_type") == "CNAME") & (F.size("results") <= 0))
    judged = _judged(
        df,
        [
            (
                answered & (F.size(missing) > 0),
                F.concat(F.lit("dns_check: expected value "), F.get(missing, F.lit(0)), F.lit(" not found in results "), got),
            ),
            (
                answered & mismatch,
                F.concat(F.lit(f"dns_check: CNAME mismatch, expected {config.get('expectCNAME') or ''}, got "), got),
            ),
            (~answered, F.concat(head, F.lit(" failed: "), "error")),
        ],
        "",
    )
    judged = judged.withColumn("message", F.when(F.col("status") == RESOLVED, F.concat(head, F.lit(" ok"))).otherwise(F.col("message")))
    fields = F.struct(
        "domain", "elapsed_ms", "error", "record_type", "results", F.lit("dns_check").alias("source_type"),
        (F.col("status") != FIRING).alias("success"),
    )
    title = F.concat(F.lit("DNS "), "record_type", F.lit(" "), "domain")
    return _signals(judged, "dns_check", title, {"domain": F.col("domain"), "record_type": F.col("record_type")}, fields)


def classify_certs(df: DataFrame, config: dict) -> DataFrame:
    """Certificates (host, port, error, chain_length, not_after, is_self_signed, sans) as signals.

    Later problems replace the message of earlier ones; an incomplete chain alone is a warning.
    """
    min_days, sans = config.get("minValidDays") or 0, config.get("expectedSANs") or []
    seen = F.col("error").isNull() & (F.col("chain_length") > 0)
    days = (F.unix_micros("not_after") - F.unix_micros("ts")) / 86_400_000_000.0
    expired = F.col("not_after") < F.col("ts")
    lower_sans = F.transform("sans", F.lower)
    missing = F.filter(
        F.array(*[F.lit(s) for s in sans]).cast("array<string>"), lambda s: ~F.array_contains(lower_sans, F.lower(s))
    )
    failures = [
        (
            seen & ~expired & (days < min_days) & F.lit(min_days > 0),
            F.format_string(f"certificate expiring soon: days_left=%.1f < min={min_days}", days),
        ),
        (
            seen & expired,
            F.concat(F.lit("certificate expired on "), F.date_format("not_after", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ),
        (seen & F.col("is_self_signed") & F.lit(not config.get("allowSelfSigned")), F.lit("certificate is self-signed")),
        (seen & (F.size(missing) > 0), F.concat(F.lit("expected SAN "), F.get(missing, F.lit(0)), F.lit(" not found"))),
        (F.col("error").isNull() & ~seen, F.lit("no peer certificates found")),
        (F.col("error").isNotNull(), F.concat(F.lit("ssl_check connection failed: "), "error")),
    ]
    incomplete = seen & (F.col("chain_length") < 2) & ~F.col("is_self_signed")
    judged = _judged(df, failures, "ssl_check ok")
    judged = judged.withColumn(
        "severity", F.when((F.col("severity") == "info") & incomplete, "warning").otherwise(F.col("severity"))
    )
    fields = F.struct(
        F.when(seen, days).alias("cert_days_left"), F.when(incomplete, True).alias("chain_incomplete"), "error", "host",
        "is_self_signed", "port", "sans", F.lit("ssl_check").alias("source_type"),
        (F.col("status") != FIRING).alias("success"),
    )
    title = F.concat(F.lit("SSL "), "host", F.lit(":"), F.col("port").cast("string"))
    return _signals(judged, "ssl_check", title, {"host": F.col("host"), "port": F.col("port")}, fields)


# Detectors by type: (measurements, config) -> signals. Add an entry to plug in another one.
DETECTORS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "metric_threshold": lambda df, config: metric_threshold(df, config).rows,
    "log_basic": lambda df, config: signals_from_rows(df),
    "http_check": classify_http,
    "tcp_check": classify_tcp,
    "dns_check": classify_dns,
    "ssl_check": classify_certs,
}


def typed_results(signals: DataFrame, detector_type: str) -> DataFrame:
    """Signals as rows of `detector_results`: data = fields, tags = labels, severity and status."""
    own = F.map_filter("labels", lambda k, _: ~k.isin("severity", "status"))
    tags = F.map_concat(own, F.create_map(F.lit("severity"), "severity", F.lit("status"), "status"))
    return signals.select(
        F.lit(detector_type).alias("detector_type"), "project_id", "monitor_id", F.col("occurred_at").alias("ts"),
        F.col("fields").alias("data"), F.to_json(tags).alias("tags"),
    )


def query_results(
    results: DataFrame,
    detector_type: str,
    project_id: int,
    monitor_id: int = 0,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    limit: int = 0,
) -> DataFrame:
    rows = results.filter((F.col("detector_type") == detector_type) & (F.col("project_id") == project_id))
    if monitor_id > 0:
        rows = rows.filter(F.col("monitor_id") == monitor_id)
    keys = [F.desc("ts"), *([F.desc("id")] if "id" in results.columns else [])]
    return between(rows, start, end).orderBy(*keys).limit(limit if limit > 0 else DEFAULT_RESULTS)


def _in_buckets(results, detector_type, project_id, start, end, interval) -> DataFrame:
    rows = results.filter((F.col("detector_type") == detector_type) & (F.col("project_id") == project_id))
    return between(rows, start, end).withColumn("bucket", interval_start(F.col("ts"), interval))


def _success_rate() -> Column:
    return F.count_if(F.col("success") == "true") * 100.0 / F.count(F.lit(1))


def avg_by_bucket(
    results: DataFrame, detector_type: str, project_id: int, field: str,
    start: str | datetime, end: str | datetime, interval: str = "1h",
) -> DataFrame:
    """(bucket, value): the mean of one number of `data`; buckets without rows are absent."""
    number = F.get_json_object("data", f"$['{field}']").try_cast("double")
    rows = _in_buckets(results, detector_type, project_id, start, end, interval)
    return rows.groupBy("bucket").agg(F.avg(number).alias("value"))


def success_rate(
    results: DataFrame, detector_type: str, project_id: int,
    start: str | datetime, end: str | datetime, interval: str = "1h",
) -> DataFrame:
    """(bucket, value): percent of results with success = true; a missing flag is no success."""
    rows = _in_buckets(results, detector_type, project_id, start, end, interval)
    return rows.withColumn("success", F.get_json_object("data", "$.success")).groupBy("bucket").agg(_success_rate().alias("value"))


def probe_summary(
    results: DataFrame, detector_type: str, project_id: int,
    start: str | datetime, end: str | datetime, interval: str = "1h",
) -> DataFrame:
    """Mean elapsed time and success rate per bucket, with one reading of `data`."""
    rows = _in_buckets(results, detector_type, project_id, start, end, interval)
    read = rows.select("bucket", F.json_tuple("data", "elapsed_ms", "success").alias("elapsed_ms", "success"))
    return read.groupBy("bucket").agg(
        F.avg(F.col("elapsed_ms").try_cast("double")).alias("elapsed_ms"), _success_rate().alias("success_rate")
    )


def run_summary(signals: DataFrame, failures: DataFrame, interval_sec: int = 60) -> DataFrame:
    """One row per run (monitor_id, run_at): status, signal_count, error and details JSON.

    `failures` lists runs that ended with an error; `signals` has the signals of all runs.
    """
    key = ["monitor_id", "run_at"]
    counts = signals.groupBy(*key, "detector_type").agg(F.count(F.lit(1)).alias("signal_count"))
    failed = failures.select(*key, "detector_type", F.lit(0).cast("bigint").alias("signal_count"), "error")
    runs = counts.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    merged = runs.groupBy(*key, "detector_type").agg(
        F.sum("signal_count").alias("signal_count"), F.coalesce(strip(F.max("error")), F.lit("")).alias("error")
    )
    ok = F.col("error") == ""
    every = 60 if interval_sec <= 0 else min(interval_sec, 86_400)
    details = F.struct(
        F.col("detector_type").alias("detectorType"), F.when(ok, every).alias("intervalSec"),
        F.when(ok, F.col("signal_count")).alias("signals"),
    )
    return merged.select(
        *key, F.when(ok, "success").otherwise("failed").alias("status"), "signal_count", "error",
        F.to_json(details).alias("result"),
    )

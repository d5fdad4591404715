"""The given Parquet tables read as the model tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import use_utc

# Cycles that give the events an os, a browser, a release and a platform.
OS_NAMES = ["iOS", "Android", "Windows"]
OS_VERSIONS = ["17", "14", "11"]
BROWSERS = ["Chrome 120", "Safari 17", "Firefox 121", "Edge 119"]


# Times are stored without a zone and mean UTC. Reading them as timestamps lets a range reach the scan.
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = use_utc(spark).read
    if name == "events":
        reader = reader.schema(EVENTS)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def project_of(projects: int) -> Column:
    return (1 + F.pmod(F.col("user_id"), F.lit(projects))).cast("int")


def track_events(spark: SparkSession, sf_dir: str, projects: int = 1) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        project_of(projects).alias("project_id"),
        F.col("ts"),
        F.col("event_id").cast("string").alias("ingest_id"),
        F.col("event_type").alias("name"),
        F.col("user_id").cast("string").alias("distinct_id"),
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"),
    )


def track_logs(spark: SparkSession, sf_dir: str, projects: int = 1) -> DataFrame:
    """Track events as log rows: level `event`, message = name, fields = properties."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        project_of(projects).alias("project_id"),
        F.col("ts"),
        F.col("event_id").cast("string").alias("ingest_id"),
        F.lit("event").alias("level"),
        F.col("user_id").cast("string").alias("distinct_id"),
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.col("event_type").alias("message"),
        F.col("props").alias("fields"),
    )


def error_events(spark: SparkSession, sf_dir: str, projects: int = 1) -> DataFrame:
    user = F.col("user_id")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    os_text = F.concat_ws(" ", pick(OS_NAMES, user), pick(OS_VERSIONS, user))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        project_of(projects).alias("project_id"),
        F.col("ts"),
        level.alias("level"),
        user.cast("string").alias("distinct_id"),
        F.concat(F.lit("d"), user.cast("string")).alias("device_id"),
        os_text.alias("os"),
        pick(BROWSERS, user).alias("browser"),
        *[F.lit("").alias(c) for c in ("platform", "release_tag", "environment", "user_id")],
        F.col("event_type").alias("title"),
        F.concat(
            F.lit('{"event_id":"'), F.col("event_id"), F.lit('","message":"'), F.col("event_type"),
            F.lit('","level":"'), level, F.lit('","user":{"id":"'), user, F.lit('"},"extra":'),
            F.col("props"), F.lit("}"),
        ).alias("data"),
        client_ip(user).alias("client_ip"),
    )


def client_ip(user: Column) -> Column:
    n = F.pmod(user * 2654435761, F.lit(4294967296))
    parts = [F.pmod(F.shiftright(n, bits), F.lit(256)).cast("string") for bits in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal slices of the IPv4 space, one per nation."""
    nations = load(spark, sf_dir, "nation").join(
        F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    width = (1 << 32) // 25
    key = F.col("n_nationkey").cast("bigint")
    return nations.select(
        (key * width).alias("lo"),
        (key * width + width - 1).alias("hi"),
        F.concat(F.lit("C"), key.cast("string")).alias("country"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.concat(F.lit("AS"), (key % 7).cast("string")).alias("asn_org"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log rows; the level comes from the labels."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    level = (
        F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warn").otherwise("info")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.lit(1).alias("project_id"),
        F.timestamp_micros((F.lit(1704067200) + F.col("doc_id") * 60) * 1000000).alias("ts"),
        F.col("doc_id").cast("string").alias("ingest_id"),
        level.alias("level"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.col("text").alias("message"),
        F.concat(
            F.lit('{"lang":"'), F.col("lang"), F.lit('","service":"'), F.col("source"), F.lit('"}')
        ).alias("fields"),
    )


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as log rows: trace = conversation, span = turn."""
    n = F.col("conv_id") * 100 + F.col("turn")
    return load(spark, sf_dir, "conversations").select(
        n.alias("id"),
        F.lit(1).alias("project_id"),
        F.timestamp_micros((F.lit(1704067200) + n) * 1000000).alias("ts"),
        n.cast("string").alias("ingest_id"),
        F.when(F.col("role") == "user", "info").otherwise("debug").alias("level"),
        F.col("conv_id").cast("string").alias("trace_id"),
        F.when(F.col("turn") > 0, F.col("turn").cast("string")).alias("span_id"),
        F.col("text").alias("message"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"role":"'), F.col("role"), F.lit('"}')))
        .otherwise("{}")
        .alias("fields"),
    )


def probe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded probe results: elapsed time and success per run of five monitors."""
    success = F.when(F.col("event_type") != "error", "true").otherwise("false")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.lit("http_check").alias("detector_type"),
        F.lit(1).alias("project_id"),
        (F.col("user_id") % 5).cast("int").alias("monitor_id"),
        F.col("ts"),
        F.concat(
            F.lit('{"elapsed_ms":'), F.format_string("%.2f", F.col("value")),
            F.lit(',"success":'), success, F.lit("}"),
        ).alias("data"),
        F.lit("{}").alias("tags"),
    )


def redelivered(rows: DataFrame) -> DataFrame:
    """The rows, and every row whose ingest id ends in 0 a second time, later."""
    first = rows.withColumn("arrival", F.lit(0))
    again = rows.filter(F.col("ingest_id").endswith("0")).withColumn("arrival", F.lit(1))
    return first.unionByName(again)


def raw_error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw error-event payloads in the spellings that clients send."""
    e = load(spark, sf_dir, "events")
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    digest = F.md5(n.cast("string"))
    dashed = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    us = F.unix_micros(F.col("ts"))
    seconds = F.concat(
        F.floor(us / 1000000).cast("string"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0")
    )

    def case(index: Column, *texts: Column) -> Column:
        out = F.lit("")
        for i, text in enumerate(texts):
            out = F.when(index == i, text).otherwise(out)
        return out

    parts = [
        F.lit('{"event_id":"'),
        case(n % 4, F.upper(dashed), F.concat(F.lit("evt-"), n), digest, F.concat(F.lit("urn:uuid:"), dashed)),
        F.lit('","timestamp":'),
        case(
            n % 3,
            F.concat(F.lit('"'), F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"')),
            seconds,
            F.lit('"soon"'),
        ),
        F.lit(',"level":"'), F.when(F.col("event_type") == "error", "error").otherwise("info"), F.lit('",'),
        case(
            n % 2,
            F.concat(F.lit('"message":"'), F.col("event_type"), F.lit('",')),
            F.concat(
                F.lit('"exception":{"values":[{"type":"T-'), F.col("event_type"), F.lit('","value":"v'), user, F.lit('"}]},')
            ),
        ),
        case(
            F.col("user_id") % 4,
            F.concat(F.lit('"user":{"id":" u'), user, F.lit(' ","email":"x@y"},')),
            F.concat(F.lit('"user":{"id":5,"username":"n'), user, F.lit('"},')),
            F.concat(F.lit('"user":{"email":"e'), user, F.lit('@x.io"},')),
        ),
        case(
            n % 5,
            F.concat(F.lit('"tags":{"device_id":" t'), user, F.lit(' "},')),
            F.concat(F.lit('"tags":[["a","b"],["device_id",'), user, F.lit("]],")),
            F.lit(""),
            F.concat(F.lit('"extra":{"device_id":"x'), user, F.lit('"},')),
        ),
        F.lit('"contexts":{'),
        F.when(n % 5 == 2, F.concat(F.lit('"device":{"id":"c'), user, F.lit('"},'))).otherwise(""),
        F.lit('"os":{"name":" '), pick(OS_NAMES, F.col("user_id")), F.lit('"'),
        F.when(F.col("user_id") % 3 != 2, F.concat(F.lit(',"version":"'), pick(OS_VERSIONS, F.col("user_id")), F.lit('"'))).otherwise(""),
        F.lit('},"browser":{"name":"Chrome","version":"120"}},"platform":"web","release":"1.0","environment":"prod"}'),
    ]
    return e.select(
        n.alias("n"),
        F.lit(1).alias("project_id"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("received"),
        F.concat(*parts).alias("body"),
    )


def raw_log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as queue messages, some of them unusable."""
    e = load(spark, sf_dir, "events")
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    when = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.concat(
        F.lit('{"level":" '), F.when(n % 3 == 0, "").when(n % 3 == 1, "event").otherwise("warn"),
        F.lit(' ","message":"'), F.when(n % 7 == 0, "  ").otherwise(F.col("event_type")),
        F.lit('","device_id":"'), F.when(n % 2 == 0, F.concat(F.lit(" d"), user)).otherwise(""),
        F.lit('","trace_id":" t'), n.cast("string"), F.lit('","fields":{"device_id":"f'), user, F.lit('"}'),
        F.when(n % 4 != 0, F.concat(F.lit(',"user":{"id":"u'), user, F.lit('"}'))).otherwise(""),
        F.when(n % 5 != 0, F.concat(F.lit(',"timestamp":"'), when, F.lit('"'))).otherwise(""),
        F.lit("}"),
    )
    kind = F.when(n % 11 == 10, "metric").when(n % 11 == 9, "event").otherwise("log")
    value = F.concat(
        F.lit('{"type":"'), kind, F.lit('","project_id":"'), (n % 13).cast("string"),
        F.lit('","received":"2024-02-01T00:00:00Z","payload":'),
        F.when(n % 17 == 16, '"text"').otherwise(payload),
        F.lit(',"meta":{"client_ip":"'), client_ip(F.col("user_id")), F.lit('"}'),
        F.when(n % 19 == 18, "").otherwise("}"),
    )
    return e.select(n.cast("string").alias("message_id"), value.alias("value"))


def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as error envelopes: plain, length-prefixed, without event, and broken ones."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    head = F.concat(F.lit('{"event_id":"env'), n.cast("string"), F.lit('"}\n'))
    event = F.concat(F.lit('{"message":"'), F.col("event_type"), F.lit('","user":{"id":"'), user, F.lit('é"}}'))
    split_event = F.concat(F.lit('{"message":\n"'), F.col("event_type"), F.lit('","user":{"id":"'), user, F.lit('é"}}'))
    size = F.octet_length(split_event).cast("string")
    body = (
        F.when(n % 6 == 0, F.concat(head, F.lit('{"type":"event"}\r\n'), event))
        .when(
            n % 6 == 1,
            F.concat(head, F.lit('{"type":"event","length":'), size, F.lit("}\n"), split_event, F.lit('\n\n{"type":"session"}\n{}\n')),
        )
        .when(n % 6 == 2, F.concat(head, F.lit('{"type":"attachment","length":3}\nabc\n{"type":"event"}\n{bad\n')))
        .when(n % 6 == 3, F.concat(head, F.lit('{"type":"event","length":-1}\n'), event))
        .when(n % 6 == 4, F.concat(head, F.lit('{"type":"event","length":9999}\n'), event))
        .otherwise(F.concat(F.lit(" \n"), event))
    )
    return load(spark, sf_dir, "events").select(n.alias("n"), body.alias("body"))

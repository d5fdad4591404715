"""Ingest: from payload texts made of the events table back to table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import identity
from tidewell.functions.payload import moment_of, read_once, text_at, value_at
from tidewell.functions.text import canonical_uuid, uuid_form
from tidewell.functions.times import day_key, micros_text
from tidewell.operators import dedupe, envelope, ingest, rollup
from tidewell.plans.model_sql import day, micros, track
from tidewell.plans.registry import query
from tidewell.session import run_dir
from tidewell.sources import facts, payloads, tables
from tidewell.streaming import sink


def _bodies(spark, sf):
    """Request bodies: blank, empty, broken, single objects and arrays."""
    n, name = F.col("event_id"), F.col("event_type")
    one = F.concat(F.lit('{"message":"'), name, F.lit('"}'))
    two = F.concat(F.lit('{"message":"b'), (n % 10).cast("string"), F.lit('"}'))
    body = (
        F.when(n % 10 == 0, "  ")
        .when(n % 10 == 1, " []")
        .when(n % 10 == 2, F.concat(F.lit("["), one))
        .when(n % 10 == 3, F.concat(F.lit("["), one, F.lit(",7]")))
        .when(n % 10 < 7, one)
        .otherwise(F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
    )
    return tables.load(spark, sf, "events").select(n.alias("n"), body.alias("body"))


@query(
    "decode_batch",
    """SELECT event_id AS n, CAST(0 AS INTEGER) AS item_no, event_type AS message FROM events WHERE event_id % 10 > 3
      UNION ALL
      SELECT event_id, 1, 'b' || (event_id % 10) FROM events WHERE event_id % 10 > 6""",
)
def _(spark, sf):
    items = ingest.decode_batch(_bodies(spark, sf)).rows
    return items.select("n", "item_no", text_at(F.col("item"), "message").alias("message"))


@query(
    "decode_batch_rejects",
    """SELECT ['empty body', 'empty array', 'bad json', 'item is not an object'][1 + event_id % 10] AS reason,
        COUNT(*) AS n FROM events WHERE event_id % 10 < 4 GROUP BY 1""",
)
def _(spark, sf):
    return ingest.decode_batch(_bodies(spark, sf)).rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_payload_files",
    """WITH b AS (SELECT strlen('{"message":"' || event_type || '","props":' || props || '}') AS s FROM events)
      SELECT 'kept' AS part, COUNT(*) AS bodies, CAST(SUM(s) AS BIGINT) AS bytes FROM b WHERE s <= 42
      UNION ALL SELECT 'rejected', COUNT(*), CAST(SUM(s) AS BIGINT) FROM b WHERE s > 42""",
)
def _(spark, sf):
    path = run_dir(spark, "bodies")
    body = F.concat(F.lit('{"message":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}"))
    payloads.write_bodies(tables.load(spark, sf, "events").select(body.alias("body")), path)
    kept, rejects = payloads.read_bodies(spark, path, limit=42)

    def sums(df, part):
        return df.agg(
            F.lit(part).alias("part"), F.count(F.lit(1)).alias("bodies"), F.sum("body_bytes").alias("bytes")
        )

    return sums(kept, "kept").unionByName(sums(rejects, "rejected"))


MESSAGE = """CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END"""
USABLE = "event_id % 19 <> 18 AND event_id % 17 <> 16 AND event_id % 11 <> 10 AND event_id % 13 > 0"
LOG_COLUMNS = f"""CAST(event_id AS VARCHAR) AS ingest_id, CAST(event_id % 13 AS INTEGER) AS project_id,
        CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'event' ELSE 'warn' END AS level,
        event_type AS message,
        {micros("CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END")} AS at"""
LOG_ROWS = f"{USABLE} AND event_id % 11 < 9 AND event_id % 7 <> 0"


@query(
    "decode_messages",
    f"""SELECT CAST(event_id AS VARCHAR) AS message_id, CASE WHEN event_id % 11 = 9 THEN 'event' ELSE 'log' END AS type,
        CAST(event_id % 13 AS INTEGER) AS project_id, {MESSAGE} AS message FROM events WHERE {USABLE}""",
)
def _(spark, sf):
    rows = ingest.decode_messages(tables.raw_log_messages(spark, sf)).rows
    return rows.select("message_id", "type", "project_id", text_at(F.col("payload"), "message").alias("message"))


@query(
    "decode_messages_rejects",
    f"""SELECT CASE WHEN event_id % 19 = 18 THEN 'undecodable message' WHEN event_id % 11 = 10 THEN 'unknown type'
          WHEN event_id % 13 = 0 THEN 'bad project id' ELSE 'undecodable payload' END AS reason, COUNT(*) AS n
      FROM events WHERE NOT ({USABLE}) GROUP BY 1""",
)
def _(spark, sf):
    rejects = ingest.decode_messages(tables.raw_log_messages(spark, sf)).rejects
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _payload_columns(spark, sf):
    messages = ingest.decode_messages(tables.raw_log_messages(spark, sf)).rows
    return ingest.log_payloads(messages.filter(F.col("type") == ingest.LOG))


@query("normalize_logs", f"SELECT {LOG_COLUMNS} FROM events WHERE {LOG_ROWS}")
def _(spark, sf):
    rows = ingest.normalize_logs(_payload_columns(spark, sf)).rows
    return rows.select(
        F.col("message_id").alias("ingest_id"), "project_id", F.trim("level").alias("level"), "message",
        micros_text(F.col("ts")).alias("at"),
    )


@query(
    "track_to_log",
    f"""SELECT event_id AS id, 'event' AS level, event_type AS message, props AS fields,
        {micros("CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END")} AS at
      FROM events WHERE event_id % 7 <> 0""",
)
def _(spark, sf):
    n = F.col("event_id")
    sent = tables.load(spark, sf, "events").select(
        n.alias("id"),
        F.when(n % 7 == 0, " \t").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\n"))).alias("name"),
        F.col("props").alias("properties"),
        F.when(n % 5 != 0, F.col("ts")).alias("ts"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("received"),
    )
    rows = ingest.track_to_log(sent).rows
    return rows.select("id", "level", "message", "fields", micros_text(F.col("ts")).alias("at"))


USER = "CASE WHEN event_id % 4 <> 0 THEN 'u' || user_id END"
DEVICE = "CASE WHEN event_id % 2 = 0 THEN 'd' || user_id END"
FIELD_DEVICE = f"CASE WHEN {USER} IS NULL AND {DEVICE} IS NULL THEN 'f' || user_id END"
LOG_DISTINCT = f"coalesce({USER}, {DEVICE}, {FIELD_DEVICE}) AS distinct_id"
LOG_DEVICE = f"coalesce({DEVICE}, {FIELD_DEVICE}, '') AS device_id"


def _log_rows(spark, sf):
    return ingest.build_log_rows(ingest.normalize_logs(_payload_columns(spark, sf)).rows)


@query("distinct_id_logs", f"SELECT CAST(event_id AS VARCHAR) AS ingest_id, {LOG_DISTINCT}, {LOG_DEVICE} FROM events WHERE {LOG_ROWS}")
def _(spark, sf):
    return _log_rows(spark, sf).select("ingest_id", "distinct_id", "device_id")


@query(
    "build_log_rows",
    f"""SELECT {LOG_COLUMNS}, {LOG_DISTINCT}, {LOG_DEVICE}, 't' || event_id AS trace_id, '' AS span_id,
        '{{"device_id":"f' || user_id || '"}}' AS fields FROM events WHERE {LOG_ROWS}""",
)
def _(spark, sf):
    return _log_rows(spark, sf).withColumn("at", micros_text(F.col("ts"))).drop("ts")


@query(
    "derive_track_events",
    f"""SELECT ingest_id, project_id, message AS name, distinct_id, device_id, "at" FROM (
        SELECT {LOG_COLUMNS}, {LOG_DISTINCT}, {LOG_DEVICE} FROM events WHERE {LOG_ROWS}) WHERE level = 'event'""",
)
def _(spark, sf):
    rows = ingest.derive_track_events(_log_rows(spark, sf))
    return rows.withColumn("at", micros_text(F.col("ts"))).drop("ts")


def _doc(spark, sf):
    return read_once(tables.raw_error_events(spark, sf), doc=F.try_parse_json("body"))


def _part(name: str):
    return value_at(F.col("doc"), name)


def _device():
    return identity.device_id(_part("tags"), _part("contexts"), _part("extra"))


DIGEST = "md5(CAST(event_id AS VARCHAR))"


def _dashed(h: str) -> str:
    return f"({h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32])"


NAME_SHA = "sha1(unhex('00000000000000000000000000000000') || encode('evt-' || event_id))"
NAME_UUID = _dashed(
    f"({NAME_SHA}[1:12] || '5' || {NAME_SHA}[14:16] || "
    f"substr('89ab', 1 + (strpos('0123456789abcdef', {NAME_SHA}[17:17]) - 1) % 4, 1) || {NAME_SHA}[18:32])"
)
EVENT_ID = f"CASE WHEN event_id % 4 = 1 THEN {NAME_UUID} ELSE {_dashed(DIGEST)} END"
EVENT_AT = micros("CASE WHEN event_id % 3 = 2 THEN TIMESTAMP '2024-02-01' ELSE ts END")
EVENT_USER = """CASE user_id % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'n' || user_id
        WHEN 2 THEN 'e' || user_id || '@x.io' ELSE '' END"""
STORED_USER = """CASE user_id % 4 WHEN 0 THEN ' u' || user_id || ' ' WHEN 1 THEN 'n' || user_id
        WHEN 2 THEN 'e' || user_id || '@x.io' ELSE '' END"""
EVENT_DEVICE = """CASE event_id % 5 WHEN 0 THEN 't' || user_id WHEN 1 THEN CAST(user_id AS VARCHAR)
        WHEN 2 THEN 'c' || user_id WHEN 3 THEN 'x' || user_id ELSE '' END"""
EVENT_DISTINCT = f"CASE WHEN {EVENT_USER} <> '' THEN {EVENT_USER} ELSE {EVENT_DEVICE} END"
EVENT_SOURCE = f"CASE WHEN {EVENT_USER} <> '' THEN 'user.id' WHEN {EVENT_DEVICE} <> '' THEN 'device_id' ELSE '' END"
EVENT_OS = "['iOS 17', 'Android 14', 'Windows'][1 + user_id % 3]"
EVENT_TITLE = "CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'T-' || event_type || ': v' || user_id END"
DATA_ID = f"""CASE event_id % 4 WHEN 0 THEN upper({_dashed(DIGEST)}) WHEN 1 THEN {NAME_UUID}
        WHEN 2 THEN {DIGEST} ELSE 'urn:uuid:' || {_dashed(DIGEST)} END"""


@query(
    "normalize_error_events",
    f"""SELECT {EVENT_ID} AS id, CAST(1 AS INTEGER) AS project_id, {EVENT_AT} AS at,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
        {EVENT_DISTINCT} AS distinct_id, {EVENT_SOURCE} AS distinct_source, {EVENT_DEVICE} AS device_id,
        {EVENT_OS} AS os, 'Chrome 120' AS browser, 'web' AS platform, '1.0' AS release_tag,
        'prod' AS environment, {STORED_USER} AS user_id, {EVENT_TITLE} AS title, {DATA_ID} AS data_id FROM events""",
)
def _(spark, sf):
    rows = ingest.normalize_error_events(_doc(spark, sf), "doc")
    data_id = F.get_json_object("data", "$.event_id").alias("data_id")
    return rows.select("*", micros_text(F.col("ts")).alias("at"), data_id).drop("ts", "data")


@query("canonical_event_id", f"SELECT event_id AS n, {EVENT_ID} AS id FROM events")
def _(spark, sf):
    sent = text_at(F.col("doc"), "event_id")
    rows = _doc(spark, sf).select("n", sent.alias("sent"), uuid_form(sent).alias("form"))
    return rows.select("n", canonical_uuid(F.col("sent"), F.col("form"), F.expr("uuid()")).alias("id"))


@query("coerce_timestamp", f"SELECT event_id AS n, {EVENT_AT} AS at FROM events")
def _(spark, sf):
    at = moment_of(value_at(F.col("doc"), "timestamp"), F.col("received"))
    return _doc(spark, sf).select("n", micros_text(at).alias("at"))


@query("derive_title", f"SELECT event_id AS n, {EVENT_TITLE} AS title FROM events")
def _(spark, sf):
    return _doc(spark, sf).select("n", identity.title(_part("message"), _part("exception")).alias("title"))


@query("extract_user_id", f"SELECT event_id AS n, {EVENT_USER} AS user_id, {STORED_USER} AS stored_user_id FROM events")
def _(spark, sf):
    user = _part("user")
    return _doc(spark, sf).select(
        "n", identity.user_id(user).alias("user_id"), identity.stored_user_id(user).alias("stored_user_id")
    )


@query("extract_device_id", f"SELECT event_id AS n, {EVENT_DEVICE} AS device_id FROM events")
def _(spark, sf):
    return _doc(spark, sf).select("n", _device().alias("device_id"))


@query("distinct_id_events", f"SELECT event_id AS n, {EVENT_DISTINCT} AS distinct_id, {EVENT_SOURCE} AS source FROM events")
def _(spark, sf):
    user, device = identity.user_id(_part("user")), _device()
    return _doc(spark, sf).select(
        "n", identity.distinct_id(user, device).alias("distinct_id"), identity.distinct_source(user, device).alias("source")
    )


@query("extract_os", f"SELECT event_id AS n, {EVENT_OS} AS os FROM events")
def _(spark, sf):
    return _doc(spark, sf).select("n", identity.named_version(_part("contexts"), "os").alias("os"))


@query("extract_browser", "SELECT event_id AS n, 'Chrome 120' AS browser FROM events")
def _(spark, sf):
    return _doc(spark, sf).select("n", identity.named_version(_part("contexts"), "browser").alias("browser"))


ENVELOPE_EVENT = """'{"message":"' || event_type || '","user":{"id":"' || user_id || 'é"}}'"""


@query(
    "parse_envelopes",
    """SELECT event_id AS n, 'env' || event_id AS event_id,
        CAST(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 2 END AS INTEGER) AS items,
        CASE WHEN event_id % 6 < 2 THEN event_type END AS message,
        CASE WHEN event_id % 6 < 2 THEN user_id || 'é' END AS user_id
      FROM events WHERE event_id % 6 < 3""",
)
def _(spark, sf):
    rows = envelope.parse_envelopes(tables.raw_envelopes(spark, sf)).rows
    return rows.select(
        "n", "event_id", "items",
        F.get_json_object("event", "$.message").alias("message"),
        F.get_json_object("event", "$.user.id").alias("user_id"),
    )


@query(
    "parse_envelopes_rejects",
    """SELECT ['invalid item length', 'body shorter than item length', 'empty header'][event_id % 6 - 2] AS reason,
        COUNT(*) AS n FROM events WHERE event_id % 6 > 2 GROUP BY 1""",
)
def _(spark, sf):
    rejects = envelope.parse_envelopes(tables.raw_envelopes(spark, sf)).rejects
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "envelope_fallback",
    f"""SELECT event_id AS n, CASE WHEN event_id % 6 = 2 THEN 'envelope' ELSE 'event' END AS type,
        'env' || event_id AS payload_id,
        CASE WHEN event_id % 6 = 2 THEN '{{"event_id":"env' || event_id || '"}}' || chr(10) ||
          '{{"type":"attachment","length":3}}' || chr(10) || 'abc' || chr(10) || '{{"type":"event"}}' || chr(10) ||
          '{{bad' || chr(10) END AS raw,
        CASE WHEN event_id % 6 < 2 THEN event_type END AS message
      FROM events WHERE event_id % 6 < 3""",
)
def _(spark, sf):
    rows = envelope.envelope_messages(envelope.parse_envelopes(tables.raw_envelopes(spark, sf)).rows)
    payload = F.try_parse_json("payload")
    return rows.select(
        "n", "type",
        text_at(payload, "event_id").alias("payload_id"),
        text_at(payload, "raw").alias("raw"),
        text_at(payload, "message").alias("message"),
    )


COPIES = "copies AS (SELECT *, 0 AS arrival FROM {0} UNION ALL SELECT *, 1 FROM {0} WHERE ingest_id LIKE '%0')"


def _first(source: str, key: str) -> str:
    return f"""WITH {track()}, {COPIES.format('track_events')}
      SELECT ingest_id, name, distinct_id, {micros('ts')} AS at FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY arrival) AS rn FROM {source}) WHERE rn = 1"""


def _copies(spark, sf):
    """Redelivered rows; the copy says so in its name, so a wrong choice would show."""
    rows = tables.redelivered(tables.track_events(spark, sf))
    return rows.withColumn("name", F.concat_ws("", "name", F.when(F.col("arrival") == 1, "-again")))


@query("dedupe_events", _first("copies", "ingest_id"))
def _(spark, sf):
    rows = dedupe.dedupe_events(_copies(spark, sf).withColumn("id", F.col("ingest_id")), ["arrival"])
    return rows.select("ingest_id", "name", "distinct_id", micros_text(F.col("ts")).alias("at"))


NULLED = f"""WITH {track()}, {COPIES.format('track_events')}, c AS (
      SELECT * REPLACE (CASE WHEN ingest_id LIKE '%00' THEN NULL ELSE ingest_id END AS ingest_id) FROM copies)
    SELECT ingest_id, name, distinct_id, {micros('ts')} AS at FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, ingest_id ORDER BY arrival) AS rn FROM c)
    WHERE rn = 1 OR ingest_id IS NULL"""


@query("dedupe_logs", NULLED)
def _(spark, sf):
    rows = tables.redelivered(tables.track_events(spark, sf)).withColumn(
        "ingest_id", F.when(~F.col("ingest_id").endswith("00"), F.col("ingest_id"))
    )
    return dedupe.dedupe_ingest(rows, ["arrival"]).select(
        "ingest_id", "name", "distinct_id", micros_text(F.col("ts")).alias("at")
    )


@query("dedupe_track", _first("copies", "project_id, ingest_id"))
def _(spark, sf):
    rows = dedupe.dedupe_ingest(_copies(spark, sf), ["arrival"])
    return rows.select("ingest_id", "name", "distinct_id", micros_text(F.col("ts")).alias("at"))


@query(
    "new_rows_only",
    f"""WITH {track()} SELECT ingest_id, name FROM track_events
      WHERE ts >= TIMESTAMP '2024-01-10' AND NOT (ts < TIMESTAMP '2024-01-20' OR ingest_id LIKE '%5')""",
)
def _(spark, sf):
    rows = tables.track_events(spark, sf)
    stored = rows.filter((F.col("ts") < "2024-01-20") | F.col("ingest_id").endswith("5"))
    batch = rows.filter(F.col("ts") >= "2024-01-10")
    return dedupe.new_rows_only(batch, stored, dedupe.INGEST_KEY).select("ingest_id", "name")


ROLLUP = f"""SELECT CAST(1 AS INTEGER) AS project_id, {day('ts')} AS day, name, distinct_id, COUNT(*) AS events
      FROM track_events"""


@query("daily_rollup", f"WITH {track()} {ROLLUP} GROUP BY ALL")
def _(spark, sf):
    return rollup.daily_rollup(tables.track_events(spark, sf))


@query("merge_rollup", f"WITH {track()} {ROLLUP} GROUP BY ALL")
def _(spark, sf):
    rows = tables.track_events(spark, sf)
    late = F.col("ingest_id").endswith("3")
    return rollup.merge_rollup(rollup.daily_rollup(rows.filter(~late)), rollup.daily_rollup(rows.filter(late)))


@query("rebuild_rollup", f"WITH {track()} {ROLLUP} WHERE ts >= TIMESTAMP '2024-01-10 10:00:00' GROUP BY ALL")
def _(spark, sf):
    rows = tables.track_events(spark, sf)
    left = rows.filter(F.col("ts") >= "2024-01-10 10:00:00")
    return rollup.rebuild_rollup(rollup.daily_rollup(rows), left, 1, "2024-01-10 10:00:00")


@query("write_logs_track_rollup", f"WITH {track()} {ROLLUP} GROUP BY ALL")
def _(spark, sf):
    """Three deliveries of overlapping rows, one of them written twice, counted once each."""
    rows = tables.track_logs(spark, sf).drop("id")
    store = sink.Store(run_dir(spark, "store"))
    halves = [rows.filter(F.col("ts") < "2024-01-15"), rows.filter(F.col("ts") >= "2024-01-15")]
    for number, batch in [(0, halves[0]), (1, halves[1]), (1, halves[1]), (2, halves[0])]:
        sink.write_batch(batch, store, number)
    return store.read_rollup(spark)


@query(
    "sink_fact_tables",
    f"""WITH {track(3)} SELECT CAST(project_id AS INTEGER) AS project_id, {day('ts')} AS day, COUNT(*) AS n
      FROM track_events WHERE project_id = 2 AND ts >= TIMESTAMP '2024-01-05 06:00:00'
        AND ts <= TIMESTAMP '2024-01-20 18:30:00' GROUP BY ALL""",
)
def _(spark, sf):
    path = run_dir(spark, "facts")
    facts.write_facts(tables.track_events(spark, sf, 3), path)
    rows = facts.read_facts(spark, path, 2, "2024-01-05 06:00:00", "2024-01-20 18:30:00")
    return rows.groupBy("project_id", day_key(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))

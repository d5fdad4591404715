"""Alert evaluation over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.functions.payload import field_at, plain_text, read_once
from tidewell.functions.times import micros_text
from tidewell.operators import alert_delivery, alert_rules, alert_state, search
from tidewell.plans.model_sql import LEVEL, OS, micros, project
from tidewell.plans.registry import query
from tidewell.session import written_once
from tidewell.sources import tables

# The rules the queries evaluate.
RULES = [
    (1, 1, "errors", True, "logs", '{"levels":["Event "],"eventNames":["ERROR"]}',
     '{"windowSec":7200,"threshold":2,"baseBackoffSec":600,"maxBackoffSec":2400,"dedupeFields":["distinct_id"]}',
     '{"webhookEndpointIds":[1,2],"emailGroupIds":[3],"emailContactIds":[4,6]}'),
    (2, 1, "purchases", True, "both",
     '{"messageKeywords":["URCH","none"],"fieldsAll":[{"path":"k","op":"in","values":[1,2,3,"4",55.0]}]}',
     '{"windowSec":86400,"threshold":3}', '{"wecomBotIds":[5],"smsGroupIds":[3,4]}'),
    (3, 2, "all views", True, "both", '{"eventNames":["view","signup"],"fieldsAll":[{"path":"device_id","op":"exists"}]}',
     '{"dedupeByMessage":false,"windowSec":21600,"threshold":4,"baseBackoffSec":3600,"maxBackoffSec":60}',
     '{"channels":[{"type":"webhook","config":{"url":"http://a"}},{"type":"email","config":{"to":"b"}}]}'),
    (4, 2, "off", False, "both", "{}", "{}", "{}"),
    (5, 3, "events only", True, "events", '{"fieldsAll":[{"path":"user.id","op":"contains","value":"1"}]}',
     "not json", '{"webhookEndpointIds":[1]}'),
    (6, 3, "fields", True, "logs",
     '{"fieldsAll":[{"path":"k","op":"eq","value":7},{"path":"k.x","op":"exists"}]}', "{}", "{}"),
    (7, 3, "unknown op", True, "logs", '{"fieldsAll":[{"path":"k","op":"starts","value":7}]}', "{}", "{}"),
]


def _rules(spark):
    return spark.createDataFrame(RULES, schemas.RULES)


def _log_inputs(spark, sf):
    return alert_rules.inputs_from_logs(tables.track_logs(spark, sf, 3))


def _event_inputs(spark, sf):
    return alert_rules.inputs_from_events(tables.error_events(spark, sf, 3))


def _inputs(spark, sf):
    return _log_inputs(spark, sf).unionByName(_event_inputs(spark, sf))


K = "json_extract_string(props, '$.k')"
LOG_FIELDS = f"""'{{"device_id":"d' || user_id || '","distinct_id":"' || user_id || '","ingest_id":"' || event_id ||
        '","k":' || {K} || '}}'"""
EVENT_FIELDS = f"""'{{"device_id":"d' || user_id || '","distinct_id":"' || user_id || '","event_id":"' || event_id ||
        '","extra":{{"k":' || {K} || '}},"level":"' || {LEVEL} || '","message":"' || event_type || '","os":"' || {OS} ||
        '","user":{{"id":"' || user_id || '"}}}}'"""
INPUTS = f"""inputs AS (
      SELECT event_id AS id, CAST(event_id AS VARCHAR) AS row_id, {project(3)} AS project_id, 'logs' AS source, ts,
             'event' AS level, event_type AS message, {LOG_FIELDS} AS fields, {K} AS k, user_id FROM events
      UNION ALL
      SELECT event_id, CAST(event_id AS VARCHAR), {project(3)}, 'events', ts, {LEVEL}, event_type, {EVENT_FIELDS}, NULL, user_id FROM events)"""


@query("alert_inputs", f"WITH {INPUTS} SELECT row_id, source, {micros('ts')} AS ts, level, message, fields FROM inputs")
def _(spark, sf):
    return alert_rules.with_fields(_inputs(spark, sf)).select(
        "row_id", "source", micros_text(F.col("ts")).alias("ts"), "level", "message", alert_rules.fields_json().alias("fields")
    )


RULE_TABLE = "rules(rule_id, project_id, rule_source) AS (VALUES (1, 1, 'logs'), (2, 1, 'both'), (3, 2, 'both'), (5, 3, 'events'), (6, 3, 'logs'), (7, 3, 'logs'))"


@query(
    "rule_routing",
    f"""WITH {INPUTS}, {RULE_TABLE}
      SELECT CAST(r.rule_id AS INTEGER) AS rule_id, i.source, COUNT(*) AS n FROM inputs i JOIN rules r
        ON r.project_id = i.project_id AND r.rule_source IN (i.source, 'both') GROUP BY ALL""",
)
def _(spark, sf):
    compiled = alert_rules.compile_rules(_rules(spark))
    rows = alert_rules.route_inputs(_inputs(spark, sf), compiled, alert_rules.routed())
    return rows.groupBy("rule_id", "source").agg(F.count(F.lit(1)).alias("n"))


WINDOWS = """CASE rule_id WHEN 1 THEN 7200 WHEN 2 THEN 86400 WHEN 3 THEN 21600 ELSE 60 END"""
THRESHOLDS = """CASE rule_id WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END"""
BASES = "CASE rule_id WHEN 1 THEN 600 WHEN 3 THEN 3600 ELSE 60 END"
CEILINGS = "CASE rule_id WHEN 1 THEN 2400 ELSE 3600 END"
MATCHED = f"""{INPUTS}, hits AS (
      SELECT 1 AS rule_id, 'errors' AS rule_name, * FROM inputs WHERE project_id = 1 AND source = 'logs' AND message = 'error'
      UNION ALL SELECT 2, 'purchases', * FROM inputs WHERE project_id = 1 AND message = 'purchase' AND k IN ('1', '2', '3', '4', '55')
      UNION ALL SELECT 3, 'all views', * FROM inputs WHERE project_id = 2 AND level = 'event' AND message IN ('view', 'signup')
      UNION ALL SELECT 5, 'events only', * FROM inputs WHERE project_id = 3 AND source = 'events' AND CAST(user_id AS VARCHAR) LIKE '%1%'),
    matched AS (
      SELECT *, sha256('rule=' || rule_id || '|src=' || source || '|lvl=' || level ||
          CASE WHEN rule_id <> 3 THEN '|msg=' || message ELSE '' END ||
          CASE WHEN rule_id = 1 THEN '|f.distinct_id=' || user_id ELSE '' END) AS key_hash,
        epoch_us(ts) AS tick FROM hits)"""


def _matched(spark, sf):
    return alert_rules.match_rules(_inputs(spark, sf), alert_rules.compile_rules(_rules(spark)))


@query("rule_match", f"WITH {MATCHED} SELECT CAST(rule_id AS INTEGER) AS rule_id, source, row_id FROM matched")
def _(spark, sf):
    return _matched(spark, sf).select("rule_id", "source", "row_id")


@query("dedupe_key", f"WITH {MATCHED} SELECT CAST(rule_id AS INTEGER) AS rule_id, source, row_id, key_hash FROM matched")
def _(spark, sf):
    return _matched(spark, sf).select("rule_id", "source", "row_id", "key_hash")


FIELD_RULES = [
    (1, '{"path":"k","op":"exists"}'),
    (2, '{"path":"k","op":"eq","value":" 7"}'),
    (3, '{"path":"k","op":"contains","value":"9"}'),
    (4, '{"path":" k ","op":"in","values":[10,"11",null]}'),
    (5, '{"path":"z","op":"exists"}'),
    (6, '{"path":"distinct_id","op":"eq","value":"3"}'),
    (7, '{"path":"distinct_id.x","op":"exists"}'),
    (8, '{"path":"","op":"exists"}'),
    (9, '{"path":"k","op":"other"}'),
]


@query(
    "field_match",
    f"""WITH v AS (SELECT event_id, {K} AS k, user_id FROM events)
      SELECT CAST(1 AS INTEGER) AS rule_id, event_id AS id FROM v
      UNION ALL SELECT 2, event_id FROM v WHERE k = '7' UNION ALL SELECT 3, event_id FROM v WHERE k LIKE '%9%'
      UNION ALL SELECT 4, event_id FROM v WHERE k IN ('10', '11') UNION ALL SELECT 6, event_id FROM v WHERE user_id = 3""",
)
def _(spark, sf):
    rules = spark.createDataFrame(
        [(n, 1, f"r{n}", True, "logs", '{"fieldsAll":[' + check + "]}", "{}", "{}") for n, check in FIELD_RULES],
        schemas.RULES,
    )
    inputs = alert_rules.inputs_from_logs(tables.track_logs(spark, sf))
    rows = alert_rules.match_rules(inputs, alert_rules.compile_rules(rules))
    return rows.select("rule_id", F.col("row_id").cast("bigint").alias("id"))


@query(
    "get_by_path",
    """SELECT event_id AS n, CASE WHEN event_id % 2 = 1 THEN 'T-' || event_type END AS kind,
        CASE WHEN event_id % 5 = 1 THEN CAST(user_id AS VARCHAR) END AS second_tag,
        event_id % 2 = 1 AS has_values, ['iOS', 'Android', 'Windows'][1 + user_id % 3] AS os,
        CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def _(spark, sf):
    rows = read_once(tables.raw_error_events(spark, sf), doc=F.try_parse_json("body"))

    def text(path):
        return plain_text(field_at(F.col("doc"), path))

    return rows.select(
        "n",
        text("exception.values.0.type").alias("kind"),
        text("tags.1.1").alias("second_tag"),
        field_at(F.col("doc"), "exception.values").isNotNull().alias("has_values"),
        F.trim(text("contexts.os.name")).alias("os"),
        text("exception.values.1.type").alias("missing"),
    )


@query(
    "repeat_defaults",
    """SELECT CAST(c_custkey AS INTEGER) AS rule_id,
        CAST(CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 ELSE 60 END AS BIGINT) AS "window",
        CAST(CASE WHEN c_custkey % 5 > 2 THEN c_custkey % 5 - 2 ELSE 1 END AS BIGINT) AS threshold,
        CAST(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 * 3000 ELSE 60 END AS BIGINT) AS base,
        CAST(greatest(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 * 3000 ELSE 60 END,
          CASE WHEN c_custkey % 2 > 0 THEN 100 ELSE 3600 END) AS BIGINT) AS ceiling,
        c_custkey % 4 <> 1 AS by_message FROM customer""",
)
def _(spark, sf):
    """One rule per customer, with settings missing, zero, negative or set."""
    n = F.col("c_custkey")
    repeat = F.concat(
        F.lit('{"windowSec":'), n % 7, F.lit(',"threshold":'), n % 5 - 2, F.lit(',"baseBackoffSec":'), n % 3 * 3000,
        F.when(n % 2 > 0, ',"maxBackoffSec":100').otherwise(""),
        F.when(n % 4 == 1, ',"dedupeByMessage":false').when(n % 4 == 2, ',"dedupeByMessage":true').otherwise(""),
        F.lit("}"),
    )
    rules = tables.load(spark, sf, "customer").select(
        n.cast("int").alias("id"), F.lit(1).alias("project_id"), F.col("c_name").alias("name"), F.lit(True).alias("enabled"),
        F.lit("both").alias("source"), F.lit("{}").alias("match"), repeat.alias("repeat"), F.lit("{}").alias("targets"),
    )
    return alert_rules.compile_rules(rules).select("rule_id", "window", "threshold", "base", "ceiling", "by_message")


SESSIONS = f"""{MATCHED}, ticks AS (
      SELECT rule_id, key_hash, tick, COUNT(*) AS n FROM matched GROUP BY ALL),
    starts AS (
      SELECT *, CASE WHEN coalesce(tick - lag(tick) OVER (PARTITION BY rule_id, key_hash ORDER BY tick) > 1000000::BIGINT * {WINDOWS}, TRUE)
        THEN 1 ELSE 0 END AS s FROM ticks),
    numbered AS (SELECT *, SUM(s) OVER (PARTITION BY rule_id, key_hash ORDER BY tick) AS session FROM starts),
    sessions AS (
      SELECT rule_id, key_hash, tick, n, CAST(session AS BIGINT) AS session,
        CAST(SUM(n) OVER (PARTITION BY rule_id, key_hash, session ORDER BY tick) AS BIGINT) AS occ FROM numbered)"""


def _sessions(spark, sf):
    return alert_state.alert_sessions(alert_state.ticks(_matched(spark, sf)))


def _states(matched):
    """States after the matches. Segments are read twice, for the last ones and for the sends, so they are stored first."""
    return alert_state.next_states(written_once(alert_state.alert_sessions(alert_state.ticks(matched))))


@query(
    "alert_sessions",
    f"""WITH {SESSIONS} SELECT CAST(rule_id AS INTEGER) AS rule_id, key_hash, tick, n, session, occ, occ - n AS occ_before,
        occ >= {THRESHOLDS} AS fires FROM sessions""",
)
def _(spark, sf):
    return alert_state.by_moment(_sessions(spark, sf)).select(
        "rule_id", "key_hash", "tick", "n", "session", "occ", "occ_before", (F.col("occ") >= F.col("threshold")).alias("fires")
    )


DECISIONS = f"""{SESSIONS}, due AS (SELECT * FROM sessions WHERE occ >= {THRESHOLDS}),
    sends AS (
      SELECT rule_id, key_hash, session, MIN(tick) AS tick, 0 AS exp FROM due GROUP BY ALL
      UNION ALL
      SELECT s.rule_id, s.key_hash, s.session, MIN(d.tick), s.exp + 1
      FROM sends s JOIN (SELECT rule_id AS r, key_hash AS h, session AS ss, tick FROM due) d
        ON d.r = s.rule_id AND d.h = s.key_hash AND d.ss = s.session
        AND d.tick >= s.tick + 1000000::BIGINT * least({BASES} * pow(2, s.exp), {CEILINGS})
      GROUP BY s.rule_id, s.key_hash, s.session, s.exp)"""


@query(
    "alert_decisions",
    f"""WITH RECURSIVE {DECISIONS} SELECT CAST(rule_id AS INTEGER) AS rule_id, key_hash, session, tick,
        CAST(exp AS BIGINT) AS backoff_exp FROM sends""",
)
def _(spark, sf):
    return alert_state.alert_decisions(_sessions(spark, sf)).select("rule_id", "key_hash", "session", "tick", "backoff_exp")


@query(
    "alert_states",
    f"""WITH RECURSIVE {DECISIONS}, lasts AS (
        SELECT * FROM (SELECT rule_id, key_hash, session, MAX(occ) AS occurrences, MAX(tick) AS last_seen FROM sessions GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY rule_id, key_hash ORDER BY session DESC) = 1)
      SELECT CAST(l.rule_id AS INTEGER) AS rule_id, l.key_hash, l.occurrences, l.last_seen,
        CAST(COUNT(s.tick) AS INTEGER) AS backoff_exp, MAX(s.tick) AS last_sent
      FROM lasts l LEFT JOIN sends s ON s.rule_id = l.rule_id AND s.key_hash = l.key_hash AND s.session = l.session GROUP BY ALL""",
)
def _(spark, sf):
    states = _states(_matched(spark, sf))
    return states.select(
        "rule_id", "key_hash", "occurrences", "backoff_exp",
        F.unix_micros("last_seen").alias("last_seen"), F.unix_micros("last_sent").alias("last_sent"),
    )


def _sending(spark, sf):
    matched = written_once(_matched(spark, sf))
    sessions = alert_state.alert_sessions(alert_state.ticks(matched))
    return alert_state.sending_rows(matched, alert_state.alert_decisions(sessions))


SENT_ROWS = f"""{DECISIONS}, sent_rows AS (
      SELECT m.* FROM (
        SELECT m.*, row_number() OVER (PARTITION BY m.rule_id, m.key_hash, m.tick ORDER BY m.ts, m.row_id) AS rn FROM matched m) m
      JOIN sends s ON s.rule_id = m.rule_id AND s.key_hash = m.key_hash AND s.tick = m.tick
      JOIN sessions x ON x.rule_id = m.rule_id AND x.key_hash = m.key_hash AND x.tick = m.tick
      WHERE m.rn = greatest(1, {THRESHOLDS.replace('rule_id', 'm.rule_id')} - (x.occ - x.n)))"""


@query(
    "format_notification",
    f"""WITH {MATCHED} SELECT CAST(rule_id AS INTEGER) AS rule_id, source, row_id,
        '[alert] Rule ' || rule_name || ' triggered' AS title,
        'project_id=' || project_id || ' source=' || source || ' level=' || level || ' message=' || message ||
          chr(10) || 'fields=' || fields AS content FROM matched""",
)
def _(spark, sf):
    return alert_rules.with_notification(_matched(spark, sf)).select("rule_id", "source", "row_id", "title", "content")


def _directory(spark, sf):
    """Bots, webhooks, contacts, groups and members, made of the customer, supplier and nation tables."""
    customers, suppliers = tables.load(spark, sf, "customer"), tables.load(spark, sf, "supplier")
    key = F.col("c_custkey").cast("int")
    kind = F.when(key % 2 == 0, "email").otherwise("sms")
    nation = F.col("n_nationkey")
    groups = tables.load(spark, sf, "nation").select(
        nation.alias("id"), F.lit(1).alias("project_id"), F.when(nation % 2 == 0, "sms").otherwise("email").alias("type")
    )
    supplier = F.col("s_suppkey").cast("int").alias("id")
    return {
        "bots": suppliers.select(supplier, F.lit(1).alias("project_id"), F.col("s_name").alias("webhook_url")),
        "webhooks": suppliers.select(
            supplier, F.when(F.col("s_suppkey") == 2, 9).otherwise(1).alias("project_id"), F.col("s_name").alias("url")
        ),
        "contacts": customers.select(
            key.alias("id"), F.lit(1).alias("project_id"), kind.alias("type"), F.col("c_name").alias("value")
        ),
        "groups": groups,
        "members": customers.select(F.col("c_nationkey").alias("group_id"), key.alias("contact_id")),
    }


TARGETS = """targets AS (
      SELECT 1 AS rule_id, 'webhook' AS channel_type, s_name AS target FROM supplier WHERE s_suppkey = 1
      UNION ALL SELECT 1, 'email', c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 0 AND (c_nationkey = 3 OR c_custkey IN (4, 6))
      UNION ALL SELECT 2, 'wecom', s_name FROM supplier WHERE s_suppkey = 5
      UNION ALL SELECT 2, 'sms', c_name FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey = 4
      UNION ALL SELECT 3, 'webhook', '{"url":"http://a"}' UNION ALL SELECT 3, 'email', '{"to":"b"}')"""


def all_targets(spark, sf):
    return alert_delivery.expand_targets(_rules(spark).filter("enabled"), **_directory(spark, sf))


@query("expand_targets", f"WITH {TARGETS} SELECT CAST(rule_id AS INTEGER) AS rule_id, channel_type, target FROM targets")
def _(spark, sf):
    return all_targets(spark, sf).select("rule_id", "channel_type", "target")


@query(
    "expand_channels",
    """SELECT CAST(s_suppkey AS INTEGER) AS rule_id, 'webhook' AS channel_type, '{"url":"' || s_name || '"}' AS target
        FROM supplier WHERE s_suppkey % 3 > 0
      UNION ALL SELECT CAST(s_suppkey AS INTEGER), 'sms', '{"n":' || s_nationkey || '}' FROM supplier WHERE s_suppkey % 3 = 2""",
)
def _(spark, sf):
    """One rule per supplier: id lists, one channel or two channels."""
    n = F.col("s_suppkey")
    one = F.concat(F.lit('{"type":"webhook","config":{"url":"'), F.col("s_name"), F.lit('"}}'))
    two = F.concat(F.lit(',{"type":"sms","config":{"n":'), F.col("s_nationkey"), F.lit("}}"))
    channels = F.concat(F.lit('{"channels":['), one, F.when(n % 3 == 2, two).otherwise(""), F.lit("]}"))
    rules = tables.load(spark, sf, "supplier").select(
        n.cast("int").alias("id"), F.lit(1).alias("project_id"),
        F.when(n % 3 > 0, channels).otherwise('{"wecomBotIds":[1],"channels":[]}').alias("targets"),
    )
    return alert_delivery.channel_targets(rules).select("rule_id", "channel_type", "target")


ALERT_DELIVERIES_SQL = f"""WITH RECURSIVE {SENT_ROWS}, {TARGETS}
      SELECT CAST(m.project_id AS INTEGER) AS project_id, CAST(t.rule_id AS INTEGER) AS rule_id, t.channel_type, t.target,
        '[alert] Rule ' || m.rule_name || ' triggered' AS title, 'pending' AS status, {micros('m.ts')} AS next_attempt_at
      FROM sent_rows m JOIN targets t ON t.rule_id = m.rule_id"""


def shown_deliveries(rows):
    return rows.select(
        "project_id", "rule_id", "channel_type", "target", "title", "status", micros_text(F.col("next_attempt_at")).alias("next_attempt_at")
    )


@query("alert_deliveries", ALERT_DELIVERIES_SQL)
def _(spark, sf):
    sends = alert_rules.with_notification(_sending(spark, sf))
    return shown_deliveries(alert_delivery.build_deliveries(sends, all_targets(spark, sf)))


NOW = "2024-01-30 12:00:00"


def _previews(spark, sf):
    """Every input as a what-if at one moment, against the states of the matches before it."""
    inputs = _inputs(spark, sf)
    compiled = alert_rules.compile_rules(_rules(spark))
    earlier = alert_rules.match_rules(inputs.filter(F.col("ts") < NOW), compiled)
    return alert_state.previews(alert_rules.preview_rows(inputs, compiled), _states(earlier), NOW)


PREVIEW = f"""{DECISIONS.replace('FROM matched GROUP BY', f"FROM matched WHERE ts < TIMESTAMP '{NOW}' GROUP BY")}, lasts AS (
        SELECT * FROM (SELECT rule_id, key_hash, session, MAX(occ) AS occ, MAX(tick) AS seen FROM sessions GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY rule_id, key_hash ORDER BY session DESC) = 1),
      states AS (
        SELECT l.rule_id, l.key_hash, l.occ, l.seen, COUNT(s.tick) AS exp,
          MAX(s.tick + 1000000::BIGINT * CAST(least({BASES.replace('rule_id', 'l.rule_id')} * pow(2, s.exp), {CEILINGS.replace('rule_id', 'l.rule_id')}) AS BIGINT)) AS next
        FROM lasts l LEFT JOIN sends s ON s.rule_id = l.rule_id AND s.key_hash = l.key_hash AND s.session = l.session GROUP BY ALL),
      now_at AS (SELECT epoch_us(TIMESTAMP '{NOW}') AS now_s),
      joined AS (
        SELECT m.rule_id, m.source, m.row_id, coalesce(s.occ, 0) AS occ_before,
          coalesce(now_s - s.seen > 1000000::BIGINT * {WINDOWS.replace('rule_id', 'm.rule_id')}, FALSE) AS expired, s.exp, s.next, now_s,
          {THRESHOLDS.replace('rule_id', 'm.rule_id')} AS threshold
        FROM matched m CROSS JOIN now_at LEFT JOIN states s ON s.rule_id = m.rule_id AND s.key_hash = m.key_hash),
      judged AS (
        SELECT *, CASE WHEN expired THEN 1 ELSE occ_before + 1 END AS occ_after,
          CASE WHEN expired THEN 0 ELSE coalesce(next, 0) END AS allowed, CASE WHEN expired THEN 0 ELSE coalesce(exp, 0) END AS e FROM joined)"""


@query(
    "alert_preview",
    f"""WITH RECURSIVE {PREVIEW}
      SELECT CAST(rule_id AS INTEGER) AS rule_id, source, row_id, CAST(occ_before AS BIGINT) AS occurrences_before,
        CAST(occ_after AS BIGINT) AS occurrences_after, expired AS window_expired,
        occ_after >= threshold AND now_s >= allowed AS will_enqueue,
        CASE WHEN occ_after < threshold THEN 'threshold' WHEN now_s < allowed THEN 'backoff' END AS suppressed_reason,
        CAST(e + CASE WHEN occ_after >= threshold AND now_s >= allowed THEN 1 ELSE 0 END AS BIGINT) AS backoff_exp_after
      FROM judged""",
)
def _(spark, sf):
    return _previews(spark, sf).filter("matched").select(
        "rule_id", "source", "row_id", "occurrences_before", "occurrences_after", "window_expired",
        "will_enqueue", "suppressed_reason", "backoff_exp_after",
    )


@query(
    "test_deliveries",
    f"""WITH RECURSIVE {PREVIEW}, {TARGETS}
      SELECT t.channel_type, t.target, '[TEST] [alert] Rule all views triggered' AS title, COUNT(*) AS n
      FROM judged j JOIN targets t ON t.rule_id = j.rule_id
      WHERE j.rule_id = 3 AND occ_after >= threshold AND now_s >= allowed GROUP BY ALL""",
)
def _(spark, sf):
    sends = alert_rules.with_notification(_previews(spark, sf))
    rows = alert_delivery.test_deliveries(sends, all_targets(spark, sf), 3)
    return rows.groupBy("channel_type", "target", "title").agg(F.count(F.lit(1)).alias("n"))


def _deliveries(spark, sf):
    """One delivery per order."""
    n, when = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(n % 5 == 0, "processing").when(n % 5 == 1, "sent").when(n % 5 == 2, "failed").otherwise("pending")
    return tables.load(spark, sf, "orders").select(
        n.alias("id"), F.lit(1).alias("project_id"), (n % 7).cast("int").alias("rule_id"),
        F.when(n % 2 == 0, "email").otherwise("webhook").alias("channel_type"), F.lit("t").alias("target"),
        status.alias("status"), (n % 12).cast("int").alias("attempts"), when.alias("next_attempt_at"),
        F.lit("old").alias("last_error"), when.alias("created_at"),
        F.timestamp_micros(F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - (n % 4) * 60000000).alias("updated_at"),
    )


ORDER_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'sent' WHEN 2 THEN 'failed' ELSE 'pending' END"
OUTCOME = "CASE WHEN o_orderkey % 5 = 3 THEN o_orderkey % 3 END"


@query(
    "delivery_transitions",
    f"""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 12 AS a, {ORDER_STATUS} AS status, {OUTCOME} AS o, o_orderdate,
          o_orderkey % 5 = 0 AND o_orderkey % 4 = 3 AS stuck FROM orders),
      j AS (SELECT *, o IN (1, 2) AS bad, o = 2 OR a + 1 >= 10 AS final FROM d)
      SELECT id, CAST(CASE WHEN bad THEN a + 1 ELSE a END AS INTEGER) AS attempts,
        CASE WHEN o = 0 THEN 'sent' WHEN bad AND final THEN 'failed' WHEN bad OR stuck THEN 'pending' ELSE status END AS status,
        CASE WHEN o = 0 THEN '' WHEN bad THEN 'e' || o ELSE 'old' END AS last_error,
        {micros('''CASE WHEN (bad AND final) OR stuck THEN TIMESTAMP '2024-01-31'
          WHEN bad THEN TIMESTAMP '2024-01-31' + to_seconds(CAST(least(2 * pow(2, a), 1800) AS BIGINT))
          ELSE CAST(o_orderdate AS TIMESTAMP) END''')} AS next_attempt_at FROM j""",
)
def _(spark, sf):
    deliveries = _deliveries(spark, sf)
    n = F.col("id")
    outcomes = deliveries.filter(n % 5 == 3).select(
        "id", (n % 3 == 0).alias("ok"), (n % 3 == 2).alias("permanent"), F.concat(F.lit("e"), n % 3).alias("error")
    )
    rows = alert_delivery.delivery_transitions(deliveries, outcomes, "2024-01-31 00:00:00")
    return rows.select(
        "id", "attempts", "status", "last_error", micros_text(F.col("next_attempt_at")).alias("next_attempt_at")
    )


@query(
    "purge_alert_history",
    f"""SELECT o_orderkey AS id, {ORDER_STATUS} AS status FROM orders
      WHERE NOT (o_orderdate < TIMESTAMP '1996-01-02' AND o_orderkey % 5 IN (1, 2))""",
)
def _(spark, sf):
    rows = alert_delivery.purge_deliveries(_deliveries(spark, sf), "1996-02-01 00:00:00", 30)
    return rows.select("id", "status")


@query(
    "purge_alert_states",
    f"""WITH {SESSIONS}, seen AS (SELECT rule_id, key_hash, MAX(tick) AS t FROM sessions GROUP BY ALL)
      SELECT CAST(rule_id AS INTEGER) AS rule_id, key_hash FROM seen WHERE t >= epoch_us(TIMESTAMP '2024-01-29 06:00:00')""",
)
def _(spark, sf):
    states = _states(_matched(spark, sf))
    return alert_delivery.purge_states(states, "2024-02-05 06:00:00", 7).select("rule_id", "key_hash")


@query(
    "list_deliveries",
    f"""SELECT o_orderkey AS id, {ORDER_STATUS} AS status FROM orders
      WHERE o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 AND o_orderkey % 7 = 3 ORDER BY id DESC LIMIT 200""",
)
def _(spark, sf):
    return search.list_deliveries(_deliveries(spark, sf), "sent", "email", 3, 200, most=200).select("id", "status")

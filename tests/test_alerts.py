"""Rule matching, alert state and deliveries on small literal data."""

import datetime as dt
import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import alert_delivery, alert_rules, alert_state
from tidewell.streaming.alert_stream import decide

T0 = dt.datetime(2025, 1, 1)
LOGS = (
    "id int, project_id int, ts timestamp, ingest_id string, level string, distinct_id string, device_id string, "
    "trace_id string, span_id string, message string, fields string"
)


def logs(spark, *rows):
    """(level, message, fields, seconds)"""
    data = [(i, 1, T0 + dt.timedelta(seconds=s), None, lv, "", "", "", "", m, f) for i, (lv, m, f, s) in enumerate(rows)]
    return spark.createDataFrame(data, LOGS)


def rule(spark, match, repeat=None, targets=None, source="logs"):
    row = (1, 1, "r", True, source, json.dumps(match), json.dumps(repeat or {}), json.dumps(targets or {}))
    return spark.createDataFrame([row], schemas.RULES)


def matched(spark, rows, match, repeat=None, max_rows=10**6):
    inputs = alert_rules.inputs_from_logs(rows)
    return alert_rules.match_rules(inputs, alert_rules.compile_rules(rule(spark, match, repeat)), max_rows)


def ids(df):
    return sorted(int(r["row_id"]) for r in df.collect())


NESTED = '{"user":{"id":"U1 "},"n":5,"b":true,"none":null,"list":[{"x":"TypeError"}],"obj":{"a":1}}'


@pytest.mark.parametrize(
    "match, hit",
    [
        ({}, True),
        ({"levels": [" EVENT "]}, True),
        ({"levels": ["error"]}, False),
        ({"levels": [""]}, False),
        ({"levels": []}, True),
        ({"eventNames": ["Signup"]}, True),
        ({"eventNames": ["other"]}, False),
        ({"messageKeywords": ["GNU", "nope"]}, True),
        ({"messageKeywords": [" "]}, False),
        ({"fieldsAll": [{"path": "user.id", "op": "eq", "value": "u1"}]}, True),
        ({"fieldsAll": [{"path": "user.id", "op": "eq", "value": "u2"}]}, False),
        ({"fieldsAll": [{"path": "n", "op": "eq", "value": 5}, {"path": "b", "op": "eq", "value": "TRUE"}]}, True),
        ({"fieldsAll": [{"path": "n", "op": "in", "values": [4, 5.0]}]}, True),
        ({"fieldsAll": [{"path": "none", "op": "exists"}]}, True),
        ({"fieldsAll": [{"path": "none", "op": "eq", "value": None}]}, True),
        ({"fieldsAll": [{"path": "none", "op": "in", "values": [""]}]}, False),
        ({"fieldsAll": [{"path": "gone", "op": "eq", "value": ""}]}, False),
        ({"fieldsAll": [{"path": "list.0.x", "op": "contains", "value": "error"}]}, True),
        ({"fieldsAll": [{"path": "list.1.x", "op": "exists"}]}, False),
        ({"fieldsAll": [{"path": "list.x", "op": "exists"}]}, False),
        ({"fieldsAll": [{"path": "obj", "op": "eq", "value": {"a": 1}}]}, True),
        ({"fieldsAll": [{"path": "n", "op": "between", "value": 5}]}, False),
        ({"fieldsAll": [{"path": "", "op": "exists"}]}, False),
    ],
)
def test_match(spark, match, hit):
    rows = logs(spark, ("event", "signup", NESTED, 0))
    assert ids(matched(spark, rows, match)) == ([0] if hit else [])


def test_salted_rule_join_gives_the_same_matches(spark):
    rows = logs(spark, *[("error", f"m{i % 3}", "{}", i) for i in range(30)])
    assert ids(matched(spark, rows, {"messageKeywords": ["m1"]}, max_rows=0)) == list(range(1, 30, 3))


def test_dedupe_key(spark):
    rows = logs(spark, (" error ", " Boom ", '{"a":"X"}', 0))
    found = matched(spark, rows, {}, {"dedupeFields": ["z", "a"]}).first()["key_hash"]
    text = "rule=1|src=logs|lvl=error|msg=boom|f.a=x|f.z=<missing>"
    assert found == hashlib.sha256(text.encode()).hexdigest()
    alone = matched(spark, rows, {}, {"dedupeByMessage": False}).first()["key_hash"]
    assert alone == hashlib.sha256(b"rule=1|src=logs|lvl=error").hexdigest()


def test_repeat_defaults():
    base = {"id": 1, "project_id": 1, "name": "r", "source": "logs", "match": None, "targets": "{}"}
    bare = alert_rules.compile_rule({**base, "repeat": "oops"})
    assert (bare["window"], bare["threshold"], bare["base"], bare["ceiling"], bare["by_message"]) == (60, 1, 60, 3600, True)
    low = alert_rules.compile_rule({**base, "repeat": '{"baseBackoffSec":90,"maxBackoffSec":30}'})
    assert (low["base"], low["ceiling"]) == (90, 90)


SECOND = 1_000_000


def sends(spark, seconds, repeat, states=None):
    rows = logs(spark, *[("error", "boom", "{}", s) for s in seconds])
    hits = matched(spark, rows, {}, repeat)
    sessions = alert_state.alert_sessions(alert_state.ticks(hits), states)
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    found = sorted((r["tick"] - start * SECOND) / SECOND for r in alert_state.alert_decisions(sessions).collect())
    return found, sessions, hits


def test_threshold_at_one_instant(spark):
    repeat = {"windowSec": 60, "threshold": 2, "baseBackoffSec": 60}
    found, sessions, hits = sends(spark, [0, 0, 0], repeat)
    assert found == [0]
    sent = alert_state.sending_rows(hits, alert_state.alert_decisions(sessions)).collect()
    assert [r["row_id"] for r in sent] == ["1"]


def test_window_expiry_resets_backoff(spark):
    assert sends(spark, [0, 61], {"windowSec": 60, "threshold": 1, "baseBackoffSec": 3600})[0] == [0, 61]
    assert sends(spark, [0, 60], {"windowSec": 60, "threshold": 1, "baseBackoffSec": 3600})[0] == [0]


def test_times_are_compared_in_full(spark):
    """Parts of a second decide: the window, the backoff, and which of several rows of a second sends."""
    repeat = {"windowSec": 60, "threshold": 1, "baseBackoffSec": 3600}
    assert sends(spark, [0.0, 60.9], repeat)[0] == [0, 60.9]
    assert sends(spark, [0.9, 60.9], repeat)[0] == [0.9]
    assert sends(spark, [0.9, 60.900001], repeat)[0] == [0.9, 60.900001]
    repeat = {"windowSec": 60, "threshold": 1, "baseBackoffSec": 10}
    assert sends(spark, [0.5, 10.4, 10.6, 10.7, 30.5, 30.599999, 30.6], repeat)[0] == [0.5, 10.6, 30.6]
    repeat = {"windowSec": 60, "threshold": 3, "baseBackoffSec": 10}
    found, sessions, hits = sends(spark, [5.1, 5.3, 5.3, 5.3, 5.7], repeat)
    assert found == [5.3]
    assert [r["row_id"] for r in alert_state.sending_rows(hits, alert_state.alert_decisions(sessions)).collect()] == ["2"]
    state = alert_state.next_states(sessions).first()
    assert (state["last_seen"].microsecond, state["last_sent"].microsecond, state["occurrences"]) == (700_000, 300_000, 5)


def test_one_noisy_key_is_many_rows_of_bounded_size(spark):
    """What meets by key has one row per second, and every second is counted on its own."""
    rows = spark.range(20_000).selectExpr("1 AS rule_id", "'k' AS key_hash", "60L AS window", "1L AS threshold", "60L AS base", "3600L AS ceiling",
                                          "timestamp_micros(1735689600000000 + id * 1000) AS ts")
    counted = alert_state.ticks(rows)
    assert counted.count() == 20 and counted.selectExpr("max(size(moments))").first()[0] == 1000
    one = alert_state.alert_sessions(counted).orderBy(F.desc("second")).first()
    assert (one["session"], one["occ"], one["last"] - one["first"]) == (1, 20_000, 999_000)


def test_backoff_sequence(spark):
    repeat = {"threshold": 2, "windowSec": 60, "baseBackoffSec": 30, "maxBackoffSec": 60}
    assert sends(spark, [0, 10, 20, 70, 200, 210], repeat)[0] == [10, 70, 210]


def brute(seconds, window, threshold, base, ceiling):
    occ = exp = allowed = 0
    last, out = None, []
    for s in sorted(seconds):
        if last is not None and s - last > window:
            occ = exp = allowed = 0
        occ, last = occ + 1, s
        if occ >= threshold and s >= allowed:
            delay = base
            for _ in range(exp):
                delay = min(delay * 2, ceiling)
            allowed, exp = s + delay, exp + 1
            out.append(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batch_and_stream_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randrange(4000) * SECOND, rng.randrange(4000 * SECOND)]) for _ in range(250))
    window, threshold, base, ceiling = rng.choice([20, 60]), rng.randrange(1, 4), rng.choice([5, 40]), rng.choice([40, 300])
    expected = brute(times, window * SECOND, threshold, base * SECOND, ceiling * SECOND)
    repeat = {"windowSec": window, "threshold": threshold, "baseBackoffSec": base, "maxBackoffSec": ceiling}
    assert [round(t * SECOND) for t in sends(spark, [t / SECOND for t in times], repeat)[0]] == expected
    counts = {}
    for s in times:
        counts[s + 1] = counts.get(s + 1, 0) + 1
    state, streamed = (0, 0, 0, 0), []
    for low in range(0, 4001 * SECOND, 500 * SECOND):
        part = {s: n for s, n in counts.items() if low < s <= low + 500 * SECOND}
        state, sent = decide(part, (window, threshold, base, ceiling), state)
        streamed += [t - 1 for t, _, _ in sent]
    assert streamed == expected


def test_stored_state_continues_a_session(spark):
    repeat = {"threshold": 2, "windowSec": 60, "baseBackoffSec": 30, "maxBackoffSec": 60}
    _, first, _ = sends(spark, [0, 10, 20], repeat)
    states = alert_state.next_states(first)
    row = states.first()
    assert (row["occurrences"], row["backoff_exp"]) == (3, 1)
    assert sends(spark, [70, 200, 210], repeat, states)[0] == [70, 210]


def test_late_rows_do_not_end_a_session():
    state, sent = decide({100 * SECOND: 1}, (60, 1, 3600, 3600), (0, 0, 0, 0))
    state, sent = decide({10 * SECOND: 1}, (60, 1, 3600, 3600), state)
    assert sent == [] and state[0] == 2 and state[2] == 100 * SECOND


def test_preview_reports_why_nothing_is_sent(spark):
    repeat = {"threshold": 2, "windowSec": 60, "baseBackoffSec": 600}
    rows = logs(spark, ("error", "boom", "{}", 0), ("error", "other", "{}", 0))
    _, sessions, _ = sends(spark, [0, 10], repeat)
    states = alert_state.next_states(sessions)
    routed = alert_rules.preview_rows(alert_rules.inputs_from_logs(rows), alert_rules.compile_rules(rule(spark, {"levels": ["error"]}, repeat)))

    def look(now):
        return {r["row_id"]: r for r in alert_state.previews(routed, states, now).collect()}

    found = look(T0 + dt.timedelta(seconds=30))
    assert (found["0"]["occurrences_before"], found["0"]["occurrences_after"], found["0"]["suppressed_reason"]) == (2, 3, "backoff")
    assert (found["1"]["occurrences_after"], found["1"]["suppressed_reason"], found["1"]["will_enqueue"]) == (1, "threshold", False)
    later = look(T0 + dt.timedelta(seconds=100))["0"]
    assert (later["window_expired"], later["occurrences_after"], later["backoff_exp_after"]) == (True, 1, 0)
    quiet = alert_rules.preview_rows(alert_rules.inputs_from_logs(rows), alert_rules.compile_rules(rule(spark, {"levels": ["info"]})))
    assert [r["matched"] for r in alert_state.previews(quiet, states, T0).collect()] == [False, False]


def test_preview_with_one_webhook_builds_one_delivery(spark):
    rules = rule(spark, {"levels": ["error"]}, {}, {"webhookEndpointIds": [1]})
    inputs = alert_rules.inputs_from_logs(logs(spark, ("error", "boom!", '{"a":1}', 0)))
    states = spark.createDataFrame([], schemas.STATES)
    routed = alert_rules.preview_rows(inputs, alert_rules.compile_rules(rules))
    sends_now = alert_rules.with_notification(alert_state.previews(routed, states, T0))
    none = spark.createDataFrame([], "id int, project_id int, type string, value string, webhook_url string, url string")
    hooks = spark.createDataFrame([(1, 1, "http://h"), (1, 2, "http://other")], "id int, project_id int, url string")
    members = spark.createDataFrame([], "group_id int, contact_id int")
    targets = alert_delivery.expand_targets(rules, none, hooks, none, none, members)
    row = alert_delivery.test_deliveries(sends_now, targets, 1).collect()
    assert [(r["channel_type"], r["target"], r["title"]) for r in row] == [("webhook", "http://h", "[TEST] [alert] Rule r triggered")]
    assert row[0]["content"] == 'project_id=1 source=logs level=error message=boom!\nfields={"a":1}'
    assert alert_delivery.test_deliveries(sends_now, targets, 2).isEmpty()


def test_retry_delays(spark):
    df = spark.createDataFrame([(i,) for i in range(14)], "n int")
    found = [r[0] for r in df.select(alert_delivery.retry_delay(F.col("n"))).collect()]
    assert found == [0, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 1800, 1800, 1800]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_walk_carries_a_session_from_part_to_part(size):
    rng = random.Random(size)
    rows = [
        (rule_id, key, session, tick, 5, 40, 1, 0, 0)
        for rule_id in (1, 2) for key in ("a", "b") for session in (1, 2)
        for tick in sorted(rng.sample(range(session * 1000, session * 1000 + 300), 60))
    ]
    names = ["rule_id", "key_hash", "session", "tick", "base", "ceiling", "nth", "seen_exp", "seen_next"]
    whole = pd.DataFrame(rows, columns=names)
    parts = [whole.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(whole), size)]
    one = pd.concat(alert_state.walk(iter([whole])), ignore_index=True)
    many = pd.concat(alert_state.walk(iter(parts)), ignore_index=True)
    assert one.astype(str).equals(many.astype(str))
    expected = brute([r[3] for r in rows if r[:3] == (2, "b", 1)], 1000, 1, 5, 40)
    assert list(one.query("rule_id == 2 and key_hash == 'b' and session == 1")["tick"]) == expected


def test_walk_of_nothing():
    assert len(pd.concat(alert_state.walk(iter([pd.DataFrame(columns=["rule_id", "key_hash", "session", "tick", "base", "ceiling", "nth", "seen_exp", "seen_next"])])))) == 0


def test_state_is_kept_for_long_windows():
    from tidewell.streaming import alert_stream

    assert alert_stream.idle_ms(30 * 86_400, 100, 0) == 30 * 86_400_000 + alert_stream.IDLE_MS
    assert alert_stream.idle_ms(60, 100 * SECOND, 1_000_000 * SECOND) == 999_900_000 + alert_stream.IDLE_MS
    assert alert_stream.idle_ms(60, 100, 0) == 60_000 + alert_stream.IDLE_MS


def test_rule_paths_are_literals_in_the_plan(spark):
    """A path that is a column would be parsed again for every row; beyond the limit it is one, with the same result."""
    checks = '{"fieldsAll":[{"path":"a.b","op":"eq","value":7},{"path":"c","op":"exists"}]}'
    rules = spark.createDataFrame([(1, 1, "r", True, "logs", checks, "{}", "{}")], schemas.RULES)
    rows = [('{"a":{"b":7},"c":1}', "x"), ('{"a":{"b":8},"c":1}', "y"), ('{"a":{"b":7}}', "z")]
    inputs = spark.createDataFrame(
        [(i, 1, "logs", dt.datetime(2025, 1, 1), "info", "m", fields, {}) for fields, i in rows],
        "row_id string, project_id int, source string, ts timestamp, level string, message string, fields string, ids map<string,string>",
    )
    found = alert_rules.match_rules(inputs, alert_rules.compile_rules(rules))
    assert [r.row_id for r in found.select("row_id").collect()] == ["x"]
    assert '$["a"]["b"]' in found._jdf.queryExecution().optimizedPlan().toString()


def test_states_match_the_rows_once(spark, sf_dir):
    """The segments behind the states are stored: the rules are not matched again for the sends."""
    from tidewell.plans import alerts

    plan = alerts._previews(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2") <= 4

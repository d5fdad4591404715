"""Funnel, retention, growth, rollup, distribution and custom analysis on small literal data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import active, custom, distribution, funnel, growth, lifecycle, retention, rollup, top_events

TRACK = "project_id int, ts timestamp, ingest_id string, name string, distinct_id string, device_id string"
DAY0 = dt.datetime(2025, 1, 2, 12)


def track(spark, *rows):
    """(name, user, seconds after DAY0)"""
    data = [(1, DAY0 + dt.timedelta(seconds=s), str(i), n, u, None) for i, (n, u, s) in enumerate(rows)]
    return spark.createDataFrame(data, TRACK)


def counts(df):
    return [r["users"] for r in df.orderBy("step_no").collect()]


RANGE = (DAY0 - dt.timedelta(days=1), DAY0 + dt.timedelta(days=20))
HOUR = dt.timedelta(hours=1)


def test_signup_funnel(spark):
    rows = track(spark, ("signup", "u1", 0), ("checkout", "u1", 1), ("paid", "u1", 2), ("signup", "u2", 0), ("checkout", "u2", 1))
    top = [tuple(r) for r in top_events.top_events(rows, *RANGE).collect()]
    assert top == [("checkout", 2, 2), ("signup", 2, 2), ("paid", 1, 1)]
    steps = funnel.with_conversion(funnel.funnel(rows, "signup,checkout,paid", *RANGE, dt.timedelta(hours=24)))
    assert [tuple(r)[2:] for r in steps.orderBy("step_no").collect()] == [(2, 1.0, 0), (2, 1.0, 0), (1, 0.5, 1)]


@pytest.mark.parametrize("hot_rows", [10**6, 0])
def test_funnel_edges(spark, hot_rows):
    """The same answers from the window form and from the form for very large users."""
    rows = track(
        spark,
        ("a", "tie", 5), ("b", "tie", 5), ("c", "tie", 5),
        ("a", "skips", 0), ("c", "skips", 9),
        ("b", "early", 0), ("a", "early", 1),
        ("a", "edge", 0), ("b", "edge", 3600), ("c", "edge", 3601),
        ("b", "never", 0), ("a", "", 0), ("b", "", 1),
    )

    def run(within=None):
        return counts(funnel.funnel(rows, ["a", "b", "c"], *RANGE, within, hot_rows=hot_rows))

    assert run() == [4, 2, 2]
    assert run(HOUR) == [4, 2, 1]
    assert counts(funnel.funnel(rows, ["x", "y"], *RANGE, hot_rows=hot_rows)) == [0, 0]


def brute_funnel(rows, steps, within):
    users = {}
    for name, user, s in rows:
        users.setdefault(user, []).append((s, name))
    out = [0] * len(steps)
    for events in users.values():
        at = first = None
        for i, step in enumerate(steps):
            ok = [s for s, n in events if n == step and (i == 0 or s >= at) and (i == 0 or not within or s <= first + within)]
            if not ok:
                break
            at = min(ok)
            first = at if i == 0 else first
            out[i] += 1
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 12, 0])
@pytest.mark.parametrize("within", [None, 7200])
def test_funnel_equals_brute_force(spark, hot_rows, within):
    rng = random.Random(7)
    rows = [(rng.choice("abcd"), f"u{min(rng.randrange(60), 20)}", rng.randrange(20000)) for _ in range(700)]
    steps = ["a", "b", "c", "d"]
    bound = dt.timedelta(seconds=within) if within else None
    found = counts(funnel.funnel(track(spark, *rows), steps, *RANGE, bound, hot_rows=hot_rows))
    assert found == brute_funnel(rows, steps, within)


def test_funnel_arguments():
    nine = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    assert funnel.clean_steps(" a,, A,b ,c,d,e,f,g,h,i") == nine
    assert funnel.clean_steps(["x" * 201, "x" * 200]) == ["x" * 201, "x" * 200]
    for refused in (lambda: funnel.clean_steps(nine, max_steps=8), lambda: funnel.clean_steps(["x" * 201], max_bytes=200)):
        with pytest.raises(ValueError):
            refused()
    assert funnel.within_seconds(dt.timedelta(milliseconds=5)) == 1
    assert funnel.within_seconds(dt.timedelta(days=90)) == 90 * 86400
    with pytest.raises(ValueError):
        funnel.within_seconds(dt.timedelta(days=90), longest=dt.timedelta(days=30))
    with pytest.raises(ValueError):
        funnel.check_range("2025-01-02", "2025-01-01")
    with pytest.raises(ValueError):
        funnel.check_range("2025-01-01", "2025-02-02", longest=dt.timedelta(days=31))
    with pytest.raises(ValueError):
        funnel.check_range("2025-01-01", "2025-01-03", now="2025-01-31", retention_days=20)
    funnel.check_range("2025-01-01", "2025-01-03", now="2025-01-31", retention_days=30)


def test_top_events_source_order(spark):
    logs = spark.createDataFrame(
        [(1, DAY0, "i", "event", "signup", "u1", "d", "{}")],
        "project_id int, ts timestamp, ingest_id string, level string, message string, distinct_id string, device_id string, fields string",
    )
    none = track(spark).limit(0)
    daily = spark.createDataFrame([(1, "2025-01-02", "signup", "u1", 3)], "project_id int, day string, name string, distinct_id string, events bigint")

    def auto(rollup_rows):
        return [tuple(r) for r in top_events.top_events_auto(rollup_rows, none, logs, *RANGE).collect()]

    assert auto(daily.limit(0)) == [("signup", 1, 1)]
    assert auto(daily) == [("signup", 3, 1)]


def test_hybrid_equals_raw(spark):
    rng = random.Random(3)
    rows = track(spark, *[(rng.choice("abc"), f"u{rng.randrange(9)}", rng.randrange(86400 * 9)) for _ in range(500)])
    start, end = DAY0 + dt.timedelta(hours=5), DAY0 + dt.timedelta(days=6, hours=3)
    raw = top_events.top_events(rows, start, end).collect()
    assert raw == top_events.top_events_hybrid(rows, rollup.daily_rollup(rows), start, end).collect()


def test_rollup(spark):
    rows = track(spark, ("signup", "u1", 0), ("signup", "u1", 9), ("signup", "u2", 0), ("checkout", "u1", 0), ("", "u1", 0), ("x", "", 0))
    found = {(r["name"], r["distinct_id"]): r["events"] for r in rollup.daily_rollup(rows).collect()}
    assert found == {("signup", "u1"): 2, ("signup", "u2"): 1, ("checkout", "u1"): 1}


def test_merge_and_rebuild_rollup(spark):
    schema = "project_id int, day string, name string, distinct_id string, events bigint"
    old = spark.createDataFrame([(1, "2025-01-01", "a", "u", 2), (1, "2025-01-02", "a", "u", 9), (2, "2025-01-01", "a", "u", 9)], schema)
    delta = spark.createDataFrame([(1, "2025-01-01", "a", "u", 3)], schema)
    merged = rollup.merge_rollup(old, delta)
    assert {tuple(r) for r in merged.collect()} == {(1, "2025-01-01", "a", "u", 5), (1, "2025-01-02", "a", "u", 9), (2, "2025-01-01", "a", "u", 9)}
    rebuilt = rollup.rebuild_rollup(merged, track(spark, ("a", "u", 0)), 1, "2025-01-02 10:00:00")
    assert {tuple(r) for r in rebuilt.collect()} == {(1, "2025-01-02", "a", "u", 1), (2, "2025-01-01", "a", "u", 9)}


def activity(spark, *rows):
    """(kind, level, user, device, day)"""
    data = [(dt.datetime(2025, 1, d, 5), k, lv, u, dev) for k, lv, u, dev, d in rows]
    return spark.createDataFrame(data, "ts timestamp, kind string, level string, distinct_id string, device_id string")


def test_today_days_and_retention(spark):
    rows = activity(spark, ("event", "error", "u1", "d1", 2), ("log", "error", "u2", "d2", 2), ("event", "info", "u1", "d1", 1))
    assert tuple(active.metrics_today(rows, "2025-01-02 08:00:00").first()) == (1, 1, 1, 2)
    assert tuple(active.metrics_total(rows).first()) == (1, 2, 2)
    days = [tuple(r) for r in active.active_by_day(rows, "2025-01-01", "2025-01-03").orderBy("day").collect()]
    assert days == [("2025-01-01", 1), ("2025-01-02", 2), ("2025-01-03", 0)]
    found = [tuple(r) for r in retention.retention(rows, "2025-01-01", "2025-01-02", [1]).orderBy("cohort").collect()]
    assert found == [("2025-01-01", 1, 1, 1, 1.0), ("2025-01-02", 2, 1, 0, 0.0)]


@pytest.mark.parametrize("sketch", [False, True])
def test_retention_equals_brute_force(spark, sketch):
    rng = random.Random(5)
    rows = [("log", "info", f"u{rng.randrange(12)}", "d", rng.randrange(1, 29)) for _ in range(80)]
    offsets = [1, 2, 9, 200]
    run = retention.retention_approx if sketch else retention.retention
    found = {(r["cohort"], r["day"]): (r["cohort_size"], r["active"]) for r in run(activity(spark, *rows), "2025-01-03", "2025-01-25", offsets).collect()}
    by_day = {}
    for _, _, user, _, day in rows:
        by_day.setdefault(day, set()).add(user)
    expected = {
        (f"2025-01-{d:02d}", k): (len(by_day.get(d, ())), len(by_day.get(d, set()) & by_day.get(d + k, set())))
        for d in range(3, 26) for k in offsets
    }
    assert found == expected


def test_retention_offsets():
    assert retention.clean_offsets([7, 1, 7, 0, -1, 366]) == [1, 7, 366]
    assert retention.clean_offsets(None) == [1, 7, 30]
    assert retention.clean_offsets(list(range(1, 12))) == list(range(1, 12))
    for refused in ({"most": 10}, {"furthest": 10}):
        with pytest.raises(ValueError):
            retention.clean_offsets(list(range(1, 12)), **refused)


def test_growth(spark):
    rows = track(spark, ("a", "u1", 0), ("a", "u1", 86400), ("a", "u2", 86400 * 2), ("a", "", 0))
    seen = growth.first_seen(rows, rows.limit(0))
    found = growth.cumulative(growth.user_growth(seen, *RANGE)).collect()
    assert [tuple(r) for r in found] == [("2025-01-02", 1, 1), ("2025-01-04", 1, 2)]
    assert growth.total_users(seen).first()[0] == 2


def test_distribution_skips_blank_keys(spark):
    df = spark.createDataFrame([(DAY0, "iOS", " "), (DAY0, " iOS ", None), (DAY0, "", "x")], "ts timestamp, os string, browser string")
    daily = distribution.daily_dims(distribution.fan_out_dims(df, ["os", "browser"]))
    assert [tuple(r) for r in distribution.distribution(daily, "os", DAY0, DAY0).collect()] == [("iOS", 2)]


@pytest.mark.parametrize("max_rows", [10**6, 0])
def test_geo_ranges(spark, max_rows):
    """The same answers from the broadcast join and from the salted join."""
    ranges = spark.createDataFrame(
        [(0, 99, "a"), (256, 70000, "b"), (16777216, 16777217, "c")], "lo bigint, hi bigint, country string"
    )
    ips = ["0.0.0.99", "0.0.0.100", "0.1.17.112", "0.1.17.113", "1.0.0.1", "1.0.0.300", "x", None]
    rows = spark.createDataFrame(list(enumerate(ips)), "n int, client_ip string")
    found = {r["n"]: r["country"] for r in distribution.geo_enrich(rows, ranges, max_rows=max_rows, salts=3).collect()}
    assert found == {0: "a", 1: None, 2: "b", 3: None, 4: "c", 5: None, 6: None, 7: None}


def logs(spark, *rows):
    data = [(1, DAY0 + dt.timedelta(seconds=s), "event", m, u, f) for m, u, f, s in rows]
    return spark.createDataFrame(data, "project_id int, ts timestamp, level string, message string, distinct_id string, fields string")


def ask(**more):
    base = {"analysis_type": "event", "time_range": {"start": "2025-01-01T00:00:00Z", "end": "2025-01-31T00:00:00+00:00"}}
    return custom.parse_request({**base, **more}, "2025-02-01")


def test_custom_counts_blank_users_and_dotted_keys(spark):
    rows = logs(spark, ("a", "", '{"x.y":"1","x":{"y":"2"}}', 0), ("a", "u", '{"x":{"y":"2"}}', 0), ("a", "", "{}", 0))
    request = ask(group_by=["property:x.y", "event"])
    found = {tuple(r) for r in custom.custom_events(rows, request).collect()}
    assert found == {("all", "a", "1", 1, 1), ("all", "a", "", 2, 2)}


def test_custom_user_total_sums_buckets(spark):
    rows = logs(spark, ("a", "u", "{}", 0), ("a", "u", "{}", 86400))
    request = ask(metric={"type": "count_users"})
    series = custom.series_points(custom.custom_series(custom.custom_events(rows, request), request)).first()
    assert (series["series"], series["total"], [tuple(p) for p in series["points"]]) == ("all", 2, [("2025-01-02", 1), ("2025-01-03", 1)])


@pytest.mark.parametrize(
    "bad",
    [
        {"analysis_type": "x"}, {"metric": {"type": "sum"}}, {"group_by": ["time", "event", "x"]}, {"group_by": ["who"]},
        {"group_by": ["property:"]}, {"group_by": ["property:a b"]}, {"group_by": ["property:a", "property:b"]},
        {"time_range": {"start": "2024-01-01T00:00:00Z", "end": "2025-01-01T00:00:00Z"}}, {"time_range": {"granularity": "year"}},
        {"filter": {"properties": {"A": {"values": ["1"]}}}}, {"time_range": {"start": "yesterday"}},
    ],
)
def test_custom_request_errors(bad):
    with pytest.raises(ValueError):
        ask(**bad)


def test_custom_request_defaults():
    request = custom.parse_request({"analysis_type": " Property "}, "2025-01-31 10:00:00")
    assert (request.start, request.end) == (dt.datetime(2025, 1, 18, 10), dt.datetime(2025, 1, 31, 10))
    assert (request.dimensions, request.metric, request.granularity) == (["time"], "count_events", "day")


def test_delete_and_retention(spark):
    data = [(1, DAY0 - dt.timedelta(days=40))] * 25 + [(1, DAY0)] * 5 + [(2, DAY0 - dt.timedelta(days=40))] * 10
    rows = spark.createDataFrame(data, "project_id int, ts timestamp")
    assert lifecycle.count_before(rows, 1, DAY0).first()[0] == 25
    left = lifecycle.delete_before(rows, 1, DAY0).groupBy("project_id").count().collect()
    assert {tuple(r) for r in left} == {(1, 5), (2, 10)}
    policies = spark.createDataFrame([(1, True, 30, 0), (2, False, 1, 1)], "project_id int, enabled boolean, logs_days int, track_days int")
    for max_rows in (10**6, 0):
        assert lifecycle.apply_retention(rows, policies, "logs_days", DAY0, max_rows).count() == 15
        assert lifecycle.apply_retention(rows, policies, "track_days", DAY0, max_rows).count() == 40


def test_storage_estimate_saturates_and_handles_empty(spark):
    rows = spark.createDataFrame([(DAY0, 1, "x" * 10, None), (DAY0, 2, "é", "{}")], "ts timestamp, id int, message string, fields string")
    found = lifecycle.storage_of(rows, "logs").first()
    assert (found["count"], found["avg_row_bytes"], found["est_bytes"]) == (2, 127, 254)
    empty = lifecycle.storage_of(rows.limit(0), "logs").first()
    assert (empty["count"], empty["sample_size"], empty["est_bytes"]) == (0, 0, 0)


def test_backslashes_in_search_text(spark):
    names = ["C:\\dir", "C:dir", "100%", "100x", "a_b", "axb", "end%", "back\\slash"]
    rows = spark.createDataFrame([(n,) for n in names], "message string")

    def found(q):
        return {r.message for r in rows.filter(F.col("message").ilike(text.contains_pattern(q))).collect()}

    assert found("C:\\d") == {"C:dir"}
    assert found("C:\\\\d") == {"C:\\dir"}
    assert found("100\\%") == {"100%"} and found("0%") == {"100%", "100x"}
    assert found("a\\_b") == {"a_b"} and found("a_b") == {"a_b", "axb"}
    assert found("end\\") == {"end%"} and found("k\\\\s") == {"back\\slash"}

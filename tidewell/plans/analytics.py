"""Product analytics over the events table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewell.functions.times import bucket_key, day_key
from tidewell.operators import active, addresses, custom, definitions, distribution, funnel, growth, retention
from tidewell.operators import rollup, top_events
from tidewell.plans.model_sql import GEO, day, errors, logs, micros, track
from tidewell.plans.registry import query
from tidewell.session import run_dir
from tidewell.sources import facts, stored_rollup, tables

# The ranges the queries ask for.
START, END = "2024-01-05 06:00:00", "2024-01-20 18:30:00"
NOW = "2024-01-31 00:00:00"
STEPS = ["view", "click", "purchase"]
DAY = timedelta(days=1)

IN_RANGE = f"ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'"
IN_DAYS = f"{day('ts')} BETWEEN '2024-01-05' AND '2024-01-20'"


def _top_sql(source: str, where: str, name: str = "name") -> str:
    return f"""WITH {source}
      SELECT {name} AS name, COUNT(*) AS events, COUNT(DISTINCT distinct_id) AS users
      FROM {source.split()[0]} WHERE {where}
      GROUP BY 1 ORDER BY events DESC, name LIMIT 20"""


@query("top_events", _top_sql(track(), IN_RANGE))
def _(spark, sf):
    return top_events.top_events(tables.track_events(spark, sf), START, END)


@query("top_events_daily", _top_sql(track(), IN_DAYS))
def _(spark, sf):
    daily = rollup.daily_rollup(tables.track_events(spark, sf))
    return top_events.top_events_daily(daily, START, END)


@query("top_events_hybrid", _top_sql(track(), IN_RANGE))
def _(spark, sf):
    track_rows = tables.track_events(spark, sf)
    return top_events.top_events_hybrid(track_rows, rollup.daily_rollup(track_rows), START, END)


@query("top_events_from_logs", _top_sql(logs(), f"level = 'event' AND distinct_id <> '' AND {IN_RANGE}", "message"))
def _(spark, sf):
    return top_events.top_events_from_logs(tables.track_logs(spark, sf), START, END)


@query("top_events_auto", _top_sql(track(), IN_RANGE))
def _(spark, sf):
    track_rows = tables.track_events(spark, sf)
    no_rollup = rollup.daily_rollup(track_rows.filter(F.lit(False)))
    return top_events.top_events_auto(no_rollup, track_rows, tables.track_logs(spark, sf), START, END)


@query("top_events_auto_rollup", _top_sql(track(), IN_DAYS))
def _(spark, sf):
    """The first source has rows, so it answers."""
    track_rows = tables.track_events(spark, sf)
    return top_events.top_events_auto(rollup.daily_rollup(track_rows), track_rows, tables.track_logs(spark, sf), START, END)


@query("top_events_stored", _top_sql(track(3), f"project_id = 2 AND {IN_RANGE}"))
def _(spark, sf):
    """Stored facts and a rollup that covers all days but two: raw folders are read for these and the edge days only."""
    path = run_dir(spark, "stored-top")
    facts.write_facts(tables.track_events(spark, sf, 3), f"{path}/track_events")
    for first, last in (("2024-01-01", "2024-01-09"), ("2024-01-12", "2024-01-31")):
        stored_rollup.refresh_rollup(spark, f"{path}/track_events", f"{path}/daily", 2, date.fromisoformat(first), date.fromisoformat(last))
    return stored_rollup.top_events_stored(spark, f"{path}/track_events", f"{path}/daily", 2, START, END)


@query("top_events_search", _top_sql(track(), f"name ILIKE '%CH%' AND {IN_RANGE}"))
def _(spark, sf):
    return top_events.top_events(tables.track_events(spark, sf), START, END, q="CH")


@query(
    "project_scope",
    f"""WITH {track(3)}
      SELECT project_id, COUNT(*) AS events, COUNT(DISTINCT distinct_id) AS users
      FROM track_events WHERE project_id = 2 AND {IN_RANGE} GROUP BY project_id""",
)
def _(spark, sf):
    from tidewell.functions.times import between

    rows = between(tables.track_events(spark, sf, 3).filter(F.col("project_id") == 2), START, END)
    return rows.groupBy(F.col("project_id").cast("bigint").alias("project_id")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("distinct_id").alias("users")
    )


def _funnel_sql(steps: list[str], source: str, name: str, within: str | None = None, extra: str = "TRUE") -> str:
    """The correlated definition: each step is the first row not before the previous step."""
    table = source.split()[0]
    parts = [
        f"""s1 AS (SELECT distinct_id, MIN(ts) AS t1 FROM base WHERE name = '{steps[0]}' GROUP BY distinct_id)"""
    ]
    for i in range(2, len(steps) + 1):
        bound = f" AND b.ts <= p.t1 + INTERVAL '{within}'" if within else ""
        earlier = "".join(f", p.t{j}" for j in range(1, i))
        parts.append(
            f"""s{i} AS (SELECT p.distinct_id{earlier}, MIN(b.ts) AS t{i}
              FROM s{i - 1} p LEFT JOIN base b ON b.distinct_id = p.distinct_id
                AND b.name = '{steps[i - 1]}' AND b.ts >= p.t{i - 1}{bound}
              GROUP BY p.distinct_id{earlier})"""
        )
    last = f"s{len(steps)}"
    rows = " UNION ALL ".join(
        f"SELECT {i} AS step_no, '{s}' AS step, (SELECT COUNT(t{i}) FROM {last}) AS users"
        for i, s in enumerate(steps, 1)
    )
    return f"""WITH {source},
      base AS (SELECT distinct_id, {name} AS name, ts FROM {table} WHERE {IN_RANGE} AND {extra}),
      {", ".join(parts)} SELECT CAST(step_no AS INTEGER) AS step_no, step, users FROM ({rows})"""


@query("funnel", _funnel_sql(STEPS, track(), "name"))
def _(spark, sf):
    return funnel.funnel(tables.track_events(spark, sf), STEPS, START, END)


@query("funnel_within", _funnel_sql(STEPS, track(), "name", "24 hours"))
def _(spark, sf):
    return funnel.funnel(tables.track_events(spark, sf), STEPS, START, END, DAY)


FOUR_STEPS = ["signup", "view", "click", "purchase"]


@query(
    "funnel_conversion",
    f"""SELECT step_no, step, users,
        round(CASE WHEN step_no = 1 THEN 1.0
          WHEN lag(users) OVER (ORDER BY step_no) > 0 THEN users / lag(users) OVER (ORDER BY step_no)
          ELSE 0.0 END, 6)::DOUBLE AS conversion,
        CASE WHEN step_no > 1 AND lag(users) OVER (ORDER BY step_no) > 0
          THEN lag(users) OVER (ORDER BY step_no) - users ELSE 0 END AS dropoff
      FROM ({_funnel_sql(FOUR_STEPS, track(), "name", "24 hours")})""",
)
def _(spark, sf):
    steps = funnel.funnel(tables.track_events(spark, sf), FOUR_STEPS, START, END, DAY)
    return funnel.with_conversion(steps).withColumn("conversion", F.round("conversion", 6))


@query("funnel_steps_clean", _funnel_sql(["view", "Purchase", "error"], track(), "name", "24 hours"))
def _(spark, sf):
    raw = " view ,, VIEW,Purchase,purchase , error"
    return funnel.funnel(tables.track_events(spark, sf), funnel.clean_steps(raw, 8, 200), START, END, DAY)


@query("funnel_source", _funnel_sql(STEPS, logs(), "message", "24 hours", "level = 'event' AND distinct_id <> ''"))
def _(spark, sf):
    track_rows, log_rows = tables.track_events(spark, sf), tables.track_logs(spark, sf)
    no_match = track_rows.filter(~F.col("name").isin(STEPS))
    rows, _ = funnel.funnel_source(no_match, log_rows, STEPS, START, END)
    return funnel.funnel(rows, STEPS, START, END, DAY)


@query("funnel_source_track", _funnel_sql(STEPS, track(), "name", "24 hours"))
def _(spark, sf):
    """The first source has the steps, so it answers."""
    rows, _ = funnel.funnel_source(tables.track_events(spark, sf), tables.track_logs(spark, sf), STEPS, START, END)
    return funnel.funnel(rows, STEPS, START, END, DAY)


@query("funnel_guard", _funnel_sql(STEPS, track(), "name", "24 hours"))
def _(spark, sf):
    longest = timedelta(days=31)
    return funnel.funnel(tables.track_events(spark, sf), STEPS, START, END, DAY, now=NOW, retention_days=30, longest=longest)


SEEN = f"""WITH {track(3)}, {logs(3)}, seen AS (
      SELECT distinct_id, MIN(ts) AS first_ts FROM (
        SELECT project_id, distinct_id, ts FROM logs UNION ALL
        SELECT project_id, distinct_id, ts FROM track_events)
      WHERE project_id = 2 AND distinct_id <> '' GROUP BY distinct_id)"""
GROWTH = f"""SELECT {day('first_ts')} AS day, COUNT(*) AS new_users FROM seen
      WHERE first_ts >= TIMESTAMP '2024-01-01' AND first_ts <= TIMESTAMP '{END}' GROUP BY 1"""


def _seen(spark, sf):
    own = F.col("project_id") == 2
    return growth.first_seen(
        tables.track_logs(spark, sf, 3).filter(own), tables.track_events(spark, sf, 3).filter(own)
    )


@query("user_growth", f"{SEEN} {GROWTH}")
def _(spark, sf):
    return growth.user_growth(_seen(spark, sf), "2024-01-01 00:00:00", END)


@query("total_users", f"{SEEN} SELECT COUNT(*) AS total_users FROM seen")
def _(spark, sf):
    return growth.total_users(_seen(spark, sf))


@query(
    "user_growth_cumulative",
    f"""{SEEN} SELECT day, new_users,
        CAST(SUM(new_users) OVER (ORDER BY day) AS BIGINT) AS cumulative_users FROM ({GROWTH})""",
)
def _(spark, sf):
    return growth.cumulative(growth.user_growth(_seen(spark, sf), "2024-01-01 00:00:00", END))


ACTIVITY = f"""WITH {errors()}, {logs()}, activity AS (
      SELECT 'event' AS kind, ts, level, distinct_id, device_id FROM error_events WHERE level = 'error'
      UNION ALL
      SELECT 'log', ts, level, distinct_id, device_id FROM logs WHERE message <> 'error')"""
CALENDAR = """calendar AS (
      SELECT strftime(generate_series, '%Y-%m-%d') AS day
      FROM generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY))"""


def _activity(spark, sf):
    """Error events, and the other events as logs."""
    return active.activity(
        tables.error_events(spark, sf).filter(F.col("level") == "error"),
        tables.track_logs(spark, sf).filter(F.col("message") != "error"),
    )


FIRST, LAST = "2023-12-30 10:00:00", "2024-02-02 09:00:00"


def _active_sql(who: str) -> str:
    return f"""{ACTIVITY}, {CALENDAR}
      SELECT c.day, COUNT(DISTINCT {who}) AS active
      FROM calendar c LEFT JOIN activity a ON {day('a.ts')} = c.day GROUP BY c.day"""


# Three standard errors of a sketch with 4096 registers.
SKETCH_ERROR = 0.05


def close_to(estimates, exact, keys: list[str], value: str, of: str | None = None, share: float = SKETCH_ERROR):
    """The exact rows with `close`: the estimate is there and off by at most a share of the count (or of `of`), plus 1."""
    both = exact.join(estimates.withColumnRenamed(value, "_estimate"), keys, "full")
    near = F.abs(F.col("_estimate") - F.col(value)) <= F.col(of or value) * share + 1
    return both.withColumn("close", F.coalesce(near, F.lit(False))).drop("_estimate")


@query("dau", _active_sql("distinct_id"))
def _(spark, sf):
    return active.active_by_day(_activity(spark, sf), FIRST, LAST)


@query("active_devices", _active_sql("device_id"))
def _(spark, sf):
    return active.active_by_day(_activity(spark, sf), FIRST, LAST, "device_id")


@query(
    "mau",
    f"""{ACTIVITY}, {CALENDAR}, months AS (SELECT DISTINCT left(day, 7) AS month FROM calendar)
      SELECT m.month, COUNT(DISTINCT distinct_id) AS active
      FROM months m LEFT JOIN activity a ON strftime(a.ts, '%Y-%m') = m.month GROUP BY m.month""",
)
def _(spark, sf):
    return active.active_by_month(_activity(spark, sf), FIRST, LAST)


COUNTS = """COUNT(*) FILTER (kind = 'log') AS logs, COUNT(*) FILTER (kind = 'event') AS events"""


@query(
    "metrics_today",
    f"""{ACTIVITY} SELECT {COUNTS},
        COUNT(*) FILTER (kind = 'event' AND level IN ('error', 'fatal')) AS errors,
        COUNT(DISTINCT distinct_id) AS users
      FROM activity WHERE {day('ts')} = '2024-01-10'""",
)
def _(spark, sf):
    return active.metrics_today(_activity(spark, sf), "2024-01-10 15:00:00")


@query("metrics_total", f"{ACTIVITY} SELECT {COUNTS}, COUNT(DISTINCT distinct_id) AS users FROM activity")
def _(spark, sf):
    return active.metrics_total(_activity(spark, sf))


@query(
    "dau_approx",
    f"""{ACTIVITY} SELECT {day('ts')} AS day, COUNT(DISTINCT distinct_id) AS active, TRUE AS close
      FROM activity WHERE distinct_id <> '' GROUP BY 1""",
)
def _(spark, sf):
    """The exact count of each day, and whether the sketch's estimate is close to it."""
    rows = _activity(spark, sf)
    exact = rows.filter("distinct_id <> ''").groupBy(day_key(F.col("ts")).alias("day"))
    exact = exact.agg(F.count_distinct("distinct_id").alias("active"))
    return close_to(active.active_from_sketches(active.daily_sketches(rows)), exact, ["day"], "active")


@query("metrics_total_approx", f"{ACTIVITY} SELECT COUNT(DISTINCT distinct_id) AS users, TRUE AS close FROM activity WHERE distinct_id <> ''")
def _(spark, sf):
    rows = _activity(spark, sf)
    exact = rows.filter("distinct_id <> ''").agg(F.count_distinct("distinct_id").alias("users"))
    total = active.total_from_sketches(active.daily_sketches(rows)).toDF("users")
    return close_to(total.withColumn("k", F.lit(0)), exact.withColumn("k", F.lit(0)), ["k"], "users").drop("k")


ENRICHED = f"""WITH {errors()}, {GEO}, enriched AS (
      SELECT e.*, g.country, g.region, g.city, g.asn_org
      FROM error_events e LEFT JOIN geo_ranges g ON e.ip BETWEEN g.lo AND g.hi)"""
PAIRS = """pairs AS (
      UNPIVOT (SELECT ts, os, browser, country, region, city, asn_org FROM enriched)
      ON os, browser, country, region, city, asn_org INTO NAME dim VALUE key)"""


def _enriched(spark, sf):
    return distribution.geo_enrich(tables.error_events(spark, sf), tables.geo_ranges(spark, sf))


@query("geo_enrich", f"{ENRICHED} SELECT id, country, region, city, asn_org FROM enriched")
def _(spark, sf):
    return _enriched(spark, sf).select("id", "country", "region", "city", "asn_org")


ADDRESSES = """addresses AS (
      SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN '' WHEN 3 THEN 'v4' ELSE 'v6' END AS kind, user_id % 97 AS a, user_id % 200 AS b FROM events)"""


@query(
    "locate_addresses",
    f"""WITH {ADDRESSES}, named AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS city FROM nation)
      SELECT x.id, CASE WHEN kind = 'v4' AND b < 25 THEN 'v4 ' || n.city WHEN kind = 'v6' AND a >= 25 THEN 'rest'
          WHEN kind = 'v6' AND b % 2 = 1 THEN 'odd ' || n.city WHEN kind = 'v6' THEN n.city END AS place
      FROM addresses x LEFT JOIN named n ON n.k = CASE WHEN kind = 'v4' THEN b ELSE a END""",
)
def _(spark, sf):
    """IPv4 and IPv6 addresses against nested ranges: one wide range, one per nation inside it, and one inside each of these."""
    user = F.col("user_id")
    a, b = (F.lower(F.hex(user % n)) for n in (97, 200))
    ip = (
        F.when(user % 4 == 1, F.concat(F.lit("2001:DB8:"), a, F.lit(":"), (user % 200 % 2).cast("string"), F.lit("::"), b))
        .when(user % 4 == 2, F.concat(F.lit("2001:db8:"), a, F.lit(":"), (user % 200 % 2).cast("string"), F.lit(":0:0:0:"), b))
        .when(user % 4 == 3, F.concat(F.lit("10."), (user % 200).cast("string"), F.lit(".0.7")))
        .otherwise("no address")
    )
    rows = tables.load(spark, sf, "events").select(F.col("event_id").alias("id"), ip.alias("client_ip"))
    nation, key = tables.load(spark, sf, "nation"), F.col("n_nationkey")
    six, four = F.lower(F.hex(key)), key.cast("string")

    def ranges(low, high, place):
        return nation.select(F.concat(*low).alias("lo"), F.concat(*high).alias("hi"), F.concat(*place).alias("place"))

    head, last, v4 = F.lit("2001:db8:"), F.lit(":ffff:ffff:ffff:ffff:ffff"), F.lit("10.")
    all_ranges = (
        nation.limit(1).select(F.lit("2001:db8::").alias("lo"), F.lit("2001:db8:ffff:ffff:ffff:ffff:ffff:ffff").alias("hi"), F.lit("rest").alias("place"))
        .unionByName(ranges([head, six, F.lit("::")], [head, six, last], [F.col("n_name")]))
        .unionByName(ranges([head, six, F.lit(":1::")], [head, six, F.lit(":1:ffff:ffff:ffff:ffff")], [F.lit("odd "), F.col("n_name")]))
        .unionByName(ranges([v4, four, F.lit(".0.0")], [v4, four, F.lit(".255.255")], [F.lit("v4 "), F.col("n_name")]))
    )
    return addresses.locate(rows, all_ranges).select("id", "place")


@query(
    "fan_out_dims",
    f"{ENRICHED}, {PAIRS} SELECT {day('ts')} AS day, dim, key, COUNT(*) AS count FROM pairs GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return distribution.daily_dims(distribution.fan_out_dims(_enriched(spark, sf)))


DIST = f"""SELECT key, COUNT(*) AS count FROM pairs WHERE dim = 'country' AND {IN_DAYS}
      GROUP BY key ORDER BY count DESC, key LIMIT 10"""


def _distribution(spark, sf):
    daily = distribution.daily_dims(distribution.fan_out_dims(_enriched(spark, sf)))
    return distribution.distribution(daily, "country", START, END)


@query("distribution", f"{ENRICHED}, {PAIRS} {DIST}")
def _(spark, sf):
    return _distribution(spark, sf)


@query(
    "distribution_share",
    f"""{ENRICHED}, {PAIRS} SELECT key, count,
        CAST(round(100.0 * count / MAX(count) OVER ()) AS BIGINT) AS share FROM ({DIST})""",
)
def _(spark, sf):
    return distribution.with_share(_distribution(spark, sf))


RETENTION = f"""{ACTIVITY}, {CALENDAR}, days AS (
      SELECT DISTINCT distinct_id, CAST(ts AS DATE) AS d FROM activity WHERE distinct_id <> ''),
    cohorts AS (
      SELECT c.day AS cohort, k.day AS day, COUNT(a.distinct_id) AS cohort_size, COUNT(b.distinct_id) AS active
      FROM calendar c CROSS JOIN (VALUES (1), (3), (7), (40)) k(day)
      LEFT JOIN days a ON a.d = CAST(c.day AS DATE)
      LEFT JOIN days b ON b.distinct_id = a.distinct_id AND b.d = a.d + k.day
      GROUP BY c.day, k.day)
    SELECT cohort, CAST(day AS INTEGER) AS day, cohort_size, active,
      round(CASE WHEN cohort_size > 0 THEN active / cohort_size ELSE 0 END, 6)::DOUBLE AS rate FROM cohorts"""


@query("retention", RETENTION)
def _(spark, sf):
    found = retention.retention(_activity(spark, sf), FIRST, LAST, [7, 1, 3, 40, 7, 0])
    return found.withColumn("rate", F.round("rate", 6))


@query("retention_approx", f"SELECT cohort, day, active, cohort_size, TRUE AS close FROM ({RETENTION}) WHERE day <> 40")
def _(spark, sf):
    """The exact points, and whether the sketches' estimates are close; errors grow with the cohort."""
    rows = _activity(spark, sf)
    exact = retention.retention(rows, FIRST, LAST, [1, 3, 7]).select("cohort", "day", "active", "cohort_size")
    found = retention.retention_approx(rows, FIRST, LAST, [1, 3, 7]).select("cohort", "day", "active")
    return close_to(found, exact, ["cohort", "day"], "active", of="cohort_size", share=3 * SKETCH_ERROR)


def _custom_sql(bucket: str, event: str, prop: str, where: str = "TRUE") -> str:
    return f"""WITH {logs()}
      SELECT {bucket} AS bucket, {event} AS event_name, {prop} AS prop_value,
             COUNT(*) AS events, COUNT(DISTINCT distinct_id) AS users
      FROM logs WHERE level = 'event' AND {IN_RANGE} AND {where} GROUP BY 1, 2, 3"""


def _ask(group_by: list[str], metric: str = "count_events", granularity: str = "day", **more):
    request = {
        "analysis_type": "event",
        "time_range": {"start": "2024-01-05T06:00:00Z", "end": "2024-01-20T18:30:00Z", "granularity": granularity},
        "metric": {"type": metric},
        "group_by": group_by,
        **more,
    }
    return custom.parse_request(request, NOW)


PROP = "json_extract_string(fields, '$.k')"


@query("custom_events", _custom_sql(day("ts"), "message", "''"))
def _(spark, sf):
    return custom.custom_events(tables.track_logs(spark, sf), _ask(["time", "event"]))


@query("custom_by_property", _custom_sql("'all'", "message", f"coalesce({PROP}, '')"))
def _(spark, sf):
    return custom.custom_events(tables.track_logs(spark, sf), _ask(["event", "Property:K"]))


FILTERED = f"message IN ('view', 'click', 'purchase') AND {PROP} IN ('1', '2', '3', '5', '8')"


@query("custom_filters", _custom_sql("strftime(ts, '%Y-%m')", "''", "''", FILTERED))
def _(spark, sf):
    ask = _ask(
        ["time"], granularity="month",
        target={"events": ["view", " click "]},
        filter={"events": ["purchase"], "properties": {"k": {"values": ["1", "2", "3", "5", "8"]}, "z": {"values": []}}},
    )
    return custom.custom_events(tables.track_logs(spark, sf), ask)


WEEK = day("date_trunc('week', ts)")


@query(
    "custom_series",
    f"""WITH points AS ({_custom_sql(WEEK, "message", "''")})
      SELECT 'event=' || event_name AS series, event_name AS name, bucket, users AS value,
        CAST(SUM(users) OVER (PARTITION BY event_name) AS BIGINT) AS total FROM points""",
)
def _(spark, sf):
    ask = _ask(["event", "time"], "count_users", "week")
    return custom.custom_series(custom.custom_events(tables.track_logs(spark, sf), ask), ask)


@query(
    "time_bucket",
    f"""WITH {logs()} SELECT {day('ts')} AS day_bucket, {WEEK} AS week_bucket,
        strftime(ts, '%Y-%m') AS month_bucket, 'all' AS no_bucket, COUNT(*) AS n FROM logs GROUP BY ALL""",
)
def _(spark, sf):
    ts = F.col("ts")
    return (
        tables.track_logs(spark, sf)
        .groupBy(
            bucket_key(ts, "day").alias("day_bucket"),
            bucket_key(ts, "week").alias("week_bucket"),
            bucket_key(ts, "month").alias("month_bucket"),
            bucket_key(ts, None).alias("no_bucket"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "label_events",
    f"""WITH {track()}, labels_of AS (
        SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' ELSE 'x' || n_nationkey END AS name,
               n_name AS display_name, 'cat' || n_regionkey AS category FROM nation)
      SELECT t.name, coalesce(l.display_name, t.name) AS display_name, l.category, COUNT(*) AS events
      FROM track_events t LEFT JOIN labels_of l ON l.name = t.name GROUP BY ALL""",
)
def _(spark, sf):
    nations = tables.load(spark, sf, "nation")
    key = F.col("n_nationkey")
    declared = nations.select(
        F.when(key == 0, "view").when(key == 1, "click").when(key == 2, "signup").otherwise(F.concat(F.lit("x"), key)).alias("name"),
        F.col("n_name").alias("display_name"),
        F.concat(F.lit("cat"), F.col("n_regionkey").cast("string")).alias("category"),
    )
    counts = tables.track_events(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("events"))
    return definitions.label_events(counts, declared)


@query(
    "property_conformance",
    f"""WITH {logs()} SELECT CASE WHEN {PROP} IN ('1', '2', '3') THEN {PROP} ELSE 'unknown' END AS value,
        COUNT(*) AS events FROM logs GROUP BY 1""",
)
def _(spark, sf):
    return definitions.enum_conformance(tables.track_logs(spark, sf), "k", ["1", "2", "3"])


@query(
    "property_conformance_numbers",
    f"""WITH {logs()}, v AS (SELECT CASE WHEN message = 'error' THEN 'n/a' ELSE {PROP} END AS v FROM logs)
      SELECT COUNT(TRY_CAST(v AS DOUBLE)) AS numeric_values,
        COUNT(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS ignored_values,
        SUM(TRY_CAST(v AS DOUBLE)) AS sum_value FROM v""",
)
def _(spark, sf):
    rows = tables.track_logs(spark, sf).withColumn(
        "fields", F.when(F.col("message") == "error", '{"k":"n/a"}').otherwise(F.col("fields"))
    )
    return definitions.number_conformance(rows, "k")


@query(
    "run_saved_view",
    f"""WITH points AS ({_custom_sql(day('ts'), "''", "''", "message = 'purchase'")})
      SELECT 'all' AS series, 'all' AS name, bucket, events AS value,
        CAST(SUM(events) OVER () AS BIGINT) AS total FROM points""",
)
def _(spark, sf):
    ask = (
        '{"analysis_type":"event","time_range":{"start":"2024-01-05T06:00:00Z","end":"2024-01-20T18:30:00Z"},'
        '"filter":{"events":["purchase"]}}'
    )
    views = spark.createDataFrame([(1, "purchases", ask)], "id int, name string, query string")
    return definitions.run_saved_view(views, 1, tables.track_logs(spark, sf), NOW)

"""Registered queries: the streaming jobs, each run over what its source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.registry import Tables, query
from fleetlens.session import fresh_path
from fleetlens.streaming import jobs
from fleetlens.streaming.sinks import counted, kept_and_late, on_clock, read_stream, run_append, run_update, update_run


def plain_time(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("R1_desired_changes", """
SELECT event_id, user_id, ts, event_type FROM (
  SELECT *, lag(event_type) OVER w AS was, lag(event_id) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE prev IS NULL OR event_type IS DISTINCT FROM was
""")
def desired_changes(t: Tables) -> DataFrame:
    stream = read_stream(t.spark, t.path("events")).select("event_id", "user_id", "ts", "event_type")
    return jobs.desired_changes(stream, "user_id", ["ts", "event_id"], ["event_type"])


@query("R2_drift_stream", """
WITH obs AS (SELECT o_custkey AS c_custkey, CASE WHEN o_totalprice > 250000 THEN 'gold' ELSE 'base' END AS tier FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
want AS (SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'base' END AS tier FROM customer)
SELECT o.c_custkey, CASE WHEN w.tier IS NULL THEN 'delete' WHEN w.tier <> o.tier THEN 'update' ELSE 'noop' END AS action,
       CASE WHEN w.tier <> o.tier THEN 'tier' ELSE '' END AS changed
FROM obs o LEFT JOIN want w USING (c_custkey)
""")
def drift(t: Tables) -> DataFrame:
    return drift_plan(t)[0].drop("batch")


def drift_plan(t: Tables) -> tuple[DataFrame, DataFrame]:
    observed = read_stream(t.spark, t.path("orders")).select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.when(F.col("o_totalprice") > 250000, "gold").otherwise("base").alias("tier")
    )
    key = F.when(F.col("c_mktsegment") == "FURNITURE", -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    desired = t.customer.select(
        key.alias("c_custkey"), F.when(F.col("c_acctbal") > 5000, "gold").otherwise("base").alias("tier")
    )
    return jobs.drift_stream(observed, desired, "c_custkey", ["o_orderdate", "o_orderkey"], ["tier"]), desired


@query("R2_never_observed", """
WITH want AS (SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN -c_custkey ELSE c_custkey END AS c_custkey FROM customer)
SELECT c_custkey, 'create' AS action FROM want WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def never_observed(t: Tables) -> DataFrame:
    """Wanted customers that no batch of orders has seen."""
    plan, desired = drift_plan(t)
    return jobs.never_observed(plan, desired, "c_custkey")


@query("R3_presence", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER w AS prev, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
silent AS (SELECT max(ts) - INTERVAL 6 HOUR AS since FROM events),
starts AS (SELECT user_id, ts AS began, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS newest FROM p WHERE prev IS NULL OR ts > prev + INTERVAL 6 HOUR),
ends AS (SELECT user_id, max(ts) >= (SELECT since FROM silent) AS lasts FROM events GROUP BY user_id)
SELECT user_id, 'online' AS state, began AS at, newest AND lasts AS open FROM starts JOIN ends USING (user_id)
UNION ALL
SELECT user_id, 'offline', ts + INTERVAL 6 HOUR, false FROM p WHERE next > ts + INTERVAL 6 HOUR OR (next IS NULL AND ts < (SELECT since FROM silent))
""")
def presence(t: Tables) -> DataFrame:
    """Presence over all events, the boards that are still online at their end included."""
    spans = jobs.activity_spans(read_stream(t.spark, t.path("events")).select("user_id", "ts"), "user_id", "ts", 3600)
    return plain_time(jobs.presence(spans, "user_id", 6 * 3600, "10 minutes")[0], "at")


@query("R3_last_states", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM p)
SELECT user_id, min(ts) AS since, max(ts) AS last FROM s GROUP BY user_id, no HAVING max(ts) >= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)
""")
def last_states(t: Tables) -> DataFrame:
    """Presence in two runs: the second goes on from the table of last states that the first has left."""
    events = t.events.select("user_id", "ts")
    middle = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("m")).scalar()
    states = None
    for i, part in enumerate((events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle))):
        path = fresh_path(t.spark, f"half-{i}")
        part.write.parquet(path)
        spans = jobs.activity_spans(read_stream(t.spark, path, schema=events.schema), "user_id", "ts", 3600)
        _, states = jobs.presence(spans, "user_id", 6 * 3600, "10 minutes", states)
    return states.select("user_id", *[F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("since", "last")])


@query("R4_telemetry_windows", """
SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end,
       count(value) AS n, min(value) AS low, max(value) AS high, CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2, 3
""")
def windows(t: Tables) -> DataFrame:
    stream = on_clock(read_stream(t.spark, t.path("events")), "ts", "10 minutes")
    rows = run_update(jobs.telemetry_windows(stream, ["event_type"], "ts", "value", "1 day"), ["event_type", "window_start"], "windows")
    return plain_time(rows, "window_start", "window_end")


@query("R4_sliding_windows", """
SELECT event_type, w AS window_start, count(*) AS n FROM (
  SELECT event_type, unnest([CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 12 HOUR * s FOR s IN [-1, 0, 1]]) AS w, ts FROM events)
WHERE ts >= w AND ts < w + INTERVAL 1 DAY GROUP BY 1, 2
""")
def sliding(t: Tables) -> DataFrame:
    stream = on_clock(read_stream(t.spark, t.path("events")), "ts", "10 minutes")
    rows = run_update(jobs.telemetry_windows(stream, ["event_type"], "ts", "value", "1 day", "12 hours"), ["event_type", "window_start"], "sliding")
    return plain_time(rows, "window_start").select("event_type", "window_start", "n")


@query("R5_activity_sessions", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM p)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events,
       max(ts) + INTERVAL 30 MINUTE >= (SELECT max(ts) FROM events) AS open
FROM s GROUP BY user_id, no
""")
def activity(t: Tables) -> DataFrame:
    """All sessions, those that could still go on marked."""
    spans = jobs.activity_spans(read_stream(t.spark, t.path("events")).select("user_id", "ts"), "user_id", "ts", 1800)
    return plain_time(jobs.activity_sessions(spans, "user_id", 1800, "10 minutes"), "session_start", "session_end")


@query("R4_late_rows", """
WITH clock AS (SELECT max(ts) - INTERVAL 10 DAY AS mark FROM events WHERE event_id % 3 = 0),
s AS (SELECT event_id % 3 < 2 OR date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT mark FROM clock) AS taken FROM events)
SELECT count(*) AS read, count(*) FILTER (WHERE taken) AS kept, count(*) FILTER (WHERE NOT taken) AS late FROM s
""")
def late_rows(t: Tables) -> DataFrame:
    """Events in three files, by their number modulo 3: of the third those are late, and counted, whose windows the
    watermark of the first had closed when the second was read."""
    path = fresh_path(t.spark, "three-files")
    events = t.events.select("event_id", "event_type", "ts", "value")
    for rest in range(3):
        events.where(F.col("event_id") % 3 == rest).coalesce(1).write.mode("append").parquet(path)
    stream = on_clock(counted(read_stream(t.spark, path, 1, events.schema)), "ts", "10 days")
    rows, ended = update_run(jobs.rate_counts(stream, ["event_type"], "ts", "1 day"), ["event_type", "window_start"], "late")
    return kept_and_late(rows, ended, "n")


@query("R6_event_dedup", "SELECT event_id, user_id, ts, event_type FROM events")
def dedup(t: Tables) -> DataFrame:
    """Every event sent twice comes out once."""
    stream = read_stream(t.spark, t.path("events")).select("event_id", "user_id", "ts", "event_type")
    doubled = on_clock(stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy"), "ts", "10 minutes")
    return plain_time(run_append(jobs.event_dedup(doubled, ["event_id"]), "dedup"), "ts")


@query("R7_request_result_stream", """
SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM orders LEFT JOIN lineitem
  ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY
""")
def request_results(t: Tables) -> DataFrame:
    """All answers within 30 days, and all requests without one."""
    requests = on_clock(read_stream(t.spark, t.path("orders")).select("o_orderkey", "o_orderdate"), "o_orderdate", "1 day")
    results = on_clock(
        read_stream(t.spark, t.path("lineitem")).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate"), "l_shipdate", "1 day"
    )
    joined = run_append(jobs.request_result_stream(requests, results, "o_orderkey", "o_orderdate", "l_shipdate", "30 DAYS"), "answers")
    asked = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return plain_time(jobs.with_open(joined, asked, "o_orderkey", "o_orderdate"), "o_orderdate", "l_shipdate")


@query("R7_request_states", """
WITH clock AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS now),
met AS (
  SELECT o_orderkey, o_orderdate, min(l_shipdate) AS first_answer, count(l_shipdate) AS answers FROM orders LEFT JOIN lineitem
    ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY ALL)
SELECT o_orderkey, o_orderdate, CASE WHEN answers > 0 THEN 'answered' WHEN o_orderdate + INTERVAL 30 DAY < now THEN 'expired' ELSE 'open' END AS state,
       first_answer, answers
FROM met, clock
""")
def request_states(t: Tables) -> DataFrame:
    """Every order once, by whether a line answered it within 30 days."""
    requests = read_stream(t.spark, t.path("orders")).select("o_orderkey", "o_orderdate")
    results = read_stream(t.spark, t.path("lineitem")).select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    states = jobs.request_states(requests, results, "o_orderkey", "o_orderdate", "l_shipdate", 30 * 86400, "1 day")
    return plain_time(states, "o_orderdate", "first_answer")


@query("R8_rate_alarm", """
SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 70
""")
def alarm(t: Tables) -> DataFrame:
    stream = on_clock(read_stream(t.spark, t.path("events")).select("event_type", "ts"), "ts", "10 minutes")
    counts = run_update(jobs.rate_counts(stream, ["event_type"], "ts", "1 day"), ["event_type", "window_start"], "rates")
    return plain_time(jobs.rate_alarm(counts, 70), "window_start")

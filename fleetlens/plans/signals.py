"""Registered queries: logs, references, telemetry and workers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import day_bucket
from fleetlens.operators import logs, telemetry
from fleetlens.operators.worker import worker_map, worker_outcomes, worker_slices
from fleetlens.plans.bindings import K_SQL, LINES_SQL, reading_k, run_lines
from fleetlens.plans.registry import Tables, query
from fleetlens.sources.scans import text_lines


@query("T1_classify_lines", f"""
WITH {LINES_SQL}
SELECT run_id, line_no, line, CASE WHEN line LIKE '[INFO]%' THEN 'INFO' WHEN line LIKE '[OK]%' THEN 'OK' WHEN line LIKE 'ERROR %' THEN 'ERROR' ELSE 'plain' END AS level
FROM lines
""")
def classify(t: Tables) -> DataFrame:
    return logs.classify_lines(run_lines(t))


@query("T2_step_outcomes", f"""
WITH {LINES_SQL}, marks AS (
  SELECT run_id, line_no, regexp_extract(line, 'step [0-9]+') AS title, line LIKE '[INFO] ===%' AS opens FROM lines
  WHERE line LIKE '[INFO] ===%' OR line LIKE '[OK] step%'),
numbered AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, title ORDER BY line_no) AS occurrence FROM marks)
SELECT run_id, title, CAST(occurrence AS BIGINT) AS occurrence, min(CASE WHEN opens THEN line_no END) AS start_line,
       min(CASE WHEN NOT opens THEN line_no END) AS end_line, count(*) FILTER (WHERE NOT opens) > 0 AS finished
FROM numbered WHERE occurrence > 0 GROUP BY run_id, title, occurrence
""")
def steps(t: Tables) -> DataFrame:
    return logs.step_outcomes(run_lines(t))


@query("T3_run_summary", f"""
WITH {LINES_SQL}
SELECT run_id, count(*) FILTER (WHERE line LIKE '[INFO] === %') AS started, count(*) FILTER (WHERE line LIKE '[OK] step%') AS finished,
       max(CAST(nullif(regexp_extract(line, 'Board totali: ([0-9]+)', 1), '') AS INTEGER)) AS boards_total,
       max(CAST(nullif(regexp_extract(line, 'Board online: ([0-9]+)', 1), '') AS INTEGER)) AS boards_online,
       max(CAST(nullif(regexp_extract(line, 'compilati: ([0-9]+)', 1), '') AS INTEGER)) AS compiled,
       bool_or(line LIKE '[OK] Suite%') AS completed, count(*) FILTER (WHERE line LIKE '  Board totali%') AS listed,
       max(CASE WHEN line LIKE '  Board totali%' THEN 60 * (line_no // 60 % 60) + line_no % 60 END) AS oldest_s
FROM lines GROUP BY run_id
""")
def summary(t: Tables) -> DataFrame:
    """Runs in which the lines that count boards also name an age."""
    age = F.concat(F.lit("   "), F.floor(F.col("line_no") / 60) % 60, F.lit("m"), F.col("line_no") % 60, F.lit("s"))
    listing = F.col("line").startswith("  Board totali")
    return logs.run_summary(run_lines(t).withColumn("line", F.when(listing, F.concat("line", age)).otherwise(F.col("line"))))


@query("T4_poll_attempts", f"""
WITH {LINES_SQL}
SELECT run_id, line_no, CAST(regexp_extract(line, '\\[([0-9]+)/', 1) AS INTEGER) AS attempt, 12 AS attempts,
       line LIKE '%Ready: True%' AS ready, line LIKE '%Synced: True%' AS synced
FROM lines WHERE line LIKE '%/12] Ready:%'
""")
def polls(t: Tables) -> DataFrame:
    return logs.poll_attempts(run_lines(t))


@query("T5_error_signatures", f"""
WITH {LINES_SQL}
SELECT regexp_replace(line, '[0-9]+', '<n>', 'g') AS signature, count(*) AS lines, count(DISTINCT run_id) AS runs FROM lines WHERE line LIKE 'ERROR %' GROUP BY 1
""")
def errors(t: Tables) -> DataFrame:
    return logs.error_signatures(run_lines(t))


@query("T5_url_signatures", """
SELECT regexp_replace(trim(url), '[0-9]+', '<n>', 'g') AS signature, count(*) AS lines, count(DISTINCT page_id) AS runs FROM pages GROUP BY 1
""")
def url_signatures(t: Tables) -> DataFrame:
    return logs.signature_counts(t.pages, "url", "page_id")


@query("T6_reference_inventory", """
WITH found AS (SELECT DISTINCT trim(regexp_replace(h, '["'',]$', '')) AS source FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)),
named AS (
  SELECT source, regexp_extract(source, ':([^/:]+)$', 1) AS tag,
         regexp_replace(regexp_replace(regexp_replace(source, ':[^/:]+$', ''), '^([^/]*[.:][^/]*|localhost)/', ''), '^[^/]*/', '') AS base FROM found WHERE source <> ''),
targets AS (SELECT source, 'docker.io/fleet/' || regexp_replace(translate(base, '/:@', '---'), '[^A-Za-z0-9._-]', '', 'g') || ':'
  || CASE WHEN tag <> '' THEN tag ELSE 'latest' END AS target FROM named)
SELECT source, target, row_number() OVER (PARTITION BY target ORDER BY source) = 1 AS kept FROM targets
""")
def references(t: Tables) -> DataFrame:
    return logs.reference_inventory(logs.extract_references(t.pages, "html", ['href="([^"]+)"']), "fleet")


@query("T7_endpoint_inventory", """
SELECT CASE WHEN url LIKE 'https://%' THEN 'https' ELSE 'http' END AS scheme, regexp_extract(url, '^(?:https?://)?([^:/?#]*)', 1) AS host, count(*) AS endpoints
FROM pages GROUP BY 1, 2
""")
def endpoints(t: Tables) -> DataFrame:
    return logs.endpoint_inventory(t.pages, "url")


@query("T8_line_filter", """
SELECT doc_id AS run_id, CAST(i AS INTEGER) AS line_no, parts[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, generate_series(1, len(parts)) AS g(i)
WHERE lower(parts[i]) LIKE '%license%' OR lower(parts[i]) LIKE '%copyright%'
""")
def line_filter(t: Tables) -> DataFrame:
    return logs.line_filter(text_lines(t.documents, "doc_id", "text"), ["License", "Copyright"])


@query("M1_telemetry_extract", f"""
SELECT user_id AS run_id, event_id AS line_no, event_id AS seq, epoch_us(ts) / 1000000.0 AS "timestamp", value AS temperature, NULL::DOUBLE AS humidity, NULL::DOUBLE AS pressure,
       NULL::DOUBLE AS wind_speed, {K_SQL} AS wind_direction
FROM events WHERE event_type <> 'error'
""")
def extract(t: Tables) -> DataFrame:
    """Readings written into log lines and taken out again; error lines hold none."""
    body = F.to_json(F.struct(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("timestamp"), F.col("value").alias("temperature"),
        reading_k().alias("wind_direction"),
    ))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("lost #"), "event_id")).otherwise(
        F.concat(F.lit("Environmental Data #"), "event_id", F.lit(": "), body)
    )
    return telemetry.telemetry_extract(t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("M2_sensor_rollup", f"""
WITH e AS (SELECT event_type, date_trunc('day', ts) AS bucket, value, {K_SQL} AS k FROM events), m AS (
  SELECT event_type, bucket, 'value' AS metric, value AS v FROM e UNION ALL SELECT event_type, bucket, 'k', CAST(k AS DOUBLE) FROM e)
SELECT event_type, CAST(bucket AS TIMESTAMP) AS bucket, metric, count(*) AS n, min(v) AS low, max(v) AS high,
       round(avg(v), 6) AS mean
FROM m GROUP BY 1, 2, 3
""")
def rollup(t: Tables) -> DataFrame:
    readings = t.events.select("event_type", "ts", "value", reading_k().cast("double").alias("k"))
    return telemetry.sensor_rollup(readings, ["event_type"], ["value", "k"], "ts", "1 day").withColumn("mean", F.round("mean", 6))


@query("M3_range_check", f"""
WITH e AS (SELECT event_id, value, CAST({K_SQL} AS DOUBLE) AS k FROM events)
SELECT event_id, 'value' AS metric, value, 1.0::DOUBLE AS low, 100.0::DOUBLE AS high FROM e WHERE value < 1 OR value > 100
UNION ALL SELECT event_id, 'k', k, 5.0::DOUBLE, 90.0::DOUBLE FROM e WHERE k < 5 OR k > 90
""")
def ranges(t: Tables) -> DataFrame:
    return telemetry.range_check(t.events.select("event_id", "value", reading_k().alias("k")), ["event_id"], {"value": (1.0, 100.0), "k": (5.0, 90.0)})


@query("M4_gap_report", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, prev AS gap_from, ts AS gap_to, (epoch_us(ts) - epoch_us(prev)) // 1000000 AS gap_seconds FROM p
WHERE epoch_us(ts) - epoch_us(prev) > CAST(12 AS BIGINT) * 3600 * 1000000
""")
def gaps(t: Tables) -> DataFrame:
    return telemetry.gap_report(t.events, ["user_id"], "ts", "event_id", 3600, 12)


@query("M4_gap_counts", """
SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // CAST(3600000000 AS BIGINT) + 1 AS expected, count(*) AS received FROM events GROUP BY 1
""")
def gap_counts(t: Tables) -> DataFrame:
    return telemetry.gap_counts(t.events, ["user_id"], "ts", 3600)


@query("M5_circular_mean", f"""
WITH r AS (SELECT user_id, radians({K_SQL} * 3.6) AS a FROM events), s AS (
  SELECT user_id, count(*) AS n, CAST(sum(CAST(sin(a) AS DECIMAL(20, 12))) AS DOUBLE) AS s, CAST(sum(CAST(cos(a) AS DECIMAL(20, 12))) AS DOUBLE) AS c FROM r GROUP BY 1)
SELECT user_id, n, round(((degrees(atan2(s, c)) + 360.0) % 360.0), 4) AS direction, round(sqrt(s * s + c * c) / n, 6) AS agreement FROM s
""")
def direction(t: Tables) -> DataFrame:
    means = telemetry.circular_mean(t.events, ["user_id"], reading_k() * 3.6)
    return means.select("user_id", "n", F.round("direction", 4).alias("direction"), F.round("agreement", 6).alias("agreement"))


@query("M6_plugin_runs", f"""
WITH e AS (SELECT *, {K_SQL} AS k, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS run_no, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS stops
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, min(stops) OVER (PARTITION BY user_id, run_no) AS s0 FROM e WHERE run_no > 0)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, min(CASE WHEN event_type = 'signup' THEN ts END) AS started, min(CASE WHEN event_type = 'error' THEN ts END) AS stopped,
       count(*) FILTER (WHERE event_type NOT IN ('signup', 'error') AND stops = s0) AS readings, arg_min(CAST(k AS BIGINT), (ts, event_id)) FILTER (WHERE event_type = 'error') AS reported,
       CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'finished' ELSE 'unfinished' END AS state
FROM r GROUP BY user_id, run_no
""")
def runs(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    readings = t.events.select("user_id", "ts", "event_id", "event_type", reading_k().cast("bigint").alias("k"))
    return telemetry.plugin_runs(readings, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "error", "k")


def last_and_count(readings: Iterator[pd.DataFrame], params: dict) -> Iterator[dict[str, list]]:
    """A worker that counts readings and keeps the last value; a reading at the limit makes it fail."""
    n, last = 0, None
    for frame in readings:
        if frame["k"].to_numpy().max() >= params["limit"]:
            raise ValueError("reading at the limit")
        n, last = n + len(frame), float(frame["value"].iat[-1])
    yield {"n": [n], "last": [last]}


@query("F1_worker_map", f"""
WITH e AS (SELECT user_id, date_trunc('day', ts) AS bucket, ts, event_id, value, {K_SQL} AS k FROM events), g AS (
  SELECT user_id, CAST(bucket AS TIMESTAMP) AS bucket, count(*) AS n, arg_max(value, (ts, event_id)) AS last, max(k) AS top FROM e GROUP BY 1, 2)
SELECT user_id, bucket, n, last, NULL AS message FROM g WHERE top < 99
UNION ALL SELECT user_id, bucket, NULL, NULL, 'Completed: ' || n FROM g WHERE top < 99
UNION ALL SELECT user_id, bucket, NULL, NULL, 'ERROR: reading at the limit' FROM g WHERE top >= 99
""")
def worker(t: Tables) -> DataFrame:
    readings = t.events.select("user_id", "ts", "event_id", "value", reading_k().alias("k"))
    out = worker_map(readings, ["user_id"], ["ts", "event_id"], last_and_count, {"limit": 99}, "n bigint, last double", day_bucket("ts"))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("F1_worker_outcomes", f"""
WITH e AS (SELECT user_id, date_trunc('day', ts) AS bucket, {K_SQL} AS k FROM events), g AS (SELECT user_id, bucket, max(k) AS top FROM e GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (WHERE top < 99) AS completed, count(*) FILTER (WHERE top >= 99) AS failed FROM g GROUP BY 1
""")
def worker_outcomes_(t: Tables) -> DataFrame:
    """Calls of the worker that ended and that failed, per board."""
    readings = t.events.select("user_id", "ts", "event_id", "value", reading_k().alias("k"))
    out = worker_map(readings, ["user_id"], ["ts", "event_id"], last_and_count, {"limit": 99}, "n bigint, last double", day_bucket("ts"))
    return worker_outcomes(out, ["user_id"])


def running(frames, params, state):
    """Readings of a call, and the sum of all of the key so far; a total that the parameter divides is an error."""
    n, total = 0, state.get("total", 0)
    for frame in frames:
        n, total = n + len(frame), total + int(frame["k"].sum())
    state["total"] = total
    state["calls"] = state.get("calls", 0) + 1
    yield {"n": [n], "total": [total]}
    if total % params["bad"] == 0:
        raise ValueError("bad total")


@query("F1_worker_slices", f"""
WITH RECURSIVE e AS (SELECT user_id, {K_SQL} AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS call FROM events),
s AS (SELECT user_id, call, count(*) AS n, CAST(sum(k) AS BIGINT) AS added FROM e GROUP BY 1, 2),
-- the total that a call leaves behind: that of a failed call is not kept
w AS (
  SELECT user_id, call, n, added AS total, CASE WHEN added % 7 = 0 THEN 0 ELSE added END AS left_ FROM s WHERE call = 0
  UNION ALL
  SELECT s.user_id, s.call, s.n, w.left_ + s.added, CASE WHEN (w.left_ + s.added) % 7 = 0 THEN w.left_ ELSE w.left_ + s.added END
  FROM w JOIN s ON s.user_id = w.user_id AND s.call = w.call + 1)
SELECT user_id, call, n, total, NULL AS message FROM w
UNION ALL SELECT user_id, call, NULL, NULL, CASE WHEN total % 7 = 0 THEN 'ERROR: bad total' ELSE 'Completed: ' || n END FROM w
""")
def worker_slices_(t: Tables) -> DataFrame:
    """Calls of five readings, the total handed from each to the next of the same board."""
    readings = t.events.select("user_id", "ts", "event_id", reading_k().alias("k"))
    out = worker_slices(readings, ["user_id"], ["ts", "event_id"], running, {"bad": 7}, "n bigint, total bigint", 5, carry=True)
    return out.drop("slice")

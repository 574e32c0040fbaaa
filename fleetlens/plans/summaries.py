"""Registered queries: aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import aggregates as op
from fleetlens.operators import ranking, sets
from fleetlens.operators.logs import poll_attempts
from fleetlens.operators.matching import mark_online
from fleetlens.plans.bindings import AGENTS_SQL, BOARDS_SQL, K_SQL, LINES_SQL, LIVE_SQL, agents, boards, reading_k, run_lines, sessions
from fleetlens.plans.matching import CHECKS_SQL, checks
from fleetlens.plans.projections import SETTINGS_SQL, settings
from fleetlens.plans.registry import Tables, query


@query("A1_online_ratio", f"""
WITH {BOARDS_SQL}, {LIVE_SQL}
SELECT site, count(*) AS total, count(l.uuid) AS online FROM boards b LEFT JOIN live l USING (uuid) GROUP BY site
""")
def online_ratio(t: Tables) -> DataFrame:
    """Boards online per site once valid sessions have been applied."""
    return op.online_ratio(mark_online(boards(t), sessions(t)), ["site"])


@query("A2_status_breakdown", "SELECT o_orderstatus AS status, o_custkey AS agent, count(*) AS n FROM orders GROUP BY 1, 2")
def breakdown(t: Tables) -> DataFrame:
    return op.status_breakdown(t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("agent")))


@query("A3_duplicate_actives", f"""
WITH {AGENTS_SQL}, c AS (SELECT site, count(*) FILTER (WHERE ragent = 1 AND online = 1) AS active FROM agents GROUP BY site)
SELECT site, active, CASE active WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'duplicate' END AS state FROM c
""")
def actives(t: Tables) -> DataFrame:
    return op.duplicate_actives(agents(t), ["site"])


LOADS_SQL = """
WITH loads AS (
  SELECT s_nationkey AS site, s_suppkey AS node, count(l_suppkey) AS functions
  FROM supplier LEFT JOIN lineitem ON CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE -l_suppkey END = s_suppkey WHERE s_acctbal > 0 GROUP BY 1, 2)
"""


@query("A4_least_loaded", LOADS_SQL + """
SELECT site, node, functions FROM loads QUALIFY rank() OVER (PARTITION BY site ORDER BY functions) = 1
""")
def least_loaded(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("node"), (F.col("s_acctbal") > 0).alias("up"))
    functions = t.lineitem.select(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).otherwise(-F.col("l_suppkey")).alias("node"))
    return op.least_loaded(nodes, functions, ["site"], "up")


@query("A4_pick_one", LOADS_SQL + """
SELECT site, arg_min(node, (md5('7|' || node), node)) AS node
FROM (SELECT * FROM loads QUALIFY rank() OVER (PARTITION BY site ORDER BY functions) = 1) GROUP BY site
""")
def pick_one(t: Tables) -> DataFrame:
    """One of the least loaded nodes of every site."""
    nodes = t.supplier.select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("node"), (F.col("s_acctbal") > 0).alias("up"))
    functions = t.lineitem.select(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).otherwise(-F.col("l_suppkey")).alias("node"))
    return op.pick_one(op.least_loaded(nodes, functions, ["site"], "up"), ["site"], seed=7)


@query("A5_node_health", """
SELECT l_suppkey AS node, count(*) AS probes, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS healthy,
       count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS unhealthy, count(*) FILTER (WHERE l_returnflag = 'R') AS unreachable,
       max(CASE WHEN l_returnflag <> 'R' THEN l_tax END) AS slowest
FROM lineitem GROUP BY 1
""")
def node_health(t: Tables) -> DataFrame:
    down = F.col("l_returnflag") == "R"
    probes = t.lineitem.select(
        F.col("l_suppkey").alias("node"), F.when(~down, F.when(F.col("l_linestatus") == "F", 200).otherwise(500)).alias("http_status"),
        F.when(down, "timeout").alias("error"), F.when(~down, F.col("l_tax")).alias("response_time"),
    )
    return op.node_health(probes)


@query("A6_health_verdict", CHECKS_SQL + """
, v AS (SELECT c_nationkey, count(*) FILTER (WHERE severity = 'ok') AS ok, count(*) FILTER (WHERE severity = 'warn') AS warn,
        count(*) FILTER (WHERE severity = 'fail') AS fail FROM checks GROUP BY 1)
SELECT *, CASE WHEN fail > 0 THEN 'ISSUES' WHEN warn > 0 THEN 'MOSTLY_OK' ELSE 'GOOD' END AS verdict FROM v
""")
def verdict(t: Tables) -> DataFrame:
    return op.health_verdict(checks(t), ["c_nationkey"])


@query("A7_ready_ratio", "SELECT l_suppkey AS namespace, count(*) FILTER (WHERE l_linestatus = 'F') AS ready, count(*) AS total FROM lineitem GROUP BY 1")
def ready(t: Tables) -> DataFrame:
    return op.ready_ratio(t.lineitem.select(F.col("l_suppkey").alias("namespace"), (F.col("l_linestatus") == "F").alias("ready")))


@query("A9_config_usage", "SELECT o_orderpriority AS config, o_orderstatus AS kind, count(*) AS resources FROM orders GROUP BY 1, 2")
def usage(t: Tables) -> DataFrame:
    return op.config_usage(t.orders.select(F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("kind")))


@query("A10_settings_coverage", SETTINGS_SQL + """
SELECT site, count(*) AS boards, count(document) AS compiled, count(*) FILTER (WHERE skipped = 'no running pod') AS no_pod,
       count(*) FILTER (WHERE skipped = 'code missing') AS no_code FROM full_docs GROUP BY site
""")
def coverage(t: Tables) -> DataFrame:
    return op.settings_coverage(settings(t), ["site"])


@query("A11_inventory_count", """
SELECT count(DISTINCT l_partkey) AS before, count(DISTINCT CASE WHEN l_quantity > 49 AND l_returnflag = 'R' THEN l_partkey END) AS after FROM lineitem
""")
def inventory(t: Tables) -> DataFrame:
    return op.inventory_count(t.lineitem, "l_partkey", (F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R"))


@query("W1_latest_row", """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return ranking.latest_row(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("W2_elect_singleton", f"""
WITH {AGENTS_SQL}, e AS (SELECT site, hostname FROM agents QUALIFY row_number() OVER (PARTITION BY site ORDER BY created_at DESC, hostname DESC) = 1)
SELECT a.site, a.hostname, CASE WHEN a.hostname = e.hostname THEN 1 ELSE 0 END AS ragent,
       CASE WHEN a.hostname = e.hostname THEN 1 ELSE a.online END AS online, a.created_at
FROM agents a JOIN e USING (site)
""")
def elect(t: Tables) -> DataFrame:
    return ranking.elect_singleton(agents(t), ["site"])


CODES_SQL = """
codes AS (SELECT o_custkey, o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS code, o_orderdate, o_orderstatus FROM orders)
"""


@query("W3_newest_matching", f"""
WITH {CODES_SQL}, m AS (SELECT * FROM codes WHERE code LIKE '1-URGENT%')
SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN code END), arg_max(code, (o_orderdate, code))) AS code,
       count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS is_new
FROM m GROUP BY 1
""")
def newest(t: Tables) -> DataFrame:
    code = F.concat("o_orderpriority", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    codes = t.orders.select("o_custkey", code.alias("code"), "o_orderdate", "o_orderstatus")
    fresh = codes.where(F.col("o_orderstatus") == "P")
    return ranking.newest_matching(fresh, codes, "code", "o_orderdate", "1-URGENT", ["o_custkey"])


@query("W3_newest_by_code", """
WITH m AS (SELECT o_custkey, o_orderkey, 'B-' || (1700000000 + (o_orderkey * 7919) % 100000) || '-' || o_orderkey AS code FROM orders)
SELECT o_custkey, arg_max(code, (1700000000 + (o_orderkey * 7919) % 100000, code)) AS code, false AS is_new FROM m GROUP BY 1
""")
def newest_by_code(t: Tables) -> DataFrame:
    """Codes that carry the time they were made at; none is fresh."""
    made = F.lit(1700000000) + (F.col("o_orderkey") * 7919) % 100000
    codes = t.orders.select("o_custkey", F.concat(F.lit("B-"), made.cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("code"))
    return ranking.newest_matching(codes.limit(0), codes, "code", None, "B-", ["o_custkey"])


@query("W4_first_per_key", "WITH named AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name END AS p_name FROM part) SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 AS kept FROM named")
def first(t: Tables) -> DataFrame:
    return ranking.first_per_key(t.part.select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_name")).alias("p_name")), "p_name", ["p_partkey"])


@query("W5_bounded_listing", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def listing(t: Tables) -> DataFrame:
    return ranking.bounded_listing(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query("W6_transitions", """
WITH p AS (SELECT *, lag(event_type) OVER w AS was, lag(event_id) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM p WHERE prev IS NULL OR event_type IS DISTINCT FROM was)
SELECT user_id, event_id, ts, was AS from_state, event_type AS to_state, (epoch_us(ts) - epoch_us(since)) // 1000000 AS seconds_in_state
FROM c WHERE prev IS NOT NULL
""")
def transitions(t: Tables) -> DataFrame:
    return ranking.transitions(t.events, ["user_id"], "ts", "event_type", "event_id")


@query("W7_poll_until", f"""
WITH {LINES_SQL}, p AS (
  SELECT run_id, CAST(regexp_extract(line, '\\[([0-9]+)/', 1) AS INTEGER) AS attempt, line LIKE '%Ready: True, Synced: True%' AS good
  FROM lines WHERE line LIKE '%/12] Ready:%'),
m AS (SELECT run_id, min(CASE WHEN good AND attempt <= 12 THEN attempt END) AS attempt FROM p GROUP BY run_id)
SELECT run_id, attempt, CASE WHEN attempt IS NULL THEN 'timeout' ELSE 'ready' END AS outcome FROM m
""")
def poll(t: Tables) -> DataFrame:
    return ranking.poll_until(poll_attempts(run_lines(t)), ["run_id"], 12)


HALVES_SQL = f"""
WITH k AS (SELECT user_id, {K_SQL} AS k, ts < TIMESTAMP '2024-01-16' AS early FROM events),
before AS (SELECT DISTINCT user_id, k FROM k WHERE early), after AS (SELECT DISTINCT user_id, k FROM k WHERE NOT early)
"""


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What each user reported in the first and in the second half of the month."""
    rows = t.events.select("user_id", reading_k().alias("k"), "ts")
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    return rows.where(F.col("ts") < split), rows.where(F.col("ts") >= split)


@query("U1_new_since", HALVES_SQL + "SELECT * FROM after EXCEPT SELECT * FROM before")
def new_since(t: Tables) -> DataFrame:
    before, after = halves(t)
    return sets.new_since(before, after, ["user_id", "k"])


@query("U2_union_inventory", """
SELECT DISTINCT trim(line) AS line FROM (
  SELECT p_name || ' ' || p_size AS line FROM part UNION ALL SELECT source FROM documents UNION ALL SELECT o_orderpriority FROM orders) WHERE trim(line) <> ''
""")
def union_inventory(t: Tables) -> DataFrame:
    parts = t.part.select(F.concat(F.lit("  "), "p_name", F.lit(" "), "p_size", F.lit("  # "), "p_type").alias("line"))
    return sets.union_inventory(parts, t.documents.select(F.col("source").alias("line")), t.orders.select(F.col("o_orderpriority").alias("line")))


@query("U3_snapshot_diff", HALVES_SQL + """
SELECT user_id, k, CASE WHEN b.hit IS NULL THEN 'added' WHEN a.hit IS NULL THEN 'removed' ELSE 'kept' END AS state
FROM (SELECT *, 1 AS hit FROM before) b FULL JOIN (SELECT *, 1 AS hit FROM after) a USING (user_id, k)
""")
def snapshot_diff(t: Tables) -> DataFrame:
    before, after = halves(t)
    return sets.snapshot_diff(before, after, ["user_id", "k"])

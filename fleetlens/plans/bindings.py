"""Driver tables seen as fleet tables: which column plays which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.registry import Tables


def reading_k() -> Column:
    """The number carried in an event's JSON properties."""
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def boards(t: Tables) -> DataFrame:
    """Customers as boards; an empty agent where the balance is negative or small."""
    return t.customer.select(
        F.col("c_custkey").alias("uuid"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("name"),
        F.lit("registered").alias("status"),
        F.when(F.col("c_acctbal") < 2000, "").otherwise(F.concat(F.lit("agent-"), F.col("c_nationkey"))).alias("agent"),
        F.col("c_nationkey").alias("site"),
    )


BOARDS_SQL = """
boards AS (
  SELECT c_custkey AS uuid, c_name AS code, c_mktsegment AS name, 'registered' AS status,
         CASE WHEN c_acctbal < 2000 THEN '' ELSE 'agent-' || c_nationkey END AS agent, c_nationkey AS site
  FROM customer)
"""


def sessions(t: Tables) -> DataFrame:
    """Events as session records; sign-ups are the valid ones."""
    return t.events.select(
        F.col("user_id").alias("board_uuid"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("valid")
    )


LIVE_SQL = "live AS (SELECT DISTINCT user_id AS uuid FROM events WHERE event_type = 'signup')"


def agents(t: Tables) -> DataFrame:
    """Orders as agent registrations of a customer's site."""
    return t.orders.select(
        F.col("o_custkey").alias("site"), F.col("o_orderkey").cast("string").alias("hostname"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("ragent"),
        F.when(F.col("o_orderpriority") < "3", 1).otherwise(0).alias("online"),
        F.col("o_orderdate").alias("created_at"),
    )


AGENTS_SQL = """
agents AS (
  SELECT o_custkey AS site, CAST(o_orderkey AS VARCHAR) AS hostname,
         CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS ragent,
         CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS online, o_orderdate AS created_at
  FROM orders)
"""


def run_lines(t: Tables) -> DataFrame:
    """Every event as a log line: the board is the run, the event id the line number."""
    k, value, kind = F.col("k"), F.col("value"), F.col("event_type")
    step = F.concat(F.lit("step "), F.floor(k / 10).cast("string"))
    line = (
        F.when(kind == "signup", F.concat(F.lit("\x1b[0;34m[INFO]\x1b[0m === "), step, F.lit(" ===")))
        .when((kind == "purchase") & (value > 100), F.lit("\x1b[0;32m[OK]\x1b[0m Suite CRD completata"))
        .when(kind == "purchase", F.concat(F.lit("\x1b[0;32m[OK]\x1b[0m "), step, F.lit(" completato")))
        .when(kind == "click", F.concat(F.lit("  Board totali: "), k, F.lit(" / Board online: "), F.floor(k / 2).cast("string")))
        .when(kind == "view", F.concat(
            F.lit("  ["), k, F.lit("/12] Ready: "), F.when(value > 20, "True").otherwise("False"),
            F.lit(", Synced: "), F.when(value > 5, "True").otherwise("False")))
        .when(value > 40, F.concat(F.lit("Settings compilati: "), k))
        .otherwise(F.concat(F.lit("ERROR "), k, F.lit(" at line "), F.col("event_id"), F.lit(": table of tier "),
                            F.when(value > 10, "high").otherwise("low"), F.lit(" is missing")))
    )
    return t.events.withColumn("k", reading_k()).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line")
    )


LINES_SQL = f"""
kv AS (SELECT *, {K_SQL} AS k FROM events),
lines AS (
  SELECT user_id AS run_id, event_id AS line_no, CASE
    WHEN event_type = 'signup' THEN '[INFO] === step ' || (k // 10) || ' ==='
    WHEN event_type = 'purchase' AND value > 100 THEN '[OK] Suite CRD completata'
    WHEN event_type = 'purchase' THEN '[OK] step ' || (k // 10) || ' completato'
    WHEN event_type = 'click' THEN '  Board totali: ' || k || ' / Board online: ' || (k // 2)
    WHEN event_type = 'view' THEN '  [' || k || '/12] Ready: ' || CASE WHEN value > 20 THEN 'True' ELSE 'False' END
         || ', Synced: ' || CASE WHEN value > 5 THEN 'True' ELSE 'False' END
    WHEN value > 40 THEN 'Settings compilati: ' || k
    ELSE 'ERROR ' || k || ' at line ' || event_id || ': table of tier '
         || CASE WHEN value > 10 THEN 'high' ELSE 'low' END || ' is missing' END AS line
  FROM kv)
"""


def site_tree(t: Tables) -> DataFrame:
    """Customers as sites; every site but the first has the site numbered a quarter of its own as parent."""
    key = F.col("c_custkey")
    return t.customer.select(key.alias("site"), F.when(key > 0, F.floor(key / 4)).alias("parent"))


CLOSURE_SQL = """
sites AS (SELECT c_custkey AS site, CASE WHEN c_custkey > 0 THEN c_custkey // 4 END AS parent FROM customer),
closure AS (
  SELECT site AS node, site AS ancestor, 0 AS distance FROM sites
  UNION ALL
  SELECT c.node, s.parent, c.distance + 1 FROM closure c JOIN sites s ON c.ancestor = s.site WHERE s.parent IS NOT NULL)
"""

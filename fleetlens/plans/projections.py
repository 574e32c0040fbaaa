"""Registered queries: sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.values import condition_status, is_blank
from fleetlens.operators import projections as op
from fleetlens.operators.aggregates import ready_ratio
from fleetlens.operators.permissions import role_binding_drift
from fleetlens.operators.ranking import latest_row
from fleetlens.plans.bindings import BOARDS_SQL, K_SQL, boards, reading_k
from fleetlens.plans.registry import Tables, query
from fleetlens.session import fresh_path
from fleetlens.sources.scans import api_capture_scan, log_scan, registry_scan, resource_scan, text_lines
from fleetlens.sources.sinks import report_sink


@query("S1_resource_scan", """
SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS uuid, c_mktsegment AS segment,
       CASE WHEN c_acctbal >= 2000 THEN 'True' ELSE 'False' END AS ready, c_name || '-ext' AS external_name
FROM customer
""")
def resource_scan_(t: Tables) -> DataFrame:
    """List exports, one per line, written from the customers and scanned back."""
    ready = F.when(F.col("c_acctbal") >= 2000, "True").otherwise("False")
    device = F.struct(
        F.lit("Device").alias("kind"),
        F.struct(
            F.col("c_name").alias("name"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("labels"),
            F.create_map(F.lit("crossplane.io/external-name"), F.concat("c_name", F.lit("-ext"))).alias("annotations"),
        ).alias("metadata"),
        F.struct(F.struct(F.col("c_custkey").cast("string").alias("uuid"), F.col("c_name").alias("code")).alias("forProvider")).alias("spec"),
        F.struct(F.array(F.struct(F.lit("Ready").alias("type"), ready.alias("status"))).alias("conditions")).alias("status"),
    )
    path = fresh_path(t.spark, "exports")
    t.customer.select(F.to_json(F.struct(F.array(device).alias("items")))).write.text(path)
    devices = resource_scan(t.spark, path, "Device", "jsonl")
    return devices.select(
        "name", "spec.uuid", F.try_element_at("labels", F.lit("segment")).alias("segment"),
        condition_status("conditions", "Ready").alias("ready"), "external_name",
    )


@query("S1_manifest_scan", """
SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS uuid, 'site-' || s_nationkey AS parent FROM supplier
""")
def manifest_scan(t: Tables) -> DataFrame:
    """Multi-document manifests written from the suppliers and scanned back."""
    text = F.format_string(
        "kind: Site\nmetadata:\n  name: '%s'\nspec:\n  forProvider:\n    uuid: '%d'\n    parentSite: site-%d\n---",
        "s_name", "s_suppkey", "s_nationkey",
    )
    path = fresh_path(t.spark, "manifests")
    t.supplier.select(text).write.text(path)
    sites = resource_scan(t.spark, path, "Site", "yaml")
    return sites.select("name", "spec.uuid", F.col("spec.parentSite").alias("parent"))


@query("S1_json_scan", """
SELECT 'n-' || n_nationkey AS name, n_name AS code, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
""")
def json_scan(t: Tables) -> DataFrame:
    """List exports of a nation's suppliers as devices, a file for every hundred thousand numbers."""
    device = F.struct(
        F.lit("Device").alias("kind"), F.struct(F.concat(F.lit("n-"), "n_nationkey").alias("name")).alias("metadata"),
        F.struct(F.struct(F.col("n_name").alias("code")).alias("forProvider")).alias("spec"))
    held = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(
        "n_nationkey", F.floor(F.col("s_suppkey") / 100_000).alias("part")).agg(F.collect_list(device).alias("items"))
    path = fresh_path(t.spark, "json")
    text = F.to_json(F.struct("items"), {"pretty": "true"}).alias("value")
    held.select("n_nationkey", "part", text).repartition("n_nationkey", "part").write.partitionBy("n_nationkey", "part").text(path)
    found = resource_scan(t.spark, f"{path}/*/*", "Device").where("error is null").select("name", "spec.code")
    return found.groupBy("name", "code").agg(F.count(F.lit(1)).alias("suppliers"))


#: Orders of one list export: many such files are written at once, each larger than a split of a large input.
LIST_ORDERS = 1_000_000


@query("S1_list_scan", """
SELECT 'o-' || o_orderkey AS name, o_orderpriority AS code, o_orderstatus AS status FROM orders
""")
def list_scan(t: Tables) -> DataFrame:
    """Pretty-printed lists of up to a million orders, each written as one file, scanned back by their splits."""
    lists = max(1, -(-t.orders.count() // LIST_ORDERS))
    begin = '{"kind": "List", "metadata": {"items": [{"kind": "Device"}], "note": "} ]"}, "items": [{"kind": "Note", "spec": [{}]}'
    end = '], "more": [{"kind": "Device"}]}'
    edges = t.spark.range(lists).select(F.col("id").alias("part"), F.explode(F.array(F.lit(0), F.lit(2))).alias("at"))
    rows = t.orders.select(
        (F.monotonically_increasing_id() % F.lit(lists)).alias("part"), F.lit(1).alias("at"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    item = F.struct(
        F.lit("Device").alias("kind"), F.struct(F.concat(F.lit("o-"), "o_orderkey").alias("name")).alias("metadata"),
        F.struct(F.struct(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("status")).alias("forProvider")).alias("spec"))
    text = F.when(F.col("at") == 0, begin).when(F.col("at") == 2, end).otherwise(F.concat(F.lit(","), F.to_json(item, {"pretty": "true"})))
    path = fresh_path(t.spark, "list")
    # in a file the begin comes first, the end last; one file for each part
    ordered = rows.unionByName(edges, allowMissingColumns=True).repartitionByRange(lists, "part").sortWithinPartitions("part", "at")
    ordered.select("part", text.alias("value")).write.partitionBy("part").text(path)
    return resource_scan(t.spark, f"{path}/*", "Device", "list").select("name", "spec.code", "spec.status")


@query("S1_pod_scan", """
SELECT 'ns-' || o_custkey AS namespace, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) AS total FROM orders GROUP BY 1
""")
def pod_scan(t: Tables) -> DataFrame:
    """Pods written from the orders, scanned back and counted per namespace."""
    done = F.when(F.col("o_orderstatus") == "F", "True").otherwise("False")
    pod = F.struct(
        F.lit("v1").alias("apiVersion"), F.lit("Pod").alias("kind"),
        F.struct(F.concat(F.lit("pod-"), "o_orderkey").alias("name"), F.concat(F.lit("ns-"), "o_custkey").alias("namespace")).alias("metadata"),
        F.struct(F.lit("Running").alias("phase"), F.array(F.struct(F.lit("Ready").alias("type"), done.alias("status"))).alias("conditions")).alias("status"),
    )
    path = fresh_path(t.spark, "pods")
    t.orders.select(F.to_json(pod)).write.text(path)
    pods = resource_scan(t.spark, path, "Pod", "jsonl").where("error is null")
    return ready_ratio(pods.select("namespace", (condition_status("conditions", "Ready") == "True").alias("ready")))


@query("S1_binding_scan", """
WITH d AS (SELECT c_custkey AS k, 'role-' || c_nationkey AS role, 'grp:' || c_mktsegment AS subject FROM customer),
e AS (SELECT s_suppkey AS k, 'role-' || s_nationkey AS role, 'grp:BUILDING' AS subject FROM supplier)
SELECT 'p-' || d.k AS namespace, d.role, d.subject AS subjects, CASE WHEN e.k IS NULL THEN 'create' WHEN d.role <> e.role THEN 'recreate' ELSE 'patch' END AS action,
       coalesce(d.subject <> e.subject, false) AS subjects_changed
FROM d LEFT JOIN e USING (k)
""")
def binding_scan(t: Tables) -> DataFrame:
    """Role bindings written as manifests from the customers, scanned back and compared with those of the suppliers."""
    text = F.format_string(
        "kind: RoleBinding\nmetadata:\n  name: admin\n  namespace: p-%d\nroleRef:\n  kind: ClusterRole\n  name: role-%d\nsubjects:\n- kind: Group\n  name: 'grp:%s'\n---",
        "c_custkey", "c_nationkey", "c_mktsegment",
    )
    path = fresh_path(t.spark, "bindings")
    t.customer.select(text).write.text(path)
    found = resource_scan(t.spark, path, "RoleBinding", "yaml").where("error is null")
    desired = found.select("namespace", F.col("name").alias("binding"), F.col("spec.roleRef.name").alias("role"), F.explode("spec.subjects.name").alias("subject"))
    existing = t.supplier.select(
        F.concat(F.lit("p-"), "s_suppkey").alias("namespace"), F.lit("admin").alias("binding"),
        F.concat(F.lit("role-"), "s_nationkey").alias("role"), F.lit("grp:BUILDING").alias("subject"))
    return role_binding_drift(desired, existing).withColumn("subjects", F.array_join("subjects", ",")).drop("binding")


@query("S2_registry_scan", f"WITH {BOARDS_SQL} SELECT CAST(uuid AS VARCHAR) AS uuid, code, name, status, agent FROM boards")
def registry_scan_(t: Tables) -> DataFrame:
    folder = fresh_path(t.spark, "registry")
    boards(t).drop("site").withColumn("uuid", F.col("uuid").cast("string")).write.parquet(f"{folder}/boards.parquet")
    return registry_scan(t.spark, folder, "boards")


@query("S3_api_capture_scan", f"""
SELECT event_id, k FROM (
  SELECT event_id, event_type, {K_SQL} AS k FROM events
  UNION ALL SELECT event_id, event_type, {K_SQL} FROM events WHERE event_type = 'view')
""")
def api_capture(t: Tables) -> DataFrame:
    """Bare objects, arrays and envelopes, by event type."""
    kind, props = F.col("event_type"), F.col("props")
    body = (
        F.when(kind == "click", props)
        .when(kind == "view", F.concat(F.lit("["), props, F.lit(", "), props, F.lit("]")))
        .otherwise(F.concat(F.lit('{"injections": ['), props, F.lit("]}")))
    )
    return api_capture_scan(t.events.select("event_id", body.alias("body")), "body", "k int", "injections")


@query("S4_log_scan", """
SELECT source AS run, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS line_no, parts[i] AS line
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents) d, generate_series(1, len(parts)) AS g(i)
""")
def log_scan_(t: Tables) -> DataFrame:
    """Documents written as one text file per source folder and read back as numbered lines."""
    path = fresh_path(t.spark, "logs")
    ordered = t.documents.select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id")
    ordered.select("source", "text").write.partitionBy("source").text(path)
    return log_scan(t.spark, path).select(F.regexp_extract("run_id", "source=([^/]*)/", 1).alias("run"), "line_no", "line")


@query("S4_text_lines", """
SELECT doc_id AS run_id, CAST(i AS INTEGER) AS line_no, parts[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, generate_series(1, len(parts)) AS g(i)
""")
def text_lines_(t: Tables) -> DataFrame:
    return text_lines(t.documents, "doc_id", "text")


@query("S5_report_sink", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL
""")
def report_sink_(t: Tables) -> DataFrame:
    """An ordered TSV report written and read back."""
    path = fresh_path(t.spark, "report")
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    report_sink(counts, path, "tsv", ["o_orderstatus", "o_orderpriority"])
    return t.spark.read.schema(counts.schema).option("sep", "\t").option("header", True).csv(path)


@query("P1_resource_summary", """
SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS code, o_orderstatus AS status,
       CASE WHEN o_orderstatus = 'F' THEN 'True' WHEN o_orderstatus = 'O' THEN 'False' ELSE 'Unknown' END AS ready,
       'Unknown' AS synced, 'o-' || o_orderkey AS external_name,
       CAST(epoch(TIMESTAMP '2003-01-01 00:00:00') - epoch(o_orderdate) AS BIGINT) AS age_s
FROM orders
""")
def summary(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    ready = F.struct(F.lit("Ready").alias("type"), F.when(status == "F", "True").otherwise("False").alias("status"))
    res = t.orders.select(
        F.col("o_orderkey").cast("string").alias("name"), F.struct(F.col("o_orderpriority").alias("code"), status.alias("status")).alias("spec"),
        F.when(status.isin("F", "O"), F.array(ready)).otherwise(F.array().cast("array<struct<type:string,status:string>>")).alias("conditions"),
        F.concat(F.lit("o-"), "o_orderkey").alias("external_name"), F.col("o_orderdate").cast("timestamp").alias("created"),
    )
    return op.resource_summary(res, F.lit("2003-01-01 00:00:00").cast("timestamp"), {"code": "spec.code", "status": "spec.status"})


@query("P2_nested_extract", f"SELECT event_id, {K_SQL} AS k FROM events WHERE event_type <> 'error'")
def nested(t: Tables) -> DataFrame:
    payload = F.when(F.col("event_type") != "error", F.struct(reading_k().alias("k")))
    docs = t.events.select("event_id", F.struct(payload.alias("payload")).alias("doc"))
    return op.nested_extract(docs, "doc.payload.k", "k", ["event_id"])


@query("P3_condition_status", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority WHEN o_orderpriority > '3' THEN 'late' ELSE 'Unknown' END AS status
FROM orders
""")
def conditions(t: Tables) -> DataFrame:
    second = F.when(F.col("o_orderpriority") > "3", "O").otherwise("none")
    conds = F.array(
        F.struct(F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("status")),
        F.struct(second.alias("type"), F.lit("late").alias("status")),
    )
    return t.orders.select("o_orderkey", condition_status(conds, "O").alias("status"))


@query("P4_fill_default_status", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'registered' ELSE o_orderpriority END AS status
FROM orders
""")
def fill(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None).when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    return op.fill_default(t.orders.select("o_orderkey", status.alias("status")), "status", "registered")


@query("P5_assign_active_agent", f"""
WITH {BOARDS_SQL}, elected AS (
  SELECT s_nationkey AS site, s_name AS hostname FROM supplier
  QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name DESC) = 1)
SELECT b.uuid, b.code, b.status, CASE WHEN b.agent = '' THEN coalesce(e.hostname, b.agent) ELSE b.agent END AS agent
FROM boards b LEFT JOIN elected e USING (site)
""")
def assign(t: Tables) -> DataFrame:
    newest = latest_row(t.supplier.select(F.col("s_nationkey").alias("site"), F.col("s_name").alias("hostname"), "s_acctbal"), ["site"], ["s_acctbal", "hostname"])
    return op.assign_agent(boards(t), newest, is_blank("agent"), ["site"]).select("uuid", "code", "status", "agent")


@query("P5_assign_single_agent", f"""
WITH {BOARDS_SQL}
SELECT uuid, CASE WHEN agent = '' THEN (SELECT s_name FROM supplier ORDER BY s_acctbal DESC, s_name DESC LIMIT 1) ELSE agent END AS agent
FROM boards
""")
def assign_single(t: Tables) -> DataFrame:
    newest = latest_row(t.supplier.select(F.col("s_name").alias("hostname"), "s_acctbal"), [], ["s_acctbal", "hostname"])
    return op.assign_agent(boards(t), newest, is_blank("agent")).select("uuid", "agent")


@query("P6_code_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt%' ORDER BY p_name")
def like(t: Tables) -> DataFrame:
    return op.code_filter(t.part.select("p_partkey", "p_name"), "p_name", "%bolt%")


@query("P7_selector_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def selector(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("labels", F.create_map(F.lit("priority"), F.col("o_orderpriority")))
    return op.selector_filter(rows, {"priority": "1-URGENT"}, {"o_orderstatus": "O"}).select("o_orderkey", "o_orderstatus")


SETTINGS_SQL = """
WITH running AS (
  SELECT c_name AS code, min('pod-' || o_orderkey) AS pod FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY c_name),
docs AS (
  SELECT b.c_custkey AS uuid, b.c_nationkey AS site, b.code, r.pod,
         CASE WHEN b.code = '' THEN 'code missing' WHEN r.pod IS NULL THEN 'no running pod' END AS skipped
  FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 1000 THEN '' ELSE c_name END AS code FROM customer) b
  LEFT JOIN running r ON b.code = r.code),
full_docs AS (
  SELECT *, CASE WHEN skipped IS NULL THEN '{"device":{"board":{"code":"' || code || '"},"wamp":{"registration-agent":'
    || '{"url":"wss://broker:8181/","realm":"fleet"}}}}' END AS document FROM docs)
"""


def settings(t: Tables) -> DataFrame:
    code = F.when(F.col("c_acctbal") < 1000, "").otherwise(F.col("c_name"))
    known = t.customer.select(F.col("c_custkey").alias("uuid"), F.col("c_nationkey").alias("site"), code.alias("code"))
    phase = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "Running").otherwise("Pending")
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("code"))
    pods = t.orders.select("o_custkey", F.concat(F.lit("pod-"), "o_orderkey").alias("pod"), phase.alias("phase")).join(names, "o_custkey")
    return op.settings_documents(known, pods, "wss://broker:8181/", "fleet")


@query("P8_settings_documents", SETTINGS_SQL + "SELECT uuid, site, code, pod, skipped, document FROM full_docs")
def settings_(t: Tables) -> DataFrame:
    return settings(t)


PATCH_SQL = """
WITH patches AS (
  SELECT l_partkey AS p_partkey, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'Recalled' ELSE '' END AS p_brand,
         CAST(round(l_discount * 100) AS INTEGER) AS p_size, l_orderkey, l_linenumber FROM lineitem),
best AS (
  SELECT p_partkey, arg_max(p_brand, (l_orderkey, l_linenumber, p_brand)) FILTER (WHERE p_brand <> '') AS p_brand,
         arg_max(p_size, (l_orderkey, l_linenumber, p_size)) FILTER (WHERE p_size <> 0) AS p_size FROM patches GROUP BY 1)
SELECT p.p_partkey, p.p_name, coalesce(nullif(b.p_brand, ''), p.p_brand) AS p_brand, coalesce(nullif(b.p_size, 0), p.p_size) AS p_size
FROM part p LEFT JOIN best b USING (p_partkey)
"""


def patches(t: Tables) -> DataFrame:
    brand = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "Recalled").otherwise("")
    return t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"), brand.alias("p_brand"), F.round(F.col("l_discount") * 100).cast("int").alias("p_size"),
        "l_orderkey", "l_linenumber",
    )


@query("P9_sparse_patch", PATCH_SQL)
def patch(t: Tables) -> DataFrame:
    return op.sparse_patch(
        t.part.select("p_partkey", "p_name", "p_brand", "p_size"), patches(t), ["p_partkey"], order=["l_orderkey", "l_linenumber"])


@query("P9_explicit_null", """
WITH patches AS (
  SELECT l_partkey AS p_partkey, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'Recalled' ELSE '' END AS p_brand,
         CASE WHEN l_linestatus = 'F' THEN CAST(round(l_discount * 100) AS INTEGER) END AS p_size, l_orderkey, l_linenumber FROM lineitem),
best AS (
  SELECT p_partkey, arg_max(p_brand, (l_orderkey, l_linenumber, p_brand)) AS p_brand,
         arg_max(p_size, (l_orderkey, l_linenumber, p_size)) FILTER (WHERE p_size IS NOT NULL) AS p_size FROM patches GROUP BY 1)
SELECT p.p_partkey, p.p_name, coalesce(b.p_brand, p.p_brand) AS p_brand, coalesce(b.p_size, p.p_size) AS p_size
FROM part p LEFT JOIN best b USING (p_partkey)
""")
def patch_with_zeros(t: Tables) -> DataFrame:
    """The same patches where empty texts and zeros are values, and only NULL is not set."""
    size = F.when(F.col("l_linestatus") == "F", F.round(F.col("l_discount") * 100).cast("int")).alias("p_size")
    given = t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "Recalled").otherwise("").alias("p_brand"),
        size, "l_orderkey", "l_linenumber")
    return op.sparse_patch(
        t.part.select("p_partkey", "p_name", "p_brand", "p_size"), given, ["p_partkey"], explicit_null=True, order=["l_orderkey", "l_linenumber"])

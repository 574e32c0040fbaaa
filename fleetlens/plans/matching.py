"""Registered queries: data-quality checks, joins, trees and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import one_row_per
from fleetlens.functions.names import group_name
from fleetlens.operators import matching as op
from fleetlens.operators import permissions as perm
from fleetlens.operators import quality, trees
from fleetlens.plans.bindings import BOARDS_SQL, CLOSURE_SQL, K_SQL, LIVE_SQL, boards, reading_k, sessions, site_tree
from fleetlens.plans.registry import Tables, query


@query("V1_conformance", """
WITH checks AS (
  SELECT l_orderkey, l_linenumber, l_partkey, 'l_returnflag' AS "column", 'enum' AS rule, l_returnflag AS value
  FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, 'quantity', 'maximum', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem WHERE l_quantity > 25
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, 'quantity', 'minimum', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem WHERE l_quantity < 3)
SELECT * FROM checks
""")
def conformance(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("quantity"))
    rules = [quality.Rule("l_returnflag", required=True, enum=("A", "R")), quality.Rule("quantity", low=3, high=25)]
    return quality.conformance(rows, ["l_orderkey", "l_linenumber", "l_partkey"], rules)


@query("V2_immutability_audit", f"""
WITH e AS (SELECT *, {K_SQL} AS k FROM events),
f AS (SELECT user_id, arg_min(event_type, ts) AS t0, arg_min(k, ts) AS k0, arg_max(event_type, ts) AS t1, arg_max(k, ts) AS k1 FROM e GROUP BY user_id)
SELECT user_id, 'event_type' AS "column", t0 AS old_value, t1 AS new_value FROM f WHERE t0 IS DISTINCT FROM t1
UNION ALL SELECT user_id, 'k', CAST(k0 AS VARCHAR), CAST(k1 AS VARCHAR) FROM f WHERE k0 IS DISTINCT FROM k1
""")
def immutability(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "event_type", reading_k().alias("k"))
    first = one_row_per(rows, ["user_id"], ["ts", "event_id"], last=False)
    last = one_row_per(rows, ["user_id"], ["ts", "event_id"])
    return quality.immutability_audit(first, last, "user_id", ["event_type", "k"])


@query("V3_missing_fields", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'url' WHEN 'error' THEN 'name, url, k' ELSE 'name, url' END AS missing FROM events
WHERE event_type <> 'view'
""")
def missing(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    body = F.to_json(F.struct(
        reading_k().alias("k"), F.when(kind.isin("click", "view"), F.lit("n")).alias("name"), F.when(kind == "view", F.lit("u")).alias("url"),
    ))
    body = F.when(kind == "error", F.lit("not json")).otherwise(body)
    rows = t.events.select("event_id", body.alias("body"))
    return quality.missing_fields(rows, "body", ["name", "url", "k"]).select("event_id", "missing")


def _slug_sql(text: str) -> str:
    step = f"regexp_replace(translate(lower(trim({text})), '@._:', '----'), '[^a-z0-9-]', '', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({step}, '-+', '-', 'g'), '-'), ''), 'x')"


@query("V4_namespace_audit", f"""
WITH p AS (
  SELECT DISTINCT CASE WHEN p_type = 'ECONOMY' THEN 'https://idp.example/r#' ELSE '' END
         || replace(p_name, ' ', CASE WHEN p_size > 25 THEN '.' ELSE '_' END) AS owner, p_brand AS project FROM part),
n AS (
  SELECT owner, project, {_slug_sql("string_split(owner, '#')[-1]")} || '-' || {_slug_sql('project')} AS namespace,
         {_slug_sql('owner')} || '-' || {_slug_sql('project')} AS delete_namespace FROM p)
SELECT owner, project, namespace, delete_namespace, false AS incomplete, count(*) OVER (PARTITION BY namespace) AS sharing,
       length(namespace) > 63 AS too_long, namespace IN ('default', 'kube-system', 'kube-public', 'kube-node-lease') AS reserved,
       count(*) OVER (PARTITION BY namespace) > 1 AS collides, namespace <> delete_namespace AS leaks
FROM n
""")
def namespaces(t: Tables) -> DataFrame:
    sep = F.when(F.col("p_size") > 25, ".").otherwise("_")
    realm = F.when(F.col("p_type") == "ECONOMY", "https://idp.example/r#").otherwise("")
    owner = F.concat(realm, F.replace("p_name", F.lit(" "), sep))
    return quality.namespace_audit(t.part.select(owner.alias("owner"), F.col("p_brand").alias("project_name")))


@query("V5_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("J1_injection_report", """
SELECT c_mktsegment AS board_name, c_name AS board_code, p_name AS plugin_name, p_partkey AS plugin_uuid,
       l_linestatus AS status, l_returnflag = 'R' AS onboot
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
""")
def injection_report(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("plugin_uuid"), F.col("l_linestatus").alias("status"),
        (F.col("l_returnflag") == "R").alias("onboot"),
    )
    injections = lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("board_uuid")), "o_orderkey")
    plugins = t.part.select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"))
    return op.injection_report(injections, boards(t), plugins)


@query("J2_mark_online", f"""
WITH {BOARDS_SQL}, {LIVE_SQL}
SELECT b.uuid, b.code, CASE WHEN l.uuid IS NOT NULL THEN 'online' ELSE b.status END AS status, b.agent
FROM boards b LEFT JOIN live l USING (uuid)
""")
def mark_online(t: Tables) -> DataFrame:
    return op.mark_online(boards(t), sessions(t)).select("uuid", "code", "status", "agent")


@query("J3_reconcile_plan", """
WITH desired AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_orderstatus FROM orders),
observed AS (
  SELECT l_orderkey AS o_orderkey, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END AS o_orderstatus
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o.o_orderstatus IS NULL THEN 'create' WHEN d.o_orderstatus IS NULL THEN 'delete'
         WHEN d.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN 'update' ELSE 'noop' END AS action,
       CASE WHEN d.o_orderstatus <> o.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed
FROM desired d FULL JOIN observed o USING (o_orderkey)
""")
def reconcile(t: Tables) -> DataFrame:
    key = F.when(F.col("o_orderpriority") == "5-LOW", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    desired = t.orders.select(key.alias("o_orderkey"), "o_orderstatus")
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    observed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(low != high, "P").otherwise(low).alias("o_orderstatus"))
    return op.reconcile_plan(desired, observed, ["o_orderkey"], ["o_orderstatus"])


@query("J4_membership_probe", """
WITH seen AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'),
wanted AS (SELECT o_orderkey, item FROM orders, (VALUES (1), (5)) v(item))
SELECT o_orderkey, item, CASE
    WHEN EXISTS (SELECT 1 FROM seen s WHERE s.l_orderkey = w.o_orderkey AND s.l_linenumber = w.item) THEN 'present'
    WHEN EXISTS (SELECT 1 FROM seen s WHERE s.l_orderkey = w.o_orderkey) THEN 'absent' ELSE 'unknown' END AS outcome
FROM wanted w
""")
def membership(t: Tables) -> DataFrame:
    wanted = t.orders.select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(5))).alias("item"))
    lists = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.array("l_linenumber")).alias("items")
    )
    return op.membership_probe(wanted, lists, "o_orderkey", "item", "items")


@query("J5_resolve_refs", """
WITH refs AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'Former#' ELSE 'Customer#' END || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders)
SELECT o_orderkey, name, c_custkey AS id,
       CASE WHEN c_acctbal >= 5000 THEN 'primary' WHEN c_custkey IS NOT NULL THEN 'fallback' ELSE 'unresolved' END AS source
FROM refs LEFT JOIN customer ON c_name = name
""")
def resolve(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "Former#").otherwise("Customer#")
    name = F.concat(kind, F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    known = t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), "c_acctbal")
    primary = known.withColumn("name", F.when(F.col("c_acctbal") >= 5000, F.col("name")))
    return op.resolve_refs(t.orders.select("o_orderkey", name.alias("name")), primary, known, "name", "id")


@query("J5_resolve_by_name", """
WITH refs AS (SELECT o_orderkey, 'CUSTOMER__' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE WHEN o_orderpriority = '5-LOW' THEN '/old' ELSE '/' END AS name FROM orders)
SELECT o_orderkey, name, c_custkey AS id, CASE WHEN c_custkey IS NOT NULL THEN 'primary' ELSE 'unresolved' END AS source
FROM refs LEFT JOIN customer ON trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-')
  = trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-')
""")
def resolve_by_name(t: Tables) -> DataFrame:
    """References and resources spelled differently meet under the object name that both become."""
    end = F.when(F.col("o_orderpriority") == "5-LOW", "/old").otherwise("/")
    name = F.concat(F.lit("CUSTOMER__"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), end)
    known = t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return op.resolve_refs(t.orders.select("o_orderkey", name.alias("name")), known, known, "name", "id", as_names=True)


CHECKS_SQL = """
WITH actual AS (SELECT user_id, count(*) AS found, count(*) FILTER (WHERE event_type = 'purchase' AND value > 150) AS good FROM events GROUP BY 1),
checks AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(found, 0) AS found, coalesce(good, 0) AS good,
         CASE WHEN good > 0 THEN 'ok' WHEN found > 0 THEN 'warn' WHEN c_mktsegment = 'BUILDING' THEN 'fail' ELSE 'warn' END AS severity
  FROM customer LEFT JOIN actual ON c_custkey = user_id)
"""


def checks(t: Tables) -> DataFrame:
    """Every customer is expected to have events, and good ones at that."""
    expected = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    actual = t.events.select(F.col("user_id").alias("c_custkey"), "event_type", "value")
    good = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    missing = F.when(F.col("c_mktsegment") == "BUILDING", "fail").otherwise("warn")
    return op.expected_vs_actual(expected, actual, ["c_custkey"], good, missing)


@query("J6_expected_vs_actual", CHECKS_SQL + "SELECT * FROM checks")
def expected(t: Tables) -> DataFrame:
    return checks(t)


@query("J7_site_closure", f"WITH RECURSIVE {CLOSURE_SQL} SELECT node, ancestor, distance FROM closure")
def closure(t: Tables) -> DataFrame:
    return trees.site_closure(site_tree(t), "site", "parent")


@query("J7_site_paths", """
WITH RECURSIVE sites AS (SELECT c_custkey AS site, CASE WHEN c_custkey > 0 THEN c_custkey // 4 END AS parent FROM customer),
walk AS (
  SELECT site AS node, CAST(0 AS INTEGER) AS depth, CAST(site AS VARCHAR) AS path, site AS top FROM sites WHERE parent IS NULL
  UNION ALL
  SELECT s.site, w.depth + 1, w.path || '/' || s.site, w.top FROM walk w JOIN sites s ON s.parent = w.node)
SELECT node, top, depth, path, 'ok' AS state FROM walk
""")
def paths(t: Tables) -> DataFrame:
    return trees.site_paths(site_tree(t), "site", "parent")


@query("J8_effective_site_config", f"""
WITH RECURSIVE {CLOSURE_SQL}, configs AS (
  SELECT c_custkey AS site, CASE WHEN c_acctbal > 3000 THEN 'region' ELSE 'area' END AS key, c_mktsegment AS value FROM customer
  UNION ALL SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'timezone' ELSE 'zone' END, CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT node, key, arg_min(value, distance) AS value, arg_min(ancestor, distance) AS source, min(distance) AS distance
FROM closure JOIN configs ON ancestor = site GROUP BY node, key
""")
def config(t: Tables) -> DataFrame:
    site = F.col("c_custkey").alias("site")
    area = F.when(F.col("c_acctbal") > 3000, "region").otherwise("area")
    region = t.customer.select(site, area.alias("key"), F.col("c_mktsegment").alias("value"))
    zone = t.customer.select(
        site, F.when(F.col("c_mktsegment") == "BUILDING", "timezone").otherwise("zone").alias("key"), F.col("c_nationkey").cast("string").alias("value")
    )
    return trees.effective_site_config(site_tree(t), "site", "parent", region.unionByName(zone))


@query("A8_site_device_count", f"""
WITH RECURSIVE {CLOSURE_SQL}, n AS (SELECT o_custkey AS site, count(*) AS n FROM orders GROUP BY 1)
SELECT ancestor AS site, CAST(sum(CASE WHEN distance = 0 THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS own, CAST(sum(coalesce(n, 0)) AS BIGINT) AS subtree
FROM closure LEFT JOIN n ON node = site GROUP BY ancestor
""")
def device_count(t: Tables) -> DataFrame:
    return trees.site_device_count(site_tree(t), "site", "parent", t.orders, "o_custkey")


@query("J10_dangling_refs", "SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey - 1 END FROM supplier)")
def dangling(t: Tables) -> DataFrame:
    parents = t.supplier.select(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).otherwise(-F.col("s_suppkey") - 1).alias("s_suppkey"))
    return op.dangling_refs(t.events.select("event_id", "user_id", "event_type"), parents, "user_id", "s_suppkey")


@query("J10_delete_guard", """
SELECT p_partkey, count(l_partkey) AS injections, count(l_partkey) = 0 AS deletable
FROM part LEFT JOIN lineitem ON CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_partkey ELSE -l_partkey - 1 END = p_partkey GROUP BY p_partkey
""")
def guard(t: Tables) -> DataFrame:
    hit = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    held = t.lineitem.select(F.when(hit, F.col("l_partkey")).otherwise(-F.col("l_partkey") - 1).alias("l_partkey"))
    return op.delete_guard(t.part.select("p_partkey"), held, "p_partkey", "l_partkey")


@query("J11_request_results", """
SELECT o_orderkey AS uuid, o_orderstatus AS status, l_partkey AS result_part, l_linestatus AS result_state
FROM orders LEFT JOIN lineitem ON CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE -l_orderkey - 1 END = o_orderkey
""")
def request_results(t: Tables) -> DataFrame:
    requests = t.orders.select(F.col("o_orderkey").alias("uuid"), F.col("o_orderstatus").alias("status"))
    asked = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).otherwise(-F.col("l_orderkey") - 1)
    results = t.lineitem.select(
        asked.alias("request_uuid"), F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("state")
    )
    return op.request_results(requests, results)


@query("J11_request_outcomes", """
SELECT o_orderkey AS uuid, count(l_orderkey) AS results, count(*) FILTER (WHERE l_linestatus = 'F') AS finished,
       count(*) FILTER (WHERE l_linestatus = 'O') AS open
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def request_outcomes(t: Tables) -> DataFrame:
    requests = t.orders.select(F.col("o_orderkey").alias("uuid"))
    results = t.lineitem.select(F.col("l_orderkey").alias("request_uuid"), "l_linestatus")
    status = F.col("l_linestatus")
    return op.request_outcomes(requests, results, {"finished": status == "F", "open": status == "O"})


@query("J12_request_tree", """
WITH RECURSIVE req AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN o_orderkey // 10 END AS parent, o_orderstatus = 'P' AS pending FROM orders),
walk AS (
  SELECT node, node AS root, 0 AS depth FROM req WHERE parent IS NULL
  UNION ALL SELECT r.node, w.root, w.depth + 1 FROM walk w JOIN req r ON r.parent = w.node),
kids AS (SELECT parent AS node, count(*) AS n, count(*) FILTER (WHERE pending) AS p FROM req WHERE parent IS NOT NULL GROUP BY 1)
SELECT node, root, depth, true AS resolved, coalesce(n, 0) AS children, coalesce(p, 0) AS pending_children FROM walk LEFT JOIN kids USING (node)
""")
def request_tree(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    requests = t.orders.select(key, F.when(key > 0, F.floor(key / 10)).alias("parent"), (F.col("o_orderstatus") == "P").alias("pending"))
    return trees.request_tree(requests, "o_orderkey", "parent", "pending")


@query("J13_port_pool", """
WITH used AS (SELECT 50000 + CAST(floor(value) AS BIGINT) AS port, count(*) AS n FROM events GROUP BY 1),
pool AS (SELECT CAST(i AS BIGINT) AS port FROM range(50000, 50101) r(i))
SELECT port, coalesce(n, 0) AS holders, CASE WHEN pool.port IS NULL THEN 'outside' WHEN n IS NULL THEN 'free' WHEN n = 1 THEN 'used' ELSE 'clash' END AS state,
       port BETWEEN 50001 AND 50100 AS forwarded
FROM pool FULL JOIN used USING (port)
""")
def ports(t: Tables) -> DataFrame:
    exposed = t.events.select((F.lit(50000) + F.floor("value")).alias("public_port"))
    return op.port_pool(t.spark, exposed, 50000, 50100, (50001, 50100))


@query("J14_injection_eligibility", f"""
WITH {BOARDS_SQL}, {LIVE_SQL}, asks AS (SELECT l_orderkey, l_linenumber, o_custkey AS board_uuid, l_partkey AS plugin_uuid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.l_orderkey, a.l_linenumber, a.board_uuid, a.plugin_uuid,
       CASE WHEN b.uuid IS NULL THEN 'board missing' WHEN l.uuid IS NULL THEN 'board offline' WHEN p.p_partkey IS NULL THEN 'target missing'
            WHEN b.agent = '' THEN 'no agent' ELSE 'allowed' END AS verdict
FROM asks a LEFT JOIN boards b ON a.board_uuid = CASE WHEN b.name = 'FURNITURE' THEN -b.uuid - 1 ELSE b.uuid END LEFT JOIN live l ON l.uuid = b.uuid
LEFT JOIN part p ON CASE WHEN p.p_size > 10 THEN p.p_partkey ELSE -p.p_partkey - 1 END = a.plugin_uuid
""")
def eligibility(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("plugin_uuid"))
    asks = lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("board_uuid")), "l_orderkey")
    moved = F.when(F.col("name") == "FURNITURE", -F.col("uuid") - 1).otherwise(F.col("uuid"))
    known = op.mark_online(boards(t).withColumn("uuid", moved), sessions(t))
    targets = t.part.select(F.when(F.col("p_size") > 10, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1).alias("uuid"))
    return op.injection_eligibility(asks, known, targets)


@query("J15_upsert_merge", """
WITH src AS (SELECT c_custkey // 2 AS s_suppkey, arg_max(c_name, c_custkey) AS s_name, arg_max(c_acctbal, c_custkey) AS s_acctbal FROM customer GROUP BY 1)
SELECT s_suppkey, CASE WHEN src.s_suppkey IS NOT NULL THEN src.s_name ELSE s.s_name END AS s_name, s.s_nationkey,
       CASE WHEN src.s_suppkey IS NOT NULL THEN src.s_acctbal ELSE s.s_acctbal END AS s_acctbal
FROM supplier s FULL JOIN src USING (s_suppkey)
""")
def upsert(t: Tables) -> DataFrame:
    source = t.customer.select(
        "c_custkey", F.floor(F.col("c_custkey") / 2).alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal")
    )
    return op.upsert_merge(t.supplier, source, ["s_suppkey"], ["s_name", "s_acctbal"], ["c_custkey"])


@query("A12_existence_check", """
WITH asks AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT a.l_suppkey, a.l_partkey, count(l.l_partkey) AS found, count(l.l_partkey) = 1 AS exactly_one
FROM asks a LEFT JOIN lineitem l ON a.l_suppkey = l.l_suppkey AND a.l_partkey = CASE WHEN l.l_linestatus = 'F' THEN l.l_partkey ELSE -l.l_partkey - 1 END GROUP BY 1, 2
""")
def existence(t: Tables) -> DataFrame:
    pair = ["l_suppkey", "l_partkey"]
    asks = t.lineitem.select(*pair).distinct()
    part = F.when(F.col("l_linestatus") == "F", F.col("l_partkey")).otherwise(-F.col("l_partkey") - 1)
    return op.existence_check(asks, t.lineitem.select("l_suppkey", part.alias("l_partkey")), pair)


GROUP, CONFIG = "iot.fleet", "config.fleet"
ROLE_OF_SEGMENT = {
    "BUILDING": "admin", "MACHINERY": "viewer", "AUTOMOBILE": "operator", "HOUSEHOLD": "manager_project", "FURNITURE": "user_project",
}


def _rules_sql() -> str:
    def quoted(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    rows = [(r, [CONFIG if res == "providerconfigs" else GROUP], [res], v) for r, rules in perm.SITE_ROLES.items() for res, v in rules.items()]
    rows += [(r, *rule) for r, rules in perm.PROJECT_ROLES.items() for rule in rules]
    values = ",\n".join(f"('{r}', {quoted(g)}, {quoted(s)}, {quoted(v)})" for r, g, s, v in rows)
    role = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in ROLE_OF_SEGMENT.items()) + " END"
    return f"""
rules AS (SELECT DISTINCT role, api_group, resource, verb FROM (
  SELECT role, api_group, resource, unnest(verbs) AS verb FROM (
    SELECT role, api_group, unnest(resources) AS resource, verbs FROM (
      SELECT role, unnest(api_groups) AS api_group, resources, verbs FROM (VALUES {values}) v(role, api_groups, resources, verbs))))),
bindings AS (SELECT c_name AS subject, {role} AS role, CASE WHEN {role} LIKE '%project' THEN 'ns-' || c_nationkey ELSE '*' END AS namespace FROM customer),
permissions AS (SELECT DISTINCT subject, namespace, api_group, resource, verb FROM bindings JOIN rules USING (role))
"""


def bindings(t: Tables) -> DataFrame:
    role = F.lit(None).cast("string")
    for segment, name in ROLE_OF_SEGMENT.items():
        role = F.when(F.col("c_mktsegment") == segment, name).otherwise(role)
    scope = F.when(role.endswith("project"), F.concat(F.lit("ns-"), "c_nationkey"))
    return t.customer.select(F.col("c_name").alias("subject"), role.alias("role"), scope.alias("namespace"))


@query("J9_effective_permissions", f"WITH {_rules_sql()} SELECT subject, namespace, api_group, resource, verb FROM permissions")
def effective_permissions(t: Tables) -> DataFrame:
    return perm.effective_permissions(bindings(t), perm.role_rules(t.spark, GROUP, CONFIG))


@query("J9_can_i", f"""
WITH {_rules_sql()}, asks AS (
  SELECT o_orderkey, c_name AS subject, CASE o_orderstatus WHEN 'F' THEN 'ns-0' WHEN 'O' THEN 'ns-' || c_nationkey END AS namespace,
    CASE o_orderstatus WHEN 'P' THEN '{CONFIG}' ELSE '{GROUP}' END AS api_group,
    CASE o_orderstatus WHEN 'F' THEN 'devices' WHEN 'O' THEN 'devices/status' ELSE 'providerconfigs' END AS resource,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'get' WHEN '2' THEN 'list' WHEN '3' THEN 'update' WHEN '4' THEN 'delete' ELSE 'create' END AS verb
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, subject, namespace, api_group, resource, verb, EXISTS (
  SELECT 1 FROM permissions p WHERE p.subject = a.subject AND p.namespace IN (a.namespace, '*') AND p.api_group IN (a.api_group, '*')
    AND p.resource IN (a.resource, '*') AND p.verb IN (a.verb, '*')) AS allowed
FROM asks a
""")
def can_i(t: Tables) -> DataFrame:
    status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    verb = F.when(level == "1", "get").when(level == "2", "list").when(level == "3", "update").when(level == "4", "delete").otherwise("create")
    resource = F.when(status == "F", "devices").when(status == "O", "devices/status").otherwise("providerconfigs")
    own = F.concat(F.lit("ns-"), F.col("c_nationkey"))
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("subject"), "c_nationkey")
    asks = t.orders.join(people, "o_custkey").select(
        "o_orderkey", "subject", F.when(status == "F", "ns-0").when(status == "O", own).alias("namespace"),
        F.when(status == "P", CONFIG).otherwise(GROUP).alias("api_group"), resource.alias("resource"), verb.alias("verb"),
    )
    return perm.can_i(asks, bindings(t), perm.role_rules(t.spark, GROUP, CONFIG))


@query("P10_group_claims", """
WITH g AS (
  SELECT c_name AS username, unnest(['grp:' || lower(c_mktsegment) || '-nation-' || c_nationkey || ':user_iot', 'grp:everyone', 'other:' || c_nationkey]) AS "group" FROM customer)
SELECT username, "group", regexp_extract("group", '^([^:]*:[^:]*)(?::(.*))?$', 1) AS project, regexp_extract("group", '^([^:]*:[^:]*)(?::(.*))?$', 2) AS role
FROM g WHERE "group" LIKE 'grp:%'
UNION ALL SELECT c_name, 'federated_users', '', '' FROM customer
""")
def claims(t: Tables) -> DataFrame:
    project = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    groups = F.array(
        group_name("grp", F.col("c_mktsegment"), project, F.lit("user_iot")), F.lit("grp:everyone"), F.concat(F.lit("other:"), "c_nationkey")
    )
    return perm.group_claims(t.customer.select(F.col("c_name").alias("username"), groups.alias("groups")), "^grp:")


@query("J16_role_binding_drift", """
WITH desired AS (
  SELECT 'p-' || c_custkey AS namespace, 'admin-binding' AS binding, 'role-' || c_nationkey AS role,
         unnest(['grp:' || c_mktsegment, 'nation:' || c_nationkey]) AS subject FROM customer),
existing AS (
  SELECT 'p-' || s_suppkey AS namespace, 'admin-binding' AS binding, 'role-' || s_nationkey AS role,
         unnest(['nation:' || s_nationkey, 'grp:' || CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERY' END]) AS subject FROM supplier),
d AS (SELECT namespace, binding, max(role) AS role, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM desired GROUP BY 1, 2),
e AS (SELECT namespace, binding, max(role) AS role, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM existing GROUP BY 1, 2)
SELECT d.namespace, d.binding, d.role, d.subjects, CASE WHEN e.role IS NULL THEN 'create' WHEN e.role <> d.role THEN 'recreate' ELSE 'patch' END AS action,
       coalesce(e.subjects <> d.subjects, false) AS subjects_changed
FROM d LEFT JOIN e USING (namespace, binding)
""")
def drift(t: Tables) -> DataFrame:
    nation = lambda c: F.concat(F.lit("nation:"), c)
    wanted = F.array(F.concat(F.lit("grp:"), "c_mktsegment"), nation("c_nationkey"))
    desired = t.customer.select(
        F.concat(F.lit("p-"), "c_custkey").alias("namespace"), F.lit("admin-binding").alias("binding"),
        F.concat(F.lit("role-"), "c_nationkey").alias("role"), F.explode(wanted).alias("subject"),
    )
    group = F.concat(F.lit("grp:"), F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("MACHINERY"))
    existing = t.supplier.select(
        F.concat(F.lit("p-"), "s_suppkey").alias("namespace"), F.lit("admin-binding").alias("binding"),
        F.concat(F.lit("role-"), "s_nationkey").alias("role"), F.explode(F.array(nation("s_nationkey"), group)).alias("subject"),
    )
    return perm.role_binding_drift(desired, existing).withColumn("subjects", F.array_join("subjects", ","))

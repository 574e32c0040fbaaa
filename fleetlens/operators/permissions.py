"""Claims, roles and bindings."""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.keyed import join_same

CATCH_ALL = "federated_users"

# Verbs, and the resources each of the three site roles may use them on.
READ = ["get", "list", "watch"]
EDIT = ["get", "list", "watch", "update", "patch"]
FULL = ["get", "list", "watch", "create", "update", "patch", "delete"]
STATUS_READ = ["get"]
STATUS_EDIT = ["get", "update", "patch"]
SITE_ROLES = {
    "admin": {
        "sites": FULL, "devices": FULL, "services": FULL, "plugins": FULL,
        "sites/status": STATUS_EDIT, "devices/status": STATUS_EDIT,
        "services/status": STATUS_EDIT, "plugins/status": STATUS_EDIT,
        "providerconfigs": READ,
    },
    "viewer": {
        "sites": READ, "devices": READ, "services": READ, "plugins": READ,
        "sites/status": STATUS_READ, "devices/status": STATUS_READ,
        "services/status": STATUS_READ, "plugins/status": STATUS_READ,
    },
    "operator": {
        "sites": EDIT, "devices": FULL, "services": FULL, "plugins": FULL,
        "sites/status": STATUS_EDIT, "devices/status": STATUS_EDIT,
        "services/status": STATUS_EDIT, "plugins/status": STATUS_EDIT,
    },
}
# The three roles of a project namespace, as (api groups, resources, verbs).
PROJECT_ROLES = {
    "admin_project": [(["*"], ["*"], ["*"])],
    "manager_project": [
        (["*"], ["*"], READ),
        (
            ["", "apps", "batch", "networking.k8s.io"],
            ["pods", "services", "configmaps", "secrets", "persistentvolumeclaims", "deployments", "replicasets",
             "statefulsets", "daemonsets", "jobs", "cronjobs", "ingresses"],
            ["create", "update", "patch", "delete"],
        ),
        ([""], ["pods/exec", "pods/log"], ["get", "create"]),
    ],
    "user_project": [(["*"], ["*"], READ)],
}


def role_rules(
    spark: SparkSession, api_group: str, config_group: str, site_name: str = "{}", project_name: str = "{}"
) -> DataFrame:
    """Rules (role, api_groups, resources, verbs) of the site and project roles.

    The names are formats that turn a role into the full name that bindings carry.
    """
    rows = [
        (site_name.format(role), [config_group if resource == "providerconfigs" else api_group], [resource], verbs)
        for role, rules in SITE_ROLES.items() for resource, verbs in rules.items()
    ]
    rows += [(project_name.format(role), *rule) for role, rules in PROJECT_ROLES.items() for rule in rules]
    names = pa.list_(pa.string())
    schema = pa.schema([("role", pa.string()), ("api_groups", names), ("resources", names), ("verbs", names)])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema))


def group_claims(users: DataFrame, whitelist: str, catch_all: str = CATCH_ALL) -> DataFrame:
    """(username, group, project, role) of the claimed groups that match; every user also gets the catch-all."""
    claimed = users.select("username", F.explode(F.filter("groups", lambda g: g.rlike(whitelist))).alias("group"))
    shape = "^([^:]*:[^:]*)(?::(.*))?$"
    parsed = claimed.distinct().select(
        "username", "group",
        F.regexp_extract("group", shape, 1).alias("project"),
        F.regexp_extract("group", shape, 2).alias("role"),
    )
    everyone = users.select("username").distinct().select(
        "username", F.lit(catch_all).alias("group"), F.lit("").alias("project"), F.lit("").alias("role")
    )
    return parsed.unionByName(everyone)


def _granted(bindings: DataFrame) -> DataFrame:
    """Distinct (subject, namespace, role); a binding without namespace holds in all of them ('*')."""
    return bindings.select("subject", F.coalesce("namespace", F.lit("*")).alias("namespace"), "role").distinct()


def _flat(rules: DataFrame) -> DataFrame:
    """Distinct (role, api_group, resource, verb)."""
    return rules.withColumn("api_group", F.explode("api_groups")).withColumn(
        "resource", F.explode("resources")
    ).withColumn("verb", F.explode("verbs")).select("role", "api_group", "resource", "verb").distinct()


def effective_permissions(bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (subject, namespace, api_group, resource, verb) that the bindings grant."""
    held = _granted(bindings).join(_flat(rules), "role")
    return held.select("subject", "namespace", "api_group", "resource", "verb").distinct()


def can_i(asks: DataFrame, bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `allowed` to asks (subject, namespace, api_group, resource, verb); an ask without namespace is for all of them.

    A rule may hold '*' on any axis. The few distinct (api_group, resource, verb) asked for are looked up under
    their eight spellings to learn which roles cover them; each distinct ask is then looked up among the
    bindings of its subject, in its namespace or in all. Every match is an equi-join, so no side has to be
    broadcast, and the granted permissions are never spelled out.
    """
    axes = ["api_group", "resource", "verb"]
    spellings = F.array(*[
        F.struct(*[(F.lit("*") if wild else F.col(axis)).alias(f"_{axis}") for axis, wild in zip(axes, mask)])
        for mask in product((False, True), repeat=len(axes))
    ])
    shapes = asks.select(*axes).distinct().select(*axes, F.explode(spellings).alias("_s")).select(*axes, "_s.*")
    renamed = _flat(rules).select("role", *[F.col(axis).alias(f"_{axis}") for axis in axes])
    covers = shapes.join(renamed, [f"_{axis}" for axis in axes]).select("role", *axes).distinct()
    distinct = asks.select("subject", "namespace", *axes).distinct()
    scoped = distinct.withColumn("_in", F.explode(F.array_distinct(F.array(F.coalesce("namespace", F.lit("*")), F.lit("*")))))
    held = _granted(bindings).withColumnRenamed("namespace", "_in")
    yes = scoped.join(held, ["subject", "_in"]).join(covers, ["role", *axes], "left_semi")
    yes = yes.select("subject", "namespace", *axes).distinct().withColumn("allowed", F.lit(True))
    return join_same(asks, yes, ["subject", "namespace", *axes], "left").select(
        *asks.columns, F.coalesce("allowed", F.lit(False)).alias("allowed")
    )


def _bound(bindings: DataFrame) -> DataFrame:
    """One row per (namespace, binding): its role and its distinct subjects, sorted."""
    return bindings.groupBy("namespace", "binding").agg(
        F.max("role").alias("role"), F.sort_array(F.collect_set("subject")).alias("subjects")
    )


def role_binding_drift(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """(namespace, binding, role, subjects, action, subjects_changed) for each wanted binding.

    Rows are (namespace, binding, role, subject); a binding holds its subjects as one list, which is replaced whole.
    action: create, recreate where the role differs, or patch.
    """
    there = _bound(existing).select(
        "namespace", "binding", F.col("role").alias("_role"), F.col("subjects").alias("_subjects"), F.lit(True).alias("_there")
    )
    action = (
        F.when(F.col("_there").isNull(), "create")
        .when(~F.col("role").eqNullSafe(F.col("_role")), "recreate")
        .otherwise("patch")
    )
    return join_same(_bound(desired), there, ["namespace", "binding"], "left").select(
        "namespace", "binding", "role", "subjects", action.alias("action"),
        F.coalesce(F.col("_there") & (F.col("subjects") != F.col("_subjects")), F.lit(False)).alias("subjects_changed"),
    )

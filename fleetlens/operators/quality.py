"""Data-quality checks; each gives one row per finding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.names import slug, user_of_subject
from fleetlens.functions.values import is_blank

# Names no project may take, and the longest DNS label.
RESERVED_NAMESPACES = ("default", "kube-system", "kube-public", "kube-node-lease")
LONGEST_LABEL = 63


@dataclass(frozen=True)
class Rule:
    """A rule on one column: required, one of a list (case matters), or between two whole numbers."""

    column: str
    required: bool = False
    enum: tuple[str, ...] = ()
    low: int | None = None
    high: int | None = None

    def checks(self) -> list[tuple[str, Column]]:
        col, text = F.col(self.column), F.col(self.column).cast("string")
        out: list[tuple[str, Column]] = []
        if self.required:
            out.append(("required", is_blank(text)))
        if self.enum:
            out.append(("enum", ~is_blank(text) & ~text.isin(*self.enum)))
        if self.low is not None:
            out.append(("minimum", col < self.low))
        if self.high is not None:
            out.append(("maximum", col > self.high))
        return out


# What the published schemas ask of boards, injections and services.
BOARD_RULES = (
    Rule("name", required=True),
    Rule("code", required=True),
    Rule("type", required=True, enum=("virtual", "physical")),
    Rule("status", enum=("registered", "online", "offline")),
)
INJECTION_RULES = (Rule("status", enum=("injected", "running", "stopped")),)
SERVICE_RULES = (
    Rule("name", required=True),
    Rule("port", required=True, low=1, high=65535),
    Rule("protocol", required=True, enum=("TCP", "UDP")),
)


def conformance(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(keys, column, rule, value) for every broken rule, in one pass over the table."""
    findings = [
        F.when(broken, F.struct(
            F.lit(rule.column).alias("column"), F.lit(name).alias("rule"), F.col(rule.column).cast("string").alias("value")
        ))
        for rule in rules
        for name, broken in rule.checks()
    ]
    return df.select(*keys, F.explode(F.array_compact(F.array(*findings))).alias("_f")).select(*keys, "_f.*")


def immutability_audit(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, column, old_value, new_value) where a field that may never change has changed."""
    before = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in cols])
    changes = [
        F.when(~F.col(f"_old_{c}").eqNullSafe(F.col(c)), F.struct(
            F.lit(c).alias("column"),
            F.col(f"_old_{c}").cast("string").alias("old_value"),
            F.col(c).cast("string").alias("new_value"),
        ))
        for c in cols
    ]
    both = before.join(new.select(key, *cols), key)
    return both.select(key, F.explode(F.array_compact(F.array(*changes))).alias("_c")).select(key, "_c.*")


def missing_fields(df: DataFrame, body: str, required: Sequence[str]) -> DataFrame:
    """Payloads lacking required keys, with the missing names joined in the order they are required."""
    wanted = F.array(*[F.lit(name) for name in required])
    present = F.coalesce(F.json_object_keys(F.col(body)), F.array().cast("array<string>"))
    missing = F.array_except(wanted, present)
    return df.withColumn("missing", F.array_join(missing, ", ")).where(F.size(missing) > 0)


def namespace_audit(projects: DataFrame, owner: str = "owner", project: str = "project_name") -> DataFrame:
    """Namespace of every distinct (owner, project) with what is wrong about it.

    Creation derives the name from the user part of the owner, deletion from the raw owner; where the two
    differ the namespace is left behind. Owners or projects without text are reported, not derived.
    """
    distinct = projects.select(
        F.trim(F.col(owner)).alias("owner"), F.trim(F.col(project)).alias("project")
    ).distinct()
    named = distinct.select(
        "*",
        (is_blank("owner") | is_blank("project")).alias("incomplete"),
        F.concat(slug(user_of_subject(F.col("owner"))), F.lit("-"), slug(F.col("project"))).alias("_create"),
        F.concat(slug(F.col("owner")), F.lit("-"), slug(F.col("project"))).alias("_delete"),
    ).select(
        "owner", "project", "incomplete",
        F.when(~F.col("incomplete"), F.col("_create")).alias("namespace"),
        F.when(~F.col("incomplete"), F.col("_delete")).alias("delete_namespace"),
    )
    sharing = named.where(F.col("namespace").isNotNull()).groupBy("namespace").agg(F.count(F.lit(1)).alias("sharing"))
    return named.join(sharing, "namespace", "left").select(
        "owner", "project", "namespace", "delete_namespace", "incomplete",
        F.coalesce("sharing", F.lit(0)).alias("sharing"),
        F.coalesce(F.length("namespace") > LONGEST_LABEL, F.lit(False)).alias("too_long"),
        F.coalesce(F.col("namespace").isin(*RESERVED_NAMESPACES), F.lit(False)).alias("reserved"),
        F.coalesce(F.col("sharing") > 1, F.lit(False)).alias("collides"),
        F.coalesce(F.col("namespace") != F.col("delete_namespace"), F.lit(False)).alias("leaks"),
    )


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key values that more than one row uses."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)

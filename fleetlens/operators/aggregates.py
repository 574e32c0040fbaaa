"""Counts, ratios and verdicts. Every one is an aggregate with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import join_same
from fleetlens.functions.names import call_outcome


def online_ratio(boards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Boards and online boards, overall or per group."""
    return boards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "online").alias("online")
    )


def status_breakdown(boards: DataFrame, by: Sequence[str] = ("status", "agent")) -> DataFrame:
    return boards.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def duplicate_actives(agents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many agents are elected and online, and whether that is none, one or several."""
    active = F.count_if((F.col("ragent") == 1) & (F.col("online") == 1)).alias("active")
    state = F.when(F.col("active") == 0, "none").when(F.col("active") == 1, "single").otherwise("duplicate")
    return agents.groupBy(*by).agg(active).withColumn("state", state)


def least_loaded(nodes: DataFrame, functions: DataFrame, by: Sequence[str] = (), reachable: str | None = None) -> DataFrame:
    """Reachable nodes with the fewest functions, all ties kept; a node without functions counts as 0."""
    live = nodes.where(F.col(reachable)) if reachable else nodes
    loads = functions.groupBy("node").agg(F.count(F.lit(1)).alias("_load"))
    loaded = live.join(loads, "node", "left").select(*by, "node", F.coalesce("_load", F.lit(0)).alias("functions"))
    fewest = loaded.groupBy(*by).agg(F.min("functions").alias("_fewest"))
    if by:
        return join_same(loaded, fewest, list(by)).where(F.col("functions") == F.col("_fewest")).select(*loaded.columns)
    return loaded.where(F.col("functions") == fewest.scalar())


def pick_one(nodes: DataFrame, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """One of the tied nodes per group, chosen by a seeded hash so that a rerun chooses the same."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col("node").cast("string")).cast("binary"))
    return nodes.groupBy(*by).agg(F.min_by("node", F.struct(draw, "node")).alias("node"))


def probe_status(http_status: str = "http_status", error: str = "error") -> Column:
    """unreachable when the probe failed, healthy on 200, else unhealthy."""
    return (
        F.when(F.col(error).isNotNull(), "unreachable")
        .when(call_outcome(F.lit("GET"), F.col(http_status)) == "present", "healthy")
        .otherwise("unhealthy")
    )


def node_health(probes: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Probes by outcome, and the slowest answer, per node or group."""
    rated = probes.withColumn("_state", probe_status())
    return rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("probes"),
        *[F.count_if(F.col("_state") == s).alias(s) for s in ("healthy", "unhealthy", "unreachable")],
        F.max("response_time").alias("slowest"),
    )


def health_verdict(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ok/warn/fail counts and the verdict: ISSUES on any fail, MOSTLY_OK on any warn, else GOOD."""
    counts = checks.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("ok", "warn", "fail")]
    )
    verdict = F.when(F.col("fail") > 0, "ISSUES").when(F.col("warn") > 0, "MOSTLY_OK").otherwise("GOOD")
    return counts.withColumn("verdict", verdict)


def ready_ratio(pods: DataFrame, by: Sequence[str] = ("namespace",), ready: str = "ready") -> DataFrame:
    """Ready pods and all pods per namespace."""
    return pods.groupBy(*by).agg(F.count_if(F.col(ready)).alias("ready"), F.count(F.lit(1)).alias("total"))


def config_usage(usages: DataFrame) -> DataFrame:
    """Resources per provider config and kind."""
    return usages.groupBy("config", "kind").agg(F.count(F.lit(1)).alias("resources"))


def settings_coverage(documents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Boards, documents produced and boards skipped by reason, over settings_documents."""
    return documents.groupBy(*by).agg(
        F.count(F.lit(1)).alias("boards"),
        F.count("document").alias("compiled"),
        F.count_if(F.col("skipped") == "no running pod").alias("no_pod"),
        F.count_if(F.col("skipped") == "code missing").alias("no_code"),
    )


def inventory_count(df: DataFrame, col: str, keep: Column, approximate: bool = False) -> DataFrame:
    """Distinct entries before and after a filter.

    The exact form takes the distinct entries first, so a hot entry is reduced before the shuffle and the
    whole set never meets in one task; the approximate form keeps only sketches.
    """
    if approximate:
        return df.agg(
            F.approx_count_distinct(col).alias("before"),
            F.approx_count_distinct(F.when(keep, F.col(col))).alias("after"),
        )
    entries = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.max(keep).alias("_kept"))
    return entries.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("_kept")).alias("after"))

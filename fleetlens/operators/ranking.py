"""Newest, first, elected and bounded rows; state changes; polling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import SPLIT_ROWS, hot_keys, join_same, one_row_per, with_previous
from fleetlens.functions.names import code_epoch


def latest_row(df: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("created_at",)) -> DataFrame:
    """The newest row, overall or per group. The last order column should be unique to settle ties."""
    return one_row_per(df, list(by), list(order))


def elect_singleton(agents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clear the elected flag everywhere, then set it, and online, on the newest hostname (ties: largest name).

    Rows that share the elected hostname are all set, as an update by hostname does.
    """
    newest = F.max_by("hostname", F.struct("created_at", "hostname"))
    if by:
        elected = agents.groupBy(*by).agg(newest.alias("_elected"))
        marked = join_same(agents, elected, list(by), "left")
        chosen = F.col("_elected")
    else:
        marked, chosen = agents, agents.agg(newest).scalar()
    hit = F.col("hostname") == chosen
    return marked.withColumn("_hit", F.coalesce(hit, F.lit(False))).select(*[
        F.when(F.col("_hit"), 1).otherwise(0).alias(c) if c == "ragent"
        else F.when(F.col("_hit"), 1).otherwise(F.col(c)).alias(c) if c == "online"
        else F.col(c)
        for c in agents.columns
    ])


def newest_matching(
    fresh: DataFrame, everything: DataFrame, code: str, created: str | None, prefix: str, by: Sequence[str] = ()
) -> DataFrame:
    """The last fresh code in sorted order with a prefix; where there is none, the newest of all such codes.

    Without a `created` column a code is as old as the time that it carries.
    """
    at = F.col(created) if created else code_epoch(F.col(code))
    rows = fresh.select(*by, F.col(code), F.lit(True).alias("_fresh"), F.lit(None).alias("_at")).unionByName(
        everything.select(*by, F.col(code), F.lit(False).alias("_fresh"), at.alias("_at"))
    ).where(F.col(code).startswith(prefix))
    last_fresh = F.max(F.when(F.col("_fresh"), F.col(code)))
    newest = F.max_by(F.when(~F.col("_fresh"), F.col(code)), F.when(~F.col("_fresh"), F.struct("_at", code)))
    return rows.groupBy(*by).agg(F.coalesce(last_fresh, newest).alias(code), last_fresh.isNotNull().alias("is_new"))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Mark the first row of every key as kept, the others as skipped. The order must be unique within a key."""
    rank = F.struct(*order)
    first = df.groupBy(key).agg(F.min(rank).alias("_first"))
    return join_same(df, first, [key]).withColumn("kept", rank == F.col("_first")).select(*df.columns, "kept")


def bounded_listing(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in an order; each task keeps only its own n best."""
    return df.orderBy(*order).limit(n)


def transitions(
    df: DataFrame, keys: Sequence[str], ts: str, state: str, tie: str, split: int = SPLIT_ROWS
) -> DataFrame:
    """Rows whose state differs from the key's previous row, with the seconds spent in the state before.

    The first row of a key starts its first state and is no transition. Keys above `split` rows are cut by time.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, [ts, tie], split)
    seen = with_previous(df.select(*keys, ts, tie, state), keys, [ts, tie], {"_was": state, "_before": tie}, hot)
    changes = seen.where(F.col("_before").isNull() | ~F.col(state).eqNullSafe(F.col("_was"))).withColumn(
        "_initial", F.col("_before").isNull()
    ).drop("_before")
    timed = with_previous(changes, keys, [ts, tie], {"_since": ts}, hot)
    spent = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp"))
    return timed.where(~F.col("_initial")).select(
        *keys, tie, ts, F.col("_was").alias("from_state"), F.col(state).alias("to_state"),
        F.floor(spent / 1_000_000).alias("seconds_in_state"),
    )


def poll_until(polls: DataFrame, by: Sequence[str], attempts: int) -> DataFrame:
    """First attempt within the allowed number with both flags true, else a timeout."""
    hit = F.col("ready") & F.col("synced") & (F.col("attempt") <= attempts)
    return polls.groupBy(*by).agg(F.min(F.when(hit, F.col("attempt"))).alias("attempt")).withColumn(
        "outcome", F.when(F.col("attempt").isNull(), "timeout").otherwise("ready")
    )

"""Joins between wanted, registered and observed tables.

No join is told to broadcast: the tables here all grow with the fleet, so the optimizer decides from measured
sizes. Sides that may repeat a key are reduced before they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.keyed import one_row_per
from fleetlens.functions.names import object_name
from fleetlens.functions.values import changed_columns, is_blank

# The columns that decide whether a resource is up to date; kinds not named compare nothing.
COMPARED = {"Device": ("code",), "Plugin": ("name",)}
# Kinds that are deleted and created again instead of updated.
REPLACED = ("BoardPluginInjection", "BoardServiceInjection")


def injection_report(injections: DataFrame, boards: DataFrame, plugins: DataFrame) -> DataFrame:
    """Injections with the names of their board and plugin."""
    board = boards.select(
        F.col("uuid").alias("board_uuid"), F.col("name").alias("board_name"), F.col("code").alias("board_code")
    )
    plugin = plugins.select(F.col("uuid").alias("plugin_uuid"), F.col("name").alias("plugin_name"))
    return injections.join(board, "board_uuid").join(plugin, "plugin_uuid").select(
        "board_name", "board_code", "plugin_name", "plugin_uuid", "status", "onboot"
    )


def mark_online(boards: DataFrame, sessions: DataFrame, within: Column | None = None) -> DataFrame:
    """Boards with a valid session become online; all others keep their status. Never turns a board offline."""
    live = (
        sessions.where(F.col("valid").cast("int") == 1)
        .select(F.col("board_uuid").alias("uuid")).distinct().withColumn("_live", F.lit(True))
    )
    hit = F.col("_live") if within is None else F.col("_live") & within
    status = F.when(hit, F.lit("online")).otherwise(F.col("status"))
    return boards.join(live, "uuid", "left").withColumn("status", status).select(*boards.columns)


def reconcile_plan(
    desired: DataFrame,
    observed: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] = (),
    deletion_policy: str = "Delete",
    replace: bool = False,
) -> DataFrame:
    """(keys, action, changed) for every resource wanted or seen.

    action: create, update (or replace), noop, and for resources nobody wants delete, or orphan when the
    deletion policy is not 'Delete'. A key that one side holds with different values is reported as repeated, for
    nothing says which of them holds. Both sides go through one aggregate by key instead of an outer join: it takes
    one shuffle, shrinks repeated keys before it, and treats a NULL key as a key.
    """
    keys, compare = list(keys), list(compare)
    row = F.struct(F.lit(True).alias("_is"), *compare)
    nothing = F.lit(None)
    sides = desired.select(*keys, row.alias("_want"), nothing.alias("_have")).unionByName(
        observed.select(*keys, nothing.alias("_want"), row.alias("_have"))
    ).groupBy(*keys).agg(
        F.max("_want").alias("_want"), F.max("_have").alias("_have"),
        (F.min("_want") != F.max("_want")).alias("_wants"), (F.min("_have") != F.max("_have")).alias("_haves"),
    )
    changed = changed_columns({c: F.col(f"_want.{c}") for c in compare}, {c: F.col(f"_have.{c}") for c in compare})
    action = (
        F.when(F.col("_wants") | F.col("_haves"), "repeated")
        .when(F.col("_have").isNull(), "create")
        .when(F.col("_want").isNull(), "delete" if deletion_policy == "Delete" else "orphan")
        .when(F.size("_changed") > 0, "replace" if replace else "update")
        .otherwise("noop")
    )
    return sides.withColumn("_changed", changed).withColumn("action", action).select(
        *keys, "action",
        F.when(F.col("action").isin("update", "replace"), F.array_join("_changed", ",")).otherwise("").alias("changed"),
    )


def reconcile_resources(
    desired: DataFrame, observed: DataFrame, kind: str, keys: Sequence[str] = ("uuid",), deletion_policy: str = "Delete"
) -> DataFrame:
    """The plan for a resource kind, comparing what the kind's controller compares and nothing else."""
    return reconcile_plan(desired, observed, keys, COMPARED.get(kind, ()), deletion_policy, kind in REPLACED)


def membership_probe(desired: DataFrame, observed: DataFrame, board: str, item: str, items: str) -> DataFrame:
    """Is each wanted (board, item) in the board's observed list: present, absent, or unknown without a list."""
    listed = observed.where(F.col(items).isNotNull())
    members = listed.select(board, F.explode(items).alias(item)).distinct().withColumn("_member", F.lit(True))
    answered = listed.select(board).distinct().withColumn("_answered", F.lit(True))
    outcome = (
        F.when(F.col("_member"), "present").when(F.col("_answered"), "absent").otherwise("unknown")
    )
    return (
        desired.join(members, [board, item], "left").join(answered, board, "left")
        .withColumn("outcome", outcome).select(*desired.columns, "outcome")
    )


def resolve_refs(
    refs: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, ident: str, as_names: bool = False
) -> DataFrame:
    """Add the id of each reference: from the primary table, else the fallback; else it is unresolved.

    Where a key has several ids the smallest is taken, so the answer does not depend on row order. With `as_names`
    keys meet as the object names that they become.
    """
    met = object_name(F.col(key)) if as_names else F.col(key)

    def smallest(df: DataFrame, name: str) -> DataFrame:
        known = df.where(~is_blank(F.col(ident).cast("string")))
        return known.groupBy(met.alias("_key")).agg(F.min(ident).alias(name))

    keyed = refs.withColumn("_key", met)
    found = keyed.join(smallest(primary, "_first"), "_key", "left").join(smallest(fallback, "_second"), "_key", "left")
    source = (
        F.when(F.col("_first").isNotNull(), "primary")
        .when(F.col("_second").isNotNull(), "fallback")
        .otherwise("unresolved")
    )
    return found.select(*refs.columns, F.coalesce("_first", "_second").alias(ident), source.alias("source"))


def expected_vs_actual(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], good: Column, missing: Column | None = None
) -> DataFrame:
    """Severity of each expected thing: ok if an actual row is good, warn if there are only others, else missing.

    `missing` is a column over the expected table (default 'fail').
    """
    keys = list(keys)
    counts = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.count_if(good).alias("good"))
    wanted = expected.withColumn("_missing", missing if missing is not None else F.lit("fail"))
    severity = (
        F.when(F.col("good") > 0, "ok").when(F.col("found") > 0, "warn").otherwise(F.col("_missing"))
    )
    return wanted.join(counts, keys, "left").select(
        *expected.columns,
        F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce("good", F.lit(0)).alias("good"),
        severity.alias("severity"),
    )


def dangling_refs(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows that name a parent which does not exist; rows naming none are not dangling."""
    known = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(known, fk, "left_anti").select(*child.columns)


def delete_guard(plugins: DataFrame, injections: DataFrame, key: str, fk: str) -> DataFrame:
    """For each plugin how many injections still hold it, and whether it can be deleted."""
    held = injections.groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias("_held"))
    count = F.coalesce("_held", F.lit(0))
    return plugins.join(held, key, "left").select(
        *plugins.columns, count.alias("injections"), (count == 0).alias("deletable")
    )


def request_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Each request (uuid) with its results (request_uuid); requests without one keep a single row.

    Written as an inner join plus the unanswered requests, so that a request owning very many results can be
    split between tasks, which an outer join on that side would not allow.
    """
    fields = [c for c in results.columns if c != "request_uuid"]
    named = results.select(F.col("request_uuid").alias("uuid"), *[F.col(c).alias(f"result_{c}") for c in fields])
    answered = named.select("uuid").distinct()
    with_result = named.join(requests, "uuid").select(*requests.columns, *[f"result_{c}" for c in fields])
    without = requests.join(answered, "uuid", "left_anti")
    return with_result.unionByName(without, allowMissingColumns=True)


def request_outcomes(requests: DataFrame, results: DataFrame, outcomes: dict[str, Column]) -> DataFrame:
    """Each request with the number of results and of each kind of outcome."""
    counts = results.groupBy(F.col("request_uuid").alias("uuid")).agg(
        F.count(F.lit(1)).alias("results"), *[F.count_if(test).alias(name) for name, test in outcomes.items()]
    )
    return requests.join(counts, "uuid", "left").select(
        *requests.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ["results", *outcomes]]
    )


def port_pool(
    spark: SparkSession, exposed: DataFrame, low: int, high: int, forwarded: tuple[int, int], port: str = "public_port"
) -> DataFrame:
    """Every port of the range or in use: holders, state (free, used, clash, outside), and is it forwarded."""
    used = exposed.groupBy(F.col(port).cast("bigint").alias("port")).agg(F.count(F.lit(1)).alias("_holders"))
    pool = spark.range(low, high + 1).select(F.col("id").alias("port"), F.lit(True).alias("_in_range"))
    holders = F.coalesce("_holders", F.lit(0))
    state = (
        F.when(F.col("_in_range").isNull(), "outside")
        .when(holders == 0, "free").when(holders == 1, "used").otherwise("clash")
    )
    return pool.join(used, "port", "full_outer").select(
        "port", holders.alias("holders"), state.alias("state"), F.col("port").between(*forwarded).alias("forwarded")
    )


def injection_eligibility(asks: DataFrame, boards: DataFrame, targets: DataFrame, target: str = "plugin_uuid") -> DataFrame:
    """Verdict on each asked injection (board_uuid, target): the first obstacle met, else allowed."""
    board = boards.select(
        F.col("uuid").alias("board_uuid"), F.col("status").alias("_status"), F.col("agent").alias("_agent"),
        F.lit(True).alias("_board"),
    )
    known = targets.select(F.col("uuid").alias(target)).distinct().withColumn("_target", F.lit(True))
    verdict = (
        F.when(F.col("_board").isNull(), "board missing")
        .when(~F.col("_status").eqNullSafe("online"), "board offline")
        .when(F.col("_target").isNull(), "target missing")
        .when(is_blank("_agent"), "no agent")
        .otherwise("allowed")
    )
    return (
        asks.join(board, "board_uuid", "left").join(known, target, "left")
        .withColumn("verdict", verdict).select(*asks.columns, "verdict")
    )


def upsert_merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Target with the given columns set from the source and unknown source keys added; nothing is removed.

    Of several source rows for one key the last by `order` counts (without an order, the largest). Target rows are only ever the left side of a join,
    so a key that repeats in the target is updated everywhere and can be split between tasks.
    """
    keys, cols = list(keys), list(cols)
    fresh = one_row_per(source.select(*dict.fromkeys([*keys, *cols, *(order or ())])), keys, order).select(*keys, *cols)
    renamed = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    updated = target.join(renamed, keys, "left").select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in target.columns
    ])
    added = fresh.join(target.select(*keys).distinct(), keys, "left_anti")
    return updated.unionByName(added, allowMissingColumns=True)


def existence_check(asks: DataFrame, injections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each asked pair: how many rows there are, and is it exactly one."""
    keys = list(keys)
    counts = injections.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return asks.join(counts, keys, "left").select(*asks.columns, n.alias("found"), (n == 1).alias("exactly_one"))

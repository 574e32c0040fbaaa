"""Projections, filters and row-wise updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.keyed import one_row_per
from fleetlens.functions.values import condition_status, is_blank, is_zero


def resource_summary(res: DataFrame, now: Column, show: dict[str, str] | None = None) -> DataFrame:
    """The list view: chosen fields, READY, SYNCED, external name and age in seconds."""
    show = show or {"board_name": "spec.name", "code": "spec.code", "status": "spec.status"}
    return res.select(
        "name",
        *[F.col(path).alias(title) for title, path in show.items()],
        condition_status("conditions", "Ready").alias("ready"),
        condition_status("conditions", "Synced").alias("synced"),
        "external_name",
        (F.unix_timestamp(now) - F.unix_timestamp("created")).alias("age_s"),
    )


def nested_extract(df: DataFrame, path: str, alias: str, keep: Sequence[str] = ()) -> DataFrame:
    """One nested value per row; rows where it is missing, null or false disappear."""
    out = df.select(*keep, F.col(path).alias(alias))
    if isinstance(out.schema[alias].dataType, T.BooleanType):
        return out.where(F.col(alias))
    return out.where(F.col(alias).isNotNull())


def fill_default(df: DataFrame, col: str, value: str) -> DataFrame:
    """NULL or empty text becomes the default."""
    return df.withColumn(col, F.when(is_blank(col), F.lit(value)).otherwise(F.col(col)))


def assign_agent(
    boards: DataFrame, elected: DataFrame, when: Column, by: Sequence[str] = (), agent: str = "agent"
) -> DataFrame:
    """Set the elected agent on the rows that meet the condition.

    `elected` has one row (or one per `by` group) with a `hostname`. Where nothing was elected the row stays.
    """
    if by:
        found = boards.join(elected.select(*by, "hostname"), list(by), "left")
        chosen = F.col("hostname")
    else:
        found = boards
        chosen = elected.agg(F.max("hostname")).scalar()
    value = F.when(when, F.coalesce(chosen, F.col(agent))).otherwise(F.col(agent))
    return found.withColumn(agent, value).select(*boards.columns)


def code_filter(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose code matches a LIKE pattern, in code order, ties settled by the other columns."""
    return df.where(F.col(col).like(pattern)).orderBy(col, *[c for c in df.columns if c != col])


def selector_filter(
    df: DataFrame, labels: dict[str, str], fields: dict[str, str] | None = None, labels_col: str = "labels"
) -> DataFrame:
    """Rows carrying all the labels and all the field values."""
    keep = F.lit(True)
    for name, value in labels.items():
        keep &= F.try_element_at(F.col(labels_col), F.lit(name)) == value
    for name, value in (fields or {}).items():
        keep &= F.col(name) == value
    return df.where(keep)


def settings_documents(boards: DataFrame, pods: DataFrame, url: str, realm: str, root: str = "device") -> DataFrame:
    """One settings document per board (code) that has a running pod (code, pod, phase); else a skip reason."""
    running = pods.where(F.col("phase") == "Running").groupBy("code").agg(F.min("pod").alias("pod"))
    agent = F.struct(F.lit(url).alias("url"), F.lit(realm).alias("realm"))
    inner = F.struct(
        F.struct(F.col("code")).alias("board"),
        F.struct(agent.alias("registration-agent")).alias("wamp"),
    )
    reason = F.when(is_blank("code"), "code missing").when(F.col("pod").isNull(), "no running pod")
    return (
        boards.join(running, "code", "left")
        .withColumn("skipped", reason)
        .withColumn("document", F.when(F.col("skipped").isNull(), F.to_json(F.struct(inner.alias(root)))))
    )


def sparse_patch(
    current: DataFrame, patch: DataFrame, keys: Sequence[str], explicit_null: bool = False, order: Sequence[str] = ()
) -> DataFrame:
    """Overlay the set fields of a patch on the current rows.

    Zero values mean 'not set' and are skipped; with explicit_null only NULL is skipped. Patches of
    one key are applied in `order`, so of each field the last set value counts (without an order, the largest).
    """
    keys, order = list(keys), list(order)
    fields = [c for c in patch.columns if c not in [*keys, *order]]
    unset = {c: F.col(c).isNull() if explicit_null else is_zero(patch, c) for c in fields}
    given = patch.groupBy(*keys).agg(*[
        F.max_by(c, F.when(~unset[c], F.struct(*order, c))).alias(f"_new_{c}") for c in fields
    ])
    value = {c: F.coalesce(f"_new_{c}", c).alias(c) for c in fields}
    return current.join(given, keys, "left").select(*[value.get(c, F.col(c)) for c in current.columns])

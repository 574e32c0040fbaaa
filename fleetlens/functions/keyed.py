"""Per-key primitives that hold when one key owns a large share of all rows.

Picking one row per key is an aggregate, so it is reduced before the shuffle. Looking at earlier rows of a key
needs order. `hot_keys` counts rows per key first. Without a hot key that is a plain window. Otherwise the rows of
the hot keys, and only these, are cut into slices of about equally many rows along the whole order: the window runs inside (key, slice), and one
summary row per (hot key, slice) carries values across the cuts. The rows are shuffled once either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import stage

# Above this many rows a key is cut. That only moves work between tasks: the result is the same for any value.
SPLIT_ROWS = 2_000_000
# Places that are looked at for every slice of a hot key; more make slices more even.
SAMPLED = 64


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of equal names in which NULL keys meet too; the keys are taken from the left."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(and_, [left[k].eqNullSafe(other[f"_same_{k}"]) for k in keys])
    return left.join(other, on, how).drop(*[f"_same_{k}" for k in keys])  # dropping what a semi-join left out is no error


def one_row_per(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, last: bool = True) -> DataFrame:
    """The last (or first) whole row of every key; the order columns should be unique within a key."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if order is None:
        row = (F.max if last else F.min)(F.struct(*rest))
    else:
        row = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*[c if c in keys else f"_row.{c}" for c in df.columns])


def day_bucket(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def _at(order: Sequence[str]) -> Column:
    """The place of a row within its key: all order columns, so that rows of one instant are told apart by their tie."""
    return F.struct(*order)


def hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], split: int = SPLIT_ROWS) -> DataFrame | None:
    """(keys, _cuts): the keys with more than `split` rows and the places where they are cut, or None without any.

    Reads the key and order columns with partial counts, and once more for a sample of the places of the hot keys, some
    `SAMPLED` of every `split` rows, picked by a hash. Every so-many-th place of the sample is a cut, so a burst is cut
    as finely as its rows ask, even one at a single instant, along the rest of the order. In all there are at most
    rows / split cuts.
    """
    keys, order = list(keys), list(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = stage(counts.where(F.col("_n") > split), "hot")
    if hot.isEmpty():
        return None
    some = join_same(df.select(*keys, *order), hot, keys)
    if SAMPLED < split:
        some = some.where(F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 40)) < int(SAMPLED / split * (1 << 40)))
    sample = some.select(*keys, "_n", _at(order).alias("_at"))
    ranked = sample.withColumns({
        "_rank": F.row_number().over(Window.partitionBy(*keys).orderBy("_at")), "_all": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    slices = F.ceil(F.col("_n") / split)
    step = lambda rank: F.floor(rank * slices / F.col("_all"))
    cuts = ranked.where((step(F.col("_rank")) > step(F.col("_rank") - 1)) & (F.col("_rank") < F.col("_all")))
    return stage(cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_cuts")), "cuts")


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with their slice (`_cuts` is NULL on keys that are not hot), and the columns to group and join on.

    Those columns are never NULL, so rows without a key keep together too, and they are plain values, which sort
    and hash faster than a struct of the keys. NULLs in the order come first, as they do in a sort; only rows that are
    equal in the whole order share a slice. There are at most rows / split cuts, so they are broadcast.
    """
    named: dict[str, Column] = {}
    for i, key in enumerate(keys):
        numeric = isinstance(df.schema[key].dataType, T.NumericType)
        value = F.coalesce(F.col(key), F.lit(0)) if numeric else F.coalesce(F.col(key).cast("string"), F.lit(""))
        named |= {f"_key{i}": value, f"_none{i}": F.col(key).isNull()}
    by = [*named]
    widths = hot.select(*[c.alias(n) for n, c in named.items()], "_cuts")
    parts = df.select("*", *[c.alias(n) for n, c in named.items()]).join(F.broadcast(widths), by, "left")
    at = _at(order)
    slice_ = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < at)))
    return parts.withColumn("_slice", slice_), by


def slice_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], split: int, name: str) -> DataFrame:
    """Add the number of each row's slice of its key: about `split` rows each, 0 in keys that are not cut."""
    hot = hot_keys(df, keys, order, split)
    if hot is None:
        return df.withColumn(name, F.lit(0))
    return _cut(df, keys, order, hot)[0].select(*df.columns, F.col("_slice").alias(name))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], hot: DataFrame | None = None
) -> DataFrame:
    """Add, under new names, column values of the previous row of the same key. `hot` comes from `hot_keys`."""
    keys, order = list(keys), list(order)
    taken = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    if hot is None:
        seen = df.withColumn("_previous", F.lag(taken).over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        parts, by = _cut(df, keys, order, hot)
        tails = parts.where(F.col("_cuts").isNotNull()).groupBy(*by, "_slice").agg(
            F.max_by(taken, F.struct(*order)).alias("_tail")
        )
        across = Window.partitionBy(*by).orderBy("_slice")
        carried = tails.select(*by, "_slice", F.lag("_tail").over(across).alias("_carried"))
        inside = Window.partitionBy(*by, "_slice").orderBy(*order)
        seen = parts.withColumn("_inside", F.lag(taken).over(inside)).join(carried, [*by, "_slice"], "left")
        seen = seen.withColumn("_previous", F.coalesce("_inside", "_carried"))
    return seen.select(*df.columns, *[F.col(f"_previous.{new}").alias(new) for new in values])


def with_running_counts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flags: dict[str, Column], hot: DataFrame | None = None
) -> DataFrame:
    """Add, for each flag, how many rows of the same key up to and including this one raise it. `hot` as above."""
    keys, order = list(keys), list(order)
    ones = {n: F.when(flag, 1).otherwise(0) for n, flag in flags.items()}
    if hot is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(one).over(upto).alias(n) for n, one in ones.items()])
    parts, by = _cut(df, keys, order, hot)
    parts = parts.select("*", *[one.alias(f"_one_{n}") for n, one in ones.items()])
    totals = parts.where(F.col("_cuts").isNotNull()).groupBy(*by, "_slice").agg(
        *[F.sum(f"_one_{n}").alias(f"_sum_{n}") for n in flags]
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_slice", *[
        F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carried_{n}") for n in flags
    ])
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = parts.select("*", *[F.sum(f"_one_{n}").over(inside).alias(f"_in_{n}") for n in flags])
    return counted.join(carried, [*by, "_slice"], "left").select(
        *df.columns, *[(F.col(f"_in_{n}") + F.coalesce(f"_carried_{n}", F.lit(0))).alias(n) for n in flags]
    )

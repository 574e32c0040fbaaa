"""Set differences and unions of key lists. Hot keys shrink to one row per task before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_since(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen after and not before."""
    return after.select(*keys).distinct().subtract(before.select(*keys).distinct())


def union_inventory(*lists: DataFrame, col: str = "line") -> DataFrame:
    """Distinct entries of several lists, without '#' comments, outer blanks and empty lines."""
    merged = reduce(DataFrame.unionByName, [d.select(col) for d in lists])
    text = F.regexp_replace(F.regexp_replace(F.col(col), "#.*$", ""), "^\\s+|\\s+$", "")
    return merged.select(text.alias(col)).where(F.col(col) != "").distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of two snapshots as added, removed or kept; one aggregate over both instead of a join."""
    tagged = before.select(*keys, F.lit(True).alias("_old"), F.lit(False).alias("_new")).unionByName(
        after.select(*keys, F.lit(False).alias("_old"), F.lit(True).alias("_new"))
    )
    sides = tagged.groupBy(*keys).agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))
    state = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").otherwise("kept")
    return sides.select(*keys, state.alias("state"))

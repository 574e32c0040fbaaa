"""Column helpers for 'not set' values: the control data uses empty string, 0 and false where SQL uses NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_blank(col: Column | str) -> Column:
    """NULL or empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | (col == "")


def is_zero(df: DataFrame, name: str) -> Column:
    """NULL or the zero value of the column's type."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.StringType):
        return is_blank(col)
    if isinstance(kind, T.BooleanType):
        return col.isNull() | ~col
    if isinstance(kind, T.NumericType):
        return col.isNull() | (col == 0)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()


def changed_columns(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Sorted names of the columns whose values differ, NULL being a value like any other."""
    names = sorted(left)
    flags = [F.when(~left[n].eqNullSafe(right[n]), F.lit(n)) for n in names]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def parsed_rows(df: DataFrame, keep: list[str], parsed: Column) -> DataFrame:
    """The kept columns and the fields of `parsed`, for the rows where that struct is not NULL.

    A filter on parsed text would be pushed below the expression and evaluate it a second time for every row; a
    generator holds it above, so each text is searched once.
    """
    held = df.select(*keep, F.explode_outer(F.array(parsed)).alias("_parsed"))
    return held.where(F.col("_parsed").isNotNull()).select(*keep, "_parsed.*")


def condition_status(conditions: Column | str, kind: str) -> Column:
    """Status of the first condition of one type, 'Unknown' where there is none."""
    conditions = F.col(conditions) if isinstance(conditions, str) else conditions
    hits = F.filter(conditions, lambda c: c["type"] == kind)
    return F.coalesce(F.get(hits, F.lit(0))["status"], F.lit("Unknown"))

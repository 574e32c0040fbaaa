"""Report writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_sink(df: DataFrame, path: str, fmt: str, order: Sequence[str] = ()) -> None:
    """Write a report: 'tsv' (ordered, with header), 'text' (sorted unique lines of the one column), 'json'.

    Ordered reports are range-partitioned, so the files in name order hold the rows in order. The other columns
    settle ties, which also lets rows that share one order value be spread over tasks.
    """
    if fmt == "tsv":
        rows = df.orderBy(*order, *[c for c in df.columns if c not in order]) if order else df
        rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    elif fmt == "text":
        (column,) = df.columns
        df.where(F.col(column) != "").distinct().orderBy(column).write.mode("overwrite").text(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")

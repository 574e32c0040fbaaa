"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from fleetlens.session import fresh_path

#: Words are the runs of anything but these six characters.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, however often and deep inside lambdas the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text (none for a null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has (0 for a null)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it back."""
    path = fresh_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written on the way to a result, to be removed once what needs them is written itself."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(df.sparkSession, f"llm-{name}")
        df.write.parquet(path)
        self.paths.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self, spark: SparkSession) -> None:
        for path in self.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


#: Bits of the filter that every task gets: 2 MB at any size of the input.
FILTER_BITS = 1 << 24


def may_be_in(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test on a column: false only for values that `keys.column` does not hold.

    It keeps long rows that can't match out of a shuffle. Where keys are so many that all bits are set it lets every
    row through, which costs the shuffle and nothing else.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    # eight places by byte, so that at most FILTER_BITS / 8 rows come back
    found = keys.select(place(F.col(column)).alias("at")).groupBy((F.col("at") / 8).cast("int").alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, at % 8)")).alias("bits")).toPandas()
    filled = np.zeros(FILTER_BITS // 8, "u1")
    filled[found["byte"].to_numpy("i8")] = found["bits"].to_numpy("i8").astype("u1")
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @pandas_udf(T.BooleanType())
    def test(at: pd.Series) -> pd.Series:
        places = at.to_numpy("i8")
        return pd.Series((shared.value[places >> 3] >> (places & 7).astype("u1") & 1).astype(bool))

    return lambda c: test(place(c))


def partitions_of(df: DataFrame) -> int:
    """How many partitions a shuffle of this session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

"""User workers over readings: rows in, rows and one completion message out."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.keyed import slice_numbers

Worker = Callable[[Iterator[pd.DataFrame], dict], Iterable[pd.DataFrame | dict[str, list]]]


FLUSH_ROWS = 10_000


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of one key, piece by piece; the frames arrive sorted by key."""
    for frame in frames:
        if not len(frame):
            continue
        head = frame[keys]
        moved = (head != head.shift()) & ~(head.isna() & head.shift().isna())
        starts = np.flatnonzero(moved.any(axis=1).to_numpy() | (np.arange(len(frame)) == 0))
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            key = tuple(None if pd.isna(v) else v for v in (frame[k].iat[a] for k in keys))
            yield key, frame.iloc[a:b]


class _Out:
    """Rows of many small calls gathered into frames of a useful size."""

    def __init__(self, keys: list[str], names: list[str]) -> None:
        self.keys, self.names, self.clear = keys, names, lambda: {c: [] for c in (*keys, *names, "message")}
        self.columns = self.clear()

    def add(self, key: tuple, given: dict[str, list], n: int, message: str | None = None) -> None:
        for name, value in zip(self.keys, key):
            self.columns[name] += [value] * n
        for name in self.names:
            self.columns[name] += given.get(name, [None] * n)
        self.columns["message"] += [message] * n

    def full(self) -> bool:
        return len(self.columns["message"]) >= FLUSH_ROWS

    def flush(self) -> pd.DataFrame:
        frame, self.columns = pd.DataFrame(self.columns), self.clear()
        return frame


def _called(frames: Iterator[pd.DataFrame], keys: list[str], names: list[str], call: Callable) -> Iterator[pd.DataFrame]:
    """One call per run of rows of one key; its rows, and a closing one that tells how it went."""
    result = _Out(keys, names)
    for key, pieces in groupby(_runs(frames, keys), key=lambda kv: kv[0]):
        seen = 0

        def readings() -> Iterator[pd.DataFrame]:
            nonlocal seen
            for _, piece in pieces:
                seen += len(piece)
                yield piece

        stream = readings()
        try:
            for rows in call(key, stream):
                lists = rows if isinstance(rows, dict) else rows.to_dict("list")
                result.add(key, lists, len(lists[names[0]]))
                if result.full():
                    yield result.flush()
            for _ in stream:
                pass
            message = f"Completed: {seen}"
        except Exception as error:  # a worker's failure is a result, not a failure of the job
            message = f"ERROR: {error}"
        result.add(key, {}, 1, message)
        if result.full():
            yield result.flush()
    if result.columns["message"]:
        yield result.flush()


def _schema(placed: DataFrame, keys: list[str], schema: str) -> tuple[T.StructType, list[str]]:
    given = T._parse_datatype_string(schema)
    out = T.StructType([
        *[placed.schema[k] for k in keys], *[T.StructField(f.name, f.dataType) for f in given.fields],
        T.StructField("message", T.StringType()),
    ])
    return out, [f.name for f in given.fields]


def _tasks(df: DataFrame) -> int:
    # A number is given so that the partitions are not merged by size: the worker's time is not in the bytes.
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_map(
    df: DataFrame, by: list[str], order: list[str], fn: Worker, params: dict, schema: str, bucket: Column
) -> DataFrame:
    """Run a worker over the ordered readings of every (key, bucket).

    The worker gets an iterator of frames and the parameters and yields frames, or lists by
    column name, in `schema`. Output rows carry
    the key, the bucket, and `message`: NULL on the worker's rows, and on one closing row per (key, bucket) either
    'Completed: <n>' or 'ERROR: <text>'. A worker that raises keeps the rows it gave before; the job goes on.

    Readings are streamed through the worker, never gathered, and the bucket (a time slice of the key) bounds
    what one call sees, so a key with very many readings is spread over many tasks.
    """
    keys = [*by, "bucket"]
    placed = df.withColumn("bucket", bucket).repartition(_tasks(df), *keys).sortWithinPartitions(*keys, *order)
    out, names = _schema(placed, keys, schema)
    return placed.mapInPandas(lambda frames: _called(frames, keys, names, lambda key, stream: fn(stream, params)), out)


def _measured(frames: Iterator[pd.DataFrame], by: list[str], slice_: str, rows: int) -> Iterator[pd.DataFrame]:
    """The frames with a column `call`: within a key and slice it goes up by one after every so many rows."""
    at, seen = None, 0
    for key, piece in _runs(frames, [*by, slice_]):
        if key != at:
            at, seen = key, 0
        numbers = (seen + np.arange(len(piece))) // rows
        seen += len(piece)
        yield piece.assign(call=numbers)


def worker_slices(
    df: DataFrame, by: list[str], order: list[str], fn: Callable, params: dict, schema: str, rows: int, carry: bool = False,
) -> DataFrame:
    """Run a worker over the ordered readings of every key, in calls of at most `rows` readings each.

    As `worker_map`, but calls are cut by what is there, not by the clock, so a burst makes more calls and no larger
    ones. Output rows carry the key, `slice` and `call`, which number a key's calls in order.

    Without `carry` calls know nothing of each other: keys of more than `rows` readings are cut at sampled places, and
    their slices are spread over tasks. With it `fn(frames, params, state)` gets a dict that it may change, empty at a
    key's first call and handed on from each to the next; a call that raises leaves it as it was before. A key's calls
    then follow each other in one task (slice is 0), which reads them as a stream.
    """
    if rows < 1:
        raise ValueError("a call takes at least one reading")
    if carry:
        sliced = df.withColumn("slice", F.lit(0))
    else:
        sliced = slice_numbers(df, by, order, rows, "slice")
    keys = [*by, "slice", "call"]
    placed = sliced.repartition(_tasks(df), *by, "slice").sortWithinPartitions(*by, "slice", *order)
    out, names = _schema(placed.withColumn("call", F.lit(0).cast("long")), keys, schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"key": None, "state": {}}

        def call(key: tuple, stream: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame | dict[str, list]]:
            given = (frame.drop(columns=["slice", "call"]) for frame in stream)
            if not carry:
                return fn(given, params)
            if held["key"] != key[:-1]:
                held.update(key=key[:-1], state={})
            return carried(given)

        def carried(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | dict[str, list]]:
            state = copy.deepcopy(held["state"])
            yield from fn(given, params, state)
            held["state"] = state

        return _called(_measured(frames, by, "slice", rows), keys, names, call)

    return placed.mapInPandas(run, out)


def worker_outcomes(results: DataFrame, by: list[str]) -> DataFrame:
    """Completed and failed calls per key."""
    return results.where(F.col("message").isNotNull()).groupBy(*by).agg(
        F.count_if(F.col("message").startswith("Completed")).alias("completed"),
        F.count_if(F.col("message").startswith("ERROR")).alias("failed"),
    )

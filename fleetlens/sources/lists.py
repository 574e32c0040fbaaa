"""One large list export, `{…, "items": [ … ], …}` of any layout, read by many tasks.

The file is read in the splits of the text reader, cut at closing braces. A cut says nothing by itself: it may stand in
a string, at any depth. So the first pass tells of every split how it changes both, whether it starts inside a string
or outside; composing these over the splits of a file gives the state that each starts in. With it, the second pass
cuts out the items: a split gives its whole items, and the pieces of those that its borders cut. Pieces, at most two a
split, are put together afterwards; which list a split starts in is told by the splits before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.session import stage

#: So many splits of files may be sent to every task; of more, the table is joined like any other.
SPLITS_TO_SEND = 200_000

_ESCAPE = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_IN_STRING = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_STATES = "file string, block bigint, quotes bigint, from_outside bigint, from_inside bigint"
_PIECES = "file string, block bigint, part string, known boolean, listed boolean, body string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: its quotes, and how it changes the depth if it starts outside, or inside, a string."""
    at, sums = None, [0, 0, 0]
    rows: list[tuple] = []
    for batch in batches:
        for file, block, text in zip(*(batch[c].to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != at:
                if at is not None:
                    rows.append((*at, *sums))
                at, sums = (file, block), [0, 0, 0]
            if "\\" in text:
                text = _ESCAPE.sub("", text)
            parts = text.split('"')
            swapped = sums[0] % 2
            for side in (0, 1):
                plain = parts[0] if len(parts) == 1 and not side else "".join(parts[side::2])
                change = plain.count("{") + plain.count("[") - plain.count("]") - plain.count("}")
                if (len(parts) - 1) % 2 == side:  # the brace that ends the segment is outside
                    change -= 1
                sums[1 + (side ^ swapped)] += change
            sums[0] += len(parts) - 1
    if at is not None:
        rows.append((*at, *sums))
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "quotes", "from_outside", "from_inside"), r)) for r in rows], pa.schema(
        [("file", pa.string()), *((c, pa.int64()) for c in ("block", "quotes", "from_outside", "from_inside"))]))


class _Cutter:
    """Cuts the items out of one split, segment by segment."""

    def __init__(self, place: tuple, key: str, depth: int, inside: bool) -> None:
        self.place, self.key, self.depth, self.inside = place, json.dumps(key), depth, inside
        # of the container at depth two: known once one was opened or closed here
        self.known = depth < 2
        self.listed = False
        self.named = None  # the last string at depth one
        self.begun = depth > 2  # whether the split starts in the middle of an item
        self.text: list[str] = []
        self.out: list[tuple] = []

    def _give(self, part: str) -> None:
        self.out.append((*self.place, part, self.known, self.listed, "".join(self.text)))
        self.text = []

    def read(self, segment: str) -> None:
        whole, at = segment + "}", 0
        if self.depth > 2 and "[" not in whole and "]" not in whole and '"' not in whole and not self.inside:
            # nothing but an object's plain end, or braces that open
            after = self.depth + whole.count("{") - 1
            if after > 2:
                self.text.append(whole)
                self.depth = after
                return
        start = 0 if self.depth > 2 else None  # where the part of an item begins
        if self.inside:
            at = _IN_STRING.match(whole).end()
            if at >= len(whole):
                if start is not None:
                    self.text.append(whole)
                return
            at, self.inside = at + 1, False
        for token in _TOKEN.finditer(whole, at):
            sign = token[0]
            if sign[0] == '"':
                if len(sign) == 1 or sign[-1] != '"' or not _closed(sign):
                    self.inside = True
                elif self.depth == 1:
                    self.named = sign
            elif sign in "{[":
                self.depth += 1
                if self.depth == 2:
                    self.known, self.listed = True, sign == "[" and self.named == self.key
                elif self.depth == 3:
                    start = token.start()
            else:
                self.depth -= 1
                if self.depth == 2:
                    self.text.append(whole[start:token.end()])
                    start = None
                    self._give("end" if self.begun else "whole")
                    self.begun = False
                elif self.depth == 1:
                    self.known, self.listed, self.named = True, False, None
        if start is not None:
            self.text.append(whole[start:])

    def close(self) -> None:
        if self.depth > 2 and (self.text or self.begun):
            self._give("middle" if self.begun else "start")
        self.out.append((*self.place, "state", self.known, self.listed, None))


def _closed(string: str) -> bool:
    """Whether a token that ends with a quote is a whole string: the quote is not escaped."""
    return (len(string) - 1 - len(string[:-1].rstrip("\\"))) % 2 == 0


def _cut(key: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _PIECES.split(", ")]
        kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.string()), ("known", pa.bool_()), ("listed", pa.bool_()), ("body", pa.string())])
        now = None

        def flushed() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(now.out), 2000):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in now.out[at:at + 2000]], kinds)
            now.out = []

        for batch in batches:
            for file, block, depth, inside, text in zip(*(batch[c].to_pylist() for c in ("file", "block", "depth", "inside", "value"))):
                if now is None or now.place != (file, block):
                    if now is not None:
                        now.close()
                        yield from flushed()
                    now = _Cutter((file, block), key, depth, inside)
                now.read(text)
            if now is not None:
                yield from flushed()
        if now is not None:
            now.close()
            yield from flushed()

    return cut


def list_items(spark: SparkSession, path: str, key: str = "items") -> DataFrame:
    """(file, body) of every object in the list `key` of each file's document, as JSON text.

    A file may be of any size and layout; its items are not ordered. Other members of the document may come before and
    after the list, lists and objects among them. A file without such a list gives no rows.
    """
    segments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = stage(segments.mapInArrow(_summed, _STATES), "list-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False))
    change = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    states = sums.withColumn("inside", inside).withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select(
        "file", "block", "inside", "depth")
    states = stage(states, "list-states")
    if states.count() <= SPLITS_TO_SEND:
        states = F.broadcast(states)
        placed = segments.join(states, ["file", "block"])
    else:  # a shuffle would lose the order of segments
        placed = segments.withColumn("_at", F.monotonically_increasing_id()).join(states, ["file", "block"]).repartition(
            "file", "block").sortWithinPartitions("file", "block", "_at").drop("_at")
    pieces = stage(placed.mapInArrow(_cut(key), _PIECES), "list-pieces")
    # whether the list is open where a split starts
    told = pieces.where("part = 'state'").select("file", "block", F.when(F.col("known"), F.col("listed")).alias("after"))
    open_ = F.coalesce(F.last("after", ignorenulls=True).over(before), F.lit(False))
    open_at = told.select("file", "block", open_.alias("open"))
    parts = pieces.where("part <> 'state'").join(open_at, ["file", "block"]).where(
        F.when(F.col("known"), F.col("listed")).otherwise(F.col("open")))
    whole = parts.where("part = 'whole'").select("file", "body")
    return whole.unionByName(_joined(parts.where("part <> 'whole'")))


def _joined(parts: DataFrame) -> DataFrame:
    """Pieces of items that borders of splits have cut, put together; an item is a start, what is between, and an end."""
    order = F.when(F.col("part") == "start", 1).otherwise(0)  # in a split the end of one item comes before the start of the next
    upto = Window.partitionBy("file").orderBy("block", order)
    numbered = parts.withColumn("_item", F.sum(F.when(F.col("part") == "start", 1).otherwise(0)).over(upto))
    pieces = F.array_sort(F.collect_list(F.struct("block", order.alias("_order"), "body")))
    return numbered.groupBy("file", "_item").agg(F.array_join(F.transform(pieces, _body), "").alias("body")).select("file", "body")


def _body(piece: Column) -> Column:
    return piece["body"]

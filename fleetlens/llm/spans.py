"""Operator 7: substring dedup by sliding spans of sentences.

A text is cut into sentences, long ones also at a word whose own hash says so, so that a passage is cut alike wherever
it stands. Runs of several consecutive sentences are hashed; the runs of all documents meet by their
hash, and the sentences of every run but the first of its kind go. Of the runs, the shortest from every sentence on and
the shortest to every sentence's end are enough: a sentence of a longer repeated run lies in one of these that lies in
that run, and repeats with it. So the result is that of all runs, for two hashes a sentence. A document sends each of its
hashes once, a hash finds its first document by a partial aggregate, and what goes back to a document is the list of its
own repeated hashes, so no group is larger than one text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from fleetlens.llm.shared import WORD, Scratch, may_be_in, written
from fleetlens.session import settings

SENTENCES = 3
#: A span takes further sentences until it has so many words, so that runs of one-word sentences are no passages.
WORDS = 15
#: Inside a sentence, a word ends a piece where its hash is 0 modulo this.
CUT = 8
ENDS = tuple(".!?…。！？")


#: Arrow's batches of texts; a worker and the JVM each hold a few of them, whatever the length of the texts.
BATCH = "4m"
#: Splits of the table of hashes. Hardly any hash repeats inside a split, so its partial minima hold a row for each.
HASHES_AT_ONCE = "16m"


class _Cuts(dict):
    """Of a word: itself in lower case as bytes, and whether a piece ends after it. Remembers so many words at most."""

    #: about 15 MB; words that come first are the frequent ones, the others are worked out each time
    most = 60_000

    def __missing__(self, word: str) -> tuple[bytes, bool]:
        low = word.lower().encode("utf-8", "surrogatepass")
        out = low, word.endswith(ENDS) or not zlib.crc32(low) % CUT
        if len(self) < self.most:
            self[word] = out
        return out


#: Hashes of runs are polynomials in this odd number, modulo 2 ** 64, over the hashes of their pieces.
BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, "u8"), np.ones(1, "u8")]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of `BASE` and of its inverse up to n."""
    if len(_POWERS[0]) <= n:
        for i, factor in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(2 * n + 1, factor, "u8")
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def pieces(text: str, cuts: _Cuts) -> tuple[list[bytes], list[int]]:
    """The sentences of a text, their words in lower case, and their numbers of words; together they hold all words.

    A sentence ends after a word that ends in a mark, at a line break, or after a word that its own hash picks.
    """
    lines, counts = [], []
    for line in text.split("\n"):
        held: list[bytes] = []
        for word in WORD.findall(line):
            low, ends = cuts[word]
            held.append(low)
            if ends:
                lines.append(b" ".join(held))
                counts.append(len(held))
                held = []
        if held:
            lines.append(b" ".join(held))
            counts.append(len(held))
    return lines, counts


def spans(text: str, cuts: _Cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each piece, and of each span its first piece, the piece after its last, and its hash.

    Spans are the shortest runs that begin, and the shortest that end, at a given piece and have `SENTENCES` pieces and
    `WORDS` words. Equal passages have equal spans, whatever stands around them.
    """
    lines, counts = pieces(text, cuts)
    n, sizes = len(lines), np.array(counts, "i8")
    total = np.concatenate((np.zeros(1, "i8"), np.cumsum(sizes)))
    at = np.arange(n + 1)
    begin = np.minimum(at - SENTENCES, np.searchsorted(total, total - WORDS, "right") - 1)
    end = np.maximum(at + SENTENCES, np.searchsorted(total, total + WORDS, "left"))
    to, since = begin >= 0, end <= n
    code = np.unique(np.concatenate((begin[to] * (n + 1) + at[to], at[since] * (n + 1) + end[since])))
    first, after = code // (n + 1), code % (n + 1)
    power, inverse = _powers(n)
    own = np.fromiter(map(xxhash.xxh64_intdigest, lines), "u8", n)
    sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(own * power[:n], dtype="u8")))
    h = (sums[after] - sums[first]) * inverse[first]
    h ^= h >> np.uint64(32)
    return sizes, first, after, (h + (after - first).astype("u8")) * np.uint64(0xD6E8FEB86659FD93)


def without(text: str, everywhere: set[int], later: set[int], cuts: _Cuts) -> tuple[str, int]:
    """The text without the pieces under spans in `everywhere`, and under spans in `later` but their first; words removed."""
    counts, first, after, hashes = spans(text, cuts)
    gone, seen = np.zeros(len(counts), bool), set()
    for a, b, h in zip(first.tolist(), after.tolist(), hashes.tolist()):  # in the order of their first pieces
        if h in everywhere or (h in later and h in seen):
            gone[a:b] = True
        seen.add(h)
    if not gone.any():
        return text, 0
    words = [m.start() for m in WORD.finditer(text)]
    firsts = np.cumsum(counts) - counts
    starts = [words[i] for i in firsts] + [len(text)]
    kept = [text[starts[i]:starts[i + 1]] for i in range(len(counts)) if not gone[i]]
    return (text[:starts[0]] + "".join(kept)).rstrip(), int(counts[gone].sum())


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, key, h, again) for each distinct span hash of each text; `again` where the text itself repeats it."""
    cuts = _Cuts()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part, sizes, hashes, again = batch.iloc[at:at + 256], [], [], []
            for text in part["text"]:
                own, counts = np.unique(spans(text or "", cuts)[3], return_counts=True)
                sizes.append(len(own))
                hashes.append(own)
                again.append(counts > 1)
            rows = part[["id", "key"]].loc[part.index.repeat(sizes)].reset_index(drop=True)
            yield rows.assign(h=np.concatenate(hashes).view("i8"), again=np.concatenate(again))


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]))
def _cleaned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of each text and its two lists of hashes (null: nothing repeats) what `without` gives."""
    cuts = _Cuts()
    for texts, everywhere, later in batches:
        out = []
        for text, a, b in zip(texts, everywhere, later):
            if text is None or a is None:
                out.append((text, 0))
            else:
                out.append(without(text, {int(h) & (1 << 64) - 1 for h in a}, {int(h) & (1 << 64) - 1 for h in b}, cuts))
        yield pd.DataFrame({"text": pd.Series([t for t, _ in out], dtype="object"), "n_removed": np.array([n for _, n in out], "i8")})


def span_deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, `text` without repeated spans, and `n_removed`, the words that went.

    The first of equal spans is that of the smallest doc_id (nulls last), and inside a text the leftmost. Rows that are
    equal in id keep what they share with each other, unless a smaller id has it too; so repeated rows stay equal. Null
    texts stay null and texts under `WORDS` words stay as they are; a text of which everything is repeated becomes empty.
    An empty table stays empty. All columns are carried, whatever their names; one named `n_removed` is replaced.

    The session's Arrow batches are held to `BATCH` from here on, until `tune` is called again.
    """
    docs = docs.drop("n_removed")
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    key = F.xxhash64(F.col(text))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), key.alias("key"), F.col(text).alias("text"))
    # written once, for both sides of the join read it
    scratch = Scratch()
    found = scratch.written(rows.mapInPandas(_hashes, f"id {kind}, key long, h long, again boolean"), "hashes")
    firsts = found.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = (F.col("id") != F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull())
    met = found.join(firsts, "h", "left").withColumn("across", F.coalesce(later, F.lit(False))).where("across or again")
    listed = met.groupBy("id", "key").agg(
        F.collect_set(F.when(F.col("across"), F.col("h"))).alias("everywhere"),
        F.collect_set(F.when(~F.col("across"), F.col("h"))).alias("later"))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": HASHES_AT_ONCE}):
        told = written(listed.withColumnsRenamed({"id": "told_id", "key": "told_key"}), "spans")
    scratch.clear(spark)
    # most texts repeat nothing and stay where they are; the columns of `docs` are in a struct of their own
    other = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(F.struct(*other).alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("id"), key.alias("key"))
    asked = may_be_in(told, "told_key")(F.col("key"))
    joined = keyed.where(asked).join(told, (F.col("id").eqNullSafe(F.col("told_id"))) & (F.col("key") == F.col("told_key")), "left")
    done = joined.withColumn("done", _cleaned(F.col("text"), "everywhere", "later")).select("row", "done.text", "done.n_removed")
    every = keyed.where(~asked).select("row", "text", F.lit(0).cast("long").alias("n_removed")).unionByName(done)
    return every.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns], "n_removed")

"""Operator 13: how the vocabulary of sources diverges.

A task cuts whole batches of texts into terms at once: every byte that is in no term becomes a space. Terms are counted
by document, then added up by (lang, source, term), so frequent terms shrink before they travel. A document is in one
batch of one task, so the documents of a term are a plain sum, and which terms a language keeps comes from the same sums
as the occurrences.

Shares are integers, a billionth a unit, and the divergence of a group from another is a sum over *all* kept terms. A
term that a group lacks has the same share there as any other that it lacks, so the sum is put together from the terms
both have, the histogram of counts of each and the number of the rest: no table of all terms by all sources is made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.shared import Scratch, written

#: Of each byte what it is in a term: A-Z lowered, a-z and all that is not ASCII as it is, the rest a space.
IN_TERM = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
#: Sums that a task holds before it passes them on, their bytes, and bytes of text that it cuts at once: they only move work.
HELD, HELD_BYTES, CUT = 400_000, 1 << 26, 1 << 22
UNIT = 1_000_000_000
#: Below so many occurrences a share is computed in longs.
LONG = 9_000_000_000

_SUMS = pa.schema([("of", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TERMS = "lang string, source string, term string, n long, docs long"


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Sums of several tables as one."""
    sums = pa.concat_tables(tables).group_by(["of", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_SUMS.names).cast(_SUMS)


def _cut(texts: pa.Array) -> pa.Array:
    """The terms of each text, with empty ones where it does not begin or end with a term."""
    if not texts.nbytes or not pc.sum(pc.binary_length(texts)).as_py():
        return pa.array([[]] * len(texts), pa.list_(pa.large_string()))
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, "i8")[texts.offset:texts.offset + len(texts) + 1]
    plain = bytes(memoryview(data)[ends[0]:ends[-1]]).translate(IN_TERM)
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))


def _term_sums(batch: pa.RecordBatch) -> pa.Table:
    """Terms of each document, then of each group: occurrences and documents."""
    cut = _cut(batch["text"])
    every, groups = pc.list_flatten(cut).dictionary_encode(), batch["of"].dictionary_encode()
    terms, of = every.dictionary, groups.indices.to_numpy().astype("i8")
    code, at = every.indices.to_numpy(), pc.list_parent_indices(cut).to_numpy().astype("i8")
    none = pc.index(terms, pa.scalar("", terms.type)).as_py()
    real = code != none
    held = pa.table({"k": at[real] * len(terms) + code[real]}).group_by("k", use_threads=False).aggregate([([], "count_all")])
    k = held["k"].to_numpy()
    k = of[k // max(1, len(terms))] * len(terms) + k % max(1, len(terms))
    sums = pa.table({"k": k, "n": held["count_all"]}).group_by("k", use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    k = sums["k"].to_numpy()
    return pa.table({
        "of": groups.dictionary.take(pa.array(k // max(1, len(terms)))), "term": terms.take(pa.array(k % max(1, len(terms)))),
        "n": sums["n_sum"], "docs": sums["count_all"]}).cast(_SUMS)


def _sent(sums: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sums in small batches, so that neither side holds many of them twice; freed memory goes back."""
    for batch in sums.to_batches(max_chunksize=10_000):
        names = batch["of"].dictionary_encode()
        both = [json.loads(x) for x in names.dictionary.to_pylist()]
        lang, source = (pa.array([b[i] for b in both], pa.string()).take(names.indices) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([lang, source, batch["term"], batch["n"], batch["docs"]], names=["lang", "source", "term", "n", "docs"])
    pa.default_memory_pool().release_unused()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's documents by term; every group also gives the term ''."""
    held: list[pa.Table] = []
    first, size, weight = 0, 0, 0  # rows of the merged table in front, rows and bytes of all

    for batch in batches:
        groups = pc.unique(batch["of"])
        zero = pa.repeat(pa.scalar(0, pa.int64()), len(groups))
        held.append(pa.table([groups, pa.repeat("", len(groups)), zero, zero], schema=_SUMS))
        bytes_of, at = pc.cumulative_sum(pc.binary_length(batch["text"]).cast(pa.int64())).to_numpy(), 0
        while at < len(batch):
            done = int(bytes_of[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(bytes_of, done + CUT, "right")))
            held.append(_term_sums(batch.slice(at, to - at)))
            size, weight, at = size + len(held[-1]), weight + held[-1].nbytes, to
            if size > max(HELD, 2 * first) or weight > 2 * HELD_BYTES:
                held = [_merged(held)]
                first = size = len(held[0])
                weight = held[0].nbytes
                if size > HELD or weight > HELD_BYTES:
                    yield from _sent(held[0])
                    held, first, size, weight = [], 0, 0, 0
    if held:
        yield from _sent(_merged(held))


def term_rows(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group. Every group has a row of term ''."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(text).alias("text"), F.to_json(F.array(plain(lang), plain(source))).alias("of"))
    return rows.mapInArrow(_counted, _TERMS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(rows: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, lang_n): terms that at least `min_docs` documents of the language hold, from 1 to 3, and their occurrences there."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is 1, 2 or 3")
    sums = rows.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    return sums.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")


def _wide(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), in whole numbers of any size; in plain longs where these hold it."""
    top = (_wide(n) + F.lit(1).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    wide = F.call_function("div", top, _wide(total) + _wide(terms)).cast("long")
    fits = (n < LONG) & (total < LONG * UNIT // 2) & (terms < LONG * UNIT // 2)
    return F.lit(1) + F.when(fits, F.call_function("div", (n + 1) * UNIT, total + terms)).otherwise(wide)


def _sum_of(value: Column) -> Column:
    """The exact sum of longs, added up in two halves of 32 bits, which are longs themselves."""
    high, low = F.sum(F.shiftright(value, 32)), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    return high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); shares are at most 10**9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(
    docs: DataFrame, min_docs: int = 3, top_terms: int = 200, lang: str = "lang", source: str = "source", text: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source stands from the others of its language, and by which terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z lowered. A language keeps the terms that `min_docs` of
    its documents hold, V in number. A group with N occurrences of kept terms gives a term with n of them the share
    p = 1 + floor(10**9 * (n + 1) / (N + V)); f(p, q) = floor((p - q)**2 / q).
    Part `pair` has for each other source of the language the sum of f over all kept terms, q being its shares (0 where
    no term is kept). Part `term` has the `top_terms` terms of highest f that the group holds more often than the
    language as a whole, whose share is q. Ranks run from 1, values descending, then items ascending.

    Nulls in text, lang and source are ''. Rows are documents: repeated rows and rows of equal or null id count each.
    Groups without terms have pairs too; a source alone in its language has none. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    scratch = Scratch()
    rows = scratch.written(term_rows(docs, lang, source, text), "terms")
    kept = scratch.written(kept_terms(rows, min_docs), "kept")
    counts = scratch.written(rows.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = rows.where("term = ''").select("lang", "source").distinct().join(langs, "lang", "left").join(
        totals, ["lang", "source"], "left").na.fill(0)
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).alias("none")
    groups = scratch.written(groups.select("*", none), "groups")

    per = counts.join(groups.drop("held"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    # one row per pair of sources
    group = groups.select("lang", "source", "terms", "held", "none")
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("none").alias("item_none"))
    pairs = group.join(other, "lang").where("source <> item")
    # what the terms of one side give against a share of none on the other, by the histogram of counts
    steps = scratch.written(per.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("many")), "steps")
    mine = steps.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(_wide("many") * _gap(F.col("p"), F.col("item_none"))).alias("mine"))
    theirs = steps.select("lang", F.col("source").alias("item"), "p", "many").join(group, "lang").where("source <> item").groupBy(
        "lang", "source", "item").agg(F.sum(_wide("many") * _gap(F.col("none"), F.col("p"))).alias("theirs"))
    # what both have, less what the histograms have added for it; a term meets itself, once per source that has it
    left = per.select("lang", "term", "source", "p", "none")
    right = per.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("item_none"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "none", "item_none"))
    both = left.join(right, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(
        _sum_of(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("both"))
    keys = ["lang", "source", "item"]
    rest = (_wide("terms") - _wide("held") - _wide("item_held")) * _gap(p0, q0)
    zero = F.lit(0).cast("decimal(20,0)")
    value = sum((F.coalesce(F.col(c), zero) for c in ("mine", "theirs", "both")), F.coalesce(rest, zero))
    pairs = pairs.join(mine, keys, "left").join(theirs, keys, "left").join(both, keys, "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    whole = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = per.withColumn("q", whole).where("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(p, q).alias("value"))
    # the best of each group are cut out before the shuffle, so no group is ordered whole
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    found = written(pairs.unionByName(above), "divergence")
    scratch.clear(docs.sparkSession)
    return found

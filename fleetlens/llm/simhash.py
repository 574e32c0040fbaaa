"""Operator 5: near duplicates by SimHash and a generalised pigeonhole search.

Every text gets a 64-bit fingerprint of its word shingles. To find all pairs of distinct fingerprints that differ in at
most `most` bits, the 64 bits are grouped into four parts, correlated bits together. If thresholds t1..t4 add up to
most - 4 + 1 (a threshold of -1 skips a part), two fingerprints within `most` bits are within ti bits in some part i.
Each fingerprint picks its own thresholds by dynamic programming over the candidates that each choice would meet, which
the exact histogram of every part's 65,536 values tells. It is posted under its four values and looks up the values
within its thresholds; what meets is verified over all 64 bits.

A value that more fingerprints share than fit one cell is cut into blocks, and every pair of blocks is a cell of its
own, so no task gets more than a bounded share of a hot value. A cell gives no pairs but the links of a shortest
spanning forest: as many rows as it holds at most, and connected just like all its links.

Near copies by a similarity of sets (`near_deduplicated`) take those links for a first round only. What is complete
there are the buckets of bands of smallest hashes: texts of one bucket are measured until all are in one group, or else
against all open texts with which they share one of their rarest shingles, early enough to be alike. Sets are read only
for pairs whose sketches, bits that tell how far two sets are apart at least, leave it open whether they are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from fleetlens.llm.components import components
from fleetlens.llm.shared import WORD_BYTES, Scratch, may_be_in, written

BITS, PARTS, WIDTH = 64, 4, 16
SEED = 42
#: Fingerprints of one value that one cell takes, and pairs that are compared at once. Both only move work.
CELL = 2048
PAIRS = 4_000_000
#: Buckets of a set of shingles: two sets of similarity j share one with a probability of 1 - (1 - j ** ROWS) ** BANDS,
#: which is 0.99997 at 0.8, whatever was edited where.
BANDS, ROWS = 20, 4
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
#: Rounds in which a bucket's texts are measured against some of them, and against how many.
ROUNDS, HUBS = 2, 4
#: Classes of sizes between a text and the smallest that can be alike; more give fewer pairs and more rows. It only moves work.
CLASSES = 4
#: Longs of a sketch of a set. More rule out more pairs of large sets before these are measured. It only moves work.
SKETCH = 16
#: For what rounding takes from a bound.
SLACK = 1e-6



def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words, A-Z lowered, in order; of the whole where there are fewer words."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1:] - 1
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), "<u8", n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without any. As a signed number of 64 bits."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i4")
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(size: int, distinct: bool = False):
    """A function of a text column: the fingerprint over its shingles of `size` words, each counted once if `distinct`."""

    @pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        hashed = (shingle_hashes(t, size) for t in texts)
        return pd.Series([fingerprint_of(np.unique(h) if distinct else h) for h in hashed], dtype="int64")

    return of


# --- the search over distinct fingerprints ---------------------------------------------------------------------------


def _bit_groups(prints: DataFrame) -> list[list[int]]:
    """Four groups of 16 bits, each grown by the bit that correlates most with those it has.

    The co-occurrence counts are sums over all fingerprints: 4,096 numbers.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            both += bits.T @ bits
        yield pd.DataFrame({"at": np.arange(BITS * BITS), "n": both.reshape(-1)})

    rows = prints.select("fp").mapInPandas(counted, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["at"]] = r["n"]
    both = both.reshape(BITS, BITS)
    n = max(1.0, prints.count())
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs((both / n - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = set(range(BITS)), []
    while free:
        left = sorted(free)
        group = [left[int(np.argmax(tied[np.ix_(left, left)].sum(axis=1)))]]
        free.discard(group[0])
        while len(group) < WIDTH:
            left = sorted(free)
            group.append(left[int(np.argmax(tied[np.ix_(left, group)].sum(axis=1)))])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _values(prints: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Of unsigned fingerprints, the value in each part."""
    out = []
    for group in groups:
        value = np.zeros(len(prints), "i8")
        for place, bit in enumerate(group):
            value |= ((prints >> np.uint64(bit)) & np.uint64(1)).astype("i8") << place
        out.append(value)
    return out


def _histogram(prints: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of each part; 4 x 65,536 numbers at any size of the input."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((PARTS, 1 << WIDTH), "i8")
        for batch in batches:
            for part, value in enumerate(_values(batch["fp"].to_numpy("i8").view("u8"), groups)):
                total[part] += np.bincount(value, minlength=1 << WIDTH)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total.reshape(-1)[at]})

    rows = prints.select("fp").mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(PARTS << WIDTH, "i8")
    total[rows["at"].to_numpy("i8")] = rows["n"].to_numpy("i8")
    return total.reshape(PARTS, 1 << WIDTH)


def _costs(histogram: np.ndarray, most: int) -> np.ndarray:
    """[part, t, value]: lookups and candidates within t bits of a value; t counts from -1, which costs nothing."""
    out = np.zeros((PARTS, most + 2, 1 << WIDTH), "f4")
    index = np.arange(1 << WIDTH)
    for part in range(PARTS):
        at = [histogram[part].astype("f8")] + [np.zeros(1 << WIDTH) for _ in range(most)]
        for bit in range(WIDTH):
            turned = index ^ (1 << bit)
            at = [at[0]] + [at[d] + at[d - 1][turned] for d in range(1, most + 1)]
        lookups = 1.0
        for t in range(most + 1):
            lookups = lookups * (WIDTH - t + 1) / t if t else 1.0
            out[part, t + 1] = out[part, t] + at[t] + lookups
    return out


def _thresholds(values: list[np.ndarray], costs: np.ndarray, most: int) -> np.ndarray:
    """[part, row]: each row's cheapest thresholds that add up to most - PARTS + 1, by dynamic programming over parts."""
    units, n = most + 1, len(values[0])  # a threshold of t takes t + 1 units
    best = np.full((units + 1, n), np.inf, "f4")
    best[0] = 0
    picks = []
    for part in range(PARTS):
        step, pick = np.full_like(best, np.inf), np.zeros((units + 1, n), "i1")
        for have in range(units + 1):
            for take in range(have + 1):
                cost = best[have - take] + costs[part, take][values[part]]
                better = cost < step[have]
                step[have] = np.where(better, cost, step[have])
                pick[have][better] = take
        best = step
        picks.append(pick)
    left, out, rows = np.full(n, units), np.zeros((PARTS, n), "i1"), np.arange(n)
    for part in reversed(range(PARTS)):
        out[part] = picks[part][left, rows]
        left = left - out[part]
    return out - 1


def _masks(distance: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), distance)], "i8")


POSTED, SEEKING, PROBE = 0, 1, 2  # a posting; a posting that also looks up its own value; a lookup from elsewhere


def _forest(n: int, u: np.ndarray, v: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the links form a shortest spanning forest over rows 0..n-1: each tree picks its shortest way out, again and again."""
    order = np.argsort(distance, kind="stable")
    label, chosen, live = np.arange(n), [], order
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    while True:
        a, b = label[u[live]], label[v[live]]
        out = a != b
        live, a, b = live[out], a[out], b[out]
        if not len(live):
            break
        best = np.full(n, len(order), "i8")
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        picked = order[np.unique(best[best < len(order)])]
        chosen.append(picked)
        x, y = label[u[picked]], label[v[picked]]
        while True:
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while True:
                ahead = label[label]
                if (ahead == label).all():
                    break
                label = ahead
        label = label[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, "i8")


def _cell_links(cell: np.ndarray, prints: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest links (print, print, bits) inside each run of one cell; rows come sorted by cell and side."""
    n = len(cell)
    new = np.concatenate(([True], cell[1:] != cell[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    run = np.cumsum(new) - 1
    posted_end = start + np.bincount(run, side < PROBE).astype("i8")[run]
    # a posting that seeks meets the postings before it, a lookup meets all postings of its cell
    length = np.where(side == POSTED, 0, np.minimum(np.arange(n), posted_end) - start)
    # rows of one print in one cell are one node
    order = np.lexsort((prints, run))
    other = (prints[order][1:] != prints[order][:-1]) | (run[order][1:] != run[order][:-1])
    node = np.empty(n, "i8")
    node[order] = np.concatenate(([0], np.cumsum(other)))
    seekers = np.flatnonzero(length)
    ends = np.cumsum(length[seekers])
    u, v, d, at = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u1"), 0
    while at < len(seekers):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        rows = seekers[at:to]
        left = np.repeat(rows, length[rows])
        right = start[left] + np.arange(len(left)) - np.repeat(ends[at:to] - length[rows] - before, length[rows])
        bits = np.bitwise_count(prints[left] ^ prints[right])
        near = np.flatnonzero((bits <= most) & (bits > 0))
        if len(near):
            u, v, d = np.concatenate((u, left[near])), np.concatenate((v, right[near])), np.concatenate((d, bits[near]))
            keep = _forest(n, node[u], node[v], d)
            u, v, d = u[keep], v[keep], d[keep]
        at = to
    return prints[u], prints[v], d


def hamming_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, bits): links between distinct fingerprints `fp` (no nulls) of at most `most` bits.

    Links of no more than `most` bits connect two fingerprints through the result exactly if they do in the whole graph.
    The same link may come from several cells.
    """
    spark = prints.sparkSession
    groups = _bit_groups(prints)
    histogram = _histogram(prints, groups)
    shared = spark.sparkContext.broadcast((histogram, _costs(histogram, most)))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, costs = shared.value
        for batch in batches:
            signed = batch["fp"].to_numpy("i8")
            for at in range(0, len(signed), 50_000):
                fp = signed[at:at + 50_000]
                values = _values(fp.view("u8"), groups)
                reach = _thresholds(values, costs, most)
                for part in range(PARTS):
                    seeks = reach[part] >= 0
                    yield from _rows(part, values[part], fp, np.where(seeks, SEEKING, POSTED), counts[part])
                    for distance in range(1, int(reach[part].max(initial=0)) + 1):
                        rows = np.flatnonzero(reach[part] >= distance)
                        masks = _masks(distance)
                        step = max(1, 500_000 // len(masks))
                        for k in range(0, len(rows), step):
                            some = rows[k:k + step]
                            value = (values[part][some, None] ^ masks[None, :]).reshape(-1)
                            source = np.repeat(fp[some], len(masks))
                            there = counts[part][value] > 0
                            value, source = value[there], source[there]
                            yield from _rows(part, value, source, np.full(len(value), PROBE), counts[part])

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            if not len(held):
                continue
            whole = int(held["cell"].searchsorted(held["cell"].iloc[-1], "left"))
            if whole:
                yield _out(held.iloc[:whole])
                held = held.iloc[whole:]
        if held is not None and len(held):
            yield _out(held)

    def _out(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, bits = _cell_links(rows["cell"].to_numpy("i8"), rows["fp"].to_numpy("i8").view("u8"), rows["side"].to_numpy("i1"), most)
        return pd.DataFrame({"a": a.view("i8"), "b": b.view("i8"), "bits": bits.astype("i4")})

    cells = prints.select("fp").mapInPandas(posted, "cell long, side byte, fp long")
    return cells.repartition("cell").sortWithinPartitions("cell", "side").mapInPandas(linked, "a long, b long, bits int")


def _rows(part: int, value: np.ndarray, fp: np.ndarray, side: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows with their cells. A value in one block has one cell; of more blocks, cell (x, y) has the postings of x and
    the lookups of y, so a posting that seeks is also a lookup there."""
    blocks = -(-counts[value] // CELL)
    key = (np.int64(part) << 60) | (value << 44)
    one = blocks <= 1
    yield pd.DataFrame({"cell": key[one], "side": side[one].astype("i1"), "fp": fp[one]})
    many = ~one
    if many.any():
        key, side, fp, blocks = key[many], side[many], fp[many], blocks[many]
        own = (fp.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("i8") % blocks
        for kind, rows in ((POSTED, np.flatnonzero(side != PROBE)), (PROBE, np.flatnonzero(side != POSTED))):
            again = np.repeat(rows, blocks[rows])
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks[rows]) - blocks[rows], blocks[rows])
            x, y = (own[again], other) if kind == POSTED else (other, own[again])
            yield pd.DataFrame({"cell": key[again] | (x << 22) | y, "side": np.full(len(again), kind, "i1"), "fp": fp[again]})


# --- what is built on the search ---------------------------------------------------------------------------------------


def fingerprint_components(docs: DataFrame, shingle: int = 3, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents link where their fingerprints differ in at most `most` bits.

    component_id is the smallest doc_id that can be reached, the row's own included. Null and empty texts have the
    fingerprint 0 and link like any other. Copies are one node of the search. Rows with a null id take part and are
    passed over as names of a component (null where all of it are null); repeated rows give repeated rows; an empty
    table gives none.
    """
    scratch = Scratch()
    marked = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(shingle)(F.col(text)).alias("fp")), "prints")
    prints = scratch.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    if prints.isEmpty():
        return marked.withColumn("component_id", F.col("doc_id"))
    found = components(hamming_links(prints, most).select("a", "b"), scratch)
    named = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = scratch.written(named.select("fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = written(named.join(names, "component").select("fp", "component_id"), "labels")
    scratch.clear(docs.sparkSession)
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def smallest_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of a set of hashes the smallest under each multiplier, its upper 32 bits; two sets agree in each with their similarity."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at:at + 1024] * MULTIPLIERS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype("u4").view("i4")


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Of a set of hashes, whether an odd number fall on each of 64 * SKETCH places.

    A hash that only one of two sets has changes one bit, so two sketches differ in no more bits than there are such hashes.
    """
    odd = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype("i8"), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _signed(size: int):
    """A function of a text column: the fingerprint over its set of words, and size, smallest hashes and sketch of its set of shingles."""

    @pandas_udf("fp long, size int, least array<int>, sketch array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        prints, sizes, least, sketches = [], [], [], []
        for text in texts:
            hashes = np.unique(shingle_hashes(text, size))
            prints.append(fingerprint_of(np.unique(shingle_hashes(text, 1))))
            sizes.append(len(hashes))
            least.append(smallest_hashes(hashes))
            sketches.append(sketch_of(hashes))
        return pd.DataFrame({
            "fp": np.array(prints, "i8"), "size": np.array(sizes, "i4"), "least": pd.Series(least, dtype="object"),
            "sketch": pd.Series(sketches, dtype="object")})

    return of


def _shingle_sets(size: int):
    @pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, size)).view("i8") for t in texts])

    return of


def _may_be_alike(similarity: float) -> Column:
    """False only for pairs (size, sketch, _size, _sketch) of sets whose similarity is below: two sets that are alike are
    apart by (1 - j) / (1 + j) of both sizes at most, and the smaller one has a share j of the larger one."""
    apart = sum(F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("_sketch", F.lit(i)))) for i in range(SKETCH))
    near = apart <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("_size")) + SLACK
    return near & (F.least("size", "_size") >= similarity * F.greatest("size", "_size") - SLACK)


def _bands(least: Column) -> Column:
    """The buckets of a row's smallest hashes, without a Python worker."""
    return F.array(*[F.xxhash64(F.lit(b), *[F.get(least, F.lit(b * ROWS + k)) for k in range(ROWS)]) for b in range(BANDS)])


def _bucketed(texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cell, key, size) of every text (key, size, cells) in each of its buckets that another text shares."""
    every = texts.select("key", "size", F.explode("cells").alias("cell"))
    node = F.xxhash64("key").alias("node")  # equal for two texts of one bucket hardly ever
    shared = every.select("cell", node).groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = scratch.written(shared.select("cell"), f"{name}-buckets")
    return every.where(may_be_in(shared, "cell")(F.col("cell"))).join(shared, "cell").select("cell", "key", "size").distinct()


def _grouped(texts: DataFrame, near: DataFrame) -> DataFrame:
    """`texts` with their component and how many texts it has."""
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("texts"))
    return texts.join(near.withColumnRenamed("node", "key"), "key", "left").join(sizes, "component", "left").withColumns(
        {"component": F.coalesce("component", "key"), "texts": F.coalesce("texts", F.lit(1))})


def _of_several_groups(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of cells that hold more than one group, and `lead`, the cell's largest group."""
    cells = placed.groupBy("cell").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("texts", "component")).alias("lead")).where("lo < hi")
    return scratch.written(placed.join(cells.select("cell", F.col("lead.component").alias("lead")), "cell").drop("texts"), "open")


def _by_rare_shingles(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Texts (key, component, texts) by cells in which any two of two groups meet whose sets can be alike: (cell, key,
    size, component, texts, at, own, other). Other columns of `texts` are carried.

    Shingles that one group alone holds come first, then the others, rarest first. Two sets of a similarity j have
    j / (1 + j) of both sizes in common, none of it before the first shingle they share: so that one stands at a place
    `at` after which each still has as many. A text is posted under the shingles at such places, for each class of sizes
    (`other`) of the texts it can be alike with there; `own` is its class.
    """
    common, carried = similarity / (1 + similarity), texts.columns
    steps = CLASSES / max(-math.log(similarity), 1e-3)
    of_size = lambda n: F.floor(F.log(n) * steps).cast("int")
    named = texts.join(sets.withColumnRenamed("_key", "key"), "key").withColumn("node", F.xxhash64("key"))
    tokens = named.select("node", F.xxhash64("component").alias("group"), F.explode("set").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi")
    held = tokens.join(shared.select("token", "n"), "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    rows = named.select("node", *carried, F.size("set").alias("size")).join(held, "node")
    size, at = F.col("size"), F.col("at")
    least, before = F.ceil(size * similarity - SLACK), size - F.size("shared")
    places = F.greatest(F.lit(0), (F.floor(size - common * (size + least) + SLACK) + 1 - before).cast("int"))
    rows = rows.select(*carried, "size", least.alias("least"), before.alias("before"), F.posexplode(F.slice("shared", 1, places)))
    rows = rows.select(*carried, "size", "least", (F.col("before") + F.col("pos")).alias("at"), F.col("col.token").alias("token"))
    most = F.floor(F.least(size / similarity, (size - at) / common - size) + SLACK)
    rows = rows.withColumns({"own": of_size(size), "most": most}).where("most >= least")
    rows = rows.withColumn("other", F.explode(F.sequence(of_size(F.col("least")), of_size(F.col("most")))))
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(cell.alias("cell"), "size", *carried, "at", "own", "other")


def _against_hubs(placed: DataFrame, step: int) -> DataFrame:
    """(key, size, sketch, _key, _size, _sketch): a bucket's texts with some of them, picked by a hash anew in every step."""
    text = F.struct("key", "size", "sketch", "component")
    picks = [F.min_by(text, F.xxhash64(F.lit(step * HUBS + i), "key")) for i in range(HUBS)]
    hubs = placed.groupBy("cell").agg(F.array_distinct(F.array(*picks)).alias("hubs")).select("cell", F.explode("hubs").alias("hub"))
    hubs = hubs.select("cell", *[F.col(f"hub.{c}").alias(f"_{c}") for c in ("key", "size", "sketch", "component")])
    return placed.join(hubs, "cell").where("component <> _component")


def _across_groups(placed: DataFrame, similarity: float) -> DataFrame:
    """(key, size, …, _key, _size, …): each text of a cell that is not of its largest group with those of other groups."""
    few = placed.where("component <> lead").drop("lead")
    every = placed.select("cell", *[F.col(c).alias(f"_{c}") for c in placed.columns if c not in ("cell", "other")])
    left = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
    enough = left >= similarity / (1 + similarity) * (F.col("size") + F.col("_size")) - SLACK
    # two texts of small groups meet twice, once is enough
    return few.join(every, "cell").where("component <> _component and (_component = _lead or key < _key) and other = _own").where(enough)


def near_deduplicated(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 6, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of `docs` without near copies: of each group one stays, that with the smallest id (nulls last).

    Equal texts are one group. Other texts are in one group if links connect them: pairs of a Jaccard similarity of
    `similarity` or more over their sets of `shingle` words, measured on the whole texts. The first round measures the
    shortest forest of a search by a fingerprint over the sets of words, which scattered edits move by a few bits. It
    joins most copies, and what it leaves out costs nothing, for the rounds after it take the buckets of smallest hashes:
    each text against a few of its bucket, and at last, of the texts that are in a bucket with other groups, every pair
    of two groups that can be alike by the rarest shingle it shares: none is missed there. In every round pairs that are
    too far apart by their sizes or sketches to be alike are left out before their sets are joined. Null and empty texts are equal
    texts. Of rows that are equal in id and text one stays. An empty table stays empty; all columns are carried, whatever
    their names.
    """
    raw = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    scratch = Scratch()
    marked = scratch.written(docs.select(
        raw.alias("key"), F.col(doc_id).alias("id"), _signed(shingle)(F.col(text)).alias("s")).select("key", "id", "s.*"), "prints")
    rows = marked.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("fp", "size", "sketch")])
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    classes = scratch.written(rows.groupBy("key").agg(
        first, F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("fp", "size", "sketch")]), "classes")
    if classes.isEmpty():
        return docs
    prints = scratch.written(classes.groupBy("fp").agg(F.min(F.struct("key", "size", "sketch")).alias("lead")), "leads")
    links = scratch.written(hamming_links(prints, most).select("a", "b").distinct(), "candidates")
    one, two = (prints.select(F.col("fp").alias(x), *[F.col(f"lead.{c}").alias(f"{u}{c}") for c in ("key", "size", "sketch")])
                for x, u in (("a", ""), ("b", "_")))
    both = ["key", "size", "sketch", "_key", "_size", "_sketch"]
    far = links.join(one, "a").join(two, "b").select(both)
    same = classes.join(two.withColumnRenamed("b", "fp"), "fp").where("key <> _key").select(both)
    ordered = (F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b"))
    pairs = scratch.written(far.union(same).where(_may_be_alike(similarity)).select(*ordered).distinct(), "pairs")
    members = _bucketed(marked.select("key", "size", _bands(F.col("least")).alias("cells")), scratch, "coarse")
    members = scratch.written(members.join(classes.select("key", "sketch"), "key"), "members")
    # the sets of shingles, once for each text of a candidate
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(members.select("key"))
    wanted = scratch.written(wanted.distinct(), "wanted")
    holders = wanted.join(classes, "key").select(F.col("key").alias("_key"), F.col("first.id").alias("_id"))
    texts = docs.select(raw.alias("_key"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    texts = texts.where(may_be_in(wanted, "key")(F.col("_key")))
    sets = texts.join(holders.withColumnRenamed("_id", "_own"), "_key").where(F.col("_id").eqNullSafe(F.col("_own")))
    sets = scratch.written(sets.select("_key", _shingle_sets(shingle)(F.col("_text")).alias("set")), "sets")
    sets = sets.groupBy("_key").agg(F.any_value("set").alias("set"))
    a, b = (sets.select(F.col("_key").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = both >= similarity * (F.size("set_a") + F.size("set_b") - both)
    measured, links, step = pairs, None, 0
    while True:
        found = scratch.written(pairs.join(a, "a").join(b, "b").where(alike).select("a", "b"), "alike")
        links = found if links is None else links.union(found)
        near = components(links, scratch)
        if step > ROUNDS:
            break
        placed = _of_several_groups(_grouped(members, near), scratch)
        if step < ROUNDS:
            met = _against_hubs(placed, step)
        else:
            asked = scratch.written(_grouped(placed.select("key", "sketch").distinct(), near), "asked")
            rare = scratch.written(_by_rare_shingles(asked, sets, similarity), "rare")
            met = _across_groups(_of_several_groups(rare, scratch), similarity)
        asked = met.where(_may_be_alike(similarity)).select(*ordered).distinct()
        pairs = scratch.written(asked.join(measured, ["a", "b"], "left_anti"), "pairs")
        measured, step = measured.union(pairs), step + 1
    grouped = scratch.written(near.join(classes, near["node"] == classes["key"]).select("component", "key", "first"), "groups")
    stays = scratch.written(
        grouped.groupBy("component").agg(F.min(F.struct("first.none", "first.id", "key")).alias("stays")), "stays")
    dropped = grouped.join(stays, "component").where(F.col("key") != F.col("stays.key")).select("key", F.lit(True).alias("drop"))
    # one decision for each text that is dropped or that several rows hold
    decided = classes.join(dropped, "key", "left").where("drop or n > 1").select(
        "key", F.coalesce("drop", F.lit(False)).alias("drop"), F.col("first.id").alias("own"), F.col("first.n").alias("n"))
    decided = written(decided, "decided")
    scratch.clear(docs.sparkSession)
    # most texts are decided by nothing and stay where they are; the columns of `docs` are in a struct of their own
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), raw.alias("key"), F.col(doc_id).alias("id"))
    asked = may_be_in(decided, "key")(F.col("key"))
    judged = keyed.where(asked).join(decided, "key", "left").where(F.col("drop").isNull() | (~F.col("drop") & F.col("id").eqNullSafe(F.col("own"))))
    single = judged.where("n is null or n = 1").select("row")
    repeated = judged.where("n > 1").dropDuplicates(["key"]).select("row")
    return keyed.where(~asked).select("row").unionByName(single).unionByName(repeated).select("row.*")

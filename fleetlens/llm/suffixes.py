"""Operator 4: repeated byte strings across documents by merging Burrows-Wheeler transforms.

Suffixes are compared on their first `length` bytes only, and only where they can repeat. Every window of `length` bytes
has an anchor, the smallest hash among its short substrings; equal windows have equal anchors, and neighbouring windows
mostly share one and form a fragment. First, anchors are counted: one that a single document holds repeats nothing. Then
the fragments with repeated anchors travel to a bucket by their anchor. In a bucket, the fragments that came from one
shard of the text get a Burrows-Wheeler transform, and the transforms are merged by refining how their rows interleave:
in round h the rows stand sorted by their first h bytes, found by one stable pass over the symbols before them. Where a
round parts neighbours is their common prefix; the rows still together after `length` rounds are the repeated
intervals. The smallest document of each interval goes back to the shards, which mark and remove what it covers.

Texts are written once in blocks and never shuffled. What is shuffled is packed: anchors, distinct fragments and answers,
in buckets whose number follows the bytes of text. Answers are written by block, and the task that reads a block's texts
again reads its answers from the shared folder.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import written
from fleetlens.session import fresh_path

LENGTH = 50
ANCHOR = 20
#: Bytes of text that are cut at once, bytes of text per bucket, symbols merged at once: all only move work.
CHUNK, BUCKET, BATCH = 3 << 20, 4 << 20, 1 << 18
#: Windows of a fragment at most, and transforms that are merged at once.
RUN, SHARDS = 64, 8
#: After so many rounds of a merge each time, finished strings are taken out of it.
EVERY = 8
NO_ID = 2**63 - 1


# --- fragments ---------------------------------------------------------------------------------------------------------


def _grams(data: bytes) -> np.ndarray:
    """A mixed 64-bit hash of every substring of `ANCHOR` bytes, which three overlapping words of eight bytes hold."""
    n = len(data) - ANCHOR + 1
    word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    for at, factor in ((8, 0xBF58476D1CE4E5B9), (ANCHOR - 8, 0x94D049BB133111EB)):
        out += word[at:at + n]
        out *= np.uint64(factor)
        out ^= out >> np.uint64(31)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size:width - size + n])


class Cut:
    """The fragments of a chunk of texts: where they start in `data`, how many windows they have, their anchor and piece."""

    def __init__(self, pieces: list[bytes], length: int) -> None:
        self.data = b"".join(pieces)
        self.ends = np.cumsum([len(p) for p in pieces])
        n = len(self.data) - length + 1
        empty = np.zeros(0, "i8")
        self.at, self.run, self.anchor, self.piece = empty, empty, empty.astype("u8"), empty
        if n <= 0:
            return
        least = _least(_grams(self.data), length - ANCHOR + 1)
        whole = np.ones(n + 1, bool)
        whole[n] = False
        for end in self.ends[:-1].tolist():
            whole[max(0, end - length + 1):end] = False
        first = np.concatenate(([True], (least[1:] != least[:-1]) | ~whole[:n - 1])) & whole[:n]
        at = np.flatnonzero(first)
        if not len(at):
            return
        borders = np.flatnonzero(np.concatenate((first | ~whole[:n], [True])))
        run = borders[np.searchsorted(borders, at, "right")] - at
        parts = -(-run // RUN)
        again = np.repeat(np.arange(len(at)), parts)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.at = at[again] + nth * RUN
        self.run = np.minimum(run[again] - nth * RUN, RUN)
        # smallest hashes are small; multiplied, they spread over all buckets
        self.anchor = least[self.at] * np.uint64(0xD6E8FEB86659FD93)
        self.piece = np.searchsorted(self.ends, self.at, "right")


def _chunks(ids: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts by the chunk with their document's id, row and place; long texts are cut with an overlap."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHUNK):
            if at and at + length - 1 >= len(text):
                break
            piece = text[at:at + CHUNK + length - 1]
            if held and size + len(piece) > CHUNK:
                yield _pieces(held, ids)
                held, size = [], 0
            held.append((piece, row, at))
            size += len(piece)
    if held:
        yield _pieces(held, ids)


def _pieces(held: list, ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    rows = np.array([r for _, r, _ in held])
    return [p for p, _, _ in held], ids[rows], rows, np.array([a for _, _, a in held])


# --- packed rows ---------------------------------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte place by byte place, so that high zero bytes compress away."""
    steps = np.diff(values, prepend=np.zeros(1, "u8"))
    return zlib.compress(np.ascontiguousarray(steps.astype("<u8").view("u1").reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype="u8")


def _buckets(sorted_anchors: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to): anchors are spread evenly, so a bucket is a range of them."""
    of = ((sorted_anchors >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, "i8")
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(of[a]), a, b


class Shelf:
    """Answers that were written by block, read by the task that has the block."""

    def __init__(self, folder: str) -> None:
        self.store, self.base = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))

    def of(self, block: int) -> list[bytes]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.base}/block={block}", allow_not_found=True))
        out: list[bytes] = []
        for info in found:
            if info.base_name.endswith(".parquet"):
                with self.store.open_input_file(info.path) as file:
                    out += parquet.read_table(file, columns=["data"])["data"].to_pylist()
        return out


def _shelved(answers: DataFrame, name: str) -> str:
    folder = fresh_path(answers.sparkSession, f"llm-{name}")
    answers.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


# --- merging transforms ---------------------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, left: np.ndarray, string: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes of strings that end in 0 each (`left`: symbols before that end). Ends differ by string.

    Suffixes that agree in over `depth` symbols may stand in any order: a merge of `depth` rounds takes one of them for
    the other, and they are in one interval throughout. Keys hold a row's place in their low bits, so that sorting them
    sorts the rows.
    """
    return ranked_order(symbols, left, string, depth)[0]


def ranked_order(symbols: np.ndarray, left: np.ndarray, string: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """As `suffix_order`, and the ranks of the suffixes by their first symbols, at most `depth`, and by how many.

    Ranks are equal where these symbols are, but ends, which the first doubling tells apart, have ranks of their own:
    where `depth` has no room for it, no symbols count.
    """
    n = len(symbols)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    places = np.arange(n, dtype="u8")
    width = min(7, (64 - int(bits)) // 8)
    key = np.zeros(n, "u8")
    for i in range(width):
        symbol = np.zeros(n, "u8")
        symbol[:n - i] = symbols[i:]
        key = (key << np.uint64(8)) | np.where(left >= i, symbol, 0)

    rank = np.empty(n, "u8")

    def ranked(keys: np.ndarray) -> np.ndarray:
        if 3 * int(bits) > 64:  # no room for places
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
        else:
            keys = np.sort((keys << bits) | places)
            order = (keys & low).astype("i8")
            keys >>= bits
        rank[order] = np.cumsum(np.concatenate((np.zeros(1, "u8"), (keys[1:] != keys[:-1]).astype("u8"))))
        return order

    order = ranked(key)
    early, begun = rank, 0
    while width <= depth + 1 and rank.max(initial=0) < n - 1:
        ahead = np.where(left < width, string, 0).astype("u8")
        far = np.flatnonzero(left >= width)
        ahead[far] = rank[far + width]
        order = ranked((rank << bits) | ahead)
        width *= 2
        if width <= depth:
            early, begun = rank.copy(), width
    return order, early, begun


def merged_intervals(
    transforms: list[np.ndarray], string: np.ndarray, window: np.ndarray, rounds: int,
    ranks: np.ndarray | None = None, begun: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """(row, interval) of rows that may agree with others in their first `rounds` symbols.

    Rows are those of the transforms, one transform after the other; `string` is a row's string and `window` tells the
    rows that are asked for. `interval` numbers the runs of rows that agree. Rows of the end symbol 0 stand by transform
    and string, all apart. A string whose asked rows are all apart is finished: it is taken out of all transforms, in
    which the rows of the others stand as before, and further rounds pass over what is left. `ranks` of the rows by their
    first `begun` symbols, with all ends apart, stand for as many rounds.
    """
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype="u1"), [len(t) for t in transforms])
    rows = np.arange(len(symbols))
    interleave, interval = shard.copy(), np.zeros(len(symbols), "i4")
    place = rows
    if begun:
        order = np.argsort(ranks, kind="stable")
        interleave, interval = shard[order], ranks[order].astype("i4")
        place = np.argsort(interleave, kind="stable")
    for done in range(begun + 1, rounds + 1):
        n = len(symbols)
        end_shards = shard[symbols == 0]
        ends = len(end_shards)
        before = np.empty(n, symbols.dtype)
        before[place] = symbols
        order = np.argsort(before, kind="stable")
        interleave = interleave[order]
        interleave[:ends] = end_shards
        old = interval[order]
        parted = np.empty(n, bool)
        np.not_equal(old[1:], old[:-1], out=parted[1:])
        parted[:ends + 1] = True
        begins = np.cumsum(np.bincount(before))  # where the next symbol begins
        parted[begins[begins < n]] = True
        interval = np.cumsum(parted, dtype="i4")
        interval -= 1
        place = np.argsort(interleave, kind="stable")
        if done % EVERY == 0 and done < rounds:
            apart = parted & np.append(parted[1:], True)
            open_ = np.zeros(len(window), bool)
            open_[string[window[rows] & ~apart[place]]] = True
            kept = open_[string]
            if not kept.any():
                return rows[:0], interval[:0]
            if kept.mean() < 0.9:
                still = np.empty(n, bool)
                still[place] = kept
                interleave, interval = interleave[still], interval[still]
                symbols, shard, rows, string = symbols[kept], shard[kept], rows[kept], string[kept]
                place = np.argsort(interleave, kind="stable")
    return rows, interval[place]


def smallest_holders(strings: list[bytes], docs: np.ndarray, source: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of every string the smallest document whose string has the same window; `source`: a string's shard."""
    # the strings of a shard after those of the one before; all are ordered at once, and each shard has its part of the order
    by_shard = np.argsort(source, kind="stable")
    sizes = np.array([len(strings[i]) for i in by_shard])
    text = np.frombuffer(b"\xff".join([strings[i] for i in by_shard]) + b"\xff", "u1") + np.uint8(1)  # \xff, in no UTF-8, becomes 0
    stops = np.cumsum(sizes + 1) - 1
    string = np.repeat(np.arange(len(by_shard)), sizes + 1)
    left = stops[string] - np.arange(len(text))
    order, ranks, begun = ranked_order(text, left, string, length)
    of = source[by_shard][string]
    order = order[np.argsort(of[order], kind="stable")]
    begins = left[order] == sizes[string[order]]
    before = np.where(begins, 0, text[order - 1]).astype("u1")
    transforms = np.split(before, np.flatnonzero(of[1:] != of[:-1]) + 1)
    ranks, string, offset = ranks[order], by_shard[string[order]], (sizes[string] - left)[order]
    sizes = np.array([len(s) for s in strings])
    window = offset + length <= sizes[string]
    rows, interval = merged_intervals(transforms, string, window, length, ranks, begun)
    asked = window[rows]
    rows, interval = rows[asked], interval[asked]
    string, offset = string[rows], offset[rows]
    least = np.full(int(interval.max(initial=0)) + 1, NO_ID)
    np.minimum.at(least, interval, docs[string])
    windows = sizes - length + 1
    starts = np.cumsum(windows) - windows
    out = np.repeat(docs, windows)
    out[starts[string] + offset] = least[interval]
    return np.split(out, starts[1:])


def _group_holders(anchor: np.ndarray, strings: list[bytes], docs: np.ndarray, source: np.ndarray, length: int) -> list[np.ndarray]:
    """As `smallest_holders`, in batches: equal windows have equal anchors, so anchors may be taken apart.

    A fragment that alone has its anchor meets no other one, and is its own answer.
    """
    out: list[np.ndarray] = [np.full(len(s) - length + 1, d) for s, d in zip(strings, docs)]
    order = np.argsort(anchor, kind="stable")
    ordered = anchor[order]
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    batch: list[int] = []
    size = 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            own = order[a:b].tolist()
            batch += own
            size += sum(len(strings[i]) for i in own)
        if batch and (size >= BATCH or b == len(order)):
            for i, least in zip(batch, smallest_holders([strings[i] for i in batch], docs[batch], source[batch], length)):
                out[i] = least
            batch, size = [], 0
    return out


# --- the job ---------------------------------------------------------------------------------------------------------------


def _keys(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), "u8", len(strings))


def _by_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    for batch in batches:
        for block, part in batch.groupby("block", sort=False):
            for at in range(0, len(part), 1000):
                yield int(block), part.iloc[at:at + 1000]


def repeats_removed(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of `docs`.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id (nulls come last
    and count as one). Strings are looked for in the texts as they came, overlaps count, and none crosses documents. A
    null text is empty; texts under `length` bytes stay whole; rows of one id, and so repeated rows, take nothing from
    each other; an empty table gives no rows. Texts are UTF-8 and read whole, however long.
    """
    texts = written(docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(doc_id).isNull().alias("nameless"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        F.spark_partition_id().alias("block")), "texts")
    total = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]]:
        for block, part in _by_block(batches):
            yield from ((block, *chunk, part) for chunk in _chunks(part["doc_id"].to_numpy("i8"), list(part["text"]), length))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A chunk's anchors, each once; the last bit tells that two documents of the chunk hold it."""
        for block, pieces, ids, _, _, _ in chunks(batches):
            cut = Cut(pieces, length)
            own = cut.anchor & ~np.uint64(1)
            order = np.lexsort((ids[cut.piece], own))
            own, of = own[order], ids[cut.piece][order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, "i8")
            last = np.concatenate((first[1:], [len(own)])) - 1 if len(first) else first
            own = own[first] | (of[first] != of[last]).astype("u8")
            rows = [(bucket, block, _packed(own[a:b])) for bucket, a, b in _buckets(own, buckets)]
            yield pd.DataFrame(rows, columns=["bucket", "block", "data"])

    def repeated(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, which of its anchors several documents hold."""
        held = [_unpacked(d) for d in rows["data"]]
        every = np.concatenate(held)
        chunk = np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(every >> np.uint64(1), kind="stable")
        bare = every[order] >> np.uint64(1)
        same = bare[1:] == bare[:-1]
        several = (every[order] & np.uint64(1)).astype(bool)
        several[1:] |= same
        several[:-1] |= same
        chunk, bare = chunk[order][several], bare[several] << np.uint64(1)
        order = np.argsort(chunk, kind="stable")
        edges = np.searchsorted(chunk[order], np.arange(len(held) + 1))
        parts = (bare[order[x:y]] for x, y in zip(edges[:-1], edges[1:]))
        return pd.DataFrame([(k, _packed(p)) for k, p in zip(rows["block"], parts) if len(p)], columns=["block", "data"])

    counted = texts.mapInPandas(anchors, "bucket int, block int, data binary").groupBy("bucket").applyInPandas(
        repeated, "block int, data binary")
    anchor_folder = _shelved(counted, "anchors")

    def candidates(cut: Cut, known: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The fragments with repeated anchors, and their bytes."""
        own = cut.anchor & ~np.uint64(1)
        at = np.searchsorted(known, own)
        some = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == own) if len(known) else np.zeros(0, "i8")
        starts = cut.at[some]
        stops = starts + cut.run[some] + length - 1
        return some, [cut.data[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    def known_anchors(shelf: Shelf, block: int) -> np.ndarray:
        found = [_unpacked(d) for d in shelf.of(block)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, "u8")

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A chunk's different fragments by bucket: anchors, lengths, smallest and largest document, bytes."""
        shelf, at_block, known = Shelf(anchor_folder), None, None
        for block, pieces, ids, _, _, _ in chunks(batches):
            if block != at_block:
                at_block, known = block, known_anchors(shelf, block)
            cut = Cut(pieces, length)
            some, strings = candidates(cut, known)
            if not strings:
                continue
            numbers: dict[bytes, int] = {}
            of = np.fromiter((numbers.setdefault(s, len(numbers)) for s in strings), "i8", len(strings))
            strings, own = list(numbers), ids[cut.piece[some]]
            least, most, anchor = np.full(len(strings), NO_ID), np.full(len(strings), np.iinfo("i8").min), np.empty(len(strings), "u8")
            np.minimum.at(least, of, own)
            np.maximum.at(most, of, own)
            anchor[of] = cut.anchor[some] & ~np.uint64(1)
            order = np.argsort(anchor, kind="stable")
            rows = []
            for bucket, a, b in _buckets(anchor[order], buckets):
                part = order[a:b]
                sizes = np.array([len(strings[i]) for i in part], "<u2").tobytes()
                ends = np.concatenate((least[part], most[part])).astype("<i8").tobytes()
                body = zlib.compress(sizes + ends + b"".join([strings[i] for i in part]), 1)
                rows.append((bucket, block, b - a, _packed(anchor[part]), body))
            yield pd.DataFrame(rows, columns=["bucket", "block", "n", "anchors", "body"])

    def answered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, runs of windows of its fragments with the smallest document that holds them."""
        numbers: dict[bytes, int] = {}
        anchor, docs_of, source, sent = [], [], [], []
        for k, (n, packed, body) in enumerate(zip(rows["n"], rows["anchors"], rows["body"])):
            raw, own = zlib.decompress(body), _unpacked(packed)
            sizes = np.frombuffer(raw, "<u2", n).astype("i8")
            least, most = np.frombuffer(raw, "<i8", 2 * n, 2 * n).reshape(2, n)
            at, mine = 18 * n, []
            for size, a, doc in zip(sizes.tolist(), own.tolist(), least.tolist()):
                string = raw[at:at + size]
                at += size
                i = numbers.setdefault(string, len(numbers))
                if i == len(anchor):
                    anchor.append(a)
                    docs_of.append(doc)
                    source.append(k % SHARDS)
                elif doc < docs_of[i]:
                    docs_of[i] = doc
                mine.append(i)
            sent.append((mine, most))
        strings = list(numbers)
        holders = _group_holders(np.array(anchor, "u8"), strings, np.array(docs_of, "i8"), np.array(source), length)
        keys = _keys(strings)
        smallest = np.array([h.min() for h in holders])
        out = []
        for block, (mine, most) in zip(rows["block"], sent):
            mine = np.array(mine)
            mine = mine[smallest[mine] < most]
            if not len(mine):
                continue
            body = [keys[mine].astype("<u8").tobytes()]
            runs, counts, holder = [], [], []
            for i in mine.tolist():
                h = holders[i]
                edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) > 1 else np.zeros(1, "i8")
                counts.append(len(edge))
                runs.append(np.diff(np.append(edge, len(h))))
                holder.append(h[edge])
            body += [np.array(counts, "u1").tobytes(), np.concatenate(runs).astype("u1").tobytes(), np.concatenate(holder).astype("<i8").tobytes()]
            out.append((block, zlib.compress(np.array([len(mine), sum(counts)], "<i8").tobytes() + b"".join(body), 1)))
        return pd.DataFrame(out, columns=["block", "data"])

    sent = texts.mapInPandas(fragments, "bucket int, block int, n int, anchors binary, body binary")
    answer_folder = _shelved(sent.groupBy("bucket").applyInPandas(answered, "block int, data binary"), "answers")

    def known_answers(shelf: Shelf, block: int) -> tuple[np.ndarray, ...]:
        """Sorted keys, and for each the first of its runs in the lists of run lengths and holders."""
        keys, counts, runs, holders = [np.zeros(0, "u8")], [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for data in shelf.of(block):
            raw = zlib.decompress(data)
            n, m = np.frombuffer(raw, "<i8", 2).tolist()
            keys.append(np.frombuffer(raw, "<u8", n, 16))
            counts.append(np.frombuffer(raw, "u1", n, 16 + 8 * n).astype("i8"))
            runs.append(np.frombuffer(raw, "u1", m, 16 + 9 * n).astype("i8"))
            holders.append(np.frombuffer(raw, "<i8", m, 16 + 9 * n + m))
        key, count = np.concatenate(keys), np.concatenate(counts)
        first = np.cumsum(count) - count
        order = np.argsort(key, kind="stable")
        return key[order], first[order], count[order], np.concatenate(runs), np.concatenate(holders)

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelf, answers, at_block, known, answer = Shelf(anchor_folder), Shelf(answer_folder), None, None, None
        part_now, cover = None, {}
        for block, pieces, ids, rows, places, part in chunks(batches):
            if part is not part_now:
                if part_now is not None:
                    yield _reported(part_now, cover, length, with_text)
                part_now, cover = part, {}
            if block != at_block:
                at_block, known, answer = block, known_anchors(shelf, block), known_answers(answers, block)
            cut = Cut(pieces, length)
            some, strings = candidates(cut, known)
            if not strings or not len(answer[0]):
                continue
            own = _keys(strings)
            at = np.minimum(np.searchsorted(answer[0], own), len(answer[0]) - 1)
            found = answer[0][at] == own
            some, at = some[found], at[found]
            first, count = answer[1][at], answer[2][at]
            entry = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            run, holder = answer[3][entry], answer[4][entry]
            piece = np.repeat(cut.piece[some], count)
            begin = np.cumsum(run) - run  # windows of one fragment follow each other in its runs
            base = np.repeat((np.cumsum(cut.run[some]) - cut.run[some]), count)
            start = np.repeat(cut.at[some], count) + begin - base
            gone = holder < ids[piece]
            start, run, piece = start[gone], run[gone], piece[gone]
            inside = start - (cut.ends[piece] - np.array([len(p) for p in pieces])[piece]) + places[piece]
            for row, a, n in zip(rows[piece].tolist(), inside.tolist(), run.tolist()):
                cover.setdefault(row, []).append((a, a + n + length - 1))
        if part_now is not None:
            yield _reported(part_now, cover, length, with_text)

    schema = "doc_id long, nameless boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    done = texts.mapInPandas(removed, schema)
    return done.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def _reported(part: pd.DataFrame, cover: dict[int, list[tuple[int, int]]], length: int, with_text: bool) -> pd.DataFrame:
    out = []
    for row, text in enumerate(part["text"]):
        kept, at, gone, spans, end = [], 0, 0, 0, -1
        for a, b in sorted(cover.get(row, ())):
            if a > end:  # not even touching the run before
                spans += 1
                kept.append(text[at:a])
                gone += b - a
            elif b > end:
                gone += b - end
            end = at = max(end, b)
        kept = text[at:] if not kept else b"".join([*kept, text[at:]])
        out.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
    frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    frame.insert(0, "doc_id", part["doc_id"].to_numpy())
    frame.insert(1, "nameless", part["nameless"].to_numpy())
    return frame if with_text else frame.drop(columns="kept")

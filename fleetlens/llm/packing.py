"""Operator 10: packing token sequences, sum of squares.

Texts become token ids inside tasks; only the length, place and checksum of every piece travel. Pieces are dealt at
random into bounded groups, and each group is packed on its own: longest piece first, each to the place where the sum
over all residual gaps of the squared number of open sequences with that gap becomes smallest. Pieces of one length are
alike, so a group is a histogram of lengths while it is packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import written

CAPACITY = 2048
END = 0
#: Pieces of one group; a group leaves a few sequences that are not full, so larger ones pack a little tighter.
GROUP = 50_000
#: Parts of words whose ids a worker remembers; further ones are encoded anew.
REMEMBERED = 600_000
#: Characters of text that are encoded at once: they only move work.
AT_ONCE = 4 << 20

_MARKS = ".,;:!?"


class Encoder:
    """Token ids of texts, by a tokenizer that lowers letters, drops white space and never joins across it.

    Such a tokenizer gives a text the ids of its words in turn, and a word the ids of its letters and then those of the
    marks at its end. So the ids of what has been seen are remembered, for the life of the Python worker.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        kept = vars(tokenizers).setdefault("_seen_by_encoders", {})
        if path not in kept:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            last = np.zeros(tokenizer.get_vocab_size(), bool)
            last[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            kept[path] = (tokenizer, last, {})
        self.tokenizer, self.last, self.parts = kept[path]

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts. Those of letters alone are encoded together: each ends with a token that ends a word."""
        found, plain = {}, [p for p in parts if p.isalpha()]
        if plain:
            ids = self._encoded(" ".join(plain))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                found = {p: raw[at[i]:at[i + 1]] for i, p in enumerate(plain)}
        for part in parts:
            if part not in found:
                found[part] = self._encoded(part).tobytes()
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of different words, by those of its letters and of the marks at its end."""
        cores, marks = [], []
        for word in words:
            core = word.rstrip(_MARKS)
            if not core[-1:].isalpha():
                core = word
            marks.append(word[len(core):])
            # not where special tokens are written
            cores.append(core.lower() if core.isascii() and "<|" not in core else core)
        ids = {"": b""}
        parts = {*cores, *marks} - ids.keys()
        for part, known in zip(parts, map(self.parts.get, parts)):
            ids[part] = known
        learnt = self._learn([part for part, known in ids.items() if known is None])
        ids.update(learnt)
        if len(self.parts) < REMEMBERED:
            self.parts.update(learnt)
        return [ids[core] + ids[mark] if mark else ids[core] for core, mark in zip(cores, marks)]


    def ids(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text, and its end mark."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > AT_ONCE:
                yield from self._ids(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._ids(held)

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each spelling of all texts is looked up once; texts are put together from its ids."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = pc.dictionary_encode(pc.list_flatten(cut))
        of, found = words.indices.to_numpy(), self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        every = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), "i8", len(found)) // 4
        begin, n = (np.cumsum(sizes) - sizes)[of], sizes[of]
        stop = np.cumsum(n)
        ids = every[np.repeat(begin - stop + n, n) + np.arange(int(n.sum()))]
        words_to = np.cumsum(pc.list_value_length(cut).to_numpy())
        ends = np.concatenate((np.zeros(1, "i8"), stop))[words_to].tolist()
        at = 0
        for end in ends:
            yield np.append(ids[at:end], np.uint32(END))
            at = end


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Pieces are taken longest first; ties of places go to the smaller gap."""
    order = np.argsort(-lengths, kind="stable")
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap
    count = np.zeros(capacity + 1, "i8")
    used: list[int] = []
    sequence, offset = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    for at in order.tolist():
        size = int(lengths[at])
        # a sequence of gap g becomes one of gap g - size: the sum changes by 2 * (count[g - size] - count[g] + 1)
        # (gap 0 is closed and not counted); a new sequence is opened only where no open one has room
        gain = 2 * count[:capacity + 1 - size] - 2 * count[size:] + 2
        gain[0] = 1 - 2 * count[size]
        gain[count[size:] == 0] = np.iinfo("i8").max
        best = int(np.argmin(gain))
        if gain[best] < np.iinfo("i8").max:
            gap = best + size
            place = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, place = capacity, len(used)
            used.append(0)
        sequence[at], offset[at] = place, used[place]
        used[place] += size
        if gap - size:
            open_at[gap - size].append(place)
            count[gap - size] += 1
    return sequence, offset


def _cut(pieces: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of a document's ids; only what is longer than a sequence is cut."""
    for piece, start in enumerate(range(0, len(pieces), capacity)):
        part = pieces[start:start + capacity]
        yield piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every row; a null or empty text is its end mark alone."""

    def pieced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at:at + 2048]
                rows = [(k, *cut) for k, ids in enumerate(encoder.ids(part["text"])) for cut in _cut(ids, capacity)]
                out = pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"])
                yield part[["doc_id"]].iloc[out["k"].to_numpy()].reset_index(drop=True).join(out.drop(columns="k"))

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(pieced, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    A sequence holds at most `capacity` tokens, its pieces follow each other from 0 without gaps. Every row of `docs` is
    packed, repeated rows and rows with a null id too; an empty table gives no rows.
    """
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, doc_id, text), "pieces")
    whole, parts = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, round(parts.count() / GROUP))
    # Full pieces are sequences by themselves; their numbers are below 0, so that they need no shuffle.
    alone = whole.withColumns({"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long")})
    # Copies of a row differ in nothing, so pieces are dealt by number: equal shares, whatever is repeated.
    dealt = parts.withColumn("_group", F.monotonically_increasing_id() % groups)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alone.schema)

    def placed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        sequence, offset = sum_of_squares(rows["length"].to_numpy("i8"), capacity)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return alone.unionByName(dealt.groupBy("_group").applyInPandas(placed, schema))

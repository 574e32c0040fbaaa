"""Operator 11: token counts by a compiled tokenizer.

A byte-pair tokenizer is compiled into two deterministic transducers, which count tokens without making any.

The first reads classes of characters and marks where words start. It has nine states, so what a chunk of text does to
them is one element of a small monoid of state maps: chunks are multiplied out side by side, a prefix scan composes the
products, and the start state of every chunk follows.

The second reads the bytes of words. Its state holds, for every place from which a token may still reach on, how far in
the vocabulary's tree that token is, the token before it, and by how many tokens that place is ahead; what is certain
for all places is annotated on the transition as the number of tokens emitted. Which token follows which is decided by
their merges alone, so a state never grows with the text. States are built when a text first asks for them, stay in the
Python worker and are forgotten when they are many. Every word starts in the same state, so all words of a slab run
abreast; words longer than a chunk are cut into chunks that run abreast from a guessed state, and their maps are put
right where the chunk before ends in another one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: Characters that are looked at together, and bytes of a chunk. Both only move work.
SLAB, CHUNK = 1 << 20, 64
#: Bytes of the tables of transitions that a worker keeps from one slab to the next.
KEPT = 1 << 27

# --- words ---------------------------------------------------------------------------------------------------------------

#: The pattern of words this transducer is for: contractions, runs of letters, single numbers, runs of anything else.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of characters; s, t, m and d end a contraction at once, r, v and l wait for e, e and l.
GAP, NUMBER, OTHER, QUOTE, LETTER, SHORT, R, V, L, E = range(10)
#: States: outside, in a word of letters, after a number, in other signs, after a quote that starts a word, after
#: quote and r, quote and v, quote and l, after a contraction.
OUT, IN, AFTER, SIGNS, QUOTED, QR, QV, QL, DONE = range(9)
#: A word starts here, or at the character before, which waited for this one.
HERE, BEFORE = 1, 2


def _word_step(state: int, kind: int) -> tuple[int, int]:
    """(next state, marks) of the transducer of words."""
    waited = BEFORE if state in (QR, QV, QL) else 0  # the letter after a quote, if no contraction comes of it
    if kind == GAP:
        return OUT, waited
    if kind == NUMBER:
        return AFTER, HERE | waited
    if kind in (OTHER, QUOTE):
        if state in (SIGNS, QUOTED):
            return SIGNS, 0
        return QUOTED if kind == QUOTE else SIGNS, HERE | waited
    if state == IN:
        return IN, 0
    if state == QUOTED:
        return {SHORT: (DONE, 0), R: (QR, 0), V: (QV, 0), L: (QL, 0)}.get(kind, (IN, HERE))
    if waited:
        return (DONE, 0) if (state, kind) in ((QR, E), (QV, E), (QL, L)) else (IN, BEFORE)
    return IN, HERE


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All state maps that runs of classes can have, the number of each class's own map, and their products."""
    letters = [tuple(_word_step(s, k)[0] for s in range(9)) for k in range(10)]
    known = {tuple(range(9)): 0}
    todo = list(known)
    for first in todo:
        for then in letters:
            both = tuple(then[s] for s in first)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    maps = list(known)
    product = np.array([[known[tuple(b[s] for s in a)] for b in maps] for a in maps], "i4")
    return np.array(maps, "i4"), np.array([known[m] for m in letters], "i4"), product


def word_marks(kinds: np.ndarray) -> np.ndarray:
    """Which characters start a word; the classes end with a gap."""
    maps, own, product = _monoid()
    n, size = len(kinds), CHUNK
    chunks = -(-n // size)
    padded = np.full(chunks * size, GAP, "u1")
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, size).T)
    # the map of each chunk, all chunks abreast
    width, flat = len(maps), product.reshape(-1)
    letter = own[columns]
    total = np.zeros(chunks, "i4")
    for row in letter:
        total = flat[total * width + row]
    # prefix scan: after a round of distance d, `scan` has the products of up to 2 * d chunks
    scan, far = total.copy(), 1
    while far < chunks:
        scan[far:] = flat[scan[:-far] * width + scan[far:]]
        far *= 2
    state = np.concatenate(([OUT], maps[scan[:-1], OUT]))
    steps = [[_word_step(s, k) for k in range(10)] for s in range(9)]
    ahead = np.array([x[0] for row in steps for x in row], "i4")
    marks = np.array([x[1] for row in steps for x in row], "u1")
    found = np.empty((size, chunks), "u1")
    for j, row in enumerate(columns):
        at = state * 10 + row
        found[j] = marks[at]
        state = ahead[at]
    found = found.T.reshape(-1)
    starts = (found & HERE).astype(bool)
    starts[:-1] |= found[1:] >= BEFORE
    return starts[:n]


# --- tokens of a word ------------------------------------------------------------------------------------------------------

NONE, UNKNOWN = -1, 255


def _byte_names() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _fits(spec: dict) -> bool:
    model, normal, words = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps = words.get("pretokenizers", [])
    return (
        (model["type"], model.get("end_of_word_suffix")) == ("BPE", "</w>")
        and not any(model.get(k) for k in ("continuing_subword_prefix", "dropout", "ignore_merges"))
        and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORDS}, "Removed", True)
        and not any(steps[1][k] for k in ("add_prefix_space", "use_regex"))
        # special strings are matched as they stand
        and not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")))


def compiled(path: str) -> dict:
    """A tokenizer's tables in plain containers, which can be sent to tasks: vocabulary tree, merges, special strings.

    It raises ValueError for a tokenizer of another kind than byte-level BPE with word ends over lowered text.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not _fits(spec):
        raise ValueError(f"{path} is not of the kind that this operator compiles")
    model = spec["model"]
    names, vocab = _byte_names(), model["vocab"]
    tree: dict[int, int] = {}
    inner: dict[int, int] = {}
    last: dict[int, int] = {}
    size = 1
    for token, number in vocab.items():
        stem = token.removesuffix("</w>")
        node = 0
        for c in stem:
            key = node << 8 | names[c]
            node = tree.get(key, 0)
            if not node:
                node = tree[key] = size
                size += 1
        (inner if stem == token else last)[node] = number
    ranks: dict[int, int] = {}
    made: dict[int, tuple[int, int, int]] = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        a, b, whole = vocab[a], vocab[b], vocab[a + b]
        if whole in made:
            raise ValueError(f"{path} makes one token by two merges")
        ranks[a << 20 | b] = rank
        made[whole] = (a, b, rank)
    spec["model"] = {**model, "vocab": {}, "merges": []}
    return {
        "tree": tree, "inner": inner, "last": last, "ranks": ranks, "made": made, "spec": json.dumps(spec),
        "special": [t["content"] for t in spec["added_tokens"]], "kept": {}}


class Transducers:
    """Both transducers over the tables of `compiled`; what is built on the way is kept in those tables."""

    def __init__(self, tables: dict) -> None:
        self.tables, self.kept = tables, tables["kept"]
        if not self.kept:
            self.kept.update(fits={}, sound={}, rights={}, lefts={})
            self._forget()
            self._ascii()
        if "library" not in self.kept:
            import tokenizers

            self.kept["library"] = tokenizers.Tokenizer.from_str(tables["spec"])
        special = sorted(tables["special"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    # which token may follow which

    def _chain(self, token: int, side: int) -> list[tuple[int, int]]:
        """What the token's outermost part on a side (1 right, 0 left) becomes, merge by merge, each with its rank."""
        known = self.kept["rights" if side else "lefts"]
        chain = known.get(token)
        if chain is None:
            made = self.tables["made"].get(token)
            chain = known[token] = [(token, NONE)] if made is None else [*self._chain(made[side], side), (token, made[2])]
        return chain

    def _apart(self, a: int, b: int, until: int) -> bool:
        """No merge of a rank below `until` joins a part of `a` with a part of `b` while both are made."""
        left, right, ranks = self._chain(a, 1), self._chain(b, 0), self.tables["ranks"]
        i, j, never = 0, 0, 1 << 40
        while True:
            across = ranks.get(left[i][0] << 20 | right[j][0], never)
            on_left = left[i + 1][1] if i + 1 < len(left) else never
            on_right = right[j + 1][1] if j + 1 < len(right) else never
            # of equal merges the one further left comes first
            if across < until and across < on_left and across <= on_right:
                return False
            if on_left == on_right == never:
                return True
            if on_left <= on_right:
                i += 1
            else:
                j += 1

    def _follows(self, a: int, b: int) -> bool:
        if a == NONE:
            return True
        fits, key = self.kept["fits"], a << 20 | b
        found = fits.get(key)
        if found is None:
            found = fits[key] = self._apart(a, b, 1 << 40)
        return found

    def _sound(self, token: int) -> bool:
        """The token's own string gives the token."""
        sound = self.kept["sound"]
        found = sound.get(token)
        if found is None:
            made = self.tables["made"].get(token)
            found = sound[token] = made is None or (
                self._sound(made[0]) and self._sound(made[1]) and self._apart(made[0], made[1], made[2]))
        return found

    # transitions

    def _forget(self) -> None:
        start = ((0, NONE, 0),)
        self.kept.update(
            numbers={start: 0}, states=[start], next=np.full((1024, 32), NONE, "i4"), ends=np.full((1024, 32), UNKNOWN, "u1"),
            column=np.full(256, UNKNOWN, "u1"), bytes=[])
        if len(self.kept["fits"]) > 1 << 20:
            self.kept["fits"] = {}

    def _grow(self, rows: int, columns: int) -> None:
        for name, fill in (("next", NONE), ("ends", UNKNOWN)):
            old = self.kept[name]
            self.kept[name] = np.full((rows, columns), fill, old.dtype)
            self.kept[name][:old.shape[0], :old.shape[1]] = old

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Of each byte its column in the tables; a byte gets one when it is first seen."""
        column = self.kept["column"]
        for byte in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (column == UNKNOWN)).tolist():
            rows, columns = self.kept["next"].shape
            if len(self.kept["bytes"]) == columns:
                self._grow(rows, 2 * columns)
            column[byte] = len(self.kept["bytes"])
            self.kept["bytes"].append(byte)
        return column[data]

    def _build(self, state: int, column: int) -> None:
        """The transition of one state on one byte: next state and tokens emitted."""
        tree, inner, kept = self.tables["tree"], self.tables["inner"], self.kept
        byte, out, token, count, emitted = kept["bytes"][column], [], NONE, 0, 1 << 30
        for node, before, ahead in kept["states"][state]:
            node = tree.get(node << 8 | byte)
            if node is None:
                continue
            out.append((node, before, ahead))
            if ahead < emitted:
                emitted = ahead
            here = inner.get(node)
            if here is not None and token == NONE and self._sound(here) and self._follows(before, here):
                token, count = here, ahead + 1
        out.append((0, token, count))
        emitted = min(emitted, count)
        key = tuple([(node, before, ahead - emitted) for node, before, ahead in out] if emitted else out)
        number = kept["numbers"].get(key)
        if number is None:
            number = kept["numbers"][key] = len(kept["states"])
            kept["states"].append(key)
            rows, columns = kept["next"].shape
            if number >= rows:
                self._grow(2 * rows, columns)
        kept["next"][state, column] = number << 6 | emitted

    def _end(self, state: int, column: int) -> None:
        """How many tokens are emitted when a byte is the last of a word."""
        byte = self.kept["bytes"][column]
        for node, before, ahead in self.kept["states"][state]:
            node = self.tables["tree"].get(node << 8 | byte)
            here = None if node is None else self.tables["last"].get(node)
            if here is not None and self._sound(here) and self._follows(before, here):
                self.kept["ends"][state, column] = ahead + 1
                return
        raise ValueError("the vocabulary lacks a byte that ends a word")

    def _looked_up(self, table: str, unknown: int, build, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        width = self.kept[table].shape[1]
        at = state * width + column
        found = self.kept[table].reshape(-1)[at]
        gaps = found == unknown
        if gaps.any():
            for code in np.unique(at[gaps]).tolist():
                build(*divmod(code, width))
            found = self.kept[table].reshape(-1)[at]
        return found

    def _abreast(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ending: bool, path: np.ndarray | None = None):
        """Runs of bytes from the start state, all at once: tokens emitted, and last states unless runs are `ending` words.

        `path` takes state and tokens so far behind every byte of every run.
        """
        order = np.argsort(-lengths.astype("i2"), kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, count = np.zeros(len(order), "i8"), np.zeros(len(order), "i8")
        longest = int(lengths[0]) if len(order) else 0
        more = len(order) - np.cumsum(np.bincount(lengths, minlength=longest + 1))  # [j]: runs of over j bytes
        for j in range(longest):
            here, on = int(more[j]), int(more[j + 1]) if ending else int(more[j])
            column = data[starts[:here] + j]
            if on < here:
                count[on:here] += self._looked_up("ends", UNKNOWN, self._end, state[on:here], column[on:])
            step = self._looked_up("next", NONE, self._build, state[:on], column[:on])
            count[:on] += step & 63
            state[:on] = step >> 6
            if path is not None:
                path[order[:here], j, 0], path[order[:here], j, 1] = state[:here], count[:here]
        back = np.empty(len(order), "i8")
        back[order] = np.arange(len(order))
        return count[back], state[back]

    def _long(self, data: np.ndarray, start: int, length: int) -> int:
        """Tokens of one long word. Its chunks' maps are known for one state each; from another state a chunk is read
        until it is in the state that it would be in from the known one, and from there on both agree."""
        body = length - 1
        places = np.arange(start, start + body, CHUNK)
        sizes = np.minimum(CHUNK, start + body - places)
        path = np.zeros((len(places), CHUNK, 2), "i8")
        counts, states = self._abreast(data, places, sizes, False, path)
        state = total = 0
        known: dict[tuple[bytes, int], tuple[int, int]] = {}
        for k, (place, size) in enumerate(zip(places.tolist(), sizes.tolist())):
            if state == 0:
                state, total = int(states[k]), total + int(counts[k])
                continue
            key = data[place:place + size].tobytes(), state
            if key not in known:
                now, more = state, 0
                for j in range(size):
                    step = self._one("next", NONE, self._build, now, int(data[place + j]))
                    now, more = step >> 6, more + (step & 63)
                    if now == path[k, j, 0]:
                        now, more = int(states[k]), more + int(counts[k] - path[k, j, 1])
                        break
                known[key] = now, more
            now, more = known[key]
            state, total = now, total + more
        return total + self._one("ends", UNKNOWN, self._end, state, int(data[start + body]))

    def _one(self, table: str, unknown: int, build, state: int, column: int) -> int:
        if self.kept[table][state, column] == unknown:
            build(state, column)
        return int(self.kept[table][state, column])

    # texts

    def _ascii(self) -> None:
        kind = np.full(0x110000, UNKNOWN, "u1")
        lower = np.arange(0x110000, dtype="u4")
        kind[:128] = OTHER
        kind[[9, 10, 11, 12, 13, 32]] = GAP
        kind[48:58] = NUMBER
        kind[97:123] = LETTER
        for letters, group in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE)):
            kind[[ord(c) for c in letters]] = group
        lower[65:91] += 32
        kind[65:91] = kind[97:123]
        self.kept.update(kind=kind, lower=lower)

    def _learn(self, codes: Iterable[int]) -> bool:
        """Class and lowered form of new characters, as the library has them; False if one becomes several."""
        kind, lower, library = self.kept["kind"], self.kept["lower"], self.kept["library"]
        single = True
        for code in codes:
            plain = library.normalizer.normalize_str(chr(code))
            if len(plain) != 1:
                single = False
                continue
            if plain == " ":
                kind[code] = GAP
            elif ord(plain) < 128:
                kind[code] = kind[ord(plain)]
            else:  # joined to a letter, joined to a sign, or neither
                joined = [len(library.pre_tokenizer.pre_tokenize_str(c + plain)) == 1 for c in "a!"]
                kind[code] = LETTER if joined[0] else OTHER if joined[1] else NUMBER
            lower[code] = ord(plain)
        return single

    def _slab(self, texts: list[str], plain: bool = False) -> np.ndarray:
        """Token counts of some texts without special strings. `plain`: they are normalised already."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.kept["kind"][codes]
        if (kinds == UNKNOWN).any():
            single = self._learn(np.unique(codes[kinds == UNKNOWN]).tolist())
            if not single and not plain:
                return self._slab([self.kept["library"].normalizer.normalize_str(t) for t in texts], True)
            kinds = self.kept["kind"][codes]
        starts = word_marks(kinds)
        inside = kinds != GAP
        final = inside.copy()
        final[:-1] &= starts[1:] | ~inside[1:]
        first, after = np.flatnonzero(starts), np.flatnonzero(final) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(ends, first, "right")
        lowered = self.kept["lower"][codes]
        if len(lowered) and lowered.max() < 128:
            data = lowered.astype("u1")
        else:
            sizes = 1 + (lowered >= 0x80) + (lowered >= 0x800) + (lowered >= 0x10000)
            place = np.concatenate(([0], np.cumsum(sizes)))
            data = np.frombuffer(lowered.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), "u1")
            first, after = place[first], place[after]
        if self.kept["next"].nbytes > KEPT:
            self._forget()
        data = self._columns(data)
        lengths = after - first
        short = lengths <= CHUNK
        counts = np.zeros(len(first), "i8")
        counts[short], _ = self._abreast(data, first[short], lengths[short], True)
        for k in np.flatnonzero(~short).tolist():
            counts[k] = self._long(data, int(first[k]), int(lengths[k]))
        return np.bincount(owner, counts, minlength=len(texts)).astype("i8")

    def _pieces(self, text: str) -> Iterator[str]:
        """A text cut before white space, so that no piece with any is much longer than a slab."""
        at = 0
        while len(text) - at > SLAB:
            gap = re.compile(r"[ \n\t\r]").search(text, at + SLAB)
            if gap is None:
                break
            yield text[at:gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """The number of tokens of each text, special strings in it included."""
        total: list[int] = []
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def count() -> None:
            for owner, n in zip(owners, self._slab(held).tolist()):
                total[owner] += n

        normal = self.kept["library"].normalizer.normalize_str
        for k, text in enumerate(texts):
            text = text or ""
            total.append(0)
            parts = [text]
            if self.special is not None and "<" in text:
                parts = self.special.split(text)
                total[k] = len(parts) - 1
            for part in parts:
                for piece in self._pieces(part):
                    if not piece:
                        continue
                    if not piece.isascii() and not unicodedata.is_normalized("NFC", piece):
                        piece = normal(piece)
                    held.append(piece)
                    owners.append(k)
                    size += len(piece)
                    if size > SLAB:
                        count()
                        held, owners, size = [], [], 0
        if held:
            count()
        return np.array(total, "i8")


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens, and whether these are over `limit`.

    Tokens are those that the library gives a whole text: no marks of begin or end are added, special strings in a text
    count as one token each, nothing is cut or filled up. Null and empty texts have none. Rows of null or equal ids and
    repeated rows are counted each; an empty table gives no rows; other columns are not read, whatever their names.
    The file `tokenizer` is read on the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer))

    @pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transducers = Transducers(shared.value)
        for batch in batches:
            yield pd.Series(transducers.counts(batch))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

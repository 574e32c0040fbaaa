"""Operator 8: toxicity by Levenshtein automata over a lexicon trie, and windows of context.

A lexicon of words and word stems is learned from labelled texts: what toxic texts hold much more often than others,
in many different surroundings. Its trie is intersected with Levenshtein automata, so a word is read once, letter by
letter, against all terms with their misspellings; the states of the intersection are made when first met and kept.
Around each hit a window of words tells quotation (quotation marks, words of reporting) from abuse (words of address).
A text's score is a logistic function of its summed hits, fitted to the labelled texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import FILTER_BITS, WORD, Scratch, written

#: So many labelled texts at most are learned from, and so many of them the weights are fitted on, drawn by a hash of the
#: text. This bounds the lexicon, whose terms need several surroundings in these, and the words held against it.
LEARNED, FITTED = 200_000, 50_000
#: One fold of so many of the labelled texts is kept from the lexicon to fit the weights of hits on.
FOLDS = 3
#: What a term needs: log odds, and different words before it in toxic texts; a stem also needs different words with it.
LOG_ODDS, SURROUNDINGS, ENDINGS = 3.0, 6, 8
STEMS = (3, 4, 5, 6, 7, 8)
#: Letters of a word from which one, and two, misspellings are allowed.
ONE_ERROR, TWO_ERRORS = 5, 9
#: Words of context on either side.
WINDOW = 6
#: Words without a hit that a task remembers.
REMEMBERED = 400_000
QUOTED, ADDRESSED = 0.3, 1.5

#: Marks of quotation, words of reporting, words of address.
QUOTES = "\"“”„‟«»‹›"
REPORTS = frozenset(
    "said says say saying wrote write writes written called calls quote quoted quotes quoting according term word words "
    "sagte sagt schrieb nannte zitat zitiert wort dit disait écrit appelé citation mot dijo dice escribió llamó cita palabra".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir dein deine ihr euch tu te toi ton vous votre tú usted eres vosotros".split())

_LETTERS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


#: The most errors that a term allows, so the most signs that can stand for letters.
MOST_ERRORS = 2
_PART = re.compile(r"[^\W_]+|[\W_]+")


def runs_of(text: str | None) -> list[str]:
    """All runs of letters and digits, in lower case."""
    return _LETTERS.findall((text or "").lower())


def masked_in(word: str) -> list[str]:
    """Readings of a word in which signs stand for letters: id!ot, *diot. Every sign is an error, so few can."""
    if word.isalnum():
        return []
    parts, out = _PART.findall(word.lower()), []
    for first in range(len(parts)):
        lead = "" if parts[first][0].isalnum() else parts[first][-1]
        start = first + bool(lead)
        signs, reading = len(lead), lead
        for part in parts[start:start + 2 * MOST_ERRORS + 1]:
            signs += 0 if part[0].isalnum() else len(part)
            if signs > MOST_ERRORS:
                break
            reading += part
            if signs and part[0].isalnum():
                out.append(reading)
    return out


def allowed(term: str) -> int:
    return MOST_ERRORS if len(term) >= TWO_ERRORS else 1 if len(term) >= ONE_ERROR else 0


WHOLE, BEGINNING, MISSPELLED = range(3)
KINDS = ("whole", "beginning", "misspelled")


class Automaton:
    """The trie of a lexicon intersected with the Levenshtein automata of its terms, made deterministic as it is read.

    A state is the set of trie nodes that the letters so far may have led to, each with its fewest errors.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], ordinary: Iterable[str] = ()) -> None:
        self.ordinary = frozenset(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[float, int]] = {}
        self.stem: dict[int, float] = {}
        self.most = [0]  # errors that some term below a node allows
        for term, weight in words.items():
            self.word[self._node(term, allowed(term))] = (weight, allowed(term))
        for term, weight in stems.items():
            self.stem[self._node(term, 0)] = weight
        self.known: dict[tuple, int] = {}
        self.ends: list[tuple[float, int] | None] = []
        self.starts: list[float | None] = []
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _node(self, term: str, errors: int) -> int:
        at = 0
        self.most[0] = max(self.most[0], errors)
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.most.append(0)
            at = self.children[at][c]
            self.most[at] = max(self.most[at], errors)
        return at

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of nodes, after letters that the word may have left out; -1 for none."""
        queue = list(nodes)
        while queue:
            node = queue.pop()
            for child in self.children[node].values() if node else ():  # a misspelled word keeps its first letter
                if nodes[node] + 1 <= self.most[child] and nodes[node] + 1 < nodes.get(child, 99):
                    nodes[child] = nodes[node] + 1
                    queue.append(child)
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            ends = [(self.word[n][0], e) for n, e in key if n in self.word and e <= self.word[n][1]]
            self.ends.append(min(ends, key=lambda x: (x[1], -x[0])) if ends else None)
            stems = [self.stem[n] for n, e in key if n in self.stem and e == 0]
            self.starts.append(max(stems) if stems else None)
            self.sets.append(key)
            self.steps.append({})
        return self.known[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, errors in self.sets[state]:
            if node and errors < self.most[node]:  # a letter too many
                nodes[node] = min(nodes.get(node, 99), errors + 1)
            for c, child in self.children[node].items():
                # a first letter may be hidden by a sign or a number, not by another letter
                cost = errors + (c != letter) * (1 if node or not letter.isalpha() else 99)
                if cost <= self.most[child] or cost == 0:
                    nodes[child] = min(nodes.get(child, 99), cost)
        self.steps[state][letter] = to = self._state(nodes)
        return to

    def hit(self, word: str) -> tuple[float, int] | None:
        """(weight, kind) of the nearest term, or of a stem that the word begins with; an ordinary word is no misspelling."""
        state, stem = self.start, None
        for letter in word:
            to = self.steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                break
            if self.starts[state] is not None:
                stem = self.starts[state]
        if state >= 0 and self.ends[state] is not None and not self.ends[state][1]:
            return self.ends[state][0], WHOLE
        if stem is not None:
            return stem, BEGINNING
        if state < 0 or self.ends[state] is None or word in self.ordinary:
            return None
        return self.ends[state][0], MISSPELLED


def best_hit(word: str, automaton: Automaton) -> tuple[float, int] | None:
    """The hit of a blank-separated word: of its runs of letters, or else of its masked readings, the best kind first."""
    hits = [h for h in map(automaton.hit, runs_of(word)) if h is not None]
    if not hits:
        hits = [(h[0], MISSPELLED) for h in map(automaton.hit, masked_in(word)) if h is not None]
    return min(hits, key=lambda h: (h[1], -h[0])) if hits else None


def features(text: str | None, automaton: Automaton, clean: set[str], hits: dict[str, tuple[float, int]]) -> list[float]:
    """Summed weights of hits by kind, each scaled by its window. `clean` and `hits` remember words."""
    words = WORD.findall(text or "")
    sums = [0.0, 0.0, 0.0]
    quotes = 0  # quotation marks so far
    for at, word in enumerate(words):
        if word not in clean:
            found = hits.get(word)
            if found is None:
                found = best_hit(word, automaton)
                if found is not None:
                    hits[word] = found
                elif len(clean) < REMEMBERED:
                    clean.add(word)
            if found is not None:
                sums[found[1]] += found[0] * _context(words, at, quotes)
        if not word.isalnum():
            for q in QUOTES:
                if q in word:
                    quotes += word.count(q)
    return sums


def _context(words: list[str], at: int, quotes: int) -> float:
    before, after = words[max(0, at - WINDOW):at], words[at + 1:at + 1 + WINDOW]
    marks = lambda some: any(q in w for w in some for q in QUOTES)
    near = {run for w in before + after for run in runs_of(w)}
    quoted = (quotes % 2 == 1 or words[at][0] in QUOTES) and marks([words[at], *after]) or (
        marks(before) and marks([words[at], *after]) and bool(near & REPORTS))
    if quoted:
        return QUOTED
    return ADDRESSED if near & ADDRESS else 1.0


# --- learning ----------------------------------------------------------------------------------------------------------


def _keys(word: str) -> Iterator[str]:
    """What a word is counted as: itself, and the stems it begins with."""
    yield word + "$"
    yield from (word[:n] for n in STEMS if len(word) > n)


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of toxic texts: in how many each word and stem is, after which words, and the words a stem is in.

    The words are sets of 64 bits, so copies and near copies of a text count as one surrounding.
    """
    for batch in batches:
        table: dict[str, list[int]] = {}
        for text in batch["text"]:
            words = runs_of(text)
            own: set[str] = set()
            for at, word in enumerate(words):
                if len(word) < 3:
                    continue
                before = 1 << (zlib.crc32(words[at - 1].encode()) & 63) if at else 1
                ending = 1 << (zlib.crc32(word.encode()) & 63)
                for key in _keys(word):
                    row = table.setdefault(key, [0, 0, 0])
                    row[1] |= before
                    row[2] |= ending
                    own.add(key)
            for key in own:
                table[key][0] += 1
        rows = np.array(list(table.values()), "u8").reshape(-1, 3).view("i8")
        yield pd.DataFrame({"key": pd.Series(list(table), dtype="object"), "pos": rows[:, 0], "before": rows[:, 1], "endings": rows[:, 2]})


def lexicon(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their log odds, from rows of (text, toxic), of which there are `LEARNED` at most.

    Toxic texts tell which words and stems have surroundings enough; the other texts are counted for all of these, which
    a filter of 2 MB tells to the tasks, and the two tables of counts meet on Spark.
    """
    scratch = Scratch()
    totals = labelled.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    seen = labelled.where("toxic = 1").select("text").mapInPandas(_surroundings, "key string, pos long, before long, endings long")
    terms = seen.groupBy("key").agg(F.sum("pos").alias("pos"), F.bit_or("before").alias("before"), F.bit_or("endings").alias("endings"))
    enough = (F.bit_count("before") >= SURROUNDINGS) & (F.col("key").endswith("$") | (F.bit_count("endings") >= ENDINGS))
    found = scratch.written(terms.where(enough).select("key", "pos"), "terms")
    place = F.crc32(F.col("key").cast("binary")) % FILTER_BITS
    bits = found.select(place.alias("at")).groupBy((F.col("at") / 8).cast("int").alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bits")).toPandas()
    filled = np.zeros(FILTER_BITS // 8, "u1")
    filled[bits["byte"].to_numpy("i8")] = bits["bits"].to_numpy("i8").astype("u1")
    shared = labelled.sparkSession.sparkContext.broadcast(filled.tobytes())

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled, of, table = shared.value, {}, Counter()
        wanted = lambda key: filled[(at := zlib.crc32(key.encode()) % FILTER_BITS) >> 3] >> (at & 7) & 1
        for batch in batches:
            for text in batch["text"]:
                own: set[str] = set()
                for word in set(WORD.findall(text or "")):
                    keys = of.get(word)
                    if keys is None:
                        keys = [k for run in runs_of(word) for k in _keys(run) if wanted(k)]
                        if len(of) < REMEMBERED:
                            of[word] = keys
                    own.update(keys)
                table.update(own)
        yield pd.DataFrame({"key": pd.Series(list(table), dtype="object"), "neg": np.fromiter(table.values(), "i8", len(table))})

    counts = labelled.where("toxic = 0").select("text").mapInPandas(counted, "key string, neg long")
    counts = counts.groupBy("key").agg(F.sum("neg").alias("neg"))
    share = lambda n, total: F.log((F.coalesce(F.col(n), F.lit(0)) + 0.5) / (total + 1))
    both = found.join(counts, "key", "left").select("key", (share("pos", totals[0]) - share("neg", totals[1])).alias("odds"))
    best = both.where(F.col("odds") >= LOG_ODDS).orderBy(F.desc("odds"), "key").collect()
    scratch.clear(labelled.sparkSession)
    terms = {r["key"]: r["odds"] for r in best}
    return {k[:-1]: w for k, w in terms.items() if k.endswith("$")}, {k: w for k, w in terms.items() if not k.endswith("$")}


def ordinary_words(labelled: DataFrame, words: dict[str, float], stems: dict[str, float]) -> list[str]:
    """Words near a term that other texts hold nearly as often as toxic ones: all that the terms' automaton reaches."""
    shared = labelled.sparkSession.sparkContext.broadcast((words, stems))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, clean = Automaton(*shared.value), set()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for word in set(runs_of(text)) - clean:
                    hit = automaton.hit(word)
                    if hit is not None and hit[1] == MISSPELLED:
                        rows.append((word, int(toxic), 1 - int(toxic)))
                    elif len(clean) < REMEMBERED:
                        clean.add(word)
            yield pd.DataFrame(rows, columns=["word", "pos", "neg"], dtype="object")

    found = labelled.select("text", "toxic").mapInPandas(near, "word string, pos long, neg long")
    counts = found.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return [r["word"] for r in counts.where("neg > 0 and pos < 4 * neg").select("word").orderBy("word").collect()]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps; the weights of the features are kept small by a unit normal prior."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w, prior = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (y - p) - prior @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)  # a hit never speaks for a text
    return w


def scored(docs: DataFrame, labelled: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
    """The rows of `docs` with a score from 0 to 1, learned from the rows (text, toxic) of `labelled`.

    Of more than `LEARNED` labelled rows about so many are learned from. Words are read with all their runs of letters; a
    sign between letters counts as a wrong one. Labels other than 0 and 1 and null ones teach nothing. Null and empty texts have the score of a text without hits;
    without labels of both kinds every score is the share of toxic labels, or 0. Texts are read whole, repeated rows
    score alike, an empty table stays empty. All columns are carried, whatever their names; one named `into` is replaced.
    """
    spark = docs.sparkSession
    known = written(labelled.where("toxic in (0, 1)").select("text", "toxic"), "labelled")
    part = min(1.0, LEARNED / max(1, known.count()))
    if part < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit("learn"), "text"), F.lit(1_000_000)) < int(part * 1_000_000))
    apart = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0

    def measured(rows: DataFrame):
        """A function of a text column, from the lexicon of labelled rows."""
        words, stems = lexicon(rows)
        shared = spark.sparkContext.broadcast((words, stems, ordinary_words(rows, words, stems)))

        def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            automaton, clean, hits = Automaton(*shared.value), set(), {}
            for some in texts:
                yield pd.DataFrame([features(t, automaton, clean, hits) for t in some], columns=list(KINDS)).astype("f8")

        return F.pandas_udf(measure, ", ".join(f"{k} double" for k in KINDS))

    # What a hit of each kind says is fitted on texts that the lexicon was not learned from.
    fresh = known.where(apart)
    share = min(1.0, FITTED / max(1, fresh.count()))
    fresh = fresh.where(F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    fitted = fresh.select(measured(known.where(~apart))("text").alias("f"), "toxic").select("f.*", "toxic").toPandas()
    y = fitted["toxic"].to_numpy("f8")
    if 0 < y.sum() < len(y):
        base, *slopes = _fit(np.log1p(fitted[list(KINDS)].to_numpy("f8")), y).tolist()
    else:
        base, slopes = math.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9)) if len(y) else -30.0, [0.0] * len(KINDS)
    inner = F.lit(base)
    for kind, slope in zip(KINDS, slopes):
        inner += slope * F.log1p(f"f.{kind}")
    # the columns of `docs` are in a struct of their own, so that none meets a name of these
    kept = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("text"))
    told = rows.select("row", measured(known)(F.col("text")).alias("f")).withColumn("score", 1 / (1 + F.exp(-inner)))
    score = F.col("score").alias(into)
    if into not in docs.columns:
        return told.select(*[F.col(f"row.`{c}`") for c in kept], score)
    return told.select(*[score if c == into else F.col(f"row.`{c}`") for c in docs.columns])

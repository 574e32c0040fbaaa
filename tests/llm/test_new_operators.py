"""Token counts, centroid clustering and source divergence: against the library, brute force and plain versions, and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import centroids, divergence, tokens
from fleetlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# --- token counts --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def transducers():
    return tokens.Transducers(tokens.compiled(PATH))


def plain_counts(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


PARTS = [
    "a", "b", "e", "r", "l", "v", "s", "'", "t", "m", "d", " ", "!", "1", "é", "<", "|", ">", "ß", "İ", "́", "\n",
    " ", " ", "²", "日", "本", "\U0001f600", "A", "Z", "'RE", "'ll", "'ve", "<|endoftext|>", "<|ENDOFTEXT|>", "\x00",
    "Σ", "ς", "Å", "th", "ing", "tion", "aa", "xyz", "\x1c", "\u0085", "가", "ᄀ", "ᅡ",
]


def test_counts_match_the_library_on_mixed_texts(transducers, library):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    assert transducers.counts(texts).tolist() == plain_counts(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_counts_match_the_library_on_any_text(transducers, library, texts):
    assert transducers.counts(texts).tolist() == plain_counts(library, texts)


def test_counts_of_words_longer_than_chunks(transducers, library):
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abcdefghijnorst") for _ in range(n))
    texts = ["a" * n for n in (1, 63, 64, 65, 66, 128, 129, 3000)] + ["ab" * 900, "é" * 400, "!" * 777, "'" * 300]
    texts += [letters(n) for n in (65, 200, 4000)] + [letters(64) + " " + letters(65)]
    assert transducers.counts(texts).tolist() == plain_counts(library, texts)


def test_counts_of_texts_longer_than_slabs(transducers, library, monkeypatch):
    r = random.Random(3)
    text = " ".join(r.choice(PARTS) * r.randint(1, 9) for _ in range(4000))
    want = plain_counts(library, [text, "x", text])
    for slab in (100, 1000):
        monkeypatch.setattr(tokens, "SLAB", slab)
        assert transducers.counts([text, "x", text]).tolist() == want


def test_counts_do_not_depend_on_what_is_kept(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 1)
    monkeypatch.setattr(tokens, "SLAB", 500)
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(200)) for _ in range(40)]
    assert tokens.Transducers(tokens.compiled(PATH)).counts(texts).tolist() == plain_counts(library, texts)


def test_word_marks_do_not_depend_on_chunks(monkeypatch):
    kinds = np.random.default_rng(5).integers(0, 10, 5000).astype("u1")
    kinds[-1] = tokens.GAP
    state, want = tokens.OUT, np.zeros(len(kinds), bool)
    for i, k in enumerate(kinds.tolist()):
        state, marks = tokens._word_step(state, k)
        want[i] |= bool(marks & tokens.HERE)
        if marks & tokens.BEFORE:
            want[i - 1] = True
    for size in (1, 7, 64):
        monkeypatch.setattr(tokens, "CHUNK", size)
        assert (tokens.word_marks(kinds) == want).all()


def test_token_query_matches_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_token_edges(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "one two"), (3, "one two"), (4, "w " * 2048), (5, "w " * 2049), (6, "w " * 400_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({"n_tokens": F.lit(7), "n_bytes": F.lit("x")})
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, PATH).collect())
    assert found == [
        (0, 7, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, False), (3, 7, 2, False), (4, 4096, 2048, False),
        (5, 4098, 2049, True), (6, 800_000, 400_000, True)]
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.compiled(public_tokenizers.path("byte_bpe_50k.json"))


# --- centroids -------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, seed="2"):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) in Python's whole numbers; rows are (vec_id, components)."""
    rows = [(i, [math.floor(256 * float(c)) for c in x]) for i, x in rows
            if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted(rows, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, x in rows:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            part = [x for (_, x), (c, _) in zip(rows, near) if c == j]
            if part:
                cents[j] = [sum(col) // len(part) for col in zip(*part)]
    near = assign()
    per = Counter()
    for c, d in near:
        per[c] += d
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(rows, near)), key=repr)


@pytest.mark.parametrize("size", [1.0, 2.0 ** 14, 2.0 ** 24, 2.0 ** 40])
def test_tournament_finds_the_nearest_at_any_size(size):
    r = np.random.default_rng(6)
    cents = [tuple(int(c) for c in row) for row in np.floor(r.normal(size=(13, 8)) * 64 * size)]
    cents[5] = cents[2]  # a tie everywhere
    x = np.concatenate((np.floor(r.normal(size=(300, 8)) * 64 * size), np.array(cents, "f8")))
    best, away = centroids.Bisectors(cents).nearest(x)
    for row, b, d in zip(x.tolist(), best.tolist(), away.tolist()):
        every = [sum((int(a) - c) ** 2 for a, c in zip(row, cent)) for cent in cents]
        assert b == every.index(min(every)) and int(d) == min(every)


def test_clusters_match_a_plain_version(spark):
    r = random.Random(7)
    rows = [(i, [r.choice((-1, 0, 1)) + r.random() / 8 for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, math.nan, 0.0, 0.0]), (203, [math.inf] * 4), (204, [1.0] * 3), (205, []),
             (None, [0.5] * 4), (7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "x": F.lit(1)})
    exact = [(v.vec_id, v.embedding) for v in table.collect()]
    for k, rounds in ((6, 5), (200, 2), (1, 1)):
        found = centroids.clustered(table, k=k, rounds=rounds, dims=4).collect()
        assert sorted((tuple(v) for v in found), key=repr) == plain_clusters(exact, k, rounds, 4)
    assert centroids.clustered(table.limit(0), dims=4).count() == 0
    assert centroids.clustered(table.where("vec_id > 199"), dims=4).count() == 0


def test_huge_components_are_exact(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice((0, 4, 5)) for _ in range(3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((tuple(v) for v in centroids.clustered(table, k=5, dims=3).collect()), key=repr)
    assert found == plain_clusters(rows, 5, 5, 3)
    rows += [(100 + i, [r.uniform(-1, 1) * 1e38 for _ in range(3)]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {v.vec_id: v for v in centroids.clustered(table, k=5, dims=3).collect()}
    for want in plain_clusters(rows, 5, 5, 3):
        fits = [v if v < 2 ** 63 else None for v in want[2:5]]
        assert tuple(found[want[0]]) == (*want[:2], *fits, want[5])


# --- divergence ------------------------------------------------------------------------------------------------------------


def plain_divergence(docs, min_docs=3, top=200):
    """docs are (text, lang, source)."""
    counts, holders, groups = defaultdict(Counter), defaultdict(set), set()
    for n, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for term in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered):
            counts[lang, source][term] += 1
            holders[lang, term].add(n)
    kept = defaultdict(list)
    for (lang, term), some in holders.items():
        if len(some) >= min_docs:
            kept[lang].append(term)
    share = lambda c, total, v: 1 + 10**9 * (c + 1) // (total + v)
    shares, out = {}, []
    for lang, source in groups:
        terms, c = kept[lang], counts[lang, source]
        total = sum(c[t] for t in terms)
        shares[lang, source] = {t: share(c[t], total, len(terms)) for t in terms}
    for lang, source in groups:
        p, terms = shares[lang, source], kept[lang]
        pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in terms), s) for (l2, s), q in shares.items() if l2 == lang and s != source]
        every = Counter()
        for (l2, _), c in counts.items():
            if l2 == lang:
                every.update({t: c[t] for t in terms if c[t]})
        q = {t: share(every[t], sum(every.values()), len(terms)) for t in terms}
        best = [((p[t] - q[t]) ** 2 // q[t], t) for t in terms if counts[lang, source][t] and p[t] > q[t]]
        order = lambda x: (-x[0], x[1].encode())
        for part, found in (("pair", sorted(pairs, key=order)), ("term", sorted(best, key=order)[:top])):
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def diverged(spark, docs, **how):
    table = spark.createDataFrame([(i, *d, 0) for i, d in enumerate(docs)], DOCS).withColumns({"term": F.lit(1), "n": F.lit(2), "row": F.lit(3)})
    return sorted(tuple(r) for r in divergence.source_divergence(table, **how).collect())


@pytest.mark.parametrize("held", [600_000, 5])
def test_divergence_matches_a_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CUT", 10 * held)
    r = random.Random(9)
    words = ["the", "The", "the,", "a", "(a)", "b-b", "c-a", "été", "x1y", "1", "日本", "z z", "don't", "", "w\x0bw", "--", "\U0001f600a"]
    docs = [(" ".join(r.choice(words) + str(r.choice(("", "", r.choice("klmnop")))) for _ in range(r.randint(0, 30))),
             r.choice(("en", "de", None, "")), r.choice(("s1", "s2", "s3", None))) for _ in range(80)]
    docs += [(None, "en", "empty"), ("", "xx", "alone"), ("1 2 3", "yy", "p"), ("", "yy", "q"), docs[0], docs[0]]
    for how in ({}, {"min_docs": 1, "top_terms": 4}, {"min_docs": 2}):
        assert diverged(spark, docs, **how) == plain_divergence(docs, how.get("min_docs", 3), how.get("top_terms", 200))


def test_divergence_edges(spark):
    assert diverged(spark, [(None, None, None)]) == []
    assert spark.createDataFrame([], DOCS).transform(divergence.source_divergence).count() == 0
    long = ("word " * 300_000 + "x" * 300_000, "en", "s")
    assert diverged(spark, [long] * 3 + [("word", "en", "t")]) == plain_divergence([long] * 3 + [("word", "en", "t")])
    with pytest.raises(ValueError):
        diverged(spark, [("a", "b", "c")], min_docs=4)


def test_a_term_of_a_group_is_one_row_whatever_stands_beside_it(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CUT", 40)
    texts = ["Word, (word) word.word", "word", None, " ,.", "\u00e9Word\u00a0x\x00WORD\x1fword!", "word; \u4e00-\u4e00"]
    rows = divergence.term_rows(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect()
    assert sorted((r.term, r.n, r.docs) for r in rows) == [("", 0, 0), ("word", 8, 4), ("\u00e9word\u00a0x", 1, 1), ("\u4e00", 2, 1)]


def test_shares_and_sums_are_exact_on_both_sides_of_a_long(spark):
    counts = [0, 1, divergence.LONG - 1, divergence.LONG, divergence.LONG + 1, 2**40]
    df = spark.createDataFrame([(n, t, v) for n in counts for t in (n + 1, 2**62) for v in (1, 10**6)], "n long, t long, v long")
    for r in df.select("*", divergence._share(F.col("n"), F.col("t"), F.col("v")).alias("share")).collect():
        assert r.share == 1 + 10**9 * (r.n + 1) // (r.t + r.v)
    values = [2**63 - 1] * 40 + [-(2**63)] * 3 + [5, -7, 10**18, -(10**18) - 1]
    one = spark.createDataFrame([(v,) for v in values], "v long").agg(divergence._sum_of(F.col("v")).alias("s")).first()
    assert int(one.s) == sum(values)

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import hashlib
import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from fleetlens.llm import components, html_text, mixing, neighbours, packing, quality, simhash, spans, suffixes, toxicity, warc
from fleetlens.session import tune

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


def table(spark, texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- quality rules -------------------------------------------------------------------------------------------------------


def plain_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_counts_match_a_plain_version(spark):
    texts = [None, "", " \n\t ", "a b", "a b c a b c x a b c", "x\nx\n\ny\nx", "é#é $ü\x0bz", "w " * 300, prose(1, 400), prose(1, 60) * 2]
    rows = quality.judged(table(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        m = row.quality.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain_quality(text)
        assert row.quality.base_failed == (m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words)
    assert [r.quality.base_failed for r in rows[:4]] == [True] * 4


def test_quality_keeps_clean_and_clashing_columns(spark, empty):
    clean = " ".join(["the house of the man is in a street and it was old"] + [prose(2, 200)])
    docs = table(spark, [clean, clean, clean.replace(" ", "## ")]).withColumn("quality", F.lit(1)).withColumn("m", F.lit(2))
    assert [r.doc_id for r in quality.kept(docs).orderBy("doc_id").collect()] == [0, 1]
    assert quality.kept(docs).columns == docs.columns
    assert quality.kept(empty).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------------


def test_mixing_fills_targets_and_repeats(spark, empty):
    texts = ["w " * n for n in (10, 20, 30, 500, 40)] + ["", None]
    docs = table(spark, texts, sources=["a", "a", "b", "c", None, "d", None]).withColumn("mix", F.lit(0))
    names = ["_size", "_drawn", "_key", "_none", "_rate", "_target", "_source_size", "_copy", "size", "drawn", "key", "none", "row", "rate", "target", "source_size", "col", "a.b"]
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    rows = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert all(r[n] == f"{n}-{r.doc_id}" for r in [*rows.values(), *mixing.emitted(docs).collect()] for n in names)
    per = {r.source: r.target for r in mixing.source_targets(
        docs.select("source", (F.size(F.split(F.coalesce("text", F.lit("")), " ")) - 1).alias("size"))).collect()}
    # weights a 1, b 2, c 3, d 1, null 2; a, b, d and null stand at three times their sizes, c takes the rest
    assert per == {"a": 90.0, "b": 90.0, "c": 300.0, "d": 0.0, None: 120.0}
    assert rows[0].mix.copies == 3 and rows[2].mix.copies == 3 and rows[4].mix.copies == 3
    assert rows[5].mix.size == 0 and rows[6].mix.size == 0 and rows[6].mix.target == 120.0
    assert rows[3].mix.copies in (0, 1) and rows[3].mix.copies == {r.doc_id: r for r in mixing.mixed(docs).collect()}[3].mix.copies
    assert mixing.emitted(docs).columns == [c for c in docs.columns if c != "mix"]
    assert mixing.emitted(empty).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = table(spark, [prose(i, 5 + i % 40) for i in range(3000)], sources=["big" if i % 3 else f"s{i % 7}" for i in range(3000)])
    taken = mixing.mixed(docs).groupBy("source").agg(
        F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target"))
    for row in taken.collect():
        assert abs(row.taken - row.target) < 0.12 * row.target


# --- components and SimHash ---------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 4), (5, 4), (None, 3), (200, 199)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 199, 199: 199}


def plain_components(prints, most):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("cell", [2048, 8])
def test_hamming_links_connect_what_brute_force_connects(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(150)]
    prints = set(base)
    for b in base[:60]:
        for _ in range(r.randint(1, 12)):
            x = b
            for bit in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    hot = r.getrandbits(64)
    prints |= {hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for most in (3, 6):
        links = simhash.hamming_links(spark.createDataFrame(signed, "fp long"), most)
        rows = links.collect()
        assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() == x.bits <= most for x in rows)
        got = {r_.node: r_.component for r_ in components.components(links.select("a", "b")).collect()}
        want = plain_components(prints, most)
        groups = {}
        for p, w in zip(signed, want):
            groups.setdefault(w, []).append(p[0])
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
            frozenset(n for n, c in got.items() if c == k) for k in set(got.values())}


def test_fingerprints_by_spark_and_by_definition(spark, empty):
    texts = [None, "", "One", "one", "a B c", "A b C d", prose(5, 300), prose(5, 300).upper()]
    docs = table(spark, texts, ids=[4, 1, 2, 9, 5, 6, None, 3])
    rows = {r.doc_id: r for r in simhash.fingerprint_components(docs).collect()}
    assert rows[4].fp == rows[1].fp == 0 and rows[4].component_id == 1
    one = spark.sql("select xxhash64('one') as h").first().h
    assert rows[2].fp == rows[9].fp == one and rows[9].component_id == 2
    assert rows[5].fp == spark.sql("select xxhash64('a b c') as h").first().h
    assert rows[None].fp == rows[3].fp and rows[None].component_id == 3
    assert simhash.fingerprint_components(empty).count() == 0


def test_near_copies_leave_one(spark, empty):
    base = prose(8, 400).split()
    near = list(base)
    near[50] = "changed"
    far = [w if i % 3 else "other" + str(i) for i, w in enumerate(base)]
    texts = [" ".join(x) for x in (near, base, base, far)] + [prose(9, 300), None, "", prose(9, 300)]
    names = [
        "_key", "key", "id", "n", "_n", "drop", "_drop", "own", "_own", "row", "fp", "size", "least", "first", "lead", "cell", "component",
        "a", "b", "set", "s", "_id", "_text", "asked.by", "hub"]
    docs = table(spark, texts, ids=[5, 2, 3, 1, 4, 8, 7, 4])
    clashing = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    kept = simhash.near_deduplicated(clashing)
    assert kept.columns == clashing.columns
    kept = kept.orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [1, 2, 4, 7]
    assert all(r[n] == f"{n}-{r.doc_id}" for r in kept for n in names)
    assert simhash.near_deduplicated(empty).count() == 0


# --- main text of pages ------------------------------------------------------------------------------------------------


def paragraphs(seed, n, words=40):
    return [prose(seed * 100 + i, words) for i in range(n)]


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


MENU = "<div><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12)) + "</ul></div>"


def test_region_of_a_page_without_an_article():
    text = paragraphs(1, 5)
    block = "<h1>Head</h1>" + "".join(f"<p>{t}</p>" for t in text)
    want = " ".join(["Head", *text])
    small = "".join(f"<div><a href='#'>x{i}</a> <span>more</span></div>" for i in range(15))
    assert html_text.main_text(page(f"{MENU}<div class='story'>{block}</div><div>{small}</div>")) == want
    assert html_text.main_text(page(f"{MENU}{block}<table><tr><td>a</td><td>b</td></tr></table>{small}")) == want


def test_clusters_decide_where_the_article_is(monkeypatch):
    text = paragraphs(2, 6)
    teaser = "<article><h2>Read</h2></article>"
    html = page(f"{MENU}{teaser}<div class='body'>" + "".join(f"<p>{t}</p>" for t in text) + "</div>" + MENU)
    assert html_text.main_text(html) == " ".join(text)
    found = {}
    for name, cluster in (("all", lambda v: np.ones(len(v), bool)), ("first", lambda v: np.arange(len(v)) == 0)):
        monkeypatch.setattr(html_text, "_high_cluster", cluster)
        found[name] = html_text.main_text(html)
    assert found["first"] != " ".join(text)
    # among dense blocks of a page, menus that no tag or class tells apart are left out by their ratios alone
    monkeypatch.undo()
    plain = page(MENU + "".join(f"<p>{t}</p>" for t in text) + MENU)
    assert html_text.main_text(plain) == " ".join(text)
    monkeypatch.setattr(html_text, "_high_cluster", lambda v: np.arange(len(v)) == 0)
    assert html_text.main_text(plain) != " ".join(text)


def test_sections_of_an_article_stay():
    text = paragraphs(3, 4)
    body = (
        f"<h1 id='side-effects'>One</h1><p>{text[0]}</p><section id='related-work'><h2 class='toc-title'>Two</h2><p>{text[1]}</p></section>"
        f"<div id='comments'><p>{text[2]}</p></div><ul><li><a href='a'>First</a> and <a href='b'>second</a></li><li><a href='c'>x</a><a href='d'>y</a></li></ul>"
        f"<div class='ad-box'><p>{prose(999, 30)}</p></div><aside>no</aside><p>{text[3]}</p>")
    want = f"One {text[0]} Two {text[1]} {text[2]} First and second xy {text[3]}"
    around = f"<nav>{MENU}</nav><div id='sidebar'><p>{prose(998, 60)}</p></div>"
    assert html_text.main_text(page(f"{around}<article>{body}</article><footer>f</footer>")) == want
    inner = f"<main><div class='col'><article>{body}</article></div></main>"
    assert html_text.main_text(page(around + inner)) == want


def test_a_short_article_among_unmarked_text():
    text = paragraphs(4, 2, 25)
    html = page(f"<div><span>Site</span><span>Sign in</span></div><article><h1>T</h1>{''.join(f'<p>{t}</p>' for t in text)}</article><div><p>Some words of a foot.</p></div>")
    assert html_text.main_text(html) == "T " + " ".join(text)


# --- spans -----------------------------------------------------------------------------------------------------------------


def edited(seed: int, words: list[str], n: int) -> str:
    r, out = random.Random(seed), list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(out)


def similarity(a: str, b: str) -> float:
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_copies_that_only_their_original_connects_leave_one(spark):
    original = prose(50, 300).split(" ")
    copies = [edited(seed, original, 5) for seed in range(50)]
    alike = [similarity(a, b) >= 0.8 for i, a in enumerate(copies) for b in copies[:i]]
    assert all(similarity(" ".join(original), c) >= 0.8 for c in copies) and not any(alike)
    # the original stands last, so a copy that is not measured against it stays
    rest = simhash.near_deduplicated(table(spark, copies + [" ".join(original)]), shingle=5, similarity=0.8)
    assert [r.doc_id for r in rest.collect()] == [0]


def groups_by_brute_force(texts):
    """The smallest place in each text's group, of links of 0.8 or more."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_links_of_each_kind_of_edit_are_found(spark):
    r, kinds, texts = random.Random(5), ["scattered", "cut off", "cut out", "continued", "both"], []
    for seed in range(150):
        words, kind = prose(2000 + seed, r.randint(100, 500)).split(" "), kinds[seed % 5]
        texts.append((kind, " ".join(words)))
        for _ in range(4):
            at, n = r.randrange(len(words)), max(1, int(len(words) * r.uniform(0.01, 0.19)))
            scattered = edited(r.randrange(10**6), words, max(1, int(len(words) * r.uniform(0.002, 0.03))))
            texts.append((kind, {
                "scattered": scattered, "cut off": " ".join(words[:-n] if at % 2 else words[n:]), "cut out": " ".join(words[:at] + words[at + n:]),
                "continued": " ".join(words) + " " + prose(r.randrange(10**6), n), "both": " ".join(scattered.split(" ")[:-max(1, n // 3)])}[kind]))
    r.shuffle(texts)
    label = {i: k for i, k in enumerate(groups_by_brute_force([t for _, t in texts]))}
    kept = {x.doc_id for x in simhash.near_deduplicated(table(spark, [t for _, t in texts])).collect()}
    assert set(label.values()) <= kept
    for kind in kinds:
        own = {i for i, (k, _) in enumerate(texts) if k == kind}
        links = len(own) - len({label[i] for i in own})
        assert links > 60 and len(kept & own) <= len({label[i] for i in own}) + 0.01 * links


def test_a_group_of_texts_that_are_nearly_alike_enough(spark):
    """Copies about 0.65 like each other: the last round finds the few links among very many pairs that are none."""
    r = random.Random(77)
    original = prose(60, 400).split(" ")
    texts = [edited(i, original, 17) for i in range(300)]
    texts += [edited(1000 + i, texts[r.randrange(300)].split(" "), 7) for i in range(60)]
    label = groups_by_brute_force(texts)
    kept = {x.doc_id for x in simhash.near_deduplicated(table(spark, texts)).collect()}
    assert set(label) <= kept and len(kept) <= len(set(label)) + 1 and 280 < len(set(label)) < 320


def test_texts_that_share_a_long_passage_are_not_all_measured(spark, monkeypatch):
    """Texts 0.7 like each other by a passage they all have: what is measured grows with the texts, and all links are found."""
    r, passage, texts = random.Random(78), prose(61, 300).split(" "), []
    for i in range(200):
        own = prose(3000 + i, 60).split(" ")
        texts.append(passage + own if i % 2 else own + passage)
    for i in range(20):
        words = list(texts[r.randrange(200)])
        for _ in range(3):
            words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    label, written, rows = groups_by_brute_force(texts), simhash.Scratch.written, []

    def counted(self, df, name):
        out = written(self, df, name)
        if name == "pairs":
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash.Scratch, "written", counted)
    kept = {x.doc_id for x in simhash.near_deduplicated(table(spark, texts)).collect()}
    assert kept == set(label) and 190 < len(kept) < 215
    assert rows[-1] < 2 * len(texts)


def test_pairs_that_are_too_far_apart_are_not_measured(spark, monkeypatch):
    """Of a group of texts about 0.65 like each other, hardly more pairs are measured in all rounds than are links."""
    r = random.Random(79)
    original = prose(62, 400).split(" ")
    texts = [edited(i, original, 17) for i in range(150)]
    texts += [edited(1000 + i, texts[r.randrange(150)].split(" "), 7) for i in range(30)]
    written, rows = simhash.Scratch.written, {"pairs": 0, "alike": 0}

    def counted(self, df, name):
        out = written(self, df, name)
        if name in rows:
            rows[name] += out.count()
        return out

    monkeypatch.setattr(simhash.Scratch, "written", counted)
    label = groups_by_brute_force(texts)
    kept = {x.doc_id for x in simhash.near_deduplicated(table(spark, texts)).collect()}
    assert kept == set(label) and len(kept) < len(texts)
    assert 0 < rows["alike"] <= rows["pairs"] <= 3 * rows["alike"]


def test_sketches_differ_in_no_more_bits_than_sets_in_hashes():
    r = simhash.np.random.default_rng(80)
    for n in (0, 1, 30, 300, 3000):
        for gone in (0, 1, n // 10, n):
            one = simhash.np.unique(r.integers(0, 1 << 63, n).astype("u8"))
            two = simhash.np.unique(simhash.np.concatenate((one[gone:], r.integers(0, 1 << 63, gone // 2).astype("u8"))))
            bits = int(simhash.np.bitwise_count(simhash.sketch_of(one).view("u8") ^ simhash.sketch_of(two).view("u8")).sum())
            assert bits <= len(simhash.np.setxor1d(one, two)) and len(simhash.sketch_of(one)) == simhash.SKETCH
            assert bits or not len(simhash.np.setxor1d(one, two))


def test_sizes_on_every_side_of_the_bound_are_found(spark):
    """Sets whose sizes are exactly at the bound, one above and one below it, and the rest of the classes of sizes."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:n]) for n in (5, 9, 14, 54, 53, 404)] + [" ".join(words[k:k + n]) for k, n in ((0, 104), (25, 104), (11, 104), (12, 104), (0, 84), (0, 129))]
    sets = spark.createDataFrame([(f"{i:02d}", simhash.np.unique(simhash.shingle_hashes(t, 5)).view("i8").tolist()) for i, t in enumerate(texts)], "_key string, set array<long>")
    alone = sets.select(F.col("_key").alias("key"), F.col("_key").alias("component"), F.lit(1).cast("long").alias("texts"))
    placed = simhash._by_rare_shingles(alone, sets, 0.8).withColumn("lead", F.lit("none"))
    found = {tuple(sorted(x)) for x in simhash._across_groups(placed, 0.8).select("key", "_key").collect()}
    own = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = {(f"{i:02d}", f"{j:02d}") for j in range(len(own)) for i in range(j) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    assert len(alike) > 5 and alike <= found


def test_copies_cut_off_or_continued_leave_one(spark):
    texts = []
    for seed in range(40):
        words, more = prose(seed, 400).split(" "), prose(1000 + seed, 60).split(" ")
        texts += [words, words[:330], words[70:], words + more, words[:150] + words[215:]]
    texts = [" ".join(t) for t in texts]
    assert all(similarity(texts[i - i % 5], t) >= 0.8 for i, t in enumerate(texts))
    rest = simhash.near_deduplicated(table(spark, texts), shingle=5, similarity=0.8)
    assert sorted(r.doc_id for r in rest.collect()) == list(range(0, 200, 5))


def test_repeated_passages_go_but_the_first(spark, empty):
    passage = prose(20, 80)
    texts = [prose(21, 120) + " " + passage + " " + prose(22, 120), prose(23, 90) + " " + passage, passage + "\n" + passage, None, "", prose(24, 200)]
    names = ["_key_of", "_key", "_id", "_done", "_later", "key", "id", "row", "done", "told_id", "told_key", "everywhere", "later", "h", "a.b", "-"]
    docs = table(spark, texts, ids=[1, 2, 3, 4, 5, 6]).withColumn("n_removed", F.lit("x"))
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    cleaned = spans.span_deduplicated(docs)
    assert cleaned.columns == [c for c in docs.columns if c != "n_removed"] + ["n_removed"]
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert all(r[n] == f"{n}-{r.doc_id}" for r in rows.values() for n in names)
    assert rows[1].text == texts[0] and rows[1].n_removed == 0 and rows[6].text == texts[5]
    assert 80 - 20 <= rows[2].n_removed <= 80 and rows[2].text.startswith(prose(23, 90)[:400])
    assert rows[3].n_removed >= 140 and rows[4].text is None and rows[5].text == ""
    assert spans.span_deduplicated(empty).count() == 0


def test_spans_match_all_runs(spark):
    """Documents put together from few sentences of uneven length, so that runs repeat in many ways; some ids repeat."""
    r = random.Random(12)
    stock = [prose(i, r.choice((1, 2, 5, 9, 16, 30))) + "." for i in range(14)]
    texts = ["\n".join(" ".join(r.choice(stock) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 3))) for _ in range(60)]
    texts += [" ".join(stock), " ".join(stock), None, "  " + stock[5] + "\t" + stock[4] + " \n", prose(3, 400), prose(3, 400)[900:]]
    ids = [*range(len(texts) - 2), 900, 900]
    ids[3] = None
    found = spans.span_deduplicated(table(spark, texts, ids=ids)).collect()
    want = brute.without_repeated_runs(list(zip(ids, texts)))
    assert sorted(((x.doc_id, x.text or "", x.n_removed) for x in found), key=repr) == sorted(((i, t or "", n) for i, t, n in want), key=repr)


def test_pieces_hold_all_words():
    for text in (prose(30, 300), "a\n\nb. c", "", "x", "word " * 50):
        lines, counts = spans.pieces(text, spans._Cuts())
        assert b" ".join(lines).decode().split() == text.lower().split() and sum(counts) == len(text.split())


def test_spans_hold_little_at_once(spark):
    """Batches of texts are bounded by their bytes, words that a worker remembers by their number; all of many batches is done."""
    passage = prose(900, 80)
    texts = [prose(901 + i, 14_000, 60_000) + ("\n" + passage if i % 20 == 0 else "") for i in range(150)]
    docs = table(spark, texts).coalesce(1)
    files = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cleaned = spans.span_deduplicated(docs)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == files

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=sum(map(len, batch["text"])))[["n"]].head(1)

    try:
        removed = {r.doc_id: r.n_removed for r in cleaned.collect()}
        most = max(r.n for r in docs.select("text").mapInPandas(sizes, "n long").collect())
    finally:
        tune(spark)
    assert sum(map(len, texts)) > 11_000_000 and most < 5_000_000
    assert len(removed) == 150 and removed[0] == 0 and all(removed[i] >= 60 for i in range(20, 150, 20))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "64m"

    tracemalloc.start()
    cuts = spans._Cuts()
    for i in range(400_000):
        cuts[f"word{i}"]
    assert tracemalloc.get_traced_memory()[0] < 30_000_000
    tracemalloc.stop()


# --- packing ---------------------------------------------------------------------------------------------------------------


def test_packing_is_gapless_and_whole(spark, empty):
    import public_tokenizers
    import zlib

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "Hello, World!", prose(40, 3000), "don't <|endoftext|> x<|ENDOFTEXT|>", "İ Σς ½² \x1ca b ...!"] + [prose(i, 20 + i) for i in range(60)]
    docs = table(spark, texts + texts[-3:])
    rows = packing.packed(docs, path).collect()
    tokenizer, by = Tokenizer.from_file(path), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts + texts[-3:]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (k, k * 2048, len(ids[k * 2048:][:2048]), zlib.crc32(np.array(ids[k * 2048:][:2048], "<u4").tobytes()))
            for k in range(-(-len(ids) // 2048))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.packed(empty, path).count() == 0


def best_fit(lengths):
    """How many sequences best fit, longest first, needs."""
    gaps = []
    for size in sorted(lengths, reverse=True):
        room = [g for g in gaps if g >= size]
        if room:
            gaps.remove(min(room))
        gaps.append((min(room) if room else 2048) - size)
    return len(gaps)


@pytest.mark.parametrize("low, high, n", [(1, 2048, 4000), (1, 2048, 300), (300, 1100, 1500), (1, 200, 3000), (700, 800, 500)])
def test_sum_of_squares_stays_near_the_bound(low, high, n):
    lengths = np.random.default_rng(1).integers(low, high, n)
    sequence, offset = packing.sum_of_squares(lengths)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and len(used) <= 1.01 * best_fit(lengths.tolist()) + 1
    if low == 1 and n > 1000:
        assert len(used) <= 1.02 * lengths.sum() / 2048 + 1


# --- WARC ------------------------------------------------------------------------------------------------------------------


def test_archives_read_back(spark, tmp_path):
    pages = [(3, "http://a/ b\r\n", "<p>é</p>"), (1, None, "<p>é</p>"), (None, "u", "<p>é</p>"), (2, "v", None), (-5, "w", ""), (9, "x", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = warc.write_archives(df, str(tmp_path), archive_bytes=500)
    rows = {r.page_id: r for r in warc.read_archives(found).collect()}
    assert len(rows) == 6 and all(r.verified for r in rows.values())
    assert rows[1].record_type == "response" and rows[1].payload.decode() == "<p>é</p>" and rows[1].url is None
    assert rows[3].record_type == "revisit" and rows[3].refers_to == 1 and rows[3].payload_bytes == 9 and rows[3].payload is None
    assert rows[3].url == "http://a/%20b%0D%0A"
    assert rows[None].refers_to == 1
    assert rows[-5].record_type == "response" and rows[2].refers_to == -5 and rows[2].payload_bytes == 0
    assert rows[9].payload == b"y" * 300_000
    assert warc.read_archives(warc.archives(spark, str(tmp_path))).count() == 6
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damaged_archives_are_noticed(tmp_path):
    import io
    import zlib

    good = warc.record(1, "u", b"payload", warc.digest_of(b"payload"), None, "d")
    rows = [warc.parsed(m) for m in warc.members(io.BytesIO(good * 3))]
    assert [r["payload"] for r in rows] == [b"payload"] * 3 and all(r["verified"] for r in rows)
    with pytest.raises(EOFError):
        list(map(warc.parsed, warc.members(io.BytesIO(good[:-20]))))
    bent = zlib.compressobj(6, zlib.DEFLATED, 31)
    bent = bent.compress(zlib.decompress(good, 31).replace(b"payload\r\n", b"paYload\r\n")) + bent.flush()
    assert [r["verified"] for r in map(warc.parsed, warc.members(io.BytesIO(bent)))] == [False]


# --- pages -----------------------------------------------------------------------------------------------------------------


def test_main_text_leaves_the_page_around():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies to do many things for you.</div><article><h1>Head &amp; tail</h1>"
        "<p>First <b>bold</b>er  text\n goes on and on for a while.<p>Second &#233;.<div class=ad>Buy this now, it is cheap!</div>"
        "<script>var a='<p>no</p>'</script><form><input><button>Send</button></form><p>Third</article>"
        "<section id=comments><p>A reader says a lot of things here, at length.</p></section><aside>More</aside><footer>(c)</footer>")
    assert html_text.main_text(page) == "Head & tail First bolder text goes on and on for a while. Second é. Third"
    for empty_page in (None, "", "<nav>a</nav>", "<div cla"):
        assert html_text.main_text(empty_page) == ""
    assert html_text.main_text("only text") == "only text"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extracted(pages).collect()) == ["", "a"]
    assert html_text.extracted(pages.limit(0)).count() == 0


# --- suffixes --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [50, 30])
def test_repeats_match_a_dictionary(spark, monkeypatch, length):
    monkeypatch.setattr(suffixes, "CHUNK", 1500)
    monkeypatch.setattr(suffixes, "BUCKET", 4000)
    monkeypatch.setattr(suffixes, "BATCH", 3000)
    passage, r = prose(50, 40), random.Random(9)
    texts = [prose(i, 60) for i in range(12)] + [prose(60 + i, 30) + passage[r.randint(0, 30):] + prose(80 + i, 9) for i in range(12)]
    texts += [texts[0], "é" * 200, "é" * 90, "ab" * 700, "ba" * 100, None, "", passage[:49], texts[3][5:]]
    ids = [r.randint(0, 40) for _ in texts[:-2]] + [None, None]
    docs = table(spark, texts, ids=ids).withColumn("block", F.lit("x")).repartition(3)
    got = sorted((tuple(x) for x in suffixes.repeats_removed(docs, length).collect()), key=repr)
    assert got == sorted(brute.repeats(list(zip(ids, texts)), length), key=repr)


def test_no_repeats_and_no_rows(spark, empty):
    assert suffixes.repeats_removed(empty).count() == 0
    row = suffixes.repeats_removed(table(spark, [prose(1, 50)]), with_text=True).first()
    assert row.n_removed == 0 and row.kept.decode() == prose(1, 50)
    assert row.kept_sha256 == hashlib.sha256(prose(1, 50).encode()).hexdigest()


def test_merged_transforms_order_prefixes():
    r = random.Random(4)
    strings = [bytes(r.choice(b"abc") for _ in range(r.randint(8, 30))) for _ in range(40)]
    least = suffixes.smallest_holders(strings, np.arange(40), np.array([i % 3 for i in range(40)]), 6)
    for string, found in zip(strings, least):
        for at, value in enumerate(found.tolist()):
            assert value == min(i for i, s in enumerate(strings) if string[at:at + 6] in s)


def test_suffix_order_sorts_up_to_its_depth():
    r = random.Random(15)
    for alphabet in (b"ab", b"abcdefg"):
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 60))) * r.choice((1, 1, 3)) for _ in range(40)]
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", "u1") + np.uint8(1)
        sizes = np.array([len(x) for x in strings])
        string = np.repeat(np.arange(40), sizes + 1)
        left = (np.cumsum(sizes + 1) - 1)[string] - np.arange(len(text))
        order = suffixes.suffix_order(text, left, string, 50)
        assert sorted(order.tolist()) == list(range(len(text)))
        tail = lambda at: text[at:at + left[at]].tobytes()[:50]  # noqa: E731, B023
        shown = [tail(at) for at in order.tolist()]
        assert shown == sorted(shown)


@pytest.mark.parametrize("every", [1, 3, 8, 100])
def test_finished_strings_leave_the_merge(monkeypatch, every):
    monkeypatch.setattr(suffixes, "EVERY", every)
    r = random.Random(every)
    for alphabet, length in ((b"ab", 14), (b"abcdefgh", 11), (b"a", 10)):
        piece = lambda n: bytes(r.choice(alphabet) for _ in range(n))  # noqa: E731, B023
        shared = [piece(25) for _ in range(6)]
        strings = list({piece(r.randint(length, 30)) + r.choice(shared)[r.randint(0, 9):] + piece(r.randint(0, 9)) for _ in range(80)})
        docs = np.array([r.randrange(1000) for _ in strings])
        least = suffixes.smallest_holders(strings, docs, np.array([i % 5 for i in range(len(strings))]), length)
        for string, found in zip(strings, least):
            assert found.tolist() == [min(d for d, s in zip(docs.tolist(), strings) if string[k:k + length] in s) for k in range(len(string) - length + 1)]


@pytest.mark.parametrize("length", [8, 20, 50])
def test_a_merge_that_begins_from_ranks_is_the_whole_merge(monkeypatch, length):
    r = random.Random(length)
    words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 30))) for _ in range(40)]
    strings = list({b"".join(r.choice(words) for _ in range(12))[:r.randint(length, 120)].ljust(length, b"a") for _ in range(400)})
    docs, source = np.array([r.randrange(50) for _ in strings]), np.array([r.randrange(8) for _ in strings])
    merged, begun_at = suffixes.merged_intervals, []

    def spied(transforms, string, window, rounds, ranks=None, begun=0):
        begun_at.append(begun)
        return merged(transforms, string, window, rounds, ranks, begun)

    monkeypatch.setattr(suffixes, "merged_intervals", spied)
    found = suffixes.smallest_holders(strings, docs, source, length)
    least = {}
    for s, d in zip(strings, docs.tolist()):
        for i in range(len(s) - length + 1):
            least[s[i:i + length]] = min(d, least.get(s[i:i + length], d))
    assert [f.tolist() for f in found] == [[least[s[i:i + length]] for i in range(len(s) - length + 1)] for s in strings]
    assert begun_at[0] <= length and (length < 20 or 2 * begun_at[0] > length)


def test_one_anchor_in_many_contexts(spark):
    """A stock phrase of 60 bytes in 10,000 different contexts, every tenth of them once more."""
    phrase = "All rights reserved, no part of this may be reproduced here."
    rows = [(i, prose(100_000 + i % 9000, 6) + phrase + prose(200_000 + i % 9000, 6)) for i in range(10_000)]
    docs = table(spark, [t for _, t in rows])
    found = {r.doc_id: r for r in suffixes.repeats_removed(docs).collect()}
    raw = [t.encode() for _, t in rows]
    assert found[0].n_removed == 0 and all(found[i].n_removed == len(raw[i]) for i in range(9000, 10_000))
    for i in range(1, 9000, 97):
        at, n = raw[i].index(phrase.encode()), len(phrase)
        assert n <= found[i].n_removed < n + 12 and found[i].n_spans == 1 and found[i].n_bytes == len(raw[i]) and at > 0


# --- neighbours ------------------------------------------------------------------------------------------------------------


def test_neighbours_reach_the_wanted_recall(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(3000, 16)) * r.uniform(0.5, 2, size=(3000, 1))
    vectors[1000:2000] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] + [1.0] * 15), (4003, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit(1))
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, top=10).toPandas().sort_values(["query_id", "rank"])
    assert set(found["query_id"]) == set(range(0, 3000, 20)) and (found.groupby("query_id").size() == 10).all()
    hits = 0
    for q, own in found.groupby("query_id"):
        scores = (vectors * vectors[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(3000), -scores)).tolist() if i != q][:10]
        hits += len(set(order) & set(own["vec_id"]))
        assert np.allclose(own["score"], scores[own["vec_id"]]) and own["score"].is_monotonic_decreasing
    assert hits >= 0.93 * 10 * 150
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2, 4001)"), F.col("vec_id") == 0, top=10).collect()
    assert sorted((x["rank"], x.vec_id) for x in few)[0][0] == 1 and {x.vec_id for x in few} == {1, 2}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------------


def test_automaton_finds_words_stems_and_misspellings():
    found = toxicity.Automaton({"idiot": 2.0, "disgusting": 3.0, "bad": 1.0}, {"scumm": 4.0}, ordinary=["idiom"])
    assert found.hit("idiot") == (2.0, toxicity.WHOLE) and found.hit("scummy") == (4.0, toxicity.BEGINNING)
    for word in ("idot", "idiott", "idiat"):
        assert found.hit(word) == (2.0, toxicity.MISSPELLED)
    assert found.hit("disgsting") and found.hit("dsigusting") and not found.hit("disgusted")
    assert not any(map(found.hit, ("idiom", "bat", "ba", "", "diot", "xidiot", "idiotic2")))


def distance(a, b):
    """Levenshtein's, by the table; the first letter of `a` is `b`'s, or no letter."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_hit(run, words, stems, ordinary):
    if run in words:
        return words[run], toxicity.WHOLE
    starts = [w for s, w in stems.items() if run.startswith(s)]
    if starts:
        longest = max((s for s in stems if run.startswith(s)), key=len)
        return stems[longest], toxicity.BEGINNING
    near = []
    for term, weight in words.items():
        # the first letter stays, or a sign or number stands for it
        d = distance(run[1:], term[1:]) + (run[0] != term[0]) if run and (run[0] == term[0] or not run[0].isalpha()) else 99
        if d <= toxicity.allowed(term):
            near.append((d, -weight))
    return (-min(near)[1], toxicity.MISSPELLED) if near and run not in ordinary else None


def test_hits_match_plain_distances():
    r = random.Random(21)
    words = {prose(3000 + i, 1): 1.0 + i / 7 for i in range(40)} | {"idiot": 2.0, "blatherskunk": 3.0, "snorkwitted": 4.0, "bad": 1.5}
    stems = {"grum": 2.5, "snor": 1.25}
    ordinary = {"idiom", "blatherskink"}
    automaton = toxicity.Automaton(words, stems, ordinary)
    letters = "abcdefghijklmnopst1!*"
    for _ in range(3000):
        run = list(r.choice([*words, *stems, *ordinary]))
        for _ in range(r.randint(0, 3)):
            at, kind = r.randrange(len(run) + 1), r.randrange(3)
            run[at:at + (kind != 0)] = [r.choice(letters)] if kind != 1 else []
        run = "".join(run)
        assert automaton.hit(run) == plain_hit(run, words, stems, ordinary), run


def test_joined_and_masked_spellings_hit():
    automaton = toxicity.Automaton({"idiot": 2.0, "moron": 3.0}, {})
    for word in ("you,idiot", "this/idiot", "well-idiot", "(idiot)", "IDIOT!!", "x.idiot.y"):
        assert toxicity.best_hit(word, automaton)[0] == 2.0, word
    for word in ("id!ot", "i*diot", "*diot", "1diot", "i**ot" if toxicity.allowed("idiot") > 1 else "idi*t", "(id!ot)", "you,id!ot"):
        assert toxicity.best_hit(word, automaton) == (2.0, toxicity.MISSPELLED), word
    assert toxicity.best_hit("idiot/moron", automaton) == (3.0, toxicity.WHOLE)
    assert not any(toxicity.best_hit(w, automaton) for w in ("", "--", "pilot", "riot", "(more)", "a-b-c"))


def test_quotation_weighs_less_than_address():
    found = toxicity.Automaton({"idiot": 2.0}, {})
    of = lambda t: toxicity.features(t, found, set(), {})[0]
    assert of('she wrote "what an idiot that was" and left') < of("there an idiot was seen") < of("you are an idiot indeed")


def test_toxic_texts_score_high(spark, empty):
    r = random.Random(6)
    bad = ["grumfle", "snorkwit", "blatherskunk"]

    def text(i, toxic):
        words = prose(1000 + i, 80).split()
        for _ in range(3 * toxic):
            words.insert(r.randint(1, len(words)), r.choice(bad))
        return " ".join(words)

    texts = [text(i, i % 4 == 0) for i in range(240)] + [None, ""]
    docs = table(spark, texts).select("*", *[F.lit(f"{n}!").alias(n) for n in ("score", "_f", "f", "row", "whole", "beginning", "misspelled", "a.b")])
    labelled = docs.where("doc_id < 160").select("text", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    found = toxicity.scored(docs, labelled)
    assert found.columns == docs.columns
    found = found.collect()
    assert all(x[n] == f"{n}!" for x in found for n in ("_f", "f", "row", "whole", "beginning", "misspelled", "a.b"))
    rows = {x.doc_id: x.score for x in found}
    assert all((rows[i] >= 0.7) == (i % 4 == 0) for i in range(160, 240)) and rows[240] == rows[241] < 0.5
    assert toxicity.scored(empty, labelled).count() == 0
    assert {x.score for x in toxicity.scored(docs.limit(3), labelled.limit(0)).collect()} == {toxicity.scored(docs.limit(1), labelled.limit(0)).first().score}


def test_lexicon_keeps_rare_terms_and_all_ordinary_words(spark, monkeypatch):
    # fifty words are more frequent in toxic texts than the one that tells them apart
    monkeypatch.setattr(toxicity, "CANDIDATES", 50, raising=False)
    r, common = random.Random(5), [f"{c}{d}mon" for c in "abcdefghij" for d in "vwxyz"]

    def text(i, toxic):
        words = [r.choice(common) for _ in range(60)]
        if toxic and i % 4 == 0:
            words[r.randrange(1, 60)] = "idiot"
        if not toxic:
            words[9] = "idio" + "bcdefghjkl"[i % 10]
        return " ".join(words), int(toxic)

    labelled = spark.createDataFrame([text(i, i < 100) for i in range(400)], "text string, toxic int")
    words, stems = toxicity.lexicon(labelled)
    assert "idiot" in words and not set(common) & set(words)
    assert toxicity.ordinary_words(labelled, words, {}) == ["idio" + c for c in "bcdefghjkl"]


@pytest.mark.parametrize("at_once", [8192, 60])
def test_neighbours_among_fifty_thousand_clustered_vectors(spark, monkeypatch, tmp_path, at_once):
    monkeypatch.setattr(neighbours, "QUERIES", at_once)
    r = np.random.default_rng(31)
    centres = r.normal(size=(300, 24))
    vectors = (centres[r.integers(0, 300, 50_000)] + 0.3 * r.normal(size=(50_000, 24))).astype("f4").astype("f8")
    parquet.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": list(vectors)}), str(tmp_path / "v.parquet"))
    found = neighbours.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 100 == 0, top=10).toPandas().sort_values(["query_id", "rank"])
    assert (found.groupby("query_id").size() == 10).all() and found["query_id"].nunique() == 500
    scores = vectors[::100] @ vectors.T
    scores[np.arange(500), np.arange(0, 50_000, 100)] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    got = found["vec_id"].to_numpy().reshape(500, 10)
    hits = sum(len(set(a) & set(b)) for a, b in zip(best.tolist(), got.tolist()))
    assert hits >= 0.9 * 5000
    exact = (vectors[found["query_id"]] * vectors[found["vec_id"]]).sum(axis=1)
    assert (np.abs(exact - found["score"]) < 1e-9).all()


# --- repeated rows, equal ids and very long texts --------------------------------------------------------------------------


def test_repeated_rows_of_archives_fingerprints_and_the_mix(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, "v", "<p>a</p>"), (3, "w", "b"), (3, "w", "b")], "page_id long, url string, html string")
    found = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert len(found) == 5 and {(i, t) for i, t, _ in found if i == 2} == {(2, "revisit")}
    assert all(refers in (None, 1) for i, _, refers in found if i < 3) and {i for i, t, _ in found if t == "response"} == {1, 3}
    text = prose(70, 50)
    docs = table(spark, [text, text, prose(71, 50), text], ids=[4, 4, 9, 2])
    rows = sorted((r.doc_id, r.component_id) for r in simhash.fingerprint_components(docs).collect())
    assert rows == [(2, 2), (4, 2), (4, 2), (9, 9)]
    mixes = {}
    for r in mixing.mixed(docs).collect():
        mixes.setdefault((r.doc_id, r.source), []).append(tuple(r.mix))
    assert len(mixes[4, "s0"]) == 1 and sum(map(len, mixes.values())) == 4
    same = table(spark, [text, text], ids=[4, 4], sources=["a", "a"])
    assert len({tuple(r.mix) for r in mixing.mixed(same).collect()}) == 1 and mixing.mixed(same).count() == 2


def test_equal_ids_of_vectors_and_spans(spark):
    r = np.random.default_rng(8)
    rows = [(i // 2, r.normal(size=8).tolist()) for i in range(60)]  # every id twice, with different vectors
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, top=5).toPandas()
    assert (found["query_id"] == 0).all() and set(found["rank"]) == set(range(1, 6))
    passage = prose(72, 80)
    docs = table(spark, [passage, passage + " " + prose(73, 40), passage], ids=[5, 5, 7])
    kept = sorted((x.doc_id, x.n_removed) for x in spans.span_deduplicated(docs).collect())
    assert [n for i, n in kept if i == 5] == [0, 0] and kept[-1][1] > 60


def test_a_very_long_text_is_scored_whole(spark):
    base = [prose(4000 + i, 60) + (" grumfle snorkwit" * 3 if i % 4 == 0 else "") for i in range(160)]
    labelled = spark.createDataFrame([(" ".join(random.Random(i).sample(t.split(), len(t.split()))), int(i % 4 == 0)) for i, t in enumerate(base)], "text string, toxic int")
    long = prose(5000, 200_000)
    rows = toxicity.scored(table(spark, [long, long + " you grumfle snorkwit" * 5]), labelled).orderBy("doc_id").collect()
    assert rows[0].score < 0.5 < rows[1].score

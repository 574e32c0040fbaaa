"""The registered queries over the driver tables: against their SQL, or against plain versions."""

import brute
import numpy as np
import pytest
from compare import differences, duck

import corpus_pipeline
from fleetlens.llm import quality
from fleetlens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLES[name]) is None


def test_suffix_query_matches_a_dictionary(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op4_suffix_array_dedup"](spark, FOLDER).collect()) == sorted(brute.repeats(rows))


def test_span_query_matches_all_runs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = QUERIES["op7_sentence_spans"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in found) == sorted(brute.without_repeated_runs(rows))


def test_simhash_query_matches_all_pairs(spark):
    found = QUERIES["op5_simhash_near_dedup"](spark, FOLDER).orderBy("doc_id").collect()
    prints = [int(r.fingerprint, 16) for r in found]
    label = list(range(len(found)))
    for _ in range(len(found)):
        new = [min(label[j] for j in range(len(found)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(found))]
        if new == label:
            break
        label = new
    assert [r.component_id for r in found] == [found[x].doc_id for x in label]


def test_neighbours_query_reaches_its_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table["embedding"]).astype("f8"), table["vec_id"].to_numpy()
    found = QUERIES["op2_nearest_neighbours"](spark, FOLDER).toPandas()
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        hits += len(set(ids[np.argsort(-scores)[:20]]) & set(found.loc[found["query_id"] == ids[at], "vec_id"]))
    assert hits >= 0.9 * len(found)


def test_toxicity_query_on_held_out_labels(spark):
    found = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = found.merge(labels, on="doc_id")
    held = held[held["held_out"]]
    right = held["predicted"] == held["toxic"]
    assert right[held["toxic"] == 1].mean() > 0.85 and right[held["toxic"] == 0].mean() > 0.99


def test_pages_query_gives_the_articles(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for row in QUERIES["op3_html_extraction"](spark, FOLDER).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|i|a|em)\b[^>]*>", "", body))).split())
        assert row.text == want and row.n_chars == len(want)


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "sequences":
            assert out.columns == columns and out.dtypes == docs.dtypes
            out = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = (docs, out)
        docs = out
    before, after = kept["quality rules"]
    passed = {r.doc_id for r in quality.judged(before).where("quality.kept").collect()}
    assert {r.doc_id for r in after.collect()} == passed
    before, after = kept["near duplicates"]
    left = [r.text for r in after.collect()]
    assert len(set(left)) == len(left) and set(left) <= {r.text for r in before.collect()}
    before, after = kept["repeated spans"]
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t, _ in brute.without_repeated_runs([(r.doc_id, r.text) for r in before.collect()])}
    before, after = kept["source mix"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and after.count() > 0
    before, after = kept["sequences"]
    assert after.where("piece = 0").count() == before.count()

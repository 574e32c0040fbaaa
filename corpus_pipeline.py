"""From raw documents to packed training sequences: five stages, each an operator over all that the one before kept.

STAGES lists them in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; the last has a row for every piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.mixing import emitted
from fleetlens.llm.packing import packed
from fleetlens.llm.quality import kept
from fleetlens.llm.shared import written
from fleetlens.llm.simhash import near_deduplicated
from fleetlens.llm.spans import BATCH, span_deduplicated
from fleetlens.session import settings, tune

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    tune(spark)
    return kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    tune(spark)
    return near_deduplicated(docs, shingle=5, similarity=0.8)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans; n_chars follows the text."""
    tune(spark)
    cleaned = span_deduplicated(docs).drop("n_removed")
    return cleaned.selectExpr(*[
        f"cast(char_length(text) as {docs.schema[c].dataType.simpleString()}) as n_chars" if c == "n_chars" else f"`{c}`"
        for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    tune(spark)
    return emitted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, packed into sequences."""
    tune(spark)
    # the texts are cut into tokens in here; workers get them in small batches
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        return packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated spans", repeated_spans),
    ("source mix", source_mix),
    ("sequences", sequences),
]

#: SQL has no tokenizer and no SimHash; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

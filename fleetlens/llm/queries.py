"""The registered queries of these operators over the driver tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import (
    centroids,
    divergence,
    html_text,
    mixing,
    neighbours,
    packing,
    quality,
    simhash,
    spans,
    suffixes,
    tokens,
    toxicity,
    warc,
)
from fleetlens.llm.shared import may_be_in
from fleetlens.plans.registry import Query, Tables
from fleetlens.session import tune

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
#: So many labels, about 16 MB, may be sent to every task instead of shuffling texts to them; more are joined.
LABELS_TO_SEND = 1_000_000


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(tune(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op5_simhash_near_dedup")
def op5(t: Tables) -> DataFrame:
    found = simhash.fingerprint_components(t.documents, shingle=3, most=3)
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


@query("op6_source_mixing", sql=f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS_SQL}) AS size, md5(coalesce(text, '')) AS digest FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM per),
-- the capped sources are the first of the order cap / weight; what is left and free after the first k of them
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
  FROM ranked
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, free FROM levels WHERE cap * free >= weight * rest ORDER BY free DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN cap * free < weight * rest THEN cap::DOUBLE
         ELSE (weight * rest)::DOUBLE / free::DOUBLE END AS target FROM ranked, level),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
""")
def op6(t: Tables) -> DataFrame:
    rows = mixing.mixed(t.documents.select("doc_id", "text", "source"))
    return rows.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


@query("op7_sentence_spans")
def op7(t: Tables) -> DataFrame:
    return spans.span_deduplicated(t.documents).select("doc_id", "text", "n_removed")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))


@query("op9_quality_rules", sql=rf"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS_SQL} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM split, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row, sum(least(3, gap)) AS n FROM (
    SELECT row, coalesce(i - lag(i) OVER (PARTITION BY row ORDER BY i), 3) AS gap FROM twice) GROUP BY row),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered c USING (row)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols <= 0.1 * n_words
       AND n_shouts <= 0.3 * n_words AND n_stop >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM based
""")
def op9(t: Tables) -> DataFrame:
    q = quality.judged(t.documents.select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    "quality.base_failed", "quality.kept")


@query("op10_sum_of_squares_packing")
def op10(t: Tables) -> DataFrame:
    return packing.packed(t.documents, public_tokenizers.path(TOKENIZER))


@query("op1_warc", sql="""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
letters AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31) + 1, 1)), '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM letters)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM firsts
""")
def op1(t: Tables) -> DataFrame:
    found = warc.round_trip(t.pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@query("op3_html_extraction")
def op3(t: Tables) -> DataFrame:
    texts = html_text.extracted(t.pages.select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op2_nearest_neighbours")
def op2(t: Tables) -> DataFrame:
    return neighbours.nearest(t.embeddings, F.col("vec_id") % 20 == 0, top=20)


@query("op8_toxicity")
def op8(t: Tables) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = t.labels.where(part != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= LABELS_TO_SEND:
        labels = F.broadcast(labels)
    may = may_be_in(labels, "doc_id")  # keeps the texts of most other documents out of the join
    labelled = t.documents.select("doc_id", "text").where(may(F.col("doc_id"))).join(labels, "doc_id").select("text", "toxic")
    rows = toxicity.scored(t.documents.select("doc_id", "text"), labelled)
    held_out = F.coalesce(part == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_suffix_array_dedup")
def op4(t: Tables) -> DataFrame:
    return suffixes.repeats_removed(t.documents, length=50)


@query("op13_source_divergence", sql=r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 3),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN vocabulary USING (lang) LEFT JOIN totals USING (lang, source)),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (total + v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term)
  JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM counts GROUP BY lang) USING (lang) JOIN vocabulary USING (lang)),
gaps AS (
  SELECT s.lang, s.source, o.source AS item, sum((s.p - o.p) * (s.p - o.p) // o.p)::HUGEINT AS value
  FROM shares s JOIN shares o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN gaps ON gaps.lang = g.lang AND gaps.source = g.source AND gaps.item = o.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""")
def op13(t: Tables) -> DataFrame:
    return divergence.source_divergence(t.documents.select("lang", "source", "text"))


def _centroid_rounds(k: int, rounds: int, seed: int) -> str:
    """SQL of k-means over whole numbers, a common table for each round."""
    assigned = """(
  SELECT row, min_by(cluster, d * 1000 + cluster) AS cluster, min(d) AS distance FROM (
    SELECT row, cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d
    FROM v, c{n} AS c) GROUP BY row)"""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED {assigned.format(n=n)}")
        parts.append(f"""m{n} AS MATERIALIZED (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (row), range(1, 65) AS u(i) GROUP BY ALL)
  GROUP BY cluster)""")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m USING (cluster))")
    return f"""WITH {", ".join(parts)}, a AS {assigned.format(n=rounds)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN v USING (row) JOIN c{rounds} AS c USING (cluster)"""


@query("op12_centroid_clustering", sql=_centroid_rounds(k=40, rounds=5, seed=2))
def op12(t: Tables) -> DataFrame:
    return centroids.clustered(t.embeddings, k=40, rounds=5, seed="2", dims=64)


@query("op11_token_counts")
def op11(t: Tables) -> DataFrame:
    return tokens.token_counts(t.documents, public_tokenizers.path(TOKENIZER), limit=2048)

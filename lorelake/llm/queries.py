"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lorelake.llm import (
    compression_quality,
    exact_dedup,
    language_crf,
    license_scan,
    mixing,
    ngram_join,
    quality_rules,
    retrieval_packing,
    sentencepiece_codec,
    sharding,
    term_ranking,
    token_counts,
    vector_codes,
)
from lorelake.llm.common import documents, labels

# Where the public tokenizer files are; a parameter of the operators.
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, row counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public merge vocabulary, and under its unigram reading."""
    return token_counts.token_counts(documents(spark, sf_dir), corpus_pipeline.MODEL_PATH).select("doc_id", "n_tokens", "n_unigram")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document."""
    found = license_scan.scan(documents(spark, sf_dir), keep=["doc_id"]).withColumn("score", F.round("score", 6))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the line labeller's verdict."""
    docs = documents(spark, sf_dir)
    model = quality_rules.fit(docs, labels(spark, sf_dir))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    return quality_rules.apply_rules(docs, model).select("doc_id", *columns)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document (giant ones: of each chunk), decoded again and compared."""
    encoded = sentencepiece_codec.encode(documents(spark, sf_dir), corpus_pipeline.MODEL_PATH, round_trip=True)
    return encoded.select("doc_id", "chunk_no", "n_chunks", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the slots of the schedule that take them."""
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot", "last_slot")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.marks(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and near-duplicate group of every document."""
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "links", "linked_docs", "group_id", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    docs = documents(spark, sf_dir)
    scored = compression_quality.score(docs, compression_quality.fit(docs, labels(spark, sf_dir)))
    predicted = (F.col("score") >= corpus_pipeline.QUALITY_THRESHOLD).cast("int")
    return scored.select("doc_id", compression_quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = documents(spark, sf_dir)
    found = language_crf.predict(docs, language_crf.fit(docs))
    return found.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 ids, each filled with lexical neighbours of its seed."""
    pieces = retrieval_packing.pack(documents(spark, sf_dir), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in 8 parts of 16 entries after 6 rounds."""
    rows, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = vector_codes.with_label_error(rows)
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return term_ranking.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_shards, op2_token_counts, op3_licenses, op4_quality_rules, op5_sentencepiece, op6_mix, op7_exact_dedup, op8_ngram_join, op9_quality, op10_language,
        op11_pack, op12_vector_codes, op13_ranked_search,
    )
} | {"pipeline": corpus_pipeline.run}

def license_sql() -> str:
    """The license scan in SQL: phrases by counting matching words at each start, IDF shares by joins."""
    listed = license_scan.templates()
    quoted = lambda x: "'" + x + "'"
    rows, key_rows = [], []
    for t, (label, words, phrases, base) in enumerate(listed):
        rows += [f"({t}, {quoted(label)}, {str(base).lower()}, {i}, {quoted(w)})" for i, w in enumerate(words)]
        for n, phrase in enumerate(phrases):
            at = license_scan.find(words, phrase)
            key_rows += [f"({t}, {n}, {i})" for i in range(at, at + len(phrase))]
    return rf"""
WITH tw(t, label, base, i, w) AS (VALUES {", ".join(rows)}),
kp(t, p, i) AS (VALUES {", ".join(key_rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d WHERE len(ws) > 0),
dw AS (SELECT * FROM u WHERE w IN (SELECT w FROM tw)),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM dw GROUP BY 1),
idf AS (SELECT w, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1e-9 AS x FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w)),
ranked AS (SELECT t, i, w, x, row_number() OVER (PARTITION BY t ORDER BY x DESC, i) AS r FROM tw JOIN idf USING (w)),
anchors AS (SELECT t, i FROM (SELECT t, p, i, row_number() OVER (PARTITION BY t, p ORDER BY x DESC, i) AS r FROM kp JOIN ranked USING (t, i)) WHERE r = 1),
ix AS (SELECT t, i, w, x FROM ranked WHERE r <= {license_scan.RARE_WORDS} OR (t, i) IN (SELECT (t, i) FROM anchors)),
ks AS (SELECT DISTINCT t, i, w FROM kp JOIN tw USING (t, i)),
st AS (SELECT doc_id, t, dw.i - ks.i AS start FROM dw JOIN ks USING (w) GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM ks k WHERE k.t = ks.t)),
tot AS (SELECT t, sum(x) AS total FROM ix GROUP BY 1),
hit AS (SELECT st.doc_id, st.t, st.start, sum(ix.x) AS placed FROM st JOIN ix ON ix.t = st.t JOIN dw ON dw.doc_id = st.doc_id AND dw.i = st.start + ix.i AND dw.w = ix.w GROUP BY 1, 2, 3),
al AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(placed / total) AS score
  FROM hit JOIN tot USING (t) JOIN (SELECT DISTINCT t, label, base FROM tw) USING (t) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1), 6) AS score
FROM d LEFT JOIN al USING (doc_id)"""


def vector_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Plain Lloyd rounds in SQL: every part against every entry, six times over."""
    steps = []
    for k in range(rounds + 1):
        # Distance and entry in one number: the smallest has the lower index of equal distances.
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, s.p, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT * {entries} + e) AS m
  FROM s JOIN c{k} ON c{k}.p = s.p GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""n{k} AS (
  SELECT p, e, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM (SELECT s.p, m % {entries} AS e, x FROM s JOIN a{k} USING (r, p)), width, range(1, w + 1) z(i) GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(b.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM n{k} GROUP BY 1, 2) b USING (p, e))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS MATERIALIZED (SELECT max(len(q)) // {parts} AS w FROM v),
s AS MATERIALIZED (SELECT r, p, list_slice(q, p * w + 1, (p + 1) * w) AS x FROM v, width, range({parts}) y(p)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM v),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM s JOIN f USING (r) WHERE e < {entries}),
{", ".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"""


RANKED_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT count(*) AS nn, sum(len(ws)) AS ll FROM d WHERE len(ws) > 0),
i AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS MATERIALIZED (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM i) GROUP BY 1, 2),
g AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, t GROUP BY 1),
m AS (SELECT r, doc_id, CAST(50 + (50 * len(ws) * nn) // ll AS BIGINT) AS m FROM d, t WHERE len(ws) > 0),
s AS (
  SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM f JOIN g USING (w) JOIN m USING (r) JOIN i USING (w) GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""


ORACLES = {
    "op12_vector_codes": vector_sql(),
    "op13_ranked_search": RANKED_SQL,
    "op3_licenses": license_sql(),
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i : i + 4], ' ')))) END AS grams FROM w),
c AS (SELECT md5(array_to_string(grams, chr(10))) AS k, min(doc_id) AS class_id, count(*) AS class_size, any_value(len(grams)) AS n, any_value(grams) AS grams FROM s GROUP BY 1),
g AS (SELECT class_id, n, class_size, unnest(grams) AS gram FROM c),
p AS (
  SELECT a.class_id AS a, b.class_id AS b, any_value(b.class_size) AS b_size
  FROM g a JOIN g b ON a.gram = b.gram AND a.class_id <> b.class_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
l AS (SELECT a, count(*) AS links, sum(b_size) AS linked_docs FROM p GROUP BY 1),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
q AS (SELECT node, min(seen) AS group_id FROM r GROUP BY 1)
SELECT s.doc_id, c.class_id, c.class_size, coalesce(l.links, 0) AS links, CAST(coalesce(l.linked_docs, 0) AS BIGINT) AS linked_docs,
  coalesce(q.group_id, c.class_id) AS group_id, s.doc_id = coalesce(q.group_id, c.class_id) AS kept
FROM s JOIN c ON c.k = md5(array_to_string(s.grams, chr(10))) LEFT JOIN l ON l.a = c.class_id LEFT JOIN q ON q.node = c.class_id""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

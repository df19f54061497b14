"""The pipeline's stages against plain models, and what the registered queries promise."""

import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from lorelake.llm import compression_quality, language_crf, mixing, queries
from lorelake.llm.common import documents, labels, stash
from tests.llm.test_duplicates import digest, plain_join, plain_targets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SMALL), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stash(stage(spark, docs, SMALL))
    return [*out, docs]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert len({tuple(s.columns) for s in stages[:-1]}) == 1


def test_quality_stage(spark, stages):
    model = compression_quality.fit(stages[0], labels(spark, SMALL))
    rows = stages[0].collect()
    want = [r["doc_id"] for r, s in zip(rows, model.scores([r["text"] for r in rows]), strict=True) if s >= 0.3]
    assert ids(stages[1]) == sorted(want)


def test_quality_stage_keeps_clean_documents(spark):
    larger = "/root/testdata/sf0.01"
    left = set(ids(corpus_pipeline.quality(spark, documents(spark, larger), larger)))
    marked = {r["doc_id"]: r["quality"] for r in labels(spark, larger).collect()}
    good = {i for i, q in marked.items() if q == 1}
    assert len(good & left) >= 0.97 * len(good) and len(left & (set(marked) - good)) <= 0.1 * (len(marked) - len(good))


def test_duplicate_stages(stages):
    first: dict = {}
    for r in stages[1].collect():
        d = digest(r["text"])
        first[d] = min(first.get(d, r["doc_id"]), r["doc_id"])
    assert ids(stages[2]) == sorted(first.values())
    want = plain_join([(r["doc_id"], r["text"]) for r in stages[2].collect()])
    assert ids(stages[3]) == sorted(i for i, w in want.items() if w[-1])


def test_mixed_stage(stages):
    size = lambda t: len((t or "").encode().split())
    given = {r["doc_id"]: r for r in stages[3].collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(stages[3]).collect()}
    times = Counter(r["doc_id"] for r in stages[4].collect())
    assert times == Counter({i: int(taken[i] / size(r["text"]) + 0.5) for i, r in given.items() if size(r["text"])})
    totals: dict = {}
    words: dict = {}
    for i, r in given.items():
        totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
        words[r["source"]] = words.get(r["source"], 0) + times[i] * size(r["text"])
    longest = max(size(r["text"]) for r in given.values())
    assert all(abs(words[s] - t) <= longest + 1 for s, t in plain_targets(totals).items())


def test_encoded_stage(spark, stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL_PATH)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].filter("n_chunks = 1").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(ids(stages[4]))
    assert all(r["ids"] == lib.encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) for r in rows)


def test_run_is_the_chain(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, stages[5].collect()))


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(contract.queries()) and set(queries.ORACLES) <= set(contract.oracle_sql())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", ["op1_shards", "op4_quality_rules", "op6_mix", "op9_quality", "op10_language"])
def test_one_row_for_each_document(spark, name):
    assert ids(queries.QUERIES[name](spark, SMALL)) == ids(documents(spark, SMALL))


def test_round_trip(spark):
    rows = queries.op5_sentencepiece(spark, SMALL).select("round_trip").distinct().collect()
    assert [r["round_trip"] for r in rows] == [True]


def test_shard_query_columns(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SMALL).collect()}
    for r in queries.op1_shards(spark, SMALL).collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))


def test_held_out_languages_are_not_read(spark):
    docs = documents(spark, SMALL)
    turned = docs.withColumn("lang", F.when(language_crf.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language_crf.fit(docs), language_crf.fit(turned)
    assert a.languages == b.languages and (a.chain.weights == b.chain.weights).all()


def test_mixed_stage_keeps_a_source_of_one_long_text(spark):
    """A text of 5,000 words whose source may have fewer than half of them; the other sources have plenty."""
    rows = [(i, "b" * 3 + f" word{i}" * 20, "en", "big") for i in range(40)] + [(100, "long " * 5000, "en", "one"), (101, None, "en", "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    target = {r["of"]: r["target"] for r in mixing.taken(docs, weights=(100, 1, 1), volume=0.2).collect()}
    assert 0 < target["one"] < 2500
    got = Counter(r["source"] for r in mixing.repeat(docs, weights=(100, 1, 1), volume=0.2).collect())
    assert got["one"] == 1 and got["none"] == 0 and got["big"] > 0


def test_encoded_stage_decodes_again(stages):
    rows = stages[5].select("round_trip").collect()
    assert rows and all(r["round_trip"] for r in rows)

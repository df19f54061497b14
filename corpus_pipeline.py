"""From raw documents to token ids: quality, exact and near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelake.llm import compression_quality, exact_dedup, mixing, ngram_join, sentencepiece_codec
from lorelake.llm.common import documents, labels, prepare, stash

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
QUALITY_THRESHOLD = 0.3
CACHED_WORDS = 150_000  # of a worker, which shares its executor with what earlier stages left


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    prepare(spark)
    model = compression_quality.fit(docs, labels(spark, sf_dir))
    return compression_quality.keep(docs, model, QUALITY_THRESHOLD)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by five-word shingle similarity of 0.8 or more."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    prepare(spark)
    return mixing.repeat(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again and compared; giant documents have a row for each chunk."""
    prepare(spark)
    ids = sentencepiece_codec.encode(docs, MODEL_PATH, cached_words=CACHED_WORDS, round_trip=True)
    return ids.select("doc_id", "lang", "source", "chunk_no", "n_chunks", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [("quality", quality), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("mixed", mixed), ("encoded", encoded)]

# Compression, hashes of the shuffle and merges of pieces are not expressible in SQL; tests/llm hold each stage against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written and read by the next."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stash(docs)
    return docs

"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Each task splits its texts into pre-tokens (a space run with what follows; no piece
crosses their borders), takes the distinct ones in order, which is a walk of their
trie, and runs the forward passes of the vocabulary along it: the states of a shared
prefix are computed once, and each terminal stores the count of its best path. A
text's count is the sum over its pre-tokens. Nothing is shuffled.

Two counts are returned, because the vocabularies at hand are merge (BPE) files:
``n_unigram`` is the path with the best sum of unigram scores, ``n_tokens`` the count
of the tokenizer the file describes, whose forward states are allowed last pieces
(see pieces.py). For a unigram file both are the same.

Null and empty texts have no tokens. Rows are kept as they are, repeated ones too;
an input column called like an added one is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelake.llm import pieces
from lorelake.llm.common import adding, fresh

HALF = 1 << 32


def counts_of(data: bytes, texts: list[str]) -> list[tuple[int, int]]:
    """(tokens, unigram pieces) of each text."""
    p = pieces.load(data)
    if not p.bpe:
        return [(n, n) for n in p.count_all(texts)]
    # Both counts in one number, so that one sum over a text's words gives both.
    work = lambda words: {w: n + HALF * m for w, (n, m) in p.both_counts(words).items()}
    return [(s % HALF, s // HALF) for s in p.fold([p.marked(t) for t in texts], "both", work, sum)]


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``n_unigram`` (long) to every row.

    ``model_path`` is a SentencePiece file on the driver; its bytes go to the tasks.
    """
    with open(model_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("struct<n_tokens: bigint, n_unigram: bigint>")
    def count(texts: pa.Array) -> pa.Array:
        found = counts_of(data.value, [t or "" for t in texts.to_pylist()])
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 2
        return pa.StructArray.from_arrays(columns, ["n_tokens", "n_unigram"])

    kept = adding(docs, "n_tokens", "n_unigram")
    (c,) = fresh(kept, "counted")
    counted = kept.withColumn(c, count.asNondeterministic()(docs[text_col].cast("string")))
    return counted.select(*kept.columns, f"{c}.n_tokens", f"{c}.n_unigram")

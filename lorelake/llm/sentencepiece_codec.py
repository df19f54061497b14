"""SentencePiece encoding and decoding, with giant texts split by a max-plus scan.

Texts up to ``chunk_chars`` are encoded where they are. A longer text is split into
chunks. For each chunk a max-plus transfer matrix says which state at its left edge
(overhang and id of the piece across the edge) can reach which state at its right
edge, at what weight. Matrices of neighbours are combined in rounds, which is associative,
until one is left for each text; the states at its edges are then handed down the same
rounds to every chunk, and each chunk is traced back alone. No task sees more than ``FAN``
matrices of a text at a time.
For a unigram file weights are score sums; for a merge (BPE) file they are 0 or
minus infinity (see pieces.py). Ids are those of the tokenizer that the file holds; of
unigram paths with equal scores, texts in chunks may take another one than whole texts.

Null text: null ids. Empty text: no ids. Rows are kept as they are, repeated ones
too; input columns named like added ones are replaced. U+2581 decodes as a space,
as that character stands for spaces in the pieces.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelake.llm import pieces
from lorelake.llm.common import adding, fresh, stash

CHUNK_CHARS = 65_536
FAN = 16  # neighbours whose matrices are combined in one round
NODE = "key bigint, no int, n_left int, n_right int, matrix binary"
CHUNK = "key bigint, chunk_no int, n_chunks int, stretch string, p0 int, p1 int, origin bigint"


def list_array(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrow lists of ids without going through Python numbers."""
    sizes = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)], dtype=np.int64)
    values = np.concatenate([a for a in arrays if a is not None and len(a)] or [np.zeros(0, "<i4")])
    mask = pa.array([a is None for a in arrays], pa.bool_()) if any(a is None for a in arrays) else None
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(values), mask=mask)


def row_text(p: pieces.Pieces, ids: np.ndarray, first: bool) -> str:
    """Text of a row's ids; ``first`` marks the row that begins a text."""
    raw = p.decode(ids).decode("utf-8", "replace")
    return raw[1:] if first and p.dummy_prefix else raw


def splitter(data, chunk_chars: int):
    """Map (key, text) to chunks, each with the context that its edges need; nothing is computed here."""
    schema = pa.schema([("key", pa.int64()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("stretch", pa.string()), ("p0", pa.int32()), ("p1", pa.int32()), ("origin", pa.int64())])

    def split(batches):
        p = pieces.load(data.value)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = p.marked(text)
                cuts = [*range(0, len(s), chunk_chars), len(s)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    # Context for the states at both edges and for pieces that lie across them.
                    lo, hi = max(0, a - 2 * p.longest), min(len(s), b + 2 * p.longest)
                    yield pa.RecordBatch.from_pylist([{"key": key, "chunk_no": k, "n_chunks": len(cuts) - 1, "stretch": s[lo:hi], "p0": a - lo, "p1": b - lo, "origin": lo}], schema=schema)

    return split


def chunks(long: DataFrame, key: str, text_col: str, data, chunk_chars: int) -> DataFrame:
    """Chunks of giant texts, dealt out one by one, with a transfer matrix made from each row alone."""

    @F.arrow_udf("struct<n_left: int, n_right: int, matrix: binary>")
    def transfer(stretch: pa.Array, p0: pa.Array, p1: pa.Array) -> pa.Array:
        p = pieces.load(data.value)
        mats = [p.transfer(s, a, b) for s, a, b in zip(stretch.to_pylist(), p0.to_pylist(), p1.to_pylist(), strict=True)]
        columns = [pa.array([m.shape[0] for m in mats], pa.int32()), pa.array([m.shape[1] for m in mats], pa.int32()), pa.array([m.tobytes() for m in mats], pa.binary())]
        return pa.StructArray.from_arrays(columns, ["n_left", "n_right", "matrix"])

    cut = long.select(key, text_col).mapInArrow(splitter(data, chunk_chars), CHUNK)
    # A fixed number of partitions: rows are few and small beside their work, and would be put together again.
    cut = cut.repartition(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "chunk_no")
    return cut.withColumn("own", transfer.asNondeterministic()("stretch", "p0", "p1")).select(*cut.columns, "own.*")


def matrices(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, float).reshape(a, b) for m, a, b in zip(part["matrix"], part["n_left"], part["n_right"], strict=True)]


def combined(part: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a few neighbours."""
    whole = functools.reduce(pieces.maxplus, matrices(part.sort_values("no")))
    first = part.iloc[0]
    return pd.DataFrame({"key": [first["key"]], "no": [first["up"]], "n_left": [whole.shape[0]], "n_right": [whole.shape[1]], "matrix": [whole.tobytes()]})


def handed_down(part: pd.DataFrame) -> pd.DataFrame:
    """States at both edges of a few neighbours, from those at the edges of all of them."""
    part = part.sort_values("no")
    mats, first = matrices(part), part.iloc[0]
    reach = [np.full(mats[0].shape[0], -np.inf)]
    reach[0][first["of_entry"]] = 0.0
    for m in mats:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    states = [int(first["of_leave"])]
    for k in range(len(mats) - 1, -1, -1):
        states.append(int(np.argmax(reach[k] + mats[k][:, states[-1]])))
    states.reverse()
    return pd.DataFrame({"key": part["key"], "no": part["no"], "entry": states[:-1], "leave": states[1:]})


def edge_states(parts: DataFrame) -> DataFrame:
    """(key, chunk_no, entry, leave) of all chunks: matrices combined upwards, states handed down."""
    levels = [parts.select("key", F.col("chunk_no").alias("no"), "n_left", "n_right", "matrix")]
    last = parts.agg(F.max("chunk_no")).first()[0] or 0
    up = F.floor(F.col("no") / FAN).cast("int")
    while last:
        levels.append(stash(levels[-1].withColumn("up", up).groupBy("key", "up").applyInPandas(combined, NODE)))
        last //= FAN
    states = levels.pop().select("key", "no", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels):
        above = states.select("key", F.col("no").alias("up"), F.col("entry").alias("of_entry"), F.col("leave").alias("of_leave"))
        below = level.withColumn("up", up).join(above, ["key", "up"])
        states = stash(below.groupBy("key", "up").applyInPandas(handed_down, "key bigint, no int, entry int, leave int"))
    return states.withColumnRenamed("no", "chunk_no")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, cached_words: int = pieces.MAX_CACHED["ids"], round_trip: bool = False) -> DataFrame:
    """One row for each text, or for each chunk of a giant text, in place of the text column's row.

    The text column then holds the row's own stretch of text; added are ``chunk_no``
    and ``n_chunks`` (int) and ``ids`` (array<int>). The ids of a text are those of its
    chunks in order. ``cached_words`` bounds the memory of a worker, not the result. With
    ``round_trip`` the ids of each row are decoded again where they were made; the boolean
    column ``round_trip`` tells whether they give the row's text (null text: true).
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        data = spark.sparkContext.broadcast(file.read())

    added = ["ids", "round_trip"] if round_trip else ["ids"]
    done_type = "ids: array<int>" + (", round_trip: boolean" if round_trip else "")

    @F.arrow_udf(f"struct<{done_type}>")
    def whole(texts: pa.Array) -> pa.Array:
        p = pieces.load(data.value)
        p.most["ids"] = cached_words
        given = texts.to_pylist()
        found = p.encode_all([p.marked(t or "") for t in given])
        columns = [list_array([None if t is None else ids for t, ids in zip(given, found, strict=True)])]
        if round_trip:
            columns.append(pa.array([t is None or row_text(p, ids, True) == t for t, ids in zip(given, found, strict=True)], pa.bool_()))
        return pa.StructArray.from_arrays(columns, added)

    @F.arrow_udf(f"struct<piece_text: string, {done_type}>")
    def one(stretch: pa.Array, p0: pa.Array, p1: pa.Array, origin: pa.Array, entry: pa.Array, leave: pa.Array) -> pa.Array:
        p = pieces.load(data.value)
        texts, found, same = [], [], []
        for s, a, b, o, x, y in zip(*(c.to_pylist() for c in (stretch, p0, p1, origin, entry, leave)), strict=True):
            # The very start and end of the text have one state; elsewhere the context is long enough for all of them.
            found.append(p.chunk_ids(s, a, b, x, y))
            start, end = a + p.states(s, a)[x][0], b + p.states(s, b)[y][0]
            own, first = s[start:end].replace(pieces.MARK, " "), o + start == 0
            texts.append(own[1:] if p.dummy_prefix and first else own)
            same.append(round_trip and row_text(p, found[-1], first) == texts[-1])
        columns = [pa.array(texts, pa.string()), list_array(found), pa.array(same, pa.bool_())]
        return pa.StructArray.from_arrays(columns[: 1 + len(added)], ["piece_text", *added])

    kept = adding(docs, "chunk_no", "n_chunks", *added).withColumn(text_col, F.col(text_col).cast("string"))
    giant = F.coalesce(F.length(text_col), F.lit(0)) > chunk_chars
    key, part = fresh(kept, "giant_key", "encoded_part")
    small = kept.filter(~giant).withColumn(part, whole.asNondeterministic()(F.col(text_col)))
    small = small.select(*kept.columns, F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks"), *[f"{part}.{c}" for c in added])

    long = stash(kept.filter(giant).withColumn(key, F.monotonically_increasing_id()))
    parts = stash(chunks(long, key, text_col, data, chunk_chars))
    done = parts.drop("matrix", "n_left", "n_right").join(edge_states(parts), ["key", "chunk_no"])
    done = done.select("key", "chunk_no", "n_chunks", one.asNondeterministic()(*[F.col(c) for c in ("stretch", "p0", "p1", "origin", "entry", "leave")]).alias("done"))
    rest = long.drop(text_col).join(done.select(F.col("key").alias(key), "chunk_no", "n_chunks", F.col("done").alias(part)), key)
    large = rest.select(*[F.col(f"{part}.piece_text").alias(c) if c == text_col else F.col(c) for c in kept.columns], "chunk_no", "n_chunks", *[f"{part}.{c}" for c in added])
    return small.unionByName(large)


def decode(encoded: DataFrame, model_path: str, out: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; a text is its chunks' texts in order. Null ids: null."""
    with open(model_path, "rb") as file:
        data = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("string")
    def text(ids: pa.Array, chunk_no: pa.Array) -> pa.Array:
        p = pieces.load(data.value)
        texts = []
        values, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for valid, a, b, no in zip(ids.is_valid().to_pylist(), starts, ends, chunk_no.to_pylist(), strict=True):
            texts.append(row_text(p, values[a:b], no == 0) if valid else None)
        return pa.array(texts, pa.string())

    return adding(encoded, out).withColumn(out, text.asNondeterministic()(F.col("ids"), F.col("chunk_no")))

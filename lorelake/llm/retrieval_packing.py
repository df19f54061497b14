"""Packing of whole corpora into windows by lexical retrieval.

1. Every text is encoded once; an end id follows it. The ids and two min-hashes of the id
   set are written to the shared folder.
2. Full windows of a text longer than a window stand alone. What is left of each text
   (its rest, shorter than a window) is packed with others.
3. Document frequencies of all ids over all rests, their number and mean length are the
   statistics of BM25; they are as long as the vocabulary.
4. Rests are range-partitioned by their min-hashes, so that texts with many ids in common
   come near each other, and each partition is read in that order in stretches of
   ``shard_tokens``. A stretch is one shard of the inverted index, held by one task.
5. A seed opens a window. The shard's postings of the seed's ids give BM25 scores, and the
   best unused neighbours fill the window from the top. The one that does not fit is cut;
   its other part is the next seed. Else the next unused rest in order is the seed.

All windows are full but a shard's last one, which is cut at powers of two, so nothing is
padded. Memory is bounded by a shard and by the longest text, whatever the input or a
group of copies: order keys are unique, so ranges stay even.

Null and empty texts have the end id alone. Repeated rows are separate documents. Equal
scores go in the shard's order. An empty table gives no pieces. Full repeats of a row are
interchangeable. Cuts of the ranges come from a sample, so another run may pack otherwise.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelake.llm import word_ids
from lorelake.llm.common import fresh, stash, text_key

WINDOW, END_ID = 4096, 2
SHARD_TOKENS, PART_TOKENS = 1 << 20, 1 << 23
K1, B = 1.2, 0.75
RANKED = 64  # neighbours that are sorted at first; all others follow if these do not fill the window
STRETCH_BYTES, OUT_BYTES = 8 << 20, 4 << 20  # texts whose words are numbered together; ids in one batch of pieces
PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint"


@functools.lru_cache(maxsize=4)
def id_hashes(size: int) -> np.ndarray:
    """Two fixed hashes of each id."""
    return np.random.default_rng(20_240_611).integers(0, 1 << 31, (2, size), dtype=np.uint32)


def stretches(batches, most: int):
    """Consecutive batches put together up to ``most`` bytes, or a single larger one."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encoder(spec, end_id: int):
    """Map (row, text) to its ids and the key that brings similar texts together."""

    def run(batches):
        words = word_ids.load(spec.value)
        end = np.array([end_id], words.kind)
        hashes = id_hashes(max(words.size, end_id + 1))
        for batch in stretches(batches, STRETCH_BYTES):
            ids, starts = words.ids(batch.column(1))
            each = [np.concatenate([ids[a:b], end]) for a, b in zip(starts, starts[1:], strict=False)]
            order = [int(hashes[0][x].min()) << 31 | int(hashes[1][x].min()) for x in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(order, pa.int64())],
                ["row", "doc_tokens", "packed", "order_key"],
            )

    return run


def counter(kind: str, size: int):
    """Partial document frequencies of one task; ids ``size`` and ``size + 1`` count rests and their ids."""

    def run(batches):
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                total[np.unique(ids)] += 1
                total[size] += 1
                total[size + 1] += len(ids)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["id", "n"])

    return run


class Shard:
    """The inverted index of one shard: postings by id, scores ready to be summed."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        self.lengths = np.array([len(r) for r in rests], np.int64)
        found = [np.unique(r, return_counts=True) for r in rests]
        self.of_doc = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
        self.terms, tf = np.concatenate([t for t, _ in found]), np.concatenate([n for _, n in found])
        doc = np.repeat(np.arange(len(rests)), np.diff(self.of_doc))
        weight = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lengths[doc] / mean))
        by_term = np.argsort(self.terms, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=len(idf)))])
        self.unused = np.ones(len(rests), bool)
        self.indexed = len(rests)

    def shrink(self, left: int) -> None:
        """Forget the postings of used rests once they are half of all."""
        if left * 2 >= self.indexed:
            return
        keep = self.unused[self.docs]
        self.starts = np.concatenate([[0], np.cumsum(keep)])[self.starts]
        self.docs, self.weights, self.indexed = self.docs[keep], self.weights[keep], left

    def neighbours(self, seed: int):
        """Unused rests by falling score, equal scores in order."""
        terms = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        spans = [slice(a, b) for a, b in zip(self.starts[:-1][terms].tolist(), self.starts[1:][terms].tolist(), strict=True) if a < b]
        docs, weights = (np.concatenate([x[s] for s in spans] or [x[:0]]) for x in (self.docs, self.weights))
        scores = np.bincount(docs, weights, len(self.lengths))
        free = np.flatnonzero(self.unused)
        scores = scores[free]
        if len(free) > RANKED:
            least = np.partition(scores, len(free) - RANKED)[len(free) - RANKED]
            top = np.flatnonzero(scores > least)
            yield from free[top[np.argsort(-scores[top], kind="stable")]].tolist()
            rest = np.flatnonzero(scores <= least)
            free, scores = free[rest], scores[rest]
        yield from free[np.argsort(-scores, kind="stable")].tolist()


def windows(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
    """Windows of one shard, each a list of (rest, first id, number of ids); only the last one may be short."""
    shard = Shard(rests, idf, mean)
    lengths, left, following, cut = shard.lengths.tolist(), len(rests), 0, None
    while left or cut:
        if cut is None:
            while not shard.unused[following]:
                following += 1
            cut, shard.unused[following], left = (following, 0), False, left - 1
        seed, at = cut
        room, taken, cut = window - (lengths[seed] - at), [(seed, at, lengths[seed] - at)], None
        if room and left:
            shard.shrink(left)
            for near in shard.neighbours(seed):
                take = min(room, lengths[near])
                taken.append((near, 0, take))
                shard.unused[near], left, room = False, left - 1, room - take
                if not room:
                    cut = (near, take) if take < lengths[near] else None
                    break
        yield taken


def cut_at_powers(taken: list[tuple[int, int, int]], window: int):
    """A short window as sequences whose lengths are powers of two, long ones first; a full window as it is."""
    total, pieces = sum(n for _, _, n in taken), list(taken)
    while total:
        size = window if total == window else 1 << (total.bit_length() - 1)
        total, out = total - size, []
        while size:
            rest, at, n = pieces.pop(0)
            out.append((rest, at, min(n, size)))
            if n > size:
                pieces.insert(0, (rest, at + size, n - size))
            size -= min(n, size)
        yield out


def packer(kind: str, window: int, shard_tokens: int, statistics):
    """Pack a partition's rests, which come in order, shard by shard."""

    def run(batches):
        idf, mean = statistics.value
        base, number = TaskContext.get().partitionId() << 33, 0
        held, rows, tokens = [], [], 0
        schema = out = size = None

        def flush():
            arrays = [pa.array(c, t) for c, t in zip(out, schema.types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def packed():
            nonlocal number, out, size
            for taken in windows(held, idf, mean, window):
                for sequence in cut_at_powers(taken, window):
                    offset = 0
                    for rest, at, n in sequence:
                        key, start, doc_tokens = rows[rest]
                        ids = held[rest][at : at + n].astype("<u4").tobytes()
                        for column, value in zip(out, (key, start + at, n, ids, doc_tokens, base + number, offset), strict=True):
                            column.append(value)
                        offset, size = offset + n, size + len(ids)
                    number += 1
                if size >= OUT_BYTES:
                    yield flush()
                    out, size = [[] for _ in schema], 0

        for batch in batches:
            if schema is None:
                names = [("row", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())]
                schema, out, size = pa.schema(names), [[] for _ in names], 0
            for key, start, doc_tokens, raw in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                rest = np.frombuffer(raw, kind)
                if held and tokens + len(rest) > shard_tokens:
                    yield from packed()
                    held, rows, tokens = [], [], 0
                held.append(rest)
                rows.append((key, start, doc_tokens))
                tokens += len(rest)
        if held:
            yield from packed()
        if schema is not None:
            yield flush()

    return run


def full_windows(kind: str, window: int):
    """Windows that one text fills alone."""

    def run(batches):
        for batch in batches:
            for key, doc_tokens, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                ids = np.frombuffer(raw, kind)
                for low in range(0, doc_tokens // window, 64):
                    starts = range(low * window, min(low + 64, doc_tokens // window) * window, window)
                    parts = [ids[s : s + window].astype("<u4").tobytes() for s in starts]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * n, batch.schema.field(0).type), pa.array(list(starts), pa.int64()), pa.array([window] * n, pa.int64()), pa.array(parts, pa.binary()), pa.array([doc_tokens] * n, pa.int64())],
                        ["row", "start", "length", "ids", "doc_tokens"],
                    )

    return run


def statistics_of(rests: DataFrame, kind: str, size: int) -> tuple[np.ndarray, float, int]:
    """(idf of each id, mean length, number of ids) over all rests; the driver sees one count for each id of the vocabulary."""
    counted = rests.mapInArrow(counter(kind, size), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size + 2, np.int64)
    for r in counted.collect():
        total[r["id"]] = r["n"]
    df, number, tokens = total[:size], int(total[size]), int(total[size + 1])
    return np.log1p((number - df + 0.5) / (df + 0.5)), tokens / max(number, 1), tokens


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Pieces of all texts: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are a piece's ids as little-endian unsigned 32-bit numbers, ``start`` the number
    of the text's ids before it, ``doc_tokens`` the text's ids with the end id, ``offset``
    the place in the sequence. Sequence ids are unique, not gapless.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    words = word_ids.load(text)
    size, kind, width = max(words.size, end_id + 1), words.kind, words.width
    if end_id >= 1 << 8 * width:
        raise ValueError("the end id is outside of the vocabulary")
    spec = spark.sparkContext.broadcast(text)
    text_of = F.col(text_col).cast("string")
    (key,) = fresh(docs, "row_key")
    thin = docs.select(F.struct(F.col(id_col).alias("id"), text_key(text_of).alias(key)).alias("row"), text_of.alias("text"))
    row_type = thin.schema["row"].dataType.simpleString()
    encoded = stash(thin.mapInArrow(encoder(spec, end_id), f"row {row_type}, doc_tokens bigint, packed binary, order_key bigint"))

    full = (F.col("doc_tokens") / window).cast("long") * window
    rests = encoded.filter(F.col("doc_tokens") % window > 0).withColumn("start", full)
    rests = rests.select("row", "start", "doc_tokens", F.expr(f"substring(packed, int(start * {width} + 1))").alias("rest"), "order_key")
    idf, mean, tokens = statistics_of(rests.select("rest"), kind, size)
    statistics = spark.sparkContext.broadcast((idf, mean))
    # Equal keys in the order are full repeats of a row.
    order = ["order_key", "row", "doc_tokens"]
    ranged = rests.repartitionByRange(max(1, -(-tokens // part_tokens)), *order).sortWithinPartitions(*order)
    near = ranged.mapInArrow(packer(kind, window, shard_tokens, statistics), f"row {row_type}, {PIECE}, sequence bigint, offset bigint")
    alone = encoded.filter(F.col("doc_tokens") >= window).select("row", "doc_tokens", "packed")
    alone = alone.mapInArrow(full_windows(kind, window), f"row {row_type}, {PIECE}").withColumn("sequence", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # Even numbers for windows of many texts, odd ones for windows of one.
    both = near.withColumn("sequence", F.col("sequence") * 2).unionByName(alone.withColumn("sequence", F.col("sequence") * 2 + 1))
    return both.select(F.col("row.id").alias(id_col), "start", "length", "ids", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")

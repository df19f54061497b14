"""Ranked search for a set of items by an Aho-Corasick scan of the texts.

The terms of all items make one automaton, each term guarded by a boundary on both sides.
It is broadcast and run over every whole text, in which other characters than those of
terms are boundaries: its outputs are the item terms with their frequency. There is no
index of the documents; a row for each document keeps its length and the item terms found,
because scores need counts over all documents first.

Scores are integers: a term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, a
document's ``m`` is ``50 + (50 * n * N) div L``, and a term adds
``w * ((10^9 * tf) div (1000 * tf + 20 * m))``. Each task keeps the best ``top`` documents of
each item and drops the others at once, ties kept by id; the few left are ranked in two steps.

Items beyond ``block_terms`` terms are dealt into blocks by hash, one scan for each, so the
automaton has a bounded size. Rows of items with the same id (null ids too) are one item
with the terms of all of them, once each. Null and empty texts have no terms; items without
a term or a hit have no rows. Repeated documents are ranked as separate rows; equal scores
go by rising id, null ids last. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelake.llm.common import stash

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP, BLOCK_TERMS = 50, 200_000
CELLS, SPREAD, SALTS = 2_000_000, 4_000_000, 64
# Bytes as the automaton sees them: A-Z lower-cased, other ASCII characters than letters and digits a space.
SEEN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """Terms of a text in order, with repeats."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def automaton_of(terms: list[str]) -> ahocorasick.Automaton:
    """Terms with a boundary on both sides; a boundary may serve two neighbours."""
    machine = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        machine.add_word(f" {term} ", number)
    machine.make_automaton()
    return machine


def counter(machine):
    """Map (id, text) to (id, n, terms, counts) of texts with at least one term."""

    def run(batches):
        scan, number = machine.value.iter, itemgetter(1)
        for batch in batches:
            kept, lengths, terms, counts, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1).to_pylist()):
                seen = f" {text or ''} ".encode().translate(SEEN)
                inside = np.frombuffer(seen, np.uint8) != 32
                n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
                if not n:
                    continue
                found = Counter(map(number, scan(seen.decode())))
                kept.append(i)
                lengths.append(n)
                for term in sorted(found):
                    terms.append(term)
                    counts.append(found[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                ["id", "n", "terms", "counts"],
            )

    return run


def best(found: pa.Table, top: int) -> pa.Table:
    """The first ``top`` rows of each item: falling score, then rising id, nulls last."""
    found = found.take(pc.sort_indices(found, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
    item = found["item"].to_numpy()
    begins = np.searchsorted(item, item)
    return found.filter(pa.array(np.arange(len(item)) - begins < top))


def ranker(shared, top: int):
    """The best documents of each item in one task's rows of (id, n, terms, counts)."""

    def run(batches):
        weights, starts, items, n_items, number, length = shared.value
        floor = np.ones(n_items, np.int64)  # least score that can still be among the best
        held: pa.Table | None = None
        chunk = max(1, min(256, CELLS // max(n_items, 1), SPREAD // max(len(items), 1)))
        for batch in batches:
            ids, ns = batch.column(0), batch.column(1).to_pylist()
            terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            m = np.array([50 + 50 * n * number // length for n in ns], np.int64)
            for a in range(0, batch.num_rows, chunk):
                b = min(a + chunk, batch.num_rows)
                t, tf = terms[ends[a] : ends[b]], counts[ends[a] : ends[b]]
                doc = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
                part = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                fan = starts[t + 1] - starts[t]
                at = np.repeat(starts[t] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
                scores = np.zeros((b - a) * n_items, np.int64)
                np.add.at(scores, np.repeat(doc - a, fan) * n_items + items[at], np.repeat(part, fan))
                good = np.flatnonzero(scores.reshape(b - a, n_items) >= floor)
                new = pa.table({"item": good % n_items, "score": scores[good], "id": ids.take(pa.array(good // n_items + a))})
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows > 2 * top * n_items + CELLS // 4:
                    held = best(held, top)
                    floor = raised(held, floor, top)
        if held is not None:
            yield from best(held, top).combine_chunks().to_batches()

    return run


def raised(held: pa.Table, floor: np.ndarray, top: int) -> np.ndarray:
    """The score of the last place of each item that has all its places."""
    item, score = held["item"].to_numpy(), held["score"].to_numpy()
    last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == top - 1)
    floor = floor.copy()
    floor[item[last]] = score[last]
    return floor


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank from 1, id, score) of the best ``top`` documents with a score above 0 for each item."""
    spark = docs.sparkSession
    named = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms_of(F.col(item_text_col)))).alias("term")).distinct()
    named = stash(named)
    blocks = max(1, -(-named.count() // block_terms))
    block = F.pmod(F.xxhash64(F.col("item").isNull(), "item"), F.lit(blocks))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((texts, "id"), (named, "item")))
    out = spark.createDataFrame([], f"item {item_type}, rank int, id {id_type}, score bigint")
    for number in range(blocks):
        pairs = named.filter(block == number).orderBy("item", "term").collect()
        if not pairs:
            continue
        found = ranked_block(texts, [(r["item"], r["term"]) for r in pairs], item_type, id_type, top)
        out = out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def ranked_block(texts: DataFrame, pairs: list[tuple], item_type: str, id_type: str, top: int) -> DataFrame:
    """Ranks for one bounded set of (item, term) pairs."""
    spark = texts.sparkSession
    names = list(dict.fromkeys(item for item, _ in pairs))
    vocabulary = sorted({term for _, term in pairs})
    number_of, place_of = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(names)}
    machine = spark.sparkContext.broadcast(automaton_of(vocabulary))
    counted = stash(texts.mapInArrow(counter(machine), f"id {id_type}, n bigint, terms array<int>, counts array<bigint>"))
    whole = counted.agg(F.count("*").alias("number"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * whole["number"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    term, item = np.array(sorted((number_of[t], place_of[x]) for x, t in pairs), np.int64).T
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    shared = spark.sparkContext.broadcast((weights, starts, item, len(names), whole["number"], max(whole["length"], 1)))
    near = counted.mapInArrow(ranker(shared, top), f"item bigint, score bigint, id {id_type}")
    order = [F.desc("score"), F.col("id").isNull(), "id"]
    # Two steps, so that the last task of an item reads a bounded number of rows.
    salted = near.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    ranked = some.withColumn("rank", rank).filter(F.col("rank") <= top)
    listed = spark.createDataFrame(list(enumerate(names)), f"place_no bigint, name {item_type}")
    return ranked.join(F.broadcast(listed), F.col("item") == F.col("place_no")).select(F.col("name").alias("item"), "rank", "id", "score")

"""Near-duplicate join on the Jaccard similarity of word n-gram sets, by MinHash banding.

1. One pass computes each text's n-gram set, a digest of the set and band hashes; band
   and row counts are chosen for the target recall at the threshold. Texts with the
   same set form a class; only one text of each class goes on.
2. Band hashes are shuffled. Each bucket links its members to its smallest one, never
   all pairs; connected classes form a candidate group.
3. Full sets are computed again for members of candidate groups, sent once to their
   group, and all pairs inside are verified. Groups over a block are cut into blocks
   by hash, and each pair of blocks is one small task group.
4. Links of each class are summed; connected linked classes form a near-duplicate group.

Pairs never become rows. Words are runs without ASCII white space, case kept; a text
of fewer words than ``n`` has one n-gram, all its words. Null and texts without words
have an empty set: one class that links to nothing.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorelake import sizes
from lorelake.llm.common import fresh, stash, text_key
from lorelake.llm.grams import window_hashes, word_hashes

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK_DOCS, BLOCK_GRAMS = 128, 400_000
SEED = 20_240_531


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 320) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


@functools.lru_cache(maxsize=4)
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def gram_set(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words, cache)
    return np.unique(window_hashes(hashes, min(n, len(hashes))))


def min_hashes(grams: np.ndarray, count: int) -> np.ndarray:
    a, b = permutations(count)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 1024):
        out = np.minimum(out, (low[at : at + 1024, None] * a + b).min(axis=0))
    return out


def sketcher(n: int, bands: int, rows: int):
    def run(batches):
        cache: dict = {}
        for batch in batches:
            digests, counts, hashes = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                grams = gram_set(text, n, cache)
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                counts.append(len(grams))
                signature = min_hashes(grams, bands * rows).reshape(bands, rows) if len(grams) else np.zeros((0, rows), np.uint32)
                hashes.append([xxhash.xxh64_intdigest(r.tobytes(), seed=k) - (1 << 63) for k, r in enumerate(signature)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("row_key")), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                ["id", "row_key", "digest", "n_grams", "bands"],
            )

    return run


def setter(n: int):
    """Full n-gram sets of the chosen texts."""

    def run(batches):
        cache: dict = {}
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            sets = [gram_set(t, n, cache).view(np.int64) for t in column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([column("cid"), column("size"), column("part"), column("n_parts"), grams], ["cid", "size", "part", "n_parts", "grams"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; ``edges`` has a and b (bigint), a > b.

    A node's smaller neighbours are first linked to the smallest of them instead of to the
    node, which leaves few edges where many nodes share neighbours. Then in each round every
    node takes the smallest label among its neighbours', then the label of its label; rounds
    are written out, so lost executors repeat one round at most.
    """
    least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    edges = least.select("a", "m").union(least.filter("b > m").select("b", "m")).distinct().toDF("a", "b")
    both = stash(edges.union(edges.select("b", "a")).toDF("node", "other"))
    labels = stash(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        after = stash(jump.select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.filter(F.col("label") < F.col("before")).isEmpty():
            return labels


def verifier(threshold: float):
    """Links inside one group or between two of its blocks, without making pairs rows."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        table = group.sort_by("cid")
        cid, size, part = (table[c].to_numpy() for c in ("cid", "size", "part"))
        grams = table["grams"].combine_chunks()
        counts = grams.value_lengths().to_numpy().astype(np.int64)
        flat = np.unique(grams.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        left, right = key[1].as_py(), key[2].as_py()
        present = np.zeros(flat.max(initial=-1) + 1, bool)
        links, linked, parent = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), np.arange(len(cid))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(cid) - 1):
            own = flat[starts[i] : starts[i] + counts[i]]
            present[own] = True
            shared = np.add.reduceat(present[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
            present[own] = False
            # shared / (a + b - shared) >= threshold, with room for rounding of the threshold itself.
            near = shared * (1 + threshold) >= threshold * (counts[i] + counts[i + 1 :]) - 1e-9
            if left != right:  # pairs inside one block belong to that block's own task
                near &= part[i + 1 :] != part[i]
            js = np.flatnonzero(near) + i + 1
            if len(js):
                links[i] += len(js)
                linked[i] += size[js].sum()
                links[js] += 1
                linked[js] += size[i]
                for j in js.tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        hit = np.flatnonzero(links)
        return pa.table({"cid": cid[hit], "links": links[hit], "linked_docs": linked[hit], "label": cid[[root(i) for i in hit.tolist()]] if len(hit) else cid[:0]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: id, row_key, class_id, class_size, links, linked_docs, group_id.

    ``class_id`` is the smallest id of the texts with the same n-gram set, ``links`` the
    number of other classes at or above the threshold, ``linked_docs`` the number of rows
    in them, ``group_id`` the smallest id among all rows connected by links (its own class
    included). ``kept`` marks one row of each group. Ids may be null (last) or repeat.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    sketch = stash(texts.mapInArrow(sketcher(n, bands, rows), f"id {id_type}, row_key bigint, digest binary, n_grams bigint, bands array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")
    classes = stash(
        sketch.groupBy("digest").agg(first, F.count("*").alias("size"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    # Buckets with more than one class link their members to the smallest one.
    rows_ = classes.select("cid", F.posexplode("bands").alias("band", "hash"))
    buckets = rows_.groupBy("band", "hash").agg(F.min("cid").alias("center"), F.max("cid").alias("last")).filter("last > center").drop("last")
    edges = rows_.join(buckets, ["band", "hash"]).filter("cid > center").select(F.col("cid").alias("a"), F.col("center").alias("b")).distinct()
    groups = components(edges)

    member = stash(groups.toDF("cid", "candidate").join(classes.select("cid", "first", "size", "n_grams"), "cid"))
    extent = member.groupBy("candidate").agg(F.count("*").alias("classes"), F.sum("n_grams").alias("grams"))
    parts = F.ceil(F.greatest(F.col("classes") / BLOCK_DOCS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    big = sizes.small(extent.withColumn("n_parts", parts).filter("n_parts > 1").select("candidate", "n_parts"))
    dealt = member.join(big, "candidate", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("n_parts")).cast("int"))
    wanted = sizes.small(stash(dealt.select("cid", "candidate", "size", "part", "n_parts", F.col("first.id").alias("first_id"), F.col("first.row_key").alias("first_key"))))
    chosen = texts.join(wanted, texts["id"].eqNullSafe(wanted["first_id"]) & (texts["row_key"] == wanted["first_key"])).select("cid", "size", "part", "n_parts", "text")
    sets = chosen.mapInArrow(setter(n), "cid bigint, size bigint, part int, n_parts int, grams array<bigint>").dropDuplicates(["cid"])
    spread = sets.join(groups.toDF("cid", "candidate"), "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    spread = spread.withColumn("left_part", F.least("part", "other")).withColumn("right_part", F.greatest("part", "other"))
    found = spread.groupBy("candidate", "left_part", "right_part").applyInArrow(verifier(threshold), "cid bigint, links bigint, linked_docs bigint, label bigint")
    found = stash(found)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    linked = components(found.filter("cid > label").select(F.col("cid").alias("a"), F.col("label").alias("b")).distinct())

    # The first row of a group: smallest id, null ids last.
    named = classes.select("cid", "digest", "first", "size").join(linked.toDF("cid", "group"), "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    heads = named.groupBy("group").agg(F.min("first").alias("head"))
    info = named.join(heads, "group").join(links, "cid", "left")
    out = sketch.select("id", "row_key", "digest").join(info, "digest")
    return out.select(
        F.col("id").alias(id_col), "row_key", F.col("first.id").alias("class_id"), F.col("size").alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"), F.col("head.id").alias("group_id"),
        (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("row_key") == F.col("head.row_key"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate group; all texts without words count as one group."""
    marks = stash(near_duplicates(docs, id_col, text_col, **limits))
    key, of_id, of_key = fresh(docs, "row_key", "of_id", "of_key")
    pair = marks.select(F.col(id_col).alias(of_id), F.col("row_key").alias(of_key), "kept")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key))
    left = keyed.join(sizes.small(stash(pair.filter(~F.col("kept")).distinct())), same, "left_anti")
    # Rows that repeat both id and text are one row; only such rows are shuffled for it.
    repeats = sizes.small(stash(pair.groupBy(of_id, of_key).count().filter("count > 1")))
    single = left.join(repeats, same, "left_anti")
    merged = left.join(repeats, same, "left_semi").dropDuplicates([id_col, key])
    return single.unionByName(merged).select(*docs.columns)

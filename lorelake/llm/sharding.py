"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Every partition permutes its rows by a hash key; the rows are written once, so each
   row keeps its partition and place there.
2. From the partitions' row counts alone the number of rows that each partition sends to
   each shard is drawn: the matrix that a uniform permutation of all rows would give.
3. A row's place in its partition and the partition's line of the matrix give its shard.
   One exchange brings the rows to blocks of their shard.
4. Blocks permute their rows again; a row's slot is its block's offset and its place.

Shards differ by one row at most (law ``rows``). No task holds a shard: a shard has as
many hashed blocks as its bytes need. The main path is DataFrame expressions; the
driver sees one count for each partition and draws one line of the matrix for each
(partitions beyond ``MATRIX_LINES`` share lines, so the matrix stays bounded).

Row hashes come from id, text and seed, so reruns agree; full repeats of a row are
interchangeable. Nulls are hashed as such. An empty table gives no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelake import sizes
from lorelake.llm.common import adding, fresh, stash, text_key

SHARDS, ROW_BYTES = 40, 16
MATRIX_LINES = 4096
BLOCK_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and a constant for the row."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + ROW_BYTES).cast("long")


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Number of good items among ``draws`` drawn without replacement; exact at any size.

    Goes outwards from the mode, so it takes steps in proportion to the standard deviation.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - peak
    up = down = mode
    p_up = p_down = peak
    while left > 0 and (p_up > 0 or p_down > 0):
        p_up = p_up * (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)) if up < high else 0.0
        if up < high:
            up += 1
            left -= p_up
            if left <= 0:
                return up
        p_down = p_down * down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)) if down > low else 0.0
        if down > low:
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if up == high and down == low:
            break
    return mode


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each line sends to each shard. Columns sum to shard sizes at most one apart."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    lines = []
    for count in counts:
        line, left, rest = [], count, sum(room)
        for s in range(shards):
            rest -= room[s]
            n = hypergeometric(room[s], rest, left, rng)
            line.append(n)
            left -= n
        room = [r - n for r, n in zip(room, line, strict=True)]
        lines.append(line)
    return lines


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``law``, ``shard`` (int, from 0), ``slot`` (long, gapless from 0 in its shard) and ``grown_shard`` (null) to all rows."""
    spark = docs.sparkSession
    kept = adding(docs, "law", "shard", "slot", "grown_shard")
    key, again, place, line, rank, upto, before, ends = fresh(kept, "key", "again", "place", "line", "rank", "upto", "before", "ends")
    first = F.xxhash64(F.lit(seed), F.col(id_col), text_key(F.col(text_col)))
    held = kept.withColumn(key, first).withColumn(again, F.xxhash64(F.col(key), F.lit("again")))
    held = stash(held.sortWithinPartitions(key).withColumn(place, F.monotonically_increasing_id()))

    # place: partition in the upper bits, rank in the partition in the lower 33.
    part = F.shiftright(place, 33)
    counts = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(size_of(F.col(text_col))).alias("bytes"))
    counts = counts.groupBy(F.pmod("part", F.lit(MATRIX_LINES)).alias("line"))
    table = sorted(counts.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).collect())
    drawn = matrix([r["n"] for r in table], shards, seed)
    rows = []
    for r, counted in zip(table, drawn, strict=True):
        upper, total = [], 0
        for n in counted:
            total += n
            upper.append(total)
        at = 0
        for p in r["parts"]:  # partitions of one line follow each other on it
            rows.append((p["part"], at, upper))
            at += p["n"]
    lines = sizes.small(spark.createDataFrame(rows, f"`{line}` bigint, `{before}` bigint, `{ends}` array<bigint>"))
    blocks = max(1, -(-sum(r["bytes"] for r in table) // (shards * block_bytes)))

    dealt = held.join(lines, part == F.col(line))
    at = F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    # The shard whose stretch of the line holds the place: the number of shards that end at or before it.
    dealt = dealt.withColumn(rank, at).withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(rank)))).drop(before, ends, line)
    dealt = dealt.withColumn(upto, F.pmod(F.col(again), F.lit(blocks)))
    window = Window.partitionBy("shard", upto)
    # Offsets of the blocks: a narrow pass over keys and counts.
    sizes_of = dealt.groupBy("shard", upto).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(upto).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes_of.select(F.col("shard").alias(line), F.col(upto).alias(rank), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    numbered = dealt.withColumn("slot", F.row_number().over(window.orderBy(again, key, id_col)) - 1)
    joined = numbered.drop(rank).join(sizes.small(stash(offsets)), (F.col("shard") == F.col(line)) & (F.col(upto) == F.col(rank)))
    return joined.select(
        *[F.col(c) for c in kept.columns], F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col(before)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

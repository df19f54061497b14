"""Mixing sources to target weights with a low-discrepancy schedule.

Texts of a source are shuffled by a hash and laid end to end; that line of words is
cut into blocks of equal length. Slot ``i`` of the mix takes the golden-ratio point
``frac((i + 1/2) / phi)``; the cumulative target shares map it to a source, so every
stretch of the mix has near its target shares. The k-th slot of a source takes its
k-th block, beginning again after the last one, at most ``max_passes`` times. The mix is
the sequence of slots: the points decide where in it a text's words come, the target how
often they come in all.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share
``volume`` times all words; a target stops at ``max_passes`` times its source's words
and the excess goes to the others by weight until none is above.

No task holds a source: positions and slot ranks are running sums over buckets. Null
and empty texts have no words and are never taken. Full repeats of a row are separate
rows. Only per-source totals (a row for each source) go through one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelake import sizes
from lorelake.llm.common import SPACE, fresh, running_sum, stash, text_key

WEIGHTS, VOLUME, MAX_PASSES = (5, 2, 1), 1.5, 2
BLOCK_WORDS = 1024
GOLDEN = 0.6180339887498949
BUCKET_BITS, SLOT_CHUNK, BINS = 10, 16_384, 1024


def size_of(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null: none."""
    return F.coalesce(F.size(F.filter(F.split(text.cast("string"), SPACE), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, weights=WEIGHTS, volume: float = VOLUME, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    The shares level out like water: sources in order of cap / weight fill up first, and
    the rest share by weight what those leave.
    """
    everything = Window.partitionBy()
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(order, F.lit(len(weights))) + 1))
    w = w.withColumn("cap", F.col("source_size") * float(max_passes)).withColumn("budget", F.sum("source_size").over(everything) * volume)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # The first source in level order that does not fill up sets the level for all after it.
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    w = w.withColumn("place", F.row_number().over(by_level)).withColumn("own", level)
    w = w.withColumn("level", F.min(F.when(F.col("own") * F.col("weight") < F.col("cap"), F.struct("place", "own"))).over(everything)["own"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def schedule(shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: (slot, source, rank), ranks from 0. ``shares`` has source, source_size and target.

    The points give every source near its number of blocks, a few more or less; ranks beyond
    that number are not used, and the missing ones follow after the last point (a few for
    each source, most where very many sources are smaller than a block). Slots are increasing,
    not gapless.
    """
    spark = shares.sparkSession
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("source").isNull(), "source")
    s = shares.filter("target > 0").withColumn("total", F.sum("target").over(everything))
    s = s.withColumn("hi", F.sum("target").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(upto).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    s = stash(s)
    total = s.agg(F.max("total")).first()[0] or 0.0
    slots = spark.range(-(-int(total) // block_words)).withColumnRenamed("id", "slot")
    point = (F.col("slot") + 0.5) * GOLDEN
    slots = slots.withColumn("point", point - F.floor(point)).withColumn("bin", F.floor(F.col("point") * BINS).cast("int"))
    bins = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * BINS).cast("int"), F.floor(F.col("hi") * BINS).cast("int"))))
    placed = slots.join(sizes.small(bins.select("bin", "lo", "hi", "source")), "bin").filter("point >= lo and point < hi")
    placed = placed.select("slot", "source", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"), F.lit(1).cast("long").alias("one"))
    ranked = stash(running_sum(placed, ["source"], "chunk", [F.col("slot")], "one", "rank").select("slot", "source", "rank"))
    reached = ranked.groupBy(F.col("source").alias("of")).agg(F.max("rank").alias("last"))
    short = shares.filter("target >= 1").join(reached, F.col("source").eqNullSafe(F.col("of")), "left")
    short = short.withColumn("from", F.coalesce(F.col("last") + 1, F.lit(0).cast("long"))).withColumn("to", blocks_of(F.floor("target"), F.col("source_size"), block_words))
    short = short.filter(F.col("from") < F.col("to")).select("source", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("rank"))
    end = -(-int(total) // block_words) - 1
    order = [F.col("rank"), F.col("source").isNull(), F.col("source")]
    # Ranges of the missing slots are numbered apart, then put one after the other.
    ranged = stash(short.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1).cast("long")))
    tail = running_sum(ranged, [], "part", order, "one", "place")
    return ranked.unionByName(tail.select((F.col("place") + F.lit(end + 1).cast("long")).alias("slot"), "source", "rank"))


def blocks_of(words: Column, source_size: Column, block_words: int) -> Column:
    """Number of slots that hold so many words of a source's line, pass after pass."""
    whole = F.floor(words / source_size)
    return (whole * F.ceil(source_size / block_words) + F.ceil((words - whole * source_size) / block_words)).cast("long")


def positions(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Narrow rows with their stretch [start, start + size) of their source's line of words."""
    key = F.xxhash64(F.lit("mix"), F.col(id_col), text_key(F.col(text_col)))
    thin = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key.alias("key"))
    thin = thin.withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKET_BITS)).withColumn("row_no", F.monotonically_increasing_id())
    thin = stash(thin)
    return running_sum(thin, ["source"], "bucket", [F.col("key"), F.col("id"), F.col("size"), F.col("row_no")], "size", "start")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, volume: float = VOLUME, max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, shares, pieces): texts on their lines, targets, and the mix itself.

    ``pieces`` has a row for each stretch of a text that a slot takes: slot, pass (from 0),
    id, row_no, first word (from 0) and number of words. A source's last slot is cut at its target.
    """
    placed = stash(positions(docs, id_col, source_col, text_col))
    shares = stash(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, volume, max_passes))
    slots = schedule(shares, block_words)
    # Blocks of a source: its line cut every block_words; the last block is shorter.
    per_pass = F.ceil(F.col("source_size") / block_words)
    dealt = slots.join(sizes.small(shares.select(F.col("source").alias("of"), "source_size", "target")), F.col("source").eqNullSafe(F.col("of")))
    before = F.floor(F.col("rank") / per_pass) * F.col("source_size") + F.col("rank") % per_pass * block_words
    dealt = dealt.withColumn("left", F.floor("target") - before).filter("left > 0").select("slot", "of", F.floor(F.col("rank") / per_pass).alias("pass"), (F.col("rank") % per_pass).alias("of_block"), "left")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    cut = cut.withColumn("from_word", begin - F.col("start")).withColumn("words", end - begin)
    met = cut.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    met = met.withColumn("words", F.least("words", F.col("of_block") * block_words + F.col("left") - F.col("start") - F.col("from_word"))).filter("words > 0")
    pieces = met.select("slot", "pass", "source", "id", "text_key", "row_no", "from_word", "words")
    return placed, shares, pieces


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken (words in the mix, repeats counted),
    n_slots, first_slot, last_slot (null if nothing is taken), pass_slots (the first slot of each pass), text_key, of.
    """
    placed, shares, pieces = mix(docs, id_col, source_col, text_col, **limits)
    passes = range(math.ceil(limits.get("max_passes", MAX_PASSES)))
    firsts = F.array_compact(F.array(*[F.min(F.when(F.col("pass") == p, F.col("slot"))) for p in passes]))
    sums = pieces.groupBy("row_no").agg(
        F.sum("words").alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), firsts.alias("pass_slots"))
    out = placed.join(sums, "row_no", "left").join(sizes.small(shares.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("n_slots", none).alias("n_slots"),
        "first_slot", "last_slot", "pass_slots", "text_key", "of")


def repeat(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slot_col: str | None = None, **limits) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken / size, rounded half up; all columns kept.

    Rows come in the order of the mix, one range of slots in each partition; a text's n-th copy
    stands where its words first come in the n-th pass. ``slot_col`` names a column to add for it.
    Rows that repeat id and text share their number of takes evenly. The text in which a source's
    target ends is gained or lost whole; a source with a target that would lose all of its texts
    keeps the one of which most is taken.
    """
    key, of_id, of_key, times, slots, slot = fresh(docs, "text_key", "of_id", "of_key", "times", "pass_slots_of", "slot_of")
    given = taken(docs, id_col, source_col, text_col, **limits).filter("size > 0 and target > 0").groupBy(F.col(id_col).alias(of_id), F.col("text_key").alias(of_key))
    share = F.sum("taken") / F.sum("size")
    # Passes of rows that repeat id and text come one after the other.
    ordered = F.array_sort(F.flatten(F.collect_list(F.coalesce("pass_slots", F.array().cast("array<bigint>")))))
    given = stash(given.agg(share.alias("share"), F.floor(share + 0.5).cast("int").alias(times), F.collect_set(F.struct("of")).alias("sources"), ordered.alias(slots)))
    best = given.withColumn("source", F.explode("sources")).groupBy("source").agg(F.max(times).alias("most"), F.max(F.struct("share", of_id, of_key)).alias("best"))
    kept = best.filter("most = 0").select(F.col(f"best.{of_id}").alias("kept_id"), F.col(f"best.{of_key}").alias("kept_key")).distinct()
    counts = given.join(sizes.small(stash(kept)), F.col(of_id).eqNullSafe(F.col("kept_id")) & (F.col(of_key) == F.col("kept_key")), "left")
    counts = counts.select(of_id, of_key, F.when(F.col("kept_key").isNotNull(), F.lit(1)).otherwise(F.col(times)).alias(times), slots).filter(F.col(times) > 0)
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    joined = keyed.join(sizes.small(stash(counts)), keyed[id_col].eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)))
    copies = joined.withColumn(of_key, F.explode(F.sequence(F.lit(1), F.col(times))))
    # A copy beyond the passes, or a text kept by rounding, stands at the last slot of its text or before all others.
    placed = copies.withColumn(slot, F.coalesce(F.get(slots, F.col(of_key) - 1), F.get(slots, F.size(slots) - 1), F.lit(-1).cast("long")))
    placed = placed.repartitionByRange(slot).sortWithinPartitions(slot)
    if slot_col is None:
        return placed.select(*docs.columns)
    return placed.select(*[c for c in docs.columns if c.lower() != slot_col.lower()], F.col(slot).alias(slot_col))

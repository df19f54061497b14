"""Context packs: document texts assembled under a character budget.

A pack holds at most 100 references, so every window below runs over a bounded
group; the check happens on counts before any grouping of rows.  Bodies are
read once, as lengths for the budget and as text for the final cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelake import checkpoints
from lorelake.brand import DEFAULT, Brand
from lorelake.functions import text as tx
from lorelake.sizes import small

# Excerpt sizes, note text and limits.
MIN_EXCERPT = 160
HARD_MIN_EXCERPT = 80
TRUNCATION_NOTE = "\n\n[Content truncated by the character budget.]\n"
RESERVE = 200
MAX_REFERENCES = 100

DOCUMENT_LIMIT = "Document limit reached"
NOT_AVAILABLE = "Document is not available in the active index"
NO_LOCATION = "Location index is unavailable"
BUDGET = "Character budget reached"


def pack_header(query: Column, max_characters: Column, brand: Brand = DEFAULT) -> Column:
    line = F.when(query == "", F.lit("No query supplied.")).otherwise(F.concat(F.lit("Query: "), query))
    return F.concat(F.lit(f"# {brand.name} context pack\n\n"), line, F.lit("\n\nBudget: "),
                    max_characters.cast("string"), F.lit(" characters\n\n"))


def document_prefix(title: Column, location_id: Column, path: Column, role: Column, reason: Column) -> Column:
    return F.concat(
        F.lit("## "), title, F.lit("\n\n- Location: `"), location_id, F.lit("`\n- Path: `"), path,
        F.lit("`\n- Role: "), role, F.lit("\n- Included because: "), reason, F.lit("\n\n---\n\n"))


def valid_packs(packs: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable packs with clamped limits, rejected packs with ``error``)."""
    sizes = selection.groupBy("pack_id").agg(F.count("*").alias("n_references"))
    checked = packs.join(sizes, "pack_id", "left").withColumns({
        "query": tx.strip("query"),
        "error": F.when(F.octet_length("query") > 1000, "The context query is too long.")
        .when(F.col("n_references").isNull(), "Select at least one document for the context pack.")
        .when(F.col("n_references") > MAX_REFERENCES, "Too many documents were selected for one context pack."),
        "max_characters": F.least(F.greatest("max_characters", F.lit(1_000)), F.lit(200_000)),
        "max_documents": F.least(F.greatest("max_documents", F.lit(1)), F.lit(20)),
    })
    return (checked.where("error IS NULL").drop("error", "n_references"),
            checked.where("error IS NOT NULL").select("pack_id", "error"))


def pack_select(packs: DataFrame, selection: DataFrame, docs: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Reference dedupe (first wins), availability and document limit.

    One row per kept reference with ``omission`` null or a reason.  Only
    available documents count towards the limit; once it is reached every later
    reference is over the limit whether available or not.
    """
    refs = selection.join(packs, "pack_id").withColumn("relative_path", tx.norm_path(F.col("relative_path")))
    refs = refs.where("relative_path <> ''")
    first = refs.groupBy("pack_id", "location_id", "relative_path", "max_documents", "max_characters", "query").agg(
        F.min(F.struct("pos", "reason")).alias("f"))
    refs = first.select("*", "f.pos", "f.reason").drop("f")
    body = tx.strip("body")
    wanted = refs.select("location_id", "relative_path").distinct()
    found = docs.join(small(wanted), ["location_id", "relative_path"], "left_semi").select("location_id", "relative_path", "title", F.col("kind").alias("role"), "generation",
                        F.length(body).alias("body_length"), F.lit(True).alias("_found"))
    joined = refs.join(found, ["location_id", "relative_path"], "left")
    if locations is not None:
        known = locations.select("location_id").distinct().withColumn("_location", F.lit(True))
        joined = joined.join(known, "location_id", "left")
    else:
        joined = joined.withColumn("_location", F.lit(True))
    before = W.partitionBy("pack_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    available = F.col("_found").isNotNull() & F.col("_location").isNotNull()
    earlier = F.coalesce(F.count_if(available).over(before), F.lit(0))
    omission = (
        F.when(earlier >= F.col("max_documents"), F.lit(DOCUMENT_LIMIT))
        .when(F.col("_location").isNull(), F.lit(NO_LOCATION))
        .when(F.col("_found").isNull(), F.lit(NOT_AVAILABLE))
    )
    reason = F.when(tx.strip("reason") == "", F.lit("Selected manually")).otherwise(tx.strip("reason"))
    return joined.withColumns({"omission": omission, "reason": reason}).drop("_found", "_location")


def budget_cut(selected: DataFrame, brand: Brand = DEFAULT) -> DataFrame:
    """Mark documents dropped from the end because even minimum excerpts do not fit."""
    note = len(TRUNCATION_NOTE)
    prefix = document_prefix(F.col("title"), F.col("location_id"), F.col("relative_path"), F.col("role"), F.col("reason"))
    header = F.length(pack_header(F.col("query"), F.col("max_characters"), brand))
    kept = F.col("omission").isNull()
    excerpt = F.least(F.col("body_length"), F.lit(HARD_MIN_EXCERPT))
    cost = F.length(prefix) + excerpt + F.when(excerpt < F.col("body_length"), note).otherwise(1)
    running = F.sum(F.when(kept, cost).otherwise(0)).over(
        W.partitionBy("pack_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    available = F.col("max_characters") - RESERVE - header
    staged = selected.withColumns({"prefix_length": F.length(prefix), "available": available, "_running": running})
    return staged.withColumn(
        "omission", F.when(kept & (F.col("_running") > F.col("available")), F.lit(BUDGET)).otherwise(F.col("omission"))
    ).drop("_running")


def even_fill(rows: DataFrame, budget: str, length: str = "body_length", group: str = "pack_id",
              order: str = "pos") -> DataFrame:
    """Closed form of the even fill up to min(length, 160); adds ``allocated``.

    The level is the largest L with Σ min(target, L) ≤ budget; what is left
    goes one character each to the first documents still below their target.
    """
    target = F.least(F.col(length), F.lit(MIN_EXCERPT))
    whole = W.partitionBy(group)
    targets = F.collect_list("_target").over(whole)
    staged = rows.withColumn("_target", target).withColumn("_targets", targets)

    def used(level: Column) -> Column:
        return F.aggregate("_targets", F.lit(0), lambda acc, t: acc + F.least(t, level))

    level = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(MIN_EXCERPT)), lambda x: used(x) <= F.col(budget)))
    staged = staged.withColumn("_level", F.coalesce(level, F.lit(0)))
    staged = staged.withColumn("_left", F.greatest(F.col(budget) - used(F.col("_level")), F.lit(0)))
    open_ = F.col("_target") > F.col("_level")
    place = F.sum(open_.cast("int")).over(W.partitionBy(group).orderBy(order))
    extra = (open_ & (place <= F.col("_left"))).cast("int")
    return staged.withColumn("allocated", F.least(F.col("_target"), F.col("_level")) + extra).drop(
        "_target", "_targets", "_level", "_left")


def proportional_split(rows: DataFrame, budget: str, length: str = "body_length", group: str = "pack_id",
                       order: str = "pos") -> DataFrame:
    """Add a largest-remainder share of ``budget`` to ``allocated``, never above the length."""
    whole = W.partitionBy(group)
    need = F.greatest(F.col(length) - F.col("allocated"), F.lit(0)).cast("long")
    staged = rows.withColumn("_need", need).withColumn("_total", F.sum("_need").over(whole))
    staged = staged.withColumn("_b", F.greatest(F.least(F.col(budget).cast("long"), F.col("_total")), F.lit(0)))
    weighted = F.col("_b") * F.col("_need")
    staged = staged.withColumns({
        "_floor": F.when(F.col("_total") > 0, F.expr("(_b * _need) div greatest(_total, 1)")).otherwise(F.lit(0)),
        "_rest": F.when(F.col("_total") > 0, weighted % F.greatest(F.col("_total"), F.lit(1))).otherwise(F.lit(0)),
    })
    left = F.col("_b") - F.sum("_floor").over(whole)
    place = F.row_number().over(W.partitionBy(group).orderBy(
        (F.col("_floor") < F.col("_need")).cast("int").desc(), F.desc("_rest"), F.desc("_need"), order))
    bonus = ((place <= left) & (F.col("_floor") < F.col("_need"))).cast("long")
    return staged.withColumn("allocated", (F.col("allocated") + F.col("_floor") + bonus).cast("int")).drop(
        "_need", "_total", "_b", "_floor", "_rest")


_RECLAIM = T.StructType([
    T.StructField("pack_id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("allocated", T.IntegerType())])


def _reclaim_notes(table):
    """Give reserved note space back until no document completes (≤ 20 rows per pack)."""
    import pyarrow as pa

    order = sorted(range(table.num_rows), key=lambda i: table["pos"][i].as_py())
    lengths = [table["body_length"][i].as_py() for i in order]
    shares = [table["allocated"][i].as_py() for i in order]
    reserved = [length > HARD_MIN_EXCERPT for length in lengths]
    while True:
        done = [i for i, held in enumerate(reserved) if held and shares[i] >= lengths[i]]
        if not done:
            break
        for i in done:
            reserved[i] = False
        budget = len(done) * (len(TRUNCATION_NOTE) - 1)
        needs = [length - share for length, share in zip(lengths, shares)]
        total = sum(needs)
        budget = min(budget, total)
        if budget <= 0:
            continue
        split = [divmod(budget * need, total) for need in needs]
        rest = budget - sum(whole for whole, _ in split)
        ranked = sorted(range(len(needs)), key=lambda i: (-split[i][1], -needs[i], i))
        for i, (whole, _) in enumerate(split):
            shares[i] += whole
        for i in ranked:
            if rest and shares[i] < lengths[i]:
                shares[i] += 1
                rest -= 1
    ids = [table["pack_id"][i].as_py() for i in order]
    return pa.table({"pack_id": pa.array(ids, pa.string()),
                     "pos": pa.array([table["pos"][i].as_py() for i in order], pa.int64()),
                     "allocated": pa.array(shares, pa.int32())})


def allocate(cut: DataFrame) -> DataFrame:
    """(pack_id, pos, allocated): body characters of every included document."""
    note = len(TRUNCATION_NOTE)
    kept = cut.where("omission IS NULL").select("pack_id", F.col("pos").cast("long").alias("pos"), "body_length", "prefix_length", "available")
    suffix = F.when(F.col("body_length") > HARD_MIN_EXCERPT, note).otherwise(1)
    spent = F.sum(F.col("prefix_length") + suffix).over(W.partitionBy("pack_id"))
    budgeted = kept.withColumn("_budget", F.greatest(F.col("available") - spent, F.lit(0)))
    filled = even_fill(budgeted, "_budget")
    used = F.sum("allocated").over(W.partitionBy("pack_id"))
    split = proportional_split(filled.withColumn("_rest_budget", F.col("_budget") - used), "_rest_budget")
    return split.select("pack_id", "pos", "body_length", "allocated").groupBy("pack_id").applyInArrow(_reclaim_notes, _RECLAIM)


def build_packs(packs: DataFrame, selection: DataFrame, docs: DataFrame, locations: DataFrame | None = None,
                brand: Brand = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, omissions, packs) of every valid pack request."""
    valid, _ = valid_packs(packs, selection)
    cut = checkpoints.cut(budget_cut(pack_select(valid, selection, docs, locations), brand))
    shares = allocate(cut)
    body = tx.strip("body")
    included = cut.where("omission IS NULL").withColumn("pos", F.col("pos").cast("long"))
    wanted = included.select("location_id", "relative_path").distinct()
    texts = docs.join(small(wanted), ["location_id", "relative_path"], "left_semi").select(
        "location_id", "relative_path", body.alias("_body"))
    prefix = document_prefix(F.col("title"), F.col("location_id"), F.col("relative_path"), F.col("role"), F.col("reason"))
    truncated = F.col("allocated") < F.col("body_length")
    items = included.join(shares, ["pack_id", "pos"]).join(texts, ["location_id", "relative_path"]).select(
        "pack_id", "pos", "location_id", "relative_path", "title", "role", "reason", "generation",
        F.left("_body", F.col("allocated")).alias("content"), truncated.alias("truncated"),
        F.concat(prefix, F.left("_body", F.col("allocated")),
                 F.when(truncated, F.lit(TRUNCATION_NOTE)).otherwise(F.lit("\n"))).alias("block"),
    ).withColumn("characters", F.length("block"))
    late = (F.col("omission") == BUDGET).cast("int")
    omissions = cut.where("omission IS NOT NULL").select(
        "pack_id", F.row_number().over(W.partitionBy("pack_id").orderBy(late, "pos")).alias("position"),
        "location_id", "relative_path", F.col("omission").alias("reason"))
    per_items = items.groupBy("pack_id").agg(
        F.count("*").alias("included"), F.count_if("truncated").alias("shortened"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda s: s["block"]), "").alias("blocks"))
    per_omissions = omissions.groupBy("pack_id").agg(F.count("*").alias("omitted"))
    joined = valid.join(per_items, "pack_id", "left").join(per_omissions, "pack_id", "left").fillna(
        0, ["included", "shortened", "omitted"]).fillna("", ["blocks"])
    any_cut = (F.col("omitted") > 0) | (F.col("shortened") > 0)
    footer = F.when(any_cut, F.concat(
        F.lit("\n---\nContext pack truncated: "), F.col("omitted").cast("string"), F.lit(" document(s) omitted; "),
        F.col("shortened").cast("string"), F.lit(" included document(s) shortened.\n"))).otherwise(F.lit(""))
    whole = joined.withColumns({
        "markdown": F.concat(pack_header(F.col("query"), F.col("max_characters"), brand), F.col("blocks"), footer),
        "truncated": any_cut, "estimator": F.lit("characters"),
    }).drop("blocks").withColumn("total_characters", F.length("markdown"))
    return items.drop("block"), omissions, whole

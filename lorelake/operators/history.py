"""Snapshot differences, renames, file identity and change history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelake import checkpoints
from lorelake.functions import text as tx

RENAME_WINDOW_MS = 2500
HISTORY_DAYS = 30
HISTORY_CAP = 5000
SEGMENT_ROWS = 200_000


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added / removed / changed / unchanged by size and mtime, one full outer join."""
    keys = ["location_id", "relative_path"]
    b = before.select(*keys, F.col("size").alias("old_size"), F.col("modified_at_ms").alias("old_ms"))
    a = after.select(*keys, F.col("size").alias("new_size"), F.col("modified_at_ms").alias("new_ms"))
    change = (
        F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "removed")
        .when((F.col("old_size") != F.col("new_size")) | (F.col("old_ms") != F.col("new_ms")), "changed")
        .otherwise("unchanged"))
    return b.join(a, keys, "full_outer").withColumn("change", change).select(
        *keys, "change", F.coalesce("new_size", "old_size").alias("size"),
        F.coalesce("new_ms", "old_ms").alias("modified_at_ms"), "old_size", "old_ms")


def removed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new, ["location_id", "relative_path"], "left_anti").select("location_id", "relative_path")


def touched_sources(changed: DataFrame, removed: DataFrame) -> DataFrame:
    keys = ["location_id", "relative_path"]
    return changed.select(*keys).union(removed.select(*keys)).distinct()


def carry_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """An existing path keeps its continuity id; a new one gets a deterministic one."""
    kept = old.select("location_id", "relative_path", F.col("continuity_id").alias("_id"))
    fresh = tx.surrogate_key(F.col("location_id"), F.col("relative_path"), F.col("modified_at_ms"))
    return new.join(kept, ["location_id", "relative_path"], "left").withColumn(
        "continuity_id", F.coalesce("_id", fresh)).drop("_id")


# -- renames ---------------------------------------------------------------


def _chains(moved: DataFrame) -> DataFrame:
    """Add ``chain``: rows of one (location, size) whose mtimes connect by gaps below the window.

    Gaps are found on time bins, not rows: a bin is as wide as the window, so
    the rows of one bin always connect and a hot (location, size) shrinks to its
    bins before the window function sees it.
    """
    keys = ["location_id", "size"]
    binned = moved.withColumn("bin", F.floor(F.col("modified_at_ms") / RENAME_WINDOW_MS))
    bins = binned.groupBy(*keys, "bin").agg(F.min("modified_at_ms").alias("lo"), F.max("modified_at_ms").alias("hi"))
    order = W.partitionBy(*keys).orderBy("bin")
    starts = (F.col("lo") - F.lag("hi").over(order) >= RENAME_WINDOW_MS) | F.lag("hi").over(order).isNull()
    marked = bins.withColumn("_start", F.when(starts, F.col("bin"))).withColumn(
        "chain", F.last("_start", ignorenulls=True).over(order))
    spans = marked.groupBy(*keys, "chain").agg((F.max("hi") - F.min("lo")).alias("span"))
    named = marked.select(*keys, "bin", "chain").join(spans, [*keys, "chain"])
    return binned.join(named, [*keys, "bin"]).drop("bin")


def spread_rank(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``row_number`` over possibly huge groups without one task per group.

    Rows are range-partitioned by (keys, order) and cut there; a group's rank is
    the rank inside its partition plus the counts of the earlier partitions.
    """
    ranged = df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    fixed = checkpoints.cut(ranged)
    counts = fixed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(order))
    return fixed.withColumn("_inside", inside).join(offsets, [*keys, "_part"]).withColumn(
        name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


_PAIR = T.StructType([T.StructField("location_id", T.StringType()), T.StructField("size", T.LongType()),
                      T.StructField("chain", T.LongType()), T.StructField("segment", T.LongType()),
                      T.StructField("removed_no", T.LongType()), T.StructField("added_no", T.LongType())])


def _first_fit(table):
    """First fit of one segment's removed files, on numbers only (a min tree over added mtimes).

    An added file with ``held`` is gone for every removed file after that number.
    """
    import bisect

    import pyarrow as pa

    rows = list(zip(*(table[c].to_pylist() for c in ("side", "no", "modified_at_ms", "held"))))
    added = sorted((t, n, h) for s, n, t, h in rows if s == "added")
    removed = sorted((n, t) for s, n, t, _ in rows if s == "removed")
    at, width, none = [t for t, _, _ in added], max(1, len(added)), 1 << 62
    tree = [none] * width + [n for _, n, _ in added] + [none] * (width - len(added))
    place = {n: i for i, (_, n, _) in enumerate(added)}
    leaving = sorted(((h, n) for _, n, h in added if h is not None), reverse=True)

    def take(number):
        i = place[number] + width
        tree[i] = none
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    left, right = [], []
    for number, time in removed:
        while leaving and leaving[-1][0] < number:
            take(leaving.pop()[1])
        low = bisect.bisect_right(at, time - RENAME_WINDOW_MS) + width
        high = bisect.bisect_left(at, time + RENAME_WINDOW_MS) + width
        best = none
        while low < high:
            if low & 1:
                best, low = min(best, tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low, high = low >> 1, high >> 1
        if best != none:
            left.append(number)
            right.append(best)
            take(best)
    same = {f.name: [table[f.name][0].as_py()] * len(left) for f in _PAIR.fields[:4]}
    return pa.table(
        same | {"removed_no": left, "added_no": right},
        schema=pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _PAIR.fields]))


def _offers(long: DataFrame, keys: list[str], segment_rows: int) -> DataFrame:
    """Long chains cut into segments of whole window-wide bins; (…, segment, side, no, modified_at_ms, held).

    A removed file is in its own segment. A file is only near files of its own and
    the two neighbour bins, so an added file is also offered to the segments of these.
    """
    binned = long.select(*keys, "side", F.col("no").cast("long").alias("no"), "modified_at_ms").withColumn(
        "bin", F.floor(F.col("modified_at_ms") / RENAME_WINDOW_MS))
    order = W.partitionBy(*keys).orderBy("bin")
    earlier = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n")).withColumn("segment", F.floor(earlier / segment_rows))
    bins = bins.withColumn("near", F.array_distinct(F.array_compact(F.array(
        "segment", F.lag("segment").over(order), F.lead("segment").over(order))))).drop("n")
    seen = F.when(F.col("side") == "removed", F.array("segment")).otherwise(F.col("near"))
    return binned.join(bins, [*keys, "bin"]).withColumn("segment", F.explode(seen)).select(
        *keys, "segment", "side", "no", "modified_at_ms", F.lit(None).cast("long").alias("held"))


def first_fit(long: DataFrame, keys: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(…, removed_no, added_no): first fit inside chains of any length, by deferred acceptance of segments.

    Every segment matches its own removed files; an added file at a border may be
    wanted by two or three segments. The lowest number keeps it, the other
    segments see it as held and match again, until no border file is wanted twice.
    Files rank each other alike on both sides, so the stable matching is the one
    that first fit in path order gives, whatever the segments are. A file once
    refused is refused for good, so the rounds end; only segments that lost a
    file run again. One task holds about ``segment_rows`` rows of three numbers,
    more only where one location has more files of one size inside one window.
    """
    group = [*keys, "segment"]
    offers = checkpoints.cut(_offers(long, keys, segment_rows))
    pairs = checkpoints.cut(offers.groupBy(*group).applyInArrow(_first_fit, _PAIR))
    shared = offers.where("side = 'added'").groupBy(*keys, F.col("no").alias("added_no")).count().where("count > 1").drop("count")
    while True:
        wanted = pairs.join(shared, [*keys, "added_no"], "left_semi").select(
            *keys, F.col("added_no").alias("no"), F.lit("added").alias("side"), F.col("segment").alias("by"), F.col("removed_no").alias("rival"))
        wants = wanted.groupBy(*keys, "no", "side").agg(F.collect_list(F.struct("by", "rival")).alias("wants"))  # three at most
        rival = F.array_min(F.transform(F.filter("wants", lambda w: w["by"] != F.col("segment")), lambda w: w["rival"]))
        fresh = checkpoints.cut(offers.join(wants, [*keys, "no", "side"], "left").withColumn("now", F.least("held", rival)).select(
            *group, "side", "no", "modified_at_ms", F.col("now").alias("held"), (~F.col("now").eqNullSafe(F.col("held"))).alias("lost")))
        again = fresh.where("lost").select(*group).distinct()
        if again.isEmpty():
            return pairs.select(*keys, "removed_no", "added_no")
        offers = fresh.drop("lost")
        solved = offers.join(again, group, "left_semi").groupBy(*group).applyInArrow(_first_fit, _PAIR)
        pairs = checkpoints.cut(pairs.join(again, group, "left_anti").unionByName(solved))


def match_renames(changes: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(location, old path, new path): removed files paired one-to-one with added files.

    In path order every removed file takes the first free added file of equal
    size whose mtime is less than 2,500 ms away.  Chains of mtimes are
    independent.  A chain no longer than the window is a plain rank-to-rank
    equi-join, which covers bulk operations that touch very many equal files at
    once; longer chains go through ``first_fit`` in segments.
    """
    keys = ["location_id", "size", "chain"]
    moved = changes.where("change IN ('added', 'removed')").select(
        "location_id", "size", "modified_at_ms", "relative_path", F.col("change").alias("side"))
    chained = _chains(moved)
    sides = chained.groupBy(*keys).agg(F.count_if(F.col("side") == "added").alias("a"), F.count_if(F.col("side") == "removed").alias("r"))
    both = chained.join(sides.where("a > 0 AND r > 0").drop("a", "r"), keys, "left_semi")
    ranked = checkpoints.cut(spread_rank(both, [*keys, "side"], "relative_path", "no"))
    short = ranked.where(F.col("span") < RENAME_WINDOW_MS)
    pairs = first_fit(ranked.where(F.col("span") >= RENAME_WINDOW_MS), keys, segment_rows)
    same = short.where("side = 'removed'").select(*keys, F.col("no").alias("removed_no"), F.col("no").alias("added_no"))
    names = ranked.select(*keys, "side", "no", "relative_path")
    old = names.where("side = 'removed'").select(*keys, F.col("no").alias("removed_no"), F.col("relative_path").alias("previous_path"))
    new = names.where("side = 'added'").select(*keys, F.col("no").alias("added_no"), "relative_path")
    return same.unionByName(pairs).join(old, [*keys, "removed_no"]).join(new, [*keys, "added_no"]).select(
        "location_id", "previous_path", "relative_path")


def change_events(changes: DataFrame, renames: DataFrame, observed_at_ms: int, source: str = "external") -> DataFrame:
    """History events of one reconcile: renamed, removed, created, modified."""
    keys = ["location_id", "relative_path"]
    gone = renames.select("location_id", F.col("previous_path").alias("relative_path"))
    rest = changes.where("change <> 'unchanged'").join(gone.unionByName(renames.select(*keys)), keys, "left_anti")
    kind = F.when(F.col("change") == "added", "created").when(F.col("change") == "removed", "removed").otherwise("modified")
    single = rest.select(*keys, F.lit(None).cast("string").alias("previous_path"), kind.alias("kind"))
    events = renames.select(*keys, "previous_path", F.lit("renamed").alias("kind")).unionByName(single)
    return events.withColumns({
        "observed_at": F.lit(observed_at_ms).cast("long"), "source": F.lit(source),
        "available": F.col("kind") != "removed",
        "event_id": tx.surrogate_key(F.col("location_id"), F.col("relative_path"), F.col("kind"), F.lit(observed_at_ms)),
    }).withColumnRenamed("relative_path", "path")


# -- identity --------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge table (a, b): smallest node of each component.

    Alternating large-star / small-star rounds; every round is two aggregations
    with map-side combine, and its result is cut to the checkpoint folder.
    """
    pairs = checkpoints.cut(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(max_rounds):
        # large star: neighbours above a node attach to the node's minimum
        both = pairs.union(pairs.select(F.col("b"), F.col("a")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours attach to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(floor, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b")))
        fresh = checkpoints.cut(small.where("a <> b").distinct())
        moved = fresh.join(pairs, ["a", "b"], "left_anti").limit(1).count() + pairs.join(fresh, ["a", "b"], "left_anti").limit(1).count()
        pairs = fresh
        if moved == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select("component", "component")).distinct()


def file_identity(events: DataFrame) -> DataFrame:
    """Add ``identity``: one value per file across its renames, never across locations."""
    def key(path: str):
        return F.concat_ws("\x00", "location_id", path)

    edges = events.where("previous_path IS NOT NULL AND previous_path <> ''").select(
        key("path").alias("a"), key("previous_path").alias("b"))
    named = components(edges)
    keyed = events.withColumn("node", key("path"))
    return keyed.join(named, "node", "left").withColumn("identity", F.coalesce("component", "node")).drop("node", "component")


def dedupe_history(events: DataFrame) -> DataFrame:
    """Latest event per file identity; equal instants keep the earliest row id."""
    return newest_per_identity(file_identity(events))


def newest_per_identity(named: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in named.columns if c != "identity"]
    # The smallest (−instant, id) is the newest event with the earliest id.
    best = named.groupBy("identity").agg(F.min_by(
        F.struct(*columns), F.struct((-F.col("observed_at")).alias("age"), F.col("event_id"))).alias("e"))
    return best.select("identity", "e.*")


def cap_history(events: DataFrame, now_ms: int, days: int = HISTORY_DAYS, cap: int = HISTORY_CAP) -> DataFrame:
    """Newest ``cap`` events of the retention window."""
    recent = events.where(F.col("observed_at") >= now_ms - days * 86_400_000)
    return recent.orderBy(F.desc("observed_at"), "event_id").limit(cap)


def recent_searches(searches: DataFrame, keep: int = 20) -> DataFrame:
    """Newest search per (user, trimmed query, sorted locations, filters), newest 20 per user."""
    key = F.to_json(F.struct(tx.strip("query").alias("query"), F.array_sort("location_ids").alias("locations"), F.col("filters")))
    newest = searches.withColumn("_key", key).groupBy("user_id", "_key").agg(
        F.max(F.struct("searched_at", "search_id", "query", "location_ids", "filters")).alias("s"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("searched_at"), F.desc("search_id")))
    return newest.select("user_id", "s.*").withColumn("query", tx.strip("query")).withColumn("rank", place).where(F.col("rank") <= keep)

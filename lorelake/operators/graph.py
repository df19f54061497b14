"""Links as a graph: resolution, related documents, concept edges, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelake.functions import text as tx
from lorelake.sizes import small


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """candidate → resolved / unresolved by existence of the target; other states stay."""
    return _refresh(links, files, F.col("status") == "candidate")


def refresh_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Re-resolve every link with a target, whatever its state, except fragments."""
    return _refresh(links, files, F.col("status") != "fragment")


def refresh_affected(links: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """All links of the sources with a link to a path that came or went, resolved again.

    ``came`` and ``went`` (location_id, relative_path) are one run's changes: the
    links are filtered by them where they lie, other links are not looked at.
    """
    keys = ["location_id", "target_relative_path"]
    moved = came.select("location_id", F.col("relative_path").alias("target_relative_path"), F.lit("resolved").alias("_now")).union(
        went.select("location_id", F.col("relative_path").alias("target_relative_path"), F.lit("unresolved").alias("_now")))
    moved = small(moved.groupBy(*keys).agg(F.min("_now").alias("_now")))
    sources = small(links.where("status <> 'fragment'").join(moved, keys, "left_semi").select("location_id", "source_relative_path").distinct())
    again = links.join(sources, ["location_id", "source_relative_path"], "left_semi").join(moved, keys, "left")
    status = F.when(F.col("status") != "fragment", F.coalesce("_now", F.col("status"))).otherwise(F.col("status"))
    return again.withColumn("status", status).select(*links.columns)


def _refresh(links: DataFrame, files: DataFrame, applies) -> DataFrame:
    known = files.select("location_id", F.col("relative_path").alias("target_relative_path")).distinct().withColumn(
        "_known", F.lit(True))
    joined = links.join(known, ["location_id", "target_relative_path"], "left")
    status = F.when(
        applies & F.col("target_relative_path").isNotNull(),
        F.when(F.col("_known"), F.lit("resolved")).otherwise(F.lit("unresolved")),
    ).otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_known").select(*links.columns)


def broken_links(links: DataFrame) -> DataFrame:
    """Findings for unresolved links to Markdown targets."""
    return links.where(
        (F.col("status") == "unresolved") & F.col("target_relative_path").rlike(r"(?i)[^/]\.(md|markdown)$")
    ).select(
        "location_id", F.col("source_relative_path").alias("relative_path"), F.lit("OKF_LINK_BROKEN").alias("code"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("The internal link '"), F.col("target"),
                 F.lit("' does not resolve to a file in this bundle.")).alias("message"),
        "start_line", "start_column", "end_line", "end_column", F.lit("hygiene").alias("tier"))


def relations(links: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(location, relative_path, other, outgoing, incoming, fragment) of resolved links, self excluded.

    Both directions are two projections of one link scan; the map-side combine
    collapses repeated links before the shuffle.
    """
    edges = links.where("status = 'resolved' AND source_relative_path <> target_relative_path")
    # The fragment only counts from the outgoing side; the first non-null one wins.
    first = F.when(F.col("fragment").isNotNull(), F.struct("position", "fragment"))
    both = edges.select("location_id", F.explode(F.array(
        F.struct(F.col("source_relative_path").alias("relative_path"), F.col("target_relative_path").alias("other"),
                 F.lit(True).alias("out"), first.alias("f")),
        F.struct(F.col("target_relative_path").alias("relative_path"), F.col("source_relative_path").alias("other"),
                 F.lit(False).alias("out"), F.lit(None).cast("struct<position:int,fragment:string>").alias("f")),
    )).alias("e")).select("location_id", "e.*")
    if seeds is not None:
        both = both.join(seeds.select("location_id", "relative_path").distinct(), ["location_id", "relative_path"], "left_semi")
    return both.groupBy("location_id", "relative_path", "other").agg(
        F.bool_or("out").alias("outgoing"), F.bool_or(~F.col("out")).alias("incoming"),
        F.min("f")["fragment"].alias("fragment"))


def related(links: DataFrame, docs: DataFrame, seeds: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """One-hop neighbours per seed, and per-seed counts taken before the limit."""
    limit = max(1, min(limit, 50))
    other = docs.select("location_id", F.col("relative_path").alias("other"), "title", "type", "tags",
                        F.col("kind").alias("role"), "generation")
    known = relations(links, seeds).join(other, ["location_id", "other"])
    seed = F.col("relative_path")
    direction = F.when(F.col("outgoing") & F.col("incoming"), "mutual").when(F.col("outgoing"), "outgoing").otherwise("incoming")
    rank = F.when(F.col("direction") == "mutual", 0).when(F.col("direction") == "outgoing", 1).otherwise(2)
    shaped = known.withColumn("direction", direction).withColumns({
        "reason": F.when(F.col("direction") == "mutual", F.concat(F.lit("Linked in both directions with "), seed))
        .when(F.col("direction") == "outgoing", F.concat(F.lit("Linked from "), seed))
        .otherwise(F.concat(F.lit("Links to "), seed)),
        "direction_rank": rank,
    })
    window = W.partitionBy("location_id", "relative_path").orderBy("direction_rank", F.lower("title"), "other")
    top = shaped.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    counts = shaped.groupBy("location_id", "relative_path").agg(
        F.count_if(F.col("outgoing")).alias("outgoing_count"), F.count_if(F.col("incoming")).alias("incoming_count"),
        F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted_count"))
    return top.drop("direction_rank", "outgoing", "incoming"), counts


def backlinks(links: DataFrame, docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every document that links to a seed, without a limit."""
    incoming = links.where("status = 'resolved' AND source_relative_path <> target_relative_path").select(
        "location_id", F.col("target_relative_path").alias("relative_path"),
        F.col("source_relative_path").alias("other"))
    wanted = incoming.join(seeds.select("location_id", "relative_path").distinct(), ["location_id", "relative_path"], "left_semi")
    named = docs.select("location_id", F.col("relative_path").alias("other"), "title")
    # A path that is listed twice does not repeat its links.
    return wanted.join(named, ["location_id", "other"]).distinct()


def concept_projection(inspected: DataFrame) -> DataFrame:
    """id without suffix, default type, title falling back to the file stem."""
    path = F.col("relative_path")
    bare = F.regexp_replace(path, r"\.(markdown|md)$", "")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return inspected.where("kind = 'concept'").select(
        "location_id", bare.alias("id"), "relative_path", F.coalesce("meta.type", F.lit("Unclassified")).alias("type"),
        F.coalesce("meta.title", stem).alias("title"), F.col("meta.description").alias("description"),
        F.col("meta.tags").alias("tags"), F.col("meta.effective_timestamp").alias("timestamp"))


def concept_edges(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct resolved concept → concept edges; a self link counts."""
    nodes = concepts.select("location_id", "relative_path")
    edges = links.where("status = 'resolved'").select(
        "location_id", F.col("source_relative_path").alias("source"), F.col("target_relative_path").alias("target")).distinct()
    return edges.join(nodes.withColumnRenamed("relative_path", "source"), ["location_id", "source"], "left_semi").join(
        nodes.withColumnRenamed("relative_path", "target"), ["location_id", "target"], "left_semi")


def undirected_edges(edges: DataFrame) -> DataFrame:
    return edges.select("location_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def degrees(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Known outgoing plus known incoming edges of every concept; a self link counts twice."""
    ends = edges.select("location_id", F.explode(F.array("source", "target")).alias("relative_path"))
    counted = ends.groupBy("location_id", "relative_path").agg(F.count("*").alias("degree"))
    return concepts.join(counted, ["location_id", "relative_path"], "left").fillna(0, ["degree"])


def top_concepts(ranked: DataFrame, limit: int = 300, labels: int = 24) -> tuple[DataFrame, DataFrame]:
    """Best ``limit`` concepts by degree per location (the first ``labels`` are labelled) and hidden counts."""
    window = W.partitionBy("location_id").orderBy(F.desc("degree"), "relative_path")
    top = ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    hidden = ranked.groupBy("location_id").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("hidden"))
    return top.withColumn("labelled", F.col("rank") <= labels), hidden


def assign_location(paths: DataFrame, locations: DataFrame, path: str = "path") -> DataFrame:
    """Most specific location containing each path, by equi-join on its ancestors.

    A path has as many ancestors as segments, so the explode is bounded by path
    depth and a large location table needs no nested loop.
    """
    distinct = paths.select(path).distinct()
    identity = tx.path_identity(F.col(path))
    parts = F.split(identity, "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    keyed = distinct.withColumn("_root", F.explode(ancestors))
    # "/" itself is spelled as an empty first segment.
    keyed = keyed.withColumn("_root", F.when(F.col("_root") == "", F.lit("/")).otherwise(F.col("_root")))
    roots = locations.select("location_id", tx.path_identity(F.col("path")).alias("_root")).groupBy("_root").agg(
        F.min("location_id").alias("location_id"))
    best = keyed.join(roots, "_root").groupBy(path).agg(F.max_by("location_id", F.length("_root")).alias("location_id"))
    return paths.join(best, path, "left")

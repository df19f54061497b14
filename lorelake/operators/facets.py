"""Counts over many locations: facets, link health, finding summaries, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelake.functions import text as tx

SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def facets(docs: DataFrame, as_of: str, by_location: bool = False) -> DataFrame:
    """Six dimensions counted in one pass and one shuffle.

    Ordered by dimension, count and folded value when sorted; the raw value is
    the last key, which makes ties deterministic.
    """
    def one(dim: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(dim).alias("dimension"), value.alias("value")))

    tags = F.transform("tags", lambda t: F.struct(F.lit("tag").alias("dimension"), t.alias("value")))
    rows = F.concat(
        one("type", F.col("type")), one("role", F.col("kind")), one("status", F.col("status")),
        one("trust", F.col("trust_tier")), one("freshness", tx.freshness(F.col("stale_after"), as_of)), tags)
    keys = ["location_id"] if by_location else []
    exploded = docs.select(*keys, F.explode(rows).alias("f")).select(*keys, "f.dimension", "f.value")
    return exploded.where("value <> ''").groupBy(*keys, "dimension", "value").agg(F.count("*").alias("count"))


def sort_facets(counts: DataFrame) -> DataFrame:
    return counts.orderBy("dimension", F.desc("count"), F.lower("value"), "value")


def concept_facets(concepts: DataFrame) -> DataFrame:
    """Type and tag counts of concepts per location."""
    rows = F.concat(
        F.array(F.struct(F.lit("type").alias("dimension"), F.col("type").alias("value"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("dimension"), t.alias("value"))))
    return concepts.select("location_id", F.explode(rows).alias("f")).groupBy(
        "location_id", "f.dimension", "f.value").agg(F.count("*").alias("count"))


def visible_tags(counts: DataFrame, selected: str | None = None, limit: int = 20) -> DataFrame:
    """Top tags per location plus the selected one if it was cut."""
    tags = counts.where("dimension = 'tag'")
    window = W.partitionBy("location_id").orderBy(F.desc("count"), "value")
    top = tags.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    if selected is None:
        return top
    chosen = tags.where(F.col("value") == selected).join(top, ["location_id", "value"], "left_anti")
    return top.unionByName(chosen.withColumn("rank", F.lit(limit + 1)))


def link_health(links: DataFrame) -> DataFrame:
    return links.groupBy("location_id").agg(
        F.count_if(F.col("status") == "resolved").alias("resolved_links"),
        F.count_if(F.col("status") == "unresolved").alias("unresolved_links"))


def lint_summary(findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """Severity counts and the pass/fail decision per location."""
    counts = findings.groupBy("location_id").agg(*[
        F.count_if(F.col("severity") == s).alias(a) for s, a in (("error", "errors"), ("warning", "warnings"), ("info", "info"))])
    failed = {"error": F.col("errors") > 0, "warning": (F.col("errors") > 0) | (F.col("warnings") > 0),
              "never": F.lit(False)}[fail_on]
    return counts.withColumn("failed", failed)


def group_findings(findings: DataFrame) -> DataFrame:
    """Findings per code: severity of the first one, size and display rank."""
    first = F.min(F.struct("relative_path", "start_line", "start_column", "message", "severity"))
    return findings.groupBy("location_id", "code").agg(first["severity"].alias("severity"), F.count("*").alias("size"))


def sort_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy("location_id", severity_rank(F.col("severity")), F.desc("size"), "code")


def detect_bundles(inspected: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Declared version and detection per location; enabled by mode when locations are given."""
    root = F.col("is_root_index")
    typed = (F.col("kind") == "concept") & (F.coalesce(F.trim("meta.type"), F.lit("")) != "")
    found = inspected.groupBy("location_id").agg(
        F.max(F.when(root, F.col("meta.okf_version"))).alias("declared_version"),
        F.bool_or(root).alias("has_root"), F.bool_or(typed).alias("has_typed"), F.count("*").alias("document_count"))
    out = found.select(
        "location_id", "declared_version", "document_count",
        (F.col("declared_version").isNotNull() | (F.col("has_root") & F.col("has_typed"))).alias("detected"))
    if locations is None:
        return out
    joined = out.join(locations.select("location_id", "okf_mode", "okf_bundle"), "location_id")
    enabled = F.when(F.col("okf_mode") == "disabled", F.lit(False)).when(
        F.col("okf_mode") == "manual", F.col("okf_bundle")).otherwise(F.col("detected"))
    return joined.withColumn("enabled", enabled)


def finding_counts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Finding count of every document, zero included."""
    counts = findings.groupBy("location_id", "relative_path").agg(F.count("*").alias("finding_count"))
    return docs.select("location_id", "relative_path").join(
        counts, ["location_id", "relative_path"], "left").fillna(0, ["finding_count"])


def storage_size(docs: DataFrame) -> DataFrame:
    return docs.groupBy("location_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("documents"))


def index_status(diff: DataFrame, docs: DataFrame, failed: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Counts and state per location of one run.

    ``failed`` holds (location_id, relative_path) that could not be read;
    ``runs`` may mark whole failed runs with ``error``.
    """
    changes = diff.groupBy("location_id").agg(
        F.count_if(F.col("change") != "removed").alias("discovered"),
        F.count_if(F.col("change").isin("added", "changed")).alias("changed"),
        F.count_if(F.col("change") == "removed").alias("removed"))
    indexed = docs.groupBy("location_id").agg(F.count("*").alias("indexed"))
    bad = failed.groupBy("location_id").agg(F.count("*").alias("failed"))
    out = changes.join(indexed, "location_id", "full_outer").join(bad, "location_id", "full_outer").fillna(
        0, ["discovered", "changed", "removed", "indexed", "failed"])
    state = F.when(F.col("failed") > 0, F.lit("degraded")).otherwise(F.lit("ready"))
    if runs is not None:
        out = out.join(runs.select("location_id", "error", "active_generation"), "location_id", "full_outer").fillna(
            0, ["discovered", "changed", "removed", "indexed", "failed"])
        state = F.when(
            F.col("error").isNotNull(),
            F.when(F.col("active_generation").isNotNull(), F.lit("degraded")).otherwise(F.lit("failed"))).otherwise(state)
    return out.withColumn("state", state)


def list_locations(locations: DataFrame, status: DataFrame, allow: DataFrame) -> DataFrame:
    """Allowed locations with their status and what they can do."""
    kept = locations.join(allow.select("location_id").distinct(), "location_id", "left_semi")
    joined = kept.join(status.select("location_id", "state", "indexed"), "location_id", "left")
    return joined.withColumns({
        "state": F.coalesce("state", F.lit("notIndexed")), "indexed": F.coalesce("indexed", F.lit(0)),
        "searchable": F.coalesce(F.col("state").isin("ready", "degraded"), F.lit(False))})


def location_signature(files: DataFrame) -> DataFrame:
    """Order-free signature of (path, mtime, size) per location: two hash sums and a count."""
    row = F.md5(F.concat_ws(":", "relative_path", F.col("modified_at_ms").cast("string"), F.col("size").cast("string")))
    high = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(row, 13, 12), 16, 10).cast("decimal(20,0)")
    return files.groupBy("location_id").agg(F.concat_ws(
        ":", F.count("*").cast("string"), F.sum(high).cast("string"), F.sum(low).cast("string")).alias("signature"))


def changed_locations(before: DataFrame, after: DataFrame, force: bool = False) -> DataFrame:
    """Locations whose signature differs, or all when forced."""
    return after if force else after.join(before, ["location_id", "signature"], "left_anti")


def merge_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of ``first`` plus those of ``second`` whose code and message ``first`` lacks."""
    keys = ["location_id", "code", "message"]
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))

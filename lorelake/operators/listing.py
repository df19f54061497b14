"""Keyset pagination and finding order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelake.functions import text as tx
from lorelake.operators.facets import severity_rank
from lorelake.sizes import small

CURSOR_VERSION = 1
CURSOR = "version int, location_id string, generation bigint, after_relative_path string, request_hash string"


def filter_hash() -> Column:
    """Hash of the normalized filters of a listing request row."""

    def text(name: str) -> Column:
        return F.nullif(tx.strip(F.coalesce(F.col(name), F.lit(""))), F.lit(""))

    return F.sha2(F.to_json(F.struct(
        text("role").alias("role"), text("type").alias("type"), text("status").alias("status"),
        distinct_tags(F.col("tags")).alias("tags"),
        tx.norm_prefix(F.coalesce(F.col("path_prefix"), F.lit(""))).alias("pathPrefix"),
        F.lit("relativePath").alias("orderBy"))), 256)


def distinct_tags(tags: Column) -> Column:
    """Trimmed, non-blank, sorted, distinct."""
    trimmed = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), tx.strip), lambda t: t != "")
    return F.array_sort(F.array_distinct(trimmed))


def encode_cursor(location_id: Column, generation: Column, after: Column, request_hash: Column) -> Column:
    return tx.url_safe_base64(F.to_json(F.struct(
        F.lit(CURSOR_VERSION).alias("version"), location_id.alias("location_id"), generation.alias("generation"),
        after.alias("after_relative_path"), request_hash.alias("request_hash"))))


def decode_cursor(cursor: Column) -> Column:
    return F.from_json(tx.url_safe_unbase64(cursor), CURSOR)


def list_documents(docs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page rows, one answer row per request) for many listing requests.

    Requests: request_id, location_id, generation, role, type, status, tags,
    path_prefix, limit, cursor.  Documents are those of the active generation.
    The page is a per-request rank ≤ limit + 1, which becomes a partial limit
    before the shuffle.
    """
    r = requests.withColumns({
        "request_hash": filter_hash(), "limit": F.least(F.greatest("limit", F.lit(1)), F.lit(100)),
        "c": decode_cursor(F.col("cursor")),
    })
    given = F.col("cursor").isNotNull()
    bad = F.coalesce(F.col("c.after_relative_path"), F.lit("")) == ""
    mismatch = ((F.col("c.version") != CURSOR_VERSION) | (F.col("c.location_id") != F.col("location_id"))
                | (F.col("c.request_hash") != F.col("request_hash")))
    r = r.withColumns({
        "error": F.when(given & bad, "The document list cursor is invalid.")
        .when(given & mismatch, "The document list cursor does not match this request.")
        .when(given & (F.col("c.generation") != F.col("generation")),
              "The document list cursor no longer matches the active index generation."),
        "r_after": F.coalesce(F.col("c.after_relative_path"), F.lit("")),
        "r_role": tx.strip(F.coalesce("role", F.lit(""))), "r_type": tx.strip(F.coalesce("type", F.lit(""))),
        "r_status": tx.strip(F.coalesce("status", F.lit(""))), "r_tags": distinct_tags(F.col("tags")),
        "r_prefix": tx.norm_prefix(F.coalesce(F.col("path_prefix"), F.lit(""))),
    })
    asked = r.where("error IS NULL").select(
        "request_id", "location_id", "generation", "limit", "request_hash", "r_after", "r_role", "r_type", "r_status",
        "r_tags", "r_prefix")
    # Listing columns only: bodies never take part in the ranking.
    rows = docs.drop("body", "search_text", "headings", "frontmatter_json").join(
        small(asked, 5_000), ["location_id", "generation"]).where(
        (F.col("relative_path") > F.col("r_after"))
        & ((F.col("r_role") == "") | (F.col("kind") == F.col("r_role")))
        & ((F.col("r_type") == "") | (F.col("type") == F.col("r_type")))
        & ((F.col("r_status") == "") | (F.col("status") == F.col("r_status")))
        & ((F.size("r_tags") == 0) | F.arrays_overlap("tags", "r_tags"))
        & ((F.col("r_prefix") == "") | F.startswith("relative_path", F.col("r_prefix"))))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("relative_path"))
    ranked = rows.withColumn("position", place).where(F.col("position") <= 101).where(F.col("position") <= F.col("limit") + 1)
    page = ranked.where(F.col("position") <= F.col("limit"))
    last = ranked.groupBy("request_id", "location_id", "generation", "limit", "request_hash").agg(
        F.max("position").alias("n"),
        F.max(F.when(F.col("position") <= F.col("limit"), F.col("relative_path"))).alias("after"))
    cursors = last.select("request_id", F.when(
        F.col("n") > F.col("limit"),
        encode_cursor(F.col("location_id"), F.col("generation"), F.col("after"), F.col("request_hash"))).alias("next_cursor"))
    answers = r.select("request_id", "error").join(cursors, "request_id", "left")
    return page.drop("r_after", "r_role", "r_type", "r_status", "r_tags", "r_prefix", "request_hash", "limit"), answers


def finding_order() -> list[Column]:
    """Severity, folded path, path, line, column (missing last), code, message."""
    return [
        severity_rank(F.col("severity")), F.lower("relative_path"), F.col("relative_path"),
        F.col("start_line").asc_nulls_last(), F.col("start_column").asc_nulls_last(), F.col("code"), F.col("message")]


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("location_id", *finding_order())


def displayed_findings(findings: DataFrame, limit: int = 1000) -> DataFrame:
    """First ``limit`` (at most 100,000) findings per location, for display only."""
    limit = max(0, min(limit, 100_000))
    place = F.row_number().over(W.partitionBy("location_id").orderBy(*finding_order()))
    return findings.withColumn("position", place).where(F.col("position") <= limit)


def order_paths(files: DataFrame, case_sensitive: bool = True) -> DataFrame:
    keys = ["relative_path"] if case_sensitive else [F.lower("relative_path"), F.col("relative_path")]
    return files.orderBy("location_id", *keys)

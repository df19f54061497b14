"""One reconcile run: list, diff, parse only what changed, upsert, re-resolve, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelake import checkpoints, sizes
from lorelake.brand import DEFAULT, Brand
from lorelake.operators import facets as fc
from lorelake.operators import graph as gr
from lorelake.operators import history as hi
from lorelake.operators import inspect as ins
from lorelake.sources import corpus, tables

DOCUMENT_SCHEMA = (
    "location_id string, generation bigint, relative_path string, continuity_id string, content_hash string, modified_at_ms bigint, "
    "size bigint, kind string, title string, description string, type string, tags array<string>, tags_text string, "
    "headings array<struct<level:tinyint,text:string>>, headings_text string, frontmatter_json string, metadata_text string, "
    "status string, trust_tier string, stale_after string, timestamp string, okf_version string, finding_count bigint, "
    "is_conformant boolean, body string, search_text string")
LINK_SCHEMA = (
    "location_id string, generation bigint, source_relative_path string, position int, target string, target_relative_path string, "
    "fragment string, origin string, field string, status string, start_line int, start_column int, end_line int, end_column int")


UNREAD_SCHEMA = "location_id string, generation bigint, relative_path string, message string"
SCHEMAS = {"documents": DOCUMENT_SCHEMA, "links": LINK_SCHEMA, "unread": UNREAD_SCHEMA}


def _shape(rows: DataFrame, schema: str) -> DataFrame:
    names = [field.split(" ")[0] for field in schema.replace("level:tinyint,text:string", "").split(", ")]
    return rows.select(*names)


def read_activity(spark: SparkSession, base: str) -> DataFrame:
    """Activity events of finished runs: location_id, relative_path, kind, at."""
    applied = tables._all_runs(spark, base).select("attempt").distinct()
    return spark.read.parquet(f"{base}/activity_events").join(applied, "attempt", "left_semi").drop("attempt")


def reconcile(spark: SparkSession, base: str, locations: DataFrame, brand: Brand = DEFAULT, batch_key: str | None = None) -> DataFrame:
    """Bring the tables under ``base`` up to date and return one status row per location.

    ``locations``: location_id, path, okf_bundle.  Unchanged files (same size
    and mtime) are never opened, and only changed rows are written.  Links of
    unchanged documents are looked at only where their target appeared or went.
    A file that cannot be decoded keeps its old row and makes the location
    ``degraded``.  The first run of a location is a full build and records no
    activity; that of later runs is in ``read_activity``.

    Nothing is visible before the run rows, which are written last.  A run that
    died can be repeated.  With a ``batch_key`` (query and batch id) a batch that
    has been applied is not applied again.
    """
    if batch_key is not None:
        done = tables.finished_batch(spark, base, batch_key)
        if not done.isEmpty():
            return done
    attempt = tables.attempt_name(batch_key)
    locations = checkpoints.cut(locations.select("location_id", "path", "okf_bundle"))
    here = locations.select("location_id").distinct()
    runs = tables.read_runs(spark, base)
    stored, stored_links, unread = (tables.read_table(spark, base, name, schema).join(here, "location_id", "left_semi") for name, schema in SCHEMAS.items())
    listing = checkpoints.stored(corpus.list_files(locations).where(f"error IS NULL AND size <= {ins.MAX_DOCUMENT_BYTES}"))
    changes = checkpoints.stored(hi.diff(stored, listing))
    keys = ["location_id", "relative_path"]
    todo = checkpoints.stored(listing.join(changes.where("change IN ('added', 'changed')").select(*keys), keys, "left_semi"))
    flags = sizes.small(locations.select("location_id", F.coalesce("okf_bundle", F.lit(False)).alias("okf_bundle")))
    # Files are read and inspected in one pass. Only what the tables keep is written, as compressed columns: later steps read the keys or the links alone.
    rows = ins.inspect(corpus.checked_text(corpus.read_contents(todo)).join(flags, "location_id"), brand).withColumn("stored_links", F.col("links"))
    seen = checkpoints.stored(ins.documents(rows, F.col("okf_bundle")).drop("okf_bundle", "path")).withColumnRenamed("stored_links", "links")
    failed = seen.where("message IS NOT NULL").select(*keys, "message")
    inspected = seen.where("message IS NULL").drop("message")
    fresh = hi.carry_ids(inspected.drop("links"), stored)
    removed = changes.where("change = 'removed'").select(*keys)
    touched = checkpoints.cut(inspected.select(*keys).union(removed))
    following = checkpoints.cut(here.join(runs.select("location_id", "active_generation"), "location_id", "left").select(
        "location_id", (F.coalesce("active_generation", F.lit(0)) + 1).alias("generation"), F.col("active_generation").isNull().alias("is_base")))
    number = following.select("location_id", "generation")
    tables.write_attempt(_shape(fresh.join(number, "location_id"), DOCUMENT_SCHEMA), touched.join(number, "location_id"), base, "documents", attempt)

    # Files that were listed before without a row, as they could not be read, are known link targets too.
    seen_unread = unread.select(*keys)
    came = changes.where("change = 'added'").select(*keys).join(seen_unread, keys, "left_anti")
    went = removed.union(seen_unread.join(listing, keys, "left_anti"))
    source = touched.withColumnRenamed("relative_path", "source_relative_path")
    kept_links = stored_links.drop("generation").join(source, ["location_id", "source_relative_path"], "left_anti")
    moved = checkpoints.cut(gr.refresh_affected(kept_links, came, went))
    own = gr.refresh_links(ins.links_table(inspected), listing)
    link_keys = source.union(moved.select("location_id", "source_relative_path").distinct())
    tables.write_attempt(_shape(own.unionByName(moved).join(number, "location_id"), LINK_SCHEMA), link_keys.join(number, "location_id"), base, "links", attempt)
    unread_keys = failed.select(*keys).union(seen_unread).distinct()
    tables.write_attempt(_shape(failed.join(number, "location_id"), UNREAD_SCHEMA), unread_keys.join(number, "location_id"), base, "unread", attempt)

    applied = changes.where("change <> 'unchanged'").join(failed, keys, "left_anti")
    kind = F.when(F.col("change") == "added", "created").otherwise(F.col("change"))
    applied.join(following.where("NOT is_base"), "location_id", "left_semi").select(
        "location_id", "relative_path", kind.alias("kind"), F.current_timestamp().alias("at")
    ).write.mode("overwrite").parquet(f"{base}/activity_events/attempt={attempt}")
    after = stored.select(*keys).join(touched, keys, "left_anti").union(inspected.select(*keys))
    status = fc.index_status(changes, after, failed).join(following, "location_id").select(
        "location_id", F.col("generation").alias("active_generation"), "state", "indexed", "failed",
        (F.col("changed") - F.col("failed")).alias("changed"), "removed", F.lit(True).alias("complete"),
        F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("finished_at"),
        F.lit(attempt).alias("attempt"), "is_base", F.lit(batch_key).cast("string").alias("batch_key"))
    status = checkpoints.cut(status)
    tables.finish_run(status, base)
    return status


def compact(spark: SparkSession, base: str, share: float = 0.25, most: int = 16) -> int:
    """New bases for the locations whose later attempts have grown; returns their number."""
    return tables.compact(spark, base, SCHEMAS, share, most)


def lint(locations: DataFrame, policy_lines: DataFrame | None = None, brand: Brand = DEFAULT):
    """(findings, bundles) of whole corpora: read failures, rule findings and broken links minus ignored paths."""
    from lorelake.operators import filters as fl

    listing = corpus.list_files(locations)
    paths = corpus.unreadable_findings(
        listing.where("error IS NOT NULL").select("location_id", "relative_path", F.col("error").alias("message")), "OKF_PATH_UNREADABLE")
    files = listing.where("error IS NULL")
    decoded, failed = corpus.decode_text(checkpoints.cut(corpus.read_contents(files)))
    inspected = checkpoints.cut(ins.inspect(decoded, brand))
    links = gr.resolve_links(ins.links_table(inspected), files)
    findings = ins.findings_table(inspected).unionByName(gr.broken_links(links)).unionByName(
        corpus.unreadable_findings(failed)).unionByName(paths)
    lines = policy_lines if policy_lines is not None else corpus.read_policy_lines(locations, brand=brand)
    ignored = fl.ignored_paths(listing.select("location_id", "relative_path"), fl.compile_policy(lines))
    findings = fl.findings_scope(findings, ignored)
    n_ignored = ignored.groupBy("location_id").agg(F.count("*").alias("ignored_documents"))
    n_files = files.groupBy("location_id").agg(F.count("*").alias("n_files"))
    bundles = locations.select("location_id", "name").join(n_files, "location_id", "left").join(n_ignored, "location_id", "left").join(
        fc.detect_bundles(inspected).select("location_id", "declared_version", "detected"), "location_id", "left").fillna(
        0, ["n_files", "ignored_documents"]).withColumn("documents", F.col("n_files") - F.col("ignored_documents"))
    return findings, bundles

"""Registered queries: every operator over the driver tables.

Array results are joined to text and scores rounded, so that both engines
compare equal values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelake import checkpoints
from lorelake.brand import DEFAULT
from lorelake.functions import text as tx
from lorelake.operators import facets as fc
from lorelake.operators import filters as fl
from lorelake.operators import graph as gr
from lorelake.operators import history as hi
from lorelake.operators import inspect as ins
from lorelake.operators import listing as li
from lorelake.operators import packs as pk
from lorelake.operators import report as rp
from lorelake.operators import review as rv
from lorelake.operators import search as se
from lorelake.operators import sync
from lorelake.sources import adapters as ad
from lorelake.sources import corpus
from lorelake.sources import tables as tb
from lorelake.sources.search_index import SearchIndex
from lorelake.streaming import streams as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF = ad.AS_OF


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def _joined(column: str) -> F.Column:
    return F.array_join(column, "|").alias(column)


def _inspected(spark: SparkSession, sf: str) -> DataFrame:
    return ins.inspect(ad.bundle_files(spark, sf))


def _links(inspected: DataFrame) -> DataFrame:
    return gr.resolve_links(ins.links_table(inspected), inspected.select("location_id", "relative_path"))


def _docs(inspected: DataFrame) -> DataFrame:
    return ins.documents(inspected).withColumn("generation", F.lit(1).cast("long"))


def _stored(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The inspected corpus written once, for queries that read it several times; only the named columns beside the keys."""
    inspected = _inspected(spark, sf)
    return checkpoints.cut(inspected.select("location_id", "relative_path", *columns) if columns else inspected)


def _stored_docs(spark: SparkSession, sf: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The named columns of the document table and the resolved links, from rows that are written once."""
    docs = _docs(_inspected(spark, sf).withColumn("stored_links", F.col("links")))
    stored = checkpoints.cut(docs.select("location_id", "relative_path", *columns, F.col("stored_links").alias("links")))
    return stored.drop("links"), _links(stored)


# -- search ----------------------------------------------------------------


@query
def search_federated(spark, sf):
    found = se.search(ad.corpus_docs(spark, sf), ad.search_queries(spark, sf), AS_OF)
    return found.select(
        "query_id", "location_id", "relative_path", "rank", "position", F.round("rank_score", 6).alias("rank_score"),
        F.round("score", 4).alias("score"), "title", "role", "freshness", "snippet", _joined("matched_fields"), "match_reason")


@query
def search_candidates(spark, sf):
    found = se.candidates(ad.corpus_docs(spark, sf), ad.search_queries(spark, sf), AS_OF)
    return found.select(
        "query_id", "location_id", "relative_path", "candidate_rank", F.round("weighted_score", 4).alias("weighted_score"),
        F.round("s_title", 4).alias("s_title"), F.round("s_body", 4).alias("s_body"), F.round("s_headings", 4).alias("s_headings"))


@query
def search_stored_index(spark, sf):
    """The same from a kept index: other titles and copies first, then a refresh that mends and removes them."""
    docs = ad.corpus_docs(spark, sf)
    index = SearchIndex(spark, checkpoints.folder(spark), buckets=64)
    copies = docs.withColumn("relative_path", F.concat(F.lit("copies/"), F.col("relative_path")))
    index.refresh(docs.withColumn("title", F.concat(F.lit("old "), F.col("title"))).unionByName(copies))
    index.refresh(docs, copies)
    found = se.candidates(docs, ad.search_queries(spark, sf), AS_OF, index=index)
    return found.select(
        "query_id", "location_id", "relative_path", "candidate_rank", F.round("weighted_score", 4).alias("weighted_score"),
        F.round("s_title", 4).alias("s_title"), F.round("s_body", 4).alias("s_body"), F.round("s_headings", 4).alias("s_headings"))


@query
def search_candidates_any_term(spark, sf):
    found = se.candidates(ad.corpus_docs(spark, sf), ad.search_queries(spark, sf), AS_OF, mode="or")
    return found.select("query_id", "location_id", "relative_path", "candidate_rank",
                        F.round("weighted_score", 4).alias("weighted_score"))


@query
def search_filtered(spark, sf):
    """Every query with type, tag, status, trust, freshness, path and findings filters of its own."""
    q = ad.search_queries(spark, sf).selectExpr(
        "query_id", "query",
        "CASE WHEN query_id % 4 = 0 THEN array('Type src1', 'Type src2', 'Type src3', 'Type src4') ELSE cast(array() AS array<string>) END AS f_types",
        "CASE WHEN query_id % 4 = 1 THEN array('t1', 't2', 't3') ELSE cast(array() AS array<string>) END AS f_tags",
        "CASE WHEN query_id % 3 = 0 THEN array('concept', 'log') END AS f_roles",
        "CASE WHEN query_id % 4 = 2 THEN array('stable', 'draft') END AS f_statuses",
        "CASE WHEN query_id % 5 = 0 THEN array('humanReviewed', 'unverified') END AS f_trust",
        "CASE WHEN query_id % 4 = 3 THEN array('stale', 'unspecified') END AS f_freshness",
        "CASE WHEN query_id % 6 = 5 THEN 'src1/' END AS f_path_prefix",
        "CASE query_id % 3 WHEN 1 THEN 'with' WHEN 2 THEN 'without' ELSE 'any' END AS f_findings",
        "cast(query_id % 30 + 1 AS int) AS limit")
    found = se.candidates(ad.corpus_docs(spark, sf), q, AS_OF)
    return found.select("query_id", "location_id", "relative_path", "candidate_rank",
                        F.round("weighted_score", 4).alias("weighted_score"))


@query
def search_phrase(spark, sf):
    """Quoted first words of every benchmark text: phrase tokens select, containment filters."""
    q = ad.search_queries(spark, sf).withColumn("query", F.concat(F.lit('"'), "query", F.lit('"')))
    found = se.search(ad.corpus_docs(spark, sf), q, AS_OF)
    return found.select("query_id", "location_id", "relative_path", "rank", F.round("score", 4).alias("score"),
                        _joined("matched_fields"), "match_reason")


@query
def search_simple(spark, sf):
    docs = ins.search_projection(ad.corpus_docs(spark, sf))
    return se.search_simple(docs, ad.search_queries(spark, sf), 20).select(
        "query_id", "location_id", "relative_path", "rank", F.round("score", 4).alias("score"))


@query
def search_lexical(spark, sf):
    return se.search_lexical(ad.corpus_docs(spark, sf), ad.search_queries(spark, sf), AS_OF).select(
        "query_id", "location_id", "relative_path", "rank", F.round("score", 4).alias("score"), _joined("matched_fields"), "match_reason")


@query
def search_field_coverage(spark, sf):
    return se.field_coverage(ad.corpus_docs(spark, sf), ad.search_queries(spark, sf))


@query
def search_unavailable(spark, sf):
    """Locations n0–n24 requested in fives; only even ones have an active generation."""
    nations = ad.table(spark, sf, "nation")
    requests = nations.groupBy((F.col("n_nationkey") % 5).alias("query_id")).agg(
        F.collect_list(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("location_ids"))
    runs = nations.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("location_id"))
    return se.unavailable(requests, runs)


@query
def postings_by_term(spark, sf):
    return se.postings(ad.corpus_docs(spark, sf)).groupBy("location_id", "field", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def field_statistics(spark, sf):
    return se.field_stats(ad.corpus_docs(spark, sf)).withColumn("avg_dl", F.round("avg_dl", 4))


@query
def analyze_tokens(spark, sf):
    tokens = tx.analyze(F.col("text"))
    return ad.table(spark, sf, "documents").select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_hash"),
        F.size(F.array_distinct(tokens)).alias("n_distinct"))


@query
def query_terms(spark, sf):
    return ad.table(spark, sf, "benchmark").select(
        "item_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"))


@query
def snippets(spark, sf):
    docs = ad.table(spark, sf, "documents")
    terms = tx.query_terms(F.element_at(F.split("text", " "), -1))
    return docs.select("doc_id", se.snippet(F.col("text"), F.lit(None).cast("string"), terms).alias("snippet"))


@query
def highlights(spark, sf):
    return ad.table(spark, sf, "documents").select(
        "doc_id", se.highlight(F.col("text"), F.lit('"the de" un (x')).alias("marked"))


# -- filters and requests --------------------------------------------------


@query
def filter_documents(spark, sf):
    return fl.filter_documents(
        ad.corpus_docs(spark, sf), types=["Type src1", "Type src2", "Type src3"], tags=["t1", "t2", "t5"], roles=["concept"],
        statuses=["stable", "draft", "deprecated"], findings="with").select("location_id", "relative_path", "type", "status")


@query
def filter_freshness(spark, sf):
    docs = fl.filter_documents(ad.corpus_docs(spark, sf), freshness=["stale"], findings="without", as_of=AS_OF)
    return docs.select("location_id", "relative_path", "stale_after", tx.freshness(F.col("stale_after"), AS_OF).alias("freshness"))


@query
def path_prefix_search(spark, sf):
    return fl.path_filter(ad.corpus_docs(spark, sf), "src1/", keep_slash=False).groupBy("location_id").agg(F.count("*").alias("n"))


@query
def path_prefix_listing(spark, sf):
    return fl.path_filter(ad.corpus_docs(spark, sf), "src1/", keep_slash=True).groupBy("location_id").agg(F.count("*").alias("n"))


@query
def quick_open(spark, sf):
    return fl.quick_open(ad.corpus_docs(spark, sf), " 42.MD").select("location_id", "relative_path")


@query
def filter_concepts(spark, sf):
    concepts = gr.concept_projection(_inspected(spark, sf))
    return fl.filter_concepts(concepts, ["ECONOMY", "PROMO"], "size7").select("location_id", "id", "type")


@query
def findings_scope_policy(spark, sf):
    findings = ad.findings_in(spark, sf)
    ignored = findings.where("relative_path LIKE '%7.md'").select(
        "location_id", F.translate("relative_path", "\\", "/").alias("relative_path"))
    return fl.findings_scope(findings, ignored).select("location_id", "relative_path", "code")


@query
def filter_findings(spark, sf):
    return fl.filter_findings(ad.findings_in(spark, sf), "error", " DOCS\\1 ").select("location_id", "relative_path", "code", "severity")


@query
def filter_history(spark, sf):
    return fl.filter_history(ad.history_events(spark, sf), "renamed").select("event_id", "location_id", "path")


@query
def ignored_paths(spark, sf):
    """Glob policies per language with negation, directory, basename and anchored rules."""
    lines = ad.table(spark, sf, "documents").select(F.col("lang").alias("location_id")).distinct().select(
        "location_id", F.posexplode(F.array(*[F.lit(v) for v in (
            "# rules", "", "src1/", "!src1/*0.md", "*7.md", "/src2/0000000?.md", "src[34]/**", "!**/src3/*[!0-4].md")])).alias("line_no", "line"))
    return fl.ignored_paths(ad.corpus_docs(spark, sf).select("location_id", "relative_path"), fl.compile_policy(lines))


@query
def pruned_directories(spark, sf):
    """Page paths as files: ignored directory names dropped at any depth."""
    files = ad.page_links(spark, sf).select(
        "page_id", "position",
        F.concat(F.element_at(F.array(F.lit("a"), F.lit("Build"), F.lit("x/pods"), F.lit("out.d")), (F.col("position") % 4 + 1).cast("int")),
                 F.lit("/"), F.regexp_replace("target", "^/+", ""), F.lit(".md")).alias("relative_path"))
    return fl.prune_ignored(files)


@query
def allowed_locations(spark, sf):
    requests = ad.corpus_docs(spark, sf).select("location_id", "relative_path")
    allow = ad.table(spark, sf, "documents").where("lang IN ('en', 'fr')").select(F.col("lang").alias("location_id"))
    return fl.allowed(requests, allow).groupBy("location_id", "error").agg(F.count("*").alias("n"))


@query
def validated_requests(spark, sf):
    requests = ad.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("turn") == 3, F.array().cast("array<string>")).when(F.col("turn") == 2, F.array(F.lit("bad id")))
        .otherwise(F.array("role")).alias("location_ids"),
        F.col("text").alias("query"), F.when(F.col("conv_id") % 7 == 0, "some").otherwise("with").alias("findings"),
        (F.col("conv_id") % 130).cast("int").alias("limit"), (F.col("turn") * 6).cast("int").alias("days"))
    return fl.validate_requests(requests).select(
        "conv_id", "turn", "error", "search_limit", "related_limit", "activity_days")


@query
def read_documents(spark, sf):
    refs = ad.pack_selection(spark, sf).select("location_id", F.concat(F.lit("./"), F.replace("relative_path", F.lit("/"), F.lit("//"))).alias("relative_path"))
    return fl.read_documents(refs, ad.pack_documents(spark, sf)).select("location_id", "relative_path", "title", "generation", "error")


@query
def active_generation(spark, sf):
    docs = ad.corpus_docs(spark, sf).withColumn("generation", F.length("title") % 3)
    runs = ad.table(spark, sf, "documents").groupBy(F.col("lang").alias("location_id")).agg(
        F.when(F.col("lang") != "es", F.length("lang") % 3 - 2).cast("int").alias("active_generation"))
    return fl.active(docs, runs).select("location_id", "relative_path", "generation")


@query
def active_filter_count(spark, sf):
    rows = ad.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("f_types"), F.array("lang", "source").alias("f_tags"),
        F.array().cast("array<string>").alias("f_roles"), F.lit(None).cast("array<string>").alias("f_statuses"),
        F.lit(None).cast("array<string>").alias("f_trust"), F.lit(None).cast("array<string>").alias("f_freshness"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise("source").alias("f_path_prefix"),
        F.when(F.col("doc_id") % 5 == 0, "with").otherwise("any").alias("f_findings"))
    return rows.select("doc_id", fl.active_filter_count(rows).cast("int").alias("n"))


# -- inspection ------------------------------------------------------------


@query
def split_front_matter(spark, sf):
    docs = ins.visible_body(ins.split_front_matter(ad.concept_files(spark, sf)))
    return docs.select("location_id", "relative_path", "front_state", F.md5("yaml").alias("yaml_hash"), F.md5("body").alias("body_hash"),
                       "body_offset")


def _document_rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        "location_id", "relative_path", "kind", "title", "description", "type", _joined("tags"), "headings_text", "metadata_text",
        "status", "trust_tier", "stale_after", "timestamp", "finding_count", "is_conformant")


@query
def inspected_documents(spark, sf):
    return _document_rows(_docs(_inspected(spark, sf)))


@query
def inspected_links(spark, sf):
    return _links(_stored(spark, sf, "links")).select(
        "location_id", "source_relative_path", "position", "target", "target_relative_path", "fragment", "origin", "field", "status",
        "start_line", "start_column", "end_line", "end_column")


@query
def wrapped_links(spark, sf):
    """Links over two lines between code spans over two lines and indented code."""
    return ins.links_table(ins.inspect(ad.wrapped_files(spark, sf))).select(
        "location_id", "source_relative_path", "position", "target", "target_relative_path", "status",
        "start_line", "start_column", "end_line", "end_column")


@query
def document_findings(spark, sf):
    return ins.findings_table(_inspected(spark, sf)).select(
        "location_id", "relative_path", "code", "severity", "message", "tier", "start_line")


@query
def bundle_findings(spark, sf):
    """Rule findings plus broken links (bag union), policy order attached as text keys."""
    inspected = _stored(spark, sf, "links", "findings")
    broken = gr.broken_links(_links(inspected))
    return ins.findings_table(inspected).unionByName(broken).groupBy("location_id", "code", "severity", "tier").agg(F.count("*").alias("n"))


@query
def concepts(spark, sf):
    return gr.concept_projection(_inspected(spark, sf)).select("location_id", "id", "type", "title", _joined("tags"), "timestamp")


@query
def document_kinds(spark, sf):
    pages = ad.page_links(spark, sf).select(
        "page_id", "position", F.concat("target", F.element_at(F.array(
            F.lit("\\Index.md"), F.lit("/LOG.markdown"), F.lit("/index.mdx"), F.lit("/log.md")), (F.col("position") % 4 + 1).cast("int"))).alias("path"))
    return pages.select("page_id", "position", ins.document_kind(F.col("path")).alias("kind"))


@query
def search_text_projection(spark, sf):
    return ins.search_projection(ad.corpus_docs(spark, sf)).select("location_id", "relative_path", F.md5("search_text").alias("search_text_hash"))


@query
def content_hashes(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


@query
def source_positions(spark, sf):
    """Offsets anywhere in the text, its end included."""
    line, column = ins.source_position(F.col("text"), F.expr("cast(pmod(doc_id * 7919, length(text) + 1) AS int)"))
    return ad.table(spark, sf, "documents").select("doc_id", line.alias("line"), column.alias("column"))


@query
def log_entries(spark, sf):
    return rp.log_entries(ad.log_documents(spark, sf)).select("location_id", "relative_path", "scope", "date", "summary")


@query
def recent_logs(spark, sf):
    return rp.recent_logs(rp.log_entries(ad.log_documents(spark, sf))).select("location_id", "rank", "relative_path", "date", "summary")


@query
def review_comments(spark, sf):
    return rv.review_comments(ad.concept_files(spark, sf)).select(
        "location_id", "relative_path", "position", "id", "quote", "comment", "created_at", "error")


@query
def review_handoff(spark, sf):
    return rv.review_handoff(rv.review_comments(ad.concept_files(spark, sf)))


def _quotes(spark, sf):
    """One word from anywhere in each document, approximately placed anywhere."""
    docs = ad.table(spark, sf, "documents").selectExpr(
        "lang AS location_id", "concat('d', cast(doc_id AS string)) AS relative_path", "doc_id", "text AS body")
    words = F.split(tx.collapse_ws(F.col("body")), " ")
    word = F.get(words, F.pmod(F.col("doc_id") * 31, F.size(words)).cast("int"))
    return docs, docs.select("location_id", "relative_path", "doc_id", word.alias("quote"),
                             F.expr("cast(pmod(doc_id * 7919, length(body) + 1) AS int)").alias("approximate_start")).where("quote <> ''")


@query
def create_anchors(spark, sf):
    docs, quotes = _quotes(spark, sf)
    return rv.create_anchors(quotes, docs).select("doc_id", "quote", "start", "end", "prefix", "suffix")


@query
def resolve_anchors(spark, sf):
    docs, quotes = _quotes(spark, sf)
    made = rv.create_anchors(quotes, docs).withColumn("anchor", F.struct("start", "end", "prefix", "suffix")).drop("start", "end", "prefix", "suffix")
    moved = docs.withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.col("body"))
                            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Preface text. "), "body"))
                            .otherwise(F.concat(F.lit("Preface text. "), F.substring("body", 60, 1 << 30))))
    return rv.resolve_anchors(made, moved).select("doc_id", "start", "end", "rule")


# -- facets and reports ----------------------------------------------------


@query
def search_facets(spark, sf):
    return fc.facets(ad.corpus_docs(spark, sf), AS_OF)


@query
def concept_facets(spark, sf):
    return fc.concept_facets(gr.concept_projection(_inspected(spark, sf)))


@query
def visible_tags(spark, sf):
    return fc.visible_tags(fc.concept_facets(gr.concept_projection(_inspected(spark, sf))), "size50").select(
        "location_id", "value", "count", "rank")


@query
def link_health(spark, sf):
    return fc.link_health(_links(_stored(spark, sf, "links")))


@query
def lint_summary(spark, sf):
    return fc.lint_summary(ad.findings_in(spark, sf), "warning")


@query
def grouped_findings(spark, sf):
    return fc.group_findings(ad.findings_in(spark, sf))


@query
def detected_bundles(spark, sf):
    modes = ad.bundle_files(spark, sf).select("location_id").distinct().select(
        "location_id", F.when(F.col("location_id") == "b1", "manual").when(F.col("location_id") == "b2", "disabled").otherwise("auto").alias("okf_mode"),
        F.lit(True).alias("okf_bundle"))
    return fc.detect_bundles(_inspected(spark, sf), modes).select("location_id", "declared_version", "document_count", "detected", "enabled")


@query
def finding_count_per_document(spark, sf):
    files = ad.table(spark, sf, "documents").selectExpr(
        "concat('f', cast(doc_id % 3 AS string)) AS location_id",
        "concat(CASE WHEN doc_id % 4 = 0 THEN 'Docs' ELSE 'docs' END, '\\\\', cast(doc_id AS string), '.md') AS relative_path")
    return fc.finding_counts(files, ad.findings_in(spark, sf))


@query
def storage_sizes(spark, sf):
    return fc.storage_size(ad.corpus_docs(spark, sf))


@query
def location_list(spark, sf):
    where = ad.locations(spark, sf)
    status = fc.storage_size(ad.corpus_docs(spark, sf)).select(
        F.when(F.col("location_id") == "en", "n4").when(F.col("location_id") == "fr", "n8").otherwise("n9").alias("location_id"),
        F.lit("ready").alias("state"), F.col("documents").alias("indexed")).dropDuplicates(["location_id"])
    allow = where.where("okf_bundle")
    return fc.list_locations(where, status, allow).select("location_id", "name", "state", F.col("searchable"))


@query
def changed_signatures(spark, sf):
    before, after = (fc.location_signature(ad.snapshot(spark, sf, side)) for side in ("before", "after"))
    return fc.changed_locations(before, after)


@query
def index_status(spark, sf):
    changes = hi.diff(ad.snapshot(spark, sf, "before"), ad.snapshot(spark, sf, "after"))
    failed = ad.snapshot(spark, sf, "after").where("location_id = 's1' AND size % 1000 = 7").select("location_id", "relative_path")
    return fc.index_status(changes, ad.snapshot(spark, sf, "after"), failed)


@query
def activity_daily(spark, sf):
    daily = rp.activity_daily(ad.activity_events(spark, sf))
    return daily.withColumns({c: tx.rfc3339(F.col(c)) for c in ("last_changed_at", "last_served_at")})


@query
def activity_top(spark, sf):
    return rp.activity_top(rp.activity_daily(ad.activity_events(spark, sf)), "2024-01-20", 15, 20, "doc-1").select(
        "location_id", "relative_path", *[f"{k}_count" for k in rp.KINDS], "total", "rank")


@query
def activity_expired(spark, sf):
    return rp.expire_activity(rp.activity_daily(ad.activity_events(spark, sf)), "2024-01-25").select(
        "location_id", "day", "relative_path", "changed_count")


@query
def activity_from_outputs(spark, sf):
    refs = ad.pack_selection(spark, sf).select("location_id", "relative_path")
    at = F.to_timestamp(F.lit("2024-01-31 10:00:00"))
    reads = rp.activity_from_reads(fl.read_documents(refs, ad.pack_documents(spark, sf)), at)
    return rp.activity_daily(reads).select("location_id", "day", "relative_path", "served_count", "context_count")


@query
def location_overview(spark, sf):
    docs, links = _stored_docs(
        spark, sf, "kind", "type", "tags", "status", "trust_tier", "stale_after", "finding_count")
    daily = rp.activity_daily(ad.activity_events(spark, sf).withColumn("location_id", F.translate("location_id", "u", "b")))
    logs = ad.log_documents(spark, sf).withColumn("location_id", F.translate("location_id", "c", "b"))
    return rp.overview(docs, links, daily, logs, "2024-01-20")


@query
def lint_annotations(spark, sf):
    return rp.lint_annotations(ad.findings_in(spark, sf), "kb").select("location_id", "relative_path", "annotation", "row")


def _bundles(spark, sf):
    return ad.findings_in(spark, sf).groupBy("location_id").agg(F.count("*").alias("documents")).select(
        "location_id", F.concat(F.lit("Bundle "), "location_id").alias("name"), F.lit(None).cast("string").alias("declared_version"),
        "documents", (F.col("documents") % 2).alias("ignored_documents"))


@query
def lint_report(spark, sf):
    findings = ad.findings_in(spark, sf).withColumn("tier", ins.finding_tier(F.col("code")))
    return rp.lint_report(findings, _bundles(spark, sf), limit=30).select(
        "location_id", "errors", "warnings", "info", "failed", "truncated", "text")


@query
def job_summary_head(spark, sf):
    findings = ad.findings_in(spark, sf).withColumn("tier", ins.finding_tier(F.col("code")))
    report = rp.lint_report(findings, _bundles(spark, sf), limit=30)
    return rp.job_summary_head(report.join(_bundles(spark, sf).select("location_id", "documents"), "location_id"))


@query
def health_handoff(spark, sf):
    return rp.health_handoff(ad.findings_in(spark, sf), _bundles(spark, sf)).select("location_id", "block", "code", "relative_path", "text")


@query
def exported_references(spark, sf):
    chosen = ad.pack_selection(spark, sf).select(
        F.col("pack_id").alias("selection_id"), "pos", F.when(F.col("location_id") == "user", "n1").otherwise(F.col("location_id")).alias("location_id"),
        "relative_path", F.concat(F.lit("Turn "), F.col("pos").cast("string")).alias("title"), F.lit("Body Match").alias("reason"))
    return rp.export_references(chosen, ad.locations(spark, sf))


# -- graph -----------------------------------------------------------------


@query
def related_documents(spark, sf):
    docs, links = _stored_docs(spark, sf, "kind", "title", "type", "tags", "generation")
    top, _ = gr.related(links, docs, docs, 3)
    return top.select("location_id", "relative_path", "other", "direction", "reason", "fragment", "rank")


@query
def related_counts(spark, sf):
    docs, links = _stored_docs(spark, sf, "kind", "title", "type", "tags", "generation")
    return gr.related(links, docs, docs, 3)[1]


@query
def backlinks(spark, sf):
    docs, links = _stored_docs(spark, sf, "title")
    return gr.backlinks(links, docs, docs)


def _edges(stored: DataFrame) -> DataFrame:
    return gr.concept_edges(_links(stored), gr.concept_projection(stored))


@query
def concept_edges(spark, sf):
    return _edges(_stored(spark, sf, "kind", "meta", "links"))


@query
def undirected_edges(spark, sf):
    return gr.undirected_edges(_edges(_stored(spark, sf, "kind", "meta", "links")))


def _ranked_concepts(spark, sf):
    stored = _stored(spark, sf, "kind", "meta", "links")
    return gr.degrees(_edges(stored), gr.concept_projection(stored).select("location_id", "relative_path"))


@query
def concept_degrees(spark, sf):
    return _ranked_concepts(spark, sf)


@query
def top_concepts(spark, sf):
    return gr.top_concepts(_ranked_concepts(spark, sf))[0]


@query
def hidden_concepts(spark, sf):
    return gr.top_concepts(_ranked_concepts(spark, sf))[1]


@query
def refreshed_links(spark, sf):
    """After dropping one target in seven every link is resolved again."""
    links = _links(_stored(spark, sf))
    left = ad.concept_files(spark, sf).where("part_key % 7 <> 3")
    return gr.refresh_links(links, left).groupBy("location_id", "origin", "status").agg(F.count("*").alias("n"))


@query
def refreshed_links_delta(spark, sf):
    """The same change, with only the links looked at whose target went; all other links stay as they are."""
    stored = _stored(spark, sf)
    links = _links(stored)
    files = ad.concept_files(spark, sf)
    went = files.where("part_key % 7 = 3")
    # Root indexes are no concept files; the first listing does not have them either.
    root = stored.where("relative_path = 'index.md'").select("location_id", "relative_path")
    again = gr.refresh_affected(links, files.limit(0), went.select("location_id", "relative_path").union(root))
    rest = links.join(again.select("location_id", "source_relative_path").distinct(), ["location_id", "source_relative_path"], "left_anti")
    return rest.unionByName(again).groupBy("location_id", "origin", "status").agg(F.count("*").alias("n"))


@query
def resolved_targets(spark, sf):
    """Page links resolved lexically against a nested source document."""
    links = ad.page_links(spark, sf).withColumn(
        "link", F.concat(F.element_at(F.array(F.lit(""), F.lit(".."), F.lit("../../.."), F.lit("./a%20b/..")), (F.col("position") % 4 + 1).cast("int")), "target"))
    staged = links.withColumn("r", ins.resolve_target(F.col("link"), F.lit("kb/notes/page.md"), F.lit("/data/site")))
    return staged.select("page_id", "position", "link", "r.fragment", "r.target_relative_path", "r.status")


@query
def assigned_locations(spark, sf):
    paths = ad.page_links(spark, sf).select(F.concat("target", F.lit("/x"), (F.col("page_id") % 25).cast("string"), F.lit("/f.md")).alias("path"))
    return gr.assign_location(paths, ad.locations(spark, sf))


# -- history ---------------------------------------------------------------


@query
def snapshot_diff(spark, sf):
    return hi.diff(ad.snapshot(spark, sf, "before"), ad.snapshot(spark, sf, "after")).select(
        "location_id", "relative_path", "change", "size", "modified_at_ms")


@query
def removed_paths(spark, sf):
    return hi.removed_paths(ad.snapshot(spark, sf, "before"), ad.snapshot(spark, sf, "after"))


@query
def touched_sources(spark, sf):
    changes = hi.diff(ad.snapshot(spark, sf, "before"), ad.snapshot(spark, sf, "after"))
    return hi.touched_sources(changes.where("change IN ('added', 'changed')"), changes.where("change = 'removed'"))


@query
def carried_ids(spark, sf):
    old = ad.snapshot(spark, sf, "before").withColumn("continuity_id", F.concat(F.lit("id-"), "relative_path"))
    return hi.carry_ids(ad.snapshot(spark, sf, "after"), old).select("location_id", "relative_path", "continuity_id")


def _moved(spark, sf):
    """orders → changes: every order leaves, arrives or changes in its place, by its key."""
    return ad.table(spark, sf, "orders").selectExpr(
        "concat('s', cast(o_custkey % 4 AS string)) AS location_id", "concat('o', lpad(cast(o_orderkey AS string), 9, '0'), '.md') AS relative_path",
        "CASE o_orderkey % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'changed' END AS change",
        "cast(o_custkey % 50 AS bigint) AS size", "1700000000000 + o_orderkey DIV 1000 * 1000000 + o_orderkey % 1000 AS modified_at_ms")


@query
def matched_renames(spark, sf):
    """Bulk moves: every chain is shorter than the window, so rank meets rank; changed files never match."""
    return hi.match_renames(_moved(spark, sf))


@query
def matched_renames_long_chains(spark, sf):
    """Long chains over all orders: mtimes 7 ms a key apart, first fit inside ±2,500 ms."""
    moved = _moved(spark, sf).withColumn("modified_at_ms", F.expr("1700000000000 + cast(substr(relative_path, 2, 9) AS bigint) * 7"))
    return hi.match_renames(moved)


@query
def change_events(spark, sf):
    """Renamed, created, removed and modified files."""
    changes = _moved(spark, sf)
    return hi.change_events(changes, hi.match_renames(changes), 1700000000000).select(
        "location_id", "path", "previous_path", "kind", "observed_at", "available")


@query
def file_identity(spark, sf):
    return hi.file_identity(ad.history_events(spark, sf)).select(
        "location_id", "path", F.replace("identity", F.lit("\x00"), F.lit("/")).alias("identity")).distinct()


@query
def deduped_history(spark, sf):
    return hi.dedupe_history(ad.history_events(spark, sf)).select("event_id", "location_id", "path", "kind", "observed_at")


@query
def capped_history(spark, sf):
    return hi.cap_history(ad.history_events(spark, sf), 1706745600000, 20, 700).select("event_id", "observed_at")


@query
def recent_searches(spark, sf):
    searches = ad.table(spark, sf, "events").select(
        F.col("user_id"), F.col("event_id").alias("search_id"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("query"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("location_ids"),
        (F.col("event_id") % 7).cast("string").alias("filters"), F.col("event_id").alias("searched_at"))
    return hi.recent_searches(searches).select("user_id", "search_id", "query", "filters", "rank")


# -- listing ---------------------------------------------------------------


def _list_requests(spark, sf):
    """One listing request per (language, source) with its own filters."""
    return ad.table(spark, sf, "documents").select("lang", "source").distinct().select(
        F.concat_ws("/", "lang", "source").alias("request_id"), F.col("lang").alias("location_id"), F.lit(1).cast("long").alias("generation"),
        F.lit(" concept ").alias("role"), F.lit(None).cast("string").alias("type"), F.lit("").alias("status"),
        F.array(F.lit(" t1"), F.lit("t1"), F.lit("t2"), F.lit("t4")).alias("tags"),
        F.concat("source", F.lit("/")).alias("path_prefix"), F.lit(2).alias("limit"), F.lit(None).cast("string").alias("cursor"))


@query
def listed_documents(spark, sf):
    page, _ = li.list_documents(ad.corpus_docs(spark, sf), _list_requests(spark, sf))
    return page.select("request_id", "location_id", "relative_path", "position")


@query
def listed_second_page(spark, sf):
    docs, requests = ad.corpus_docs(spark, sf), _list_requests(spark, sf)
    _, answers = li.list_documents(docs, requests)
    again = requests.drop("cursor").join(answers.where("next_cursor IS NOT NULL").select("request_id", F.col("next_cursor").alias("cursor")), "request_id")
    page, _ = li.list_documents(docs, again)
    return page.select("request_id", "location_id", "relative_path", "position")


@query
def rejected_cursors(spark, sf):
    docs, requests = ad.corpus_docs(spark, sf), _list_requests(spark, sf)
    _, answers = li.list_documents(docs, requests)
    again = requests.drop("cursor").join(answers.where("next_cursor IS NOT NULL").select("request_id", F.col("next_cursor").alias("cursor")), "request_id")
    changed = again.withColumn("role", F.when(F.endswith("request_id", F.lit("1")), "log").otherwise(F.col("role"))).withColumn(
        "generation", F.when(F.endswith("request_id", F.lit("2")), 2).otherwise(F.col("generation"))).withColumn(
        "cursor", F.when(F.endswith("request_id", F.lit("3")), "???").otherwise(F.col("cursor")))
    _, result = li.list_documents(docs, changed)
    return result.select("request_id", "error")


@query
def sorted_findings(spark, sf):
    return li.displayed_findings(ad.findings_in(spark, sf), 40).select("location_id", "position", "relative_path", "code", "severity")


@query
def distinct_tags(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", F.array_join(li.distinct_tags(
        F.array(F.concat(F.lit(" "), "source"), "lang", F.lit(" "), F.lit("en"), "source")), "|").alias("tags"))


# -- packs -----------------------------------------------------------------


def _packs(spark, sf):
    return ad.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("pack_id"),
        F.when(F.col("conv_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("topic "), F.col("conv_id").cast("string"))).alias("query"),
        (F.col("conv_id") % 5 * 400 + 500).cast("int").alias("max_characters"), (F.col("conv_id") % 4 + 1).cast("int").alias("max_documents"))


@query
def pack_selection(spark, sf):
    valid, _ = pk.valid_packs(_packs(spark, sf), ad.pack_selection(spark, sf))
    chosen = pk.pack_select(valid, ad.pack_selection(spark, sf), ad.pack_documents(spark, sf))
    return pk.budget_cut(chosen).select("pack_id", "pos", "location_id", "relative_path", "omission", "reason", "prefix_length", "available")


@query
def pack_omissions(spark, sf):
    return pk.build_packs(_packs(spark, sf), ad.pack_selection(spark, sf), ad.pack_documents(spark, sf))[1]


@query
def pack_totals(spark, sf):
    packs = pk.build_packs(_packs(spark, sf), ad.pack_selection(spark, sf), ad.pack_documents(spark, sf))[2]
    return packs.select("pack_id", "included", "omitted", (F.col("total_characters") <= F.col("max_characters")).alias("fits"))


@query
def pack_items(spark, sf):
    """Exact allocation of every item; the reclaim loop has no SQL twin."""
    items = pk.build_packs(_packs(spark, sf), ad.pack_selection(spark, sf), ad.pack_documents(spark, sf))[0]
    return items.select("pack_id", "pos", "relative_path", "characters", "truncated", F.md5("content").alias("content_hash"))


def _pack_lengths(spark, sf):
    return ad.table(spark, sf, "conversations").selectExpr(
        "concat('p', cast(conv_id AS string)) AS pack_id", "turn AS pos", "length(text) AS body_length",
        "cast(conv_id % 9 * 60 + 17 AS int) AS budget")


@query
def even_fill(spark, sf):
    return pk.even_fill(_pack_lengths(spark, sf), "budget").select("pack_id", "pos", "allocated")


@query
def proportional_split(spark, sf):
    rows = _pack_lengths(spark, sf).withColumn("allocated", F.least(F.col("body_length"), F.lit(10)))
    return pk.proportional_split(rows, "budget").select("pack_id", "pos", "allocated")


# -- scalar functions ------------------------------------------------------


@query
def folded_text(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded_hash"))


@query
def normalized_paths(spark, sf):
    raw = ad.page_links(spark, sf).withColumn("raw", F.concat(F.lit("./a\\"), "target", F.lit("//b/./"), F.when(F.col("position") % 2 == 0, F.lit("c\\")).otherwise(F.lit("c"))))
    return raw.select("page_id", "position", tx.norm_path(F.col("raw")).alias("path"), tx.norm_prefix(F.col("raw")).alias("prefix"),
                      tx.parent_path(F.col("raw")).alias("parent"), tx.basename(F.col("raw")).alias("base"))


@query
def path_identities(spark, sf):
    raw = ad.page_links(spark, sf).withColumn("raw", F.concat(F.element_at(F.array(
        F.lit("C:\\Docs"), F.lit("\\\\?\\C:\\Docs"), F.lit("\\\\?\\UNC\\Srv"), F.lit("/Home")), (F.col("position") % 4 + 1).cast("int")), "target", F.lit("/")))
    return raw.select("page_id", "position", tx.path_identity(F.col("raw")).alias("identity"), tx.parent_path(F.col("raw")).alias("parent"))


@query
def split_link_targets(spark, sf):
    raw = ad.table(spark, sf, "pages").select("page_id", F.col("url"))
    path, fragment = tx.split_target(F.col("url"))
    return raw.select("page_id", path.alias("path"), fragment.alias("fragment"), tx.has_scheme(F.col("url")).alias("external"))


@query
def decoded_paths(spark, sf):
    raw = ad.page_links(spark, sf).withColumn("raw", F.concat(F.lit("a+b%20c%"), F.replace("target", F.lit("e"), F.lit("%65")), F.lit("%zz")))
    return raw.select("page_id", "position", tx.percent_decode(F.col("raw")).alias("decoded"))


@query
def dot_folded_paths(spark, sf):
    raw = ad.page_links(spark, sf).withColumn("raw", F.concat(F.lit("/a/./b/.."), "target", F.lit("/../../z/..//q")))
    return raw.select("page_id", "position", tx.fold_dots(F.col("raw")).alias("folded"))


@query
def escaped_texts(spark, sf):
    text = F.concat("html", F.lit("|'\n"))
    return ad.table(spark, sf, "pages").select(
        "page_id", F.md5(tx.escape_xml(text)).alias("xml"), F.md5(tx.escape_xml_attribute(text)).alias("attribute"),
        F.md5(tx.escape_command(text)).alias("command"), F.md5(tx.escape_cell(text)).alias("cell"))


@query
def display_values(spark, sf):
    d = ad.corpus_docs(spark, sf)
    return d.select("location_id", "relative_path", tx.display_facet(F.col("trust_tier")).alias("label"),
                    tx.age_bucket(F.col("modified_at_ms"), F.lit(1700000900000)).alias("age"),
                    tx.counted(F.col("finding_count"), "finding", "findings").alias("counted"))


@query
def surrogate_keys(spark, sf):
    return ad.corpus_docs(spark, sf).select("location_id", "relative_path", tx.surrogate_key(
        F.col("location_id"), F.col("generation"), F.col("relative_path")).alias("key"))


@query
def cursor_round_trip(spark, sf):
    made = ad.corpus_docs(spark, sf).select("location_id", "relative_path", li.encode_cursor(
        F.col("location_id"), F.col("generation"), F.col("relative_path"), F.lit("h")).alias("cursor"))
    return made.select("location_id", "relative_path", "cursor", li.decode_cursor(F.col("cursor"))["after_relative_path"].alias("after"))


@query
def collapsed_text(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", F.md5(tx.collapse_ws(F.col("html"))).alias("collapsed_hash"))



# -- findings, generations -------------------------------------------------


@query
def merged_findings(spark, sf):
    """Two overlapping finding sets; the first one wins on equal code and message."""
    findings = ad.findings_in(spark, sf)
    return fc.merge_findings(
        findings.where("severity <> 'info'"), findings.withColumn("severity", F.lit("late"))).select("location_id", "code", "message", "severity")


@query
def dropped_generations(spark, sf):
    docs = ad.snapshot(spark, sf, "after").withColumn("generation", F.col("size") % 3)
    runs = docs.select("location_id").distinct().select("location_id", F.substring("location_id", 2, 1).cast("long").alias("active_generation"))
    return tb.drop_generations(docs, runs).select("location_id", "relative_path", "generation")


ORDER_ROW = "location_id string, generation bigint, relative_path string, size bigint, modified_at_ms bigint"


def _three_generations(spark, sf):
    """Listings of orders as three runs of one table; returns its folder.

    The first run writes all rows, the second what the snapshots differ in, the third takes
    away the keys that end in 4 and brings those back that the second had taken away.
    """
    base = checkpoints.folder(spark)
    before, after = ad.snapshot(spark, sf, "before"), ad.snapshot(spark, sf, "after")
    changes = checkpoints.cut(hi.diff(before, after).where("change <> 'unchanged'"))
    number = F.regexp_extract("relative_path", "[0-9]+", 0).cast("long")
    back = before.where(number % 10 == 2).withColumn("size", F.col("size") + 5)
    runs = [
        (before, before.limit(0)),
        (changes.where("change <> 'removed'"), changes.where("change = 'removed'")),
        (back, before.where(number % 10 == 4)),
    ]
    for generation, (rows, gone) in enumerate(runs, 1):
        number_of = F.lit(generation).cast("long").alias("generation")
        put = rows.select("location_id", number_of, "relative_path", "size", "modified_at_ms")
        keys = put.select("location_id", "relative_path", "generation").union(gone.select("location_id", "relative_path", number_of))
        attempt = tb.attempt_name(f"run {generation}")
        tb.write_attempt(put, keys, base, "listing", attempt)
        states = before.select("location_id").distinct().select(
            "location_id", F.lit(generation).alias("active_generation"), F.lit("ready").alias("state"),
            *[F.lit(0).alias(c) for c in ("indexed", "failed", "changed", "removed")], F.lit(True).alias("complete"), F.lit(None).alias("error"),
            F.current_timestamp().alias("finished_at"), F.lit(attempt).alias("attempt"), F.lit(generation == 1).alias("is_base"), F.lit(None).alias("batch_key"))
        tb.finish_run(states, base)
    # An attempt that wrote its rows and died is not seen.
    tb.write_attempt(put.withColumn("size", F.lit(0).cast("long")), keys, base, "listing", tb.attempt_name("died"))
    return base


@query
def merged_generations(spark, sf):
    """Rows of a table after three runs, each of which wrote only what it changed."""
    return tb.read_table(spark, _three_generations(spark, sf), "listing", ORDER_ROW)


@query
def compacted_generations(spark, sf):
    """The same rows from the one base that compaction wrote, and the number of attempts read."""
    base = _three_generations(spark, sf)
    tb.compact(spark, base, {"listing": ORDER_ROW}, share=0.01)
    attempts = tb.live_attempts(spark, base).select("attempt").distinct().count()
    return tb.read_table(spark, base, "listing", ORDER_ROW).withColumn("attempts", F.lit(attempts).cast("long"))


@query
def reconciled_documents(spark, sf):
    """Documents after two runs over files: the second finds new, changed and removed ones; a repeat of its batch does nothing."""
    files = ad.bundle_files(spark, sf)
    # A shared folder that is mounted is read as plain files.
    root, base = re.sub("^file:/+", "/", checkpoints.folder(spark)), checkpoints.folder(spark)
    key = F.coalesce("part_key", F.lit(0))
    older = files.where(key % 3 != 1).withColumn("content", F.when(key % 5 == 1, F.concat("content", F.lit("older text\n"))).otherwise(F.col("content")))
    extra = files.where(key % 8 == 3).withColumn("relative_path", F.concat(F.lit("gone/"), "relative_path"))
    corpus.write_files(older.unionByName(extra), root)
    where = files.select("location_id").distinct().select("location_id", F.concat(F.lit(f"{root}/"), "location_id").alias("path"), F.lit(True).alias("okf_bundle"))
    sync.reconcile(spark, base, where)
    corpus.write_files(files.where((key % 3 == 1) | (key % 5 == 1)), root)
    corpus.remove_files(extra, root)
    for _ in range(2):
        sync.reconcile(spark, base, where, batch_key="second")
    return _document_rows(tb.read_table(spark, base, "documents", sync.DOCUMENT_SCHEMA))


# -- streams ---------------------------------------------------------------


def _event_stream(spark, sf):
    """The events table as a file stream."""
    schema = ad.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _streamed(frame: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is available and read back what it wrote."""
    spark = frame.sparkSession
    base = checkpoints.folder(spark)
    writer = frame.writeStream.outputMode(mode).foreachBatch(st.batch_sink(f"{base}/rows"))
    st.await_all(writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/rows")


def _daily(spark, path, **limits):
    daily = st.read_activity(spark, path, **limits)
    return daily.withColumns({c: tx.rfc3339(F.col(c)) for c in ("last_changed_at", "last_served_at")})


@query
def streamed_activity(spark, sf):
    """Daily counters from the event stream, nothing expired."""
    base = checkpoints.folder(spark)
    st.await_all(st.run_activity(ad.as_activity(_event_stream(spark, sf)), f"{base}/daily", f"{base}/state", days=None))
    return _daily(spark, f"{base}/daily", days=None)


def _arrivals(spark, sf, schema, rows, start):
    """Append the rows, oldest quarter of the time first, to a log and run its stream to the end after each."""
    base = checkpoints.folder(spark)
    bounds = rows.agg(F.min("at_ms").alias("low"), F.max("at_ms").alias("high")).first()
    if bounds["low"] is None:
        return base
    quarter = F.floor((F.col("at_ms") - bounds["low"]) * 4 / (bounds["high"] - bounds["low"] + 1))
    for number in range(4):
        rows.where(quarter == number).drop("at_ms").write.mode("append").parquet(f"{base}/log")
        st.await_all(start(st.read_changes(spark, f"{base}/log", schema), f"{base}/table", f"{base}/state"))
    return base


@query
def streamed_activity_retained(spark, sf):
    """Daily counters of the newest fifteen days: four arrivals, two of them write a base and expire old days."""
    rows = ad.activity_events(spark, sf).withColumn("at_ms", F.unix_millis("at"))
    base = _arrivals(spark, sf, st.ACTIVITY, rows, lambda *a: st.run_activity(*a, every=2))
    return _daily(spark, f"{base}/table")


@query
def streamed_history_retained(spark, sf):
    """Newest 5,000 files changed in the last twenty days: four arrivals, two of them write a base."""
    rows = ad.history_events(spark, sf).withColumn("at_ms", F.col("observed_at"))
    base = _arrivals(spark, sf, st.EVENT, rows, lambda *a: st.run_history(*a, days=20, every=2))
    return st.read_history(spark, f"{base}/table", days=20).select("event_id", "location_id", "path", "kind", "observed_at")


@query
def streamed_bursts(spark, sf):
    """Quiet-period sessions of ten minutes per location; a heartbeat after the last event closes open ones."""
    changes = ad.as_activity(_event_stream(spark, sf)).select(
        "location_id", F.when(F.col("kind") == "removed", f"kb/{DEFAULT.ignore_file}").otherwise("kb/a.md").alias("path"), "at")
    log = checkpoints.folder(spark)
    last = ad.activity_events(spark, sf).agg(F.max("at").alias("at"))
    st.append_heartbeat(last.select((F.col("at") + F.expr("INTERVAL 2 DAYS")).alias("at")), log)
    beating = changes.unionByName(st.read_changes(spark, log))
    return _streamed(st.coalesce_changes(st.with_bounds(beating), "10 minutes"), "append").select(
        "location_id", tx.rfc3339(F.col("started_at")).alias("started_at"), "changes", "force")


@query
def streamed_throttle(spark, sf):
    """Run requests at least one hour apart per location."""
    requests = ad.as_activity(_event_stream(spark, sf)).select("location_id", F.unix_millis("at").alias("at_ms"))
    return _streamed(st.throttle_runs(requests, 3_600_000), "append").where("applied").select("location_id", "at_ms")


@query
def streamed_history(spark, sf):
    base = checkpoints.folder(spark)
    st.await_all(st.run_history(ad.as_history(_event_stream(spark, sf)), f"{base}/latest", f"{base}/state", days=None, cap=None))
    return st.read_history(spark, f"{base}/latest", days=None, cap=None).select("event_id", "location_id", "path", "kind", "observed_at")

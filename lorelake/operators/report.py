"""Activity, logs, overviews and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorelake.brand import DEFAULT, Brand
from lorelake.functions import text as tx
from lorelake.operators import facets as fc
from lorelake.operators.filters import _normal_prefix
from lorelake.operators.listing import displayed_findings

KINDS = ["changed", "served", "context", "created", "removed"]
ACTIVITY_DAYS = 14  # days kept before the newest one


def activity_daily(events: DataFrame) -> DataFrame:
    """Counters per (location, day, path) with the last change and read instants."""
    kind = F.col("kind")
    return events.where(kind.isin(KINDS)).groupBy("location_id", tx.day_text(F.col("at")).alias("day"), "relative_path").agg(
        *[F.count_if(kind == k).alias(f"{k}_count") for k in KINDS],
        F.max(F.when(kind.isin("changed", "created", "removed"), F.col("at"))).alias("last_changed_at"),
        F.max(F.when(kind.isin("served", "context"), F.col("at"))).alias("last_served_at"))


def merge_activity(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add new daily rows to stored ones."""
    return summed_activity(stored.unionByName(fresh))


def summed_activity(rows: DataFrame) -> DataFrame:
    """One row per (location, day, path) from partial counters."""
    return rows.groupBy("location_id", "day", "relative_path").agg(
        *[F.sum(f"{k}_count").alias(f"{k}_count") for k in KINDS],
        F.max("last_changed_at").alias("last_changed_at"), F.max("last_served_at").alias("last_served_at"))


def expire_activity(daily: DataFrame, as_of: str, days: int = ACTIVITY_DAYS) -> DataFrame:
    return daily.where(F.col("day") >= tx.days_before(as_of, days))


def activity_top(daily: DataFrame, as_of: str, days: int = 15, limit: int = 20, path_prefix: str = "") -> DataFrame:
    """Most active documents per location inside the window."""
    days, limit = max(1, min(days, 15)), max(1, min(limit, 50))
    kept = expire_activity(daily, as_of, days - 1)
    prefix = _normal_prefix(path_prefix, keep_slash=False)
    if prefix:
        kept = kept.where(F.startswith("relative_path", F.lit(prefix)))
    sums = kept.groupBy("location_id", "relative_path").agg(
        *[F.sum(f"{k}_count").alias(f"{k}_count") for k in KINDS],
        F.max("last_changed_at").alias("last_changed_at"), F.max("last_served_at").alias("last_served_at"))
    total = sum((F.col(f"{k}_count") for k in KINDS), F.lit(0))
    place = F.row_number().over(W.partitionBy("location_id").orderBy(F.desc("total"), "relative_path"))
    return sums.withColumn("total", total).withColumn("rank", place).where(F.col("rank") <= limit)


def activity_from_reads(reads: DataFrame, at) -> DataFrame:
    """Each successful point read serves its document."""
    return reads.where("error IS NULL").select(
        "location_id", "relative_path", F.lit("served").alias("kind"), at.alias("at"))


def activity_from_packs(items: DataFrame, at) -> DataFrame:
    """Each included pack item is a context use."""
    return items.select("location_id", "relative_path", F.lit("context").alias("kind"), at.alias("at"))


def log_entries(docs: DataFrame) -> DataFrame:
    """Dated paragraphs of log bodies: (location, path, scope, position, date, summary).

    Works inside one document row: the body is cut at its date headings, each
    piece at its blank lines, so nothing is shuffled.
    """
    # A date heading is a '#' line whose first word, after trimming other characters, starts like dddd-dd-.
    lines = F.transform(F.split("body", "\r?\n"), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))

    def date_of(line):
        word = F.get(F.split(F.regexp_replace(line, r"^#+\s*", ""), r"\s+"), F.lit(0))
        core = F.regexp_replace(word, r"^[^0-9\-]+|[^0-9\-]+$", "")
        dated = F.startswith(line, F.lit("#")) & (F.octet_length(core) >= 10) & core.rlike(r"^.{4}-.{2}-")
        return F.when(dated, F.left(core, F.lit(10)))

    marked = F.transform(lines, lambda v: F.struct(v.alias("t"), date_of(v).alias("d")))
    # Control characters cannot be typed in Markdown text, so they are safe joints.
    joined = F.array_join(F.transform(
        marked, lambda s: F.when(s["d"].isNotNull(), F.concat(F.lit("\x1d"), s["d"], F.lit("\x1f")))
        .when(s["t"] == "", F.lit("\x1e"))
        .when(F.startswith(s["t"], F.lit("---")), F.lit(""))
        .otherwise(F.concat(F.regexp_replace(s["t"], r"^[-*+]+\s*", ""), F.lit("\x1c")))), "")
    scope = F.when(F.contains("relative_path", F.lit("/")), tx.parent_dir(F.col("relative_path"))).otherwise(F.lit("root"))
    sections = docs.select("location_id", "relative_path", scope.alias("scope"),
                           F.posexplode(F.split(joined, "\x1d")).alias("section", "text"))
    dated = sections.select(
        "location_id", "relative_path", "scope", "section",
        F.when(F.contains("text", F.lit("\x1f")), F.substring_index("text", "\x1f", 1)).alias("date"),
        F.posexplode(F.split(F.substring_index("text", "\x1f", -1), "\x1e")).alias("part", "paragraph"))
    summary = F.trim(F.left(F.trim(F.translate(F.rtrim(F.col("paragraph"), F.lit("\x1c")), "\x1c", " ")), F.lit(500)))
    return dated.withColumn("summary", summary).where("summary <> ''").drop("paragraph")


def recent_logs(entries: DataFrame, limit: int = 20) -> DataFrame:
    """Newest entries per location, undated last."""
    place = F.row_number().over(W.partitionBy("location_id").orderBy(
        F.col("date").desc_nulls_last(), "relative_path", "section", "part"))
    return entries.withColumn("rank", place).where(F.col("rank") <= limit)


def overview(docs: DataFrame, links: DataFrame, daily: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """Location overview in long form: (location_id, section, key, value, count).

    Facets, link health, finding total, 20 recent log entries and 20 active
    documents.  The long form keeps a location with very many tags out of one row.
    """
    shape = ["location_id", "section", "key", "value", "count"]
    facet = fc.facets(docs, as_of, by_location=True).where("dimension <> 'freshness'").select(
        "location_id", F.concat(F.lit("facet:"), "dimension").alias("section"), F.col("value").alias("key"),
        F.lit(None).cast("string").alias("value"), "count")
    totals = docs.groupBy("location_id").agg(F.sum("finding_count").alias("n")).select(
        "location_id", F.lit("findings").alias("section"), F.lit("total").alias("key"),
        F.lit(None).cast("string").alias("value"), F.col("n").alias("count"))
    health = fc.link_health(links).select("location_id", F.explode(F.array(
        F.struct(F.lit("resolved").alias("key"), F.col("resolved_links").alias("count")),
        F.struct(F.lit("unresolved").alias("key"), F.col("unresolved_links").alias("count")))).alias("h")).select(
        "location_id", F.lit("links").alias("section"), "h.key", F.lit(None).cast("string").alias("value"), "h.count")
    log_rows = recent_logs(log_entries(logs)).select(
        "location_id", F.lit("log").alias("section"), F.concat_ws(" ", F.lpad(F.col("rank").cast("string"), 2, "0"), "relative_path").alias("key"),
        F.concat_ws(": ", "date", "summary").alias("value"), F.lit(1).cast("long").alias("count"))
    active = activity_top(daily, as_of, 15, 20).select(
        "location_id", F.lit("activity").alias("section"), F.col("relative_path").alias("key"),
        F.lit(None).cast("string").alias("value"), F.col("total").cast("long").alias("count"))
    out = facet.select(shape)
    for part in (totals, health, log_rows, active):
        out = out.unionByName(part.select(shape))
    return out


# -- text reports ----------------------------------------------------------


def _where_text(line: str = "start_line", column: str | None = "start_column"):
    place = F.concat(F.lit(":"), F.col(line).cast("string"))
    if column:
        place = F.concat(place, F.coalesce(F.concat(F.lit(":"), F.col(column).cast("string")), F.lit("")))
    return F.concat(F.col("relative_path"), F.when(F.col(line) > 0, place).otherwise(F.lit("")))


def lint_report(findings: DataFrame, bundles: DataFrame, limit: int = 1000, quiet: bool = False,
                version: str = "1", fail_on: str = "error", brand: Brand = DEFAULT) -> DataFrame:
    """Versioned JSON and text report per location.

    ``bundles``: location_id, name, declared_version, documents, ignored_documents.
    Totals come from all findings; the text holds at most ``limit`` of them.
    """
    shown = displayed_findings(findings, 0 if quiet else limit)
    point = lambda line, col: F.struct(F.col(line).alias("line"), F.col(col).alias("column"))
    rng = F.when(F.col("start_line").isNotNull(), F.struct(
        point("start_line", "start_column").alias("start"), point("end_line", "end_column").alias("end")))
    item = F.struct("code", "severity", "tier", F.col("relative_path").alias("relativePath"), rng.alias("range"), "message")
    line = F.concat(F.lit("\n"), F.upper("severity"), F.lit(" "), "code", F.lit(" "), _where_text(),
                    F.lit("\n  "), "message", F.lit("\n"))
    listed = shown.groupBy("location_id").agg(F.array_sort(F.collect_list(
        F.struct("position", item.alias("item"), line.alias("line")))).alias("rows"))
    summary = fc.lint_summary(findings, fail_on)
    joined = bundles.join(summary, "location_id", "left").join(listed, "location_id", "left").fillna(
        0, ["errors", "warnings", "info"]).fillna(False, ["failed"])
    total = F.col("errors") + F.col("warnings") + F.col("info")
    count = F.coalesce(F.size("rows"), F.lit(0))
    count = F.when(count < 0, 0).otherwise(count)
    cut = count < total
    report = F.struct(
        F.lit(1).alias("schemaVersion"),
        F.struct(F.lit(brand.lint_tool).alias("name"), F.lit(version).alias("version")).alias("tool"),
        F.struct(F.col("name"), F.col("declared_version").alias("declaredOkfVersion")).alias("bundle"),
        F.struct("documents", F.col("ignored_documents").alias("ignoredDocuments"), "errors", "warnings", "info",
                 cut.alias("truncated")).alias("summary"),
        F.coalesce(F.transform("rows", lambda r: r["item"]), F.array()).alias("findings"))
    note = F.when(cut & F.lit(quiet), F.lit("\nFindings omitted by --quiet.\n")).when(
        cut, F.concat(F.lit("\nOutput limited to "), count.cast("string"), F.lit(" of "), total.cast("string"),
                      F.lit(" findings.\n"))).otherwise(F.lit(""))
    ignored = F.when(F.col("ignored_documents") > 0, F.concat(
        F.lit(" · "), tx.counted(F.col("ignored_documents"), "document ignored", "documents ignored"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("OKF lint: "), "name", F.lit("\n"),
        F.coalesce(F.array_join(F.transform("rows", lambda r: r["line"]), ""), F.lit("")), note,
        F.lit("\nSummary: "), tx.counted(F.col("documents"), "document", "documents"), ignored, F.lit(" · "),
        tx.counted(F.col("errors"), "error", "errors"), F.lit(" · "),
        tx.counted(F.col("warnings"), "warning", "warnings"), F.lit(" · "),
        tx.counted(F.col("info"), "info", "info"),
        F.lit("\nResult: "), F.when(F.col("failed"), "failed").otherwise("passed"), F.lit("\n"))
    return joined.select("location_id", "errors", "warnings", "info", "failed", cut.alias("truncated"),
                         F.to_json(report).alias("json"), text.alias("text"))


def lint_annotations(findings: DataFrame, root: str = "") -> DataFrame:
    """One CI annotation line and one summary-table row per finding."""
    path = F.regexp_replace(F.concat(F.lit(f"{root}/" if root else ""), tx.fold_dots(F.translate("relative_path", "\\", "/"))), "^/+", "")
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise(F.lit("notice"))
    has_line = F.col("start_line") > 0
    properties = F.concat_ws(
        ",", F.concat(F.lit("file="), tx.escape_command(path)),
        F.when(has_line, F.concat(F.lit("line="), F.col("start_line").cast("string"))),
        F.when(has_line, F.concat(F.lit("col="), F.coalesce(F.col("start_column"), F.lit(1)).cast("string"))),
        F.when(has_line & (F.col("end_line") > 0), F.concat(F.lit("endLine="), F.col("end_line").cast("string"))),
        F.when(has_line & (F.col("end_column") > 0), F.concat(F.lit("endColumn="), F.col("end_column").cast("string"))),
        F.concat(F.lit("title="), tx.escape_command(F.col("code"))))
    annotation = F.concat(F.lit("::"), level, F.lit(" "), properties, F.lit("::"), tx.escape_command(F.col("message")))
    row = F.concat(
        F.lit("| "), tx.escape_cell(F.col("severity")), F.lit(" | `"), tx.escape_cell(F.col("code")), F.lit("` | `"),
        tx.escape_cell(_where_text(column=None)), F.lit("` | "), tx.escape_cell(F.col("message")), F.lit(" |"))
    return findings.select("location_id", "relative_path", "code", "severity", annotation.alias("annotation"), row.alias("row"))


def job_summary_head(bundles: DataFrame, threshold: str = "error") -> DataFrame:
    """Heading lines of the CI job summary per location (table rows come from ``lint_annotations``)."""
    total = F.col("errors") + F.col("warnings") + F.col("info")
    head = F.concat(
        F.lit("**"), F.col("documents").cast("string"), F.lit(" documents · "), F.col("errors").cast("string"),
        F.lit(" errors · "), F.col("warnings").cast("string"), F.lit(" warnings · "), F.col("info").cast("string"),
        F.lit(f" info**\n\nFailure threshold: `{threshold}`"),
        F.when(F.col("truncated"), F.lit(" · findings truncated by the CLI output limit")).otherwise(F.lit("")),
        F.when(total > 0, F.lit("\n\n| Severity | Code | Location | Finding |\n| --- | --- | --- | --- |"))
        .otherwise(F.lit("\n\nNo findings.")))
    return bundles.select("location_id", head.alias("head"))


def export_references(selection: DataFrame, locations: DataFrame, brand: Brand = DEFAULT) -> DataFrame:
    """Ordered reference lines; line 0 and 1 are the heading and a blank line."""
    names = locations.select("location_id", "name")
    lines = selection.join(names, "location_id", "left").select(
        "selection_id", (F.col("pos") + 2).alias("line_no"),
        F.concat(F.lit("- "), "title", F.lit(" — "), F.coalesce(F.nullif("name", F.lit("")), "location_id"), F.lit(":"),
                 "relative_path", F.lit(" ("), F.lower("reason"), F.lit(")")).alias("line"))
    head = selection.select("selection_id").distinct().select(
        "selection_id", F.explode(F.array(
            F.struct(F.lit(0).alias("n"), F.lit(f"Selected {brand.name} references:").alias("t")),
            F.struct(F.lit(1).alias("n"), F.lit("").alias("t")))).alias("h")).select(
        "selection_id", F.col("h.n").cast("long").alias("line_no"), F.col("h.t").alias("line"))
    return head.unionByName(lines.withColumn("line_no", F.col("line_no").cast("long")))


def health_handoff(findings: DataFrame, bundles: DataFrame, scope: str = "policy", brand: Brand = DEFAULT) -> DataFrame:
    """Repair handoff as ordered blocks per location.

    Block 0 is the heading, block 2 the footing, and every finding is its own
    block between them (order: ``finding_order``), so a location with very many
    findings is sorted and written like any other table.
    """
    label = (f"repository policy ({brand.ignore_file} applied)" if scope == "policy"
             else f"all Markdown ({brand.ignore_file} bypassed)")
    counts = bundles.select("location_id", "name", "documents").join(
        fc.lint_summary(findings), "location_id", "left").fillna(0, ["errors", "warnings", "info"])
    head = F.concat(
        F.lit('Review and fix the OKF findings in the "'), "name", F.lit(
            '" bundle.\n\nPreserve the author\'s content and all unknown frontmatter fields. Do not invent metadata values'
            " or impose a closed type taxonomy. Inspect each document before choosing a missing type. Do not rewrite the"
            f' bundle automatically beyond the findings you verify.\n\n<okf-lint scope="{label}" documents="'),
        F.col("documents").cast("string"), F.lit('" errors="'), F.col("errors").cast("string"), F.lit('" warnings="'),
        F.col("warnings").cast("string"), F.lit('" info="'), F.col("info").cast("string"), F.lit('">\n'),
        F.when(F.col("errors") + F.col("warnings") + F.col("info") == 0, F.lit("No findings in this scope.\n")).otherwise(F.lit("")))
    foot = F.lit("</okf-lint>\n\nAfter making changes, run the OKF linter again and report the remaining findings.")
    ends = counts.select("location_id", F.explode(F.array(
        F.struct(F.lit(0).alias("block"), head.alias("text")), F.struct(F.lit(2).alias("block"), foot.alias("text")))).alias("e")).select(
        "location_id", "e.block", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("relative_path"), "e.text")
    text = F.concat(F.lit('<violation code="'), "code", F.lit('" severity="'), "severity", F.lit('" location="'),
                    _where_text(), F.lit('">\n'), "message", F.lit("\n</violation>"))
    return ends.unionByName(findings.select(
        "location_id", F.lit(1).alias("block"), "code", "relative_path", text.alias("text")))



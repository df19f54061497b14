"""Projections, filters and predicates over documents, files, findings and requests."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelake.functions import text as tx
from lorelake.sizes import small

# Directory names never scanned, compared without case.
IGNORED_DIRECTORIES = [
    ".git", ".hg", ".svn", "node_modules", "vendor", ".venv", "venv", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", "dist", "build", "out",
    ".next", ".nuxt", ".svelte-kit", ".gradle", ".idea", "Pods", "DerivedData", "bin",
    "obj", ".terraform", ".dart_tool", ".pub-cache", "coverage", ".coverage",
]
MAX_RULES = 1024
MAX_RULE_BYTES = 64 * 1024


def prune_ignored(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Drop files below an ignored directory name at any depth."""
    dirs = F.split(F.lower(tx.parent_dir(F.col(path))), "/")
    names = F.array(*[F.lit(name.lower()) for name in IGNORED_DIRECTORIES])
    return files.where(~F.arrays_overlap(dirs, names))


def markdown_only(files: DataFrame, path: str = "relative_path") -> DataFrame:
    return files.where(F.col(path).rlike(r"(?i)[^/]\.(md|markdown)$"))


def filter_documents(docs: DataFrame, *, types=(), tags=(), roles=(), statuses=(), trust=(),
                     freshness=(), path_prefix="", findings="any", as_of: str | None = None) -> DataFrame:
    """Metadata, findings, freshness and path filters: OR inside one, AND across."""
    if types:
        docs = docs.where(F.col("type").isin(*types))
    if tags:
        docs = docs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if roles:
        docs = docs.where(F.col("kind").isin(*roles))
    if statuses:
        docs = docs.where(F.col("status").isin(*statuses))
    if trust:
        docs = docs.where(F.col("trust_tier").isin(*trust))
    if freshness:
        docs = docs.where(tx.freshness(F.col("stale_after"), as_of).isin(*freshness))
    if path_prefix:
        docs = path_filter(docs, path_prefix, keep_slash=False)
    if findings == "with":
        docs = docs.where("finding_count > 0")
    elif findings == "without":
        docs = docs.where("finding_count = 0")
    elif findings != "any":
        raise ValueError("The findings filter is invalid.")
    return docs


def _normal_prefix(prefix: str, keep_slash: bool) -> str:
    parts = [p for p in prefix.replace("\\", "/").split("/") if p not in ("", ".")]
    tail = "/" if keep_slash and parts and prefix[-1] in "/\\" else ""
    return "/".join(parts) + tail


def path_filter(docs: DataFrame, prefix: str, keep_slash: bool) -> DataFrame:
    """Search and activity drop a trailing slash, listing keeps it."""
    normal = _normal_prefix(prefix, keep_slash)
    return docs.where(F.startswith("relative_path", F.lit(normal))) if normal else docs


def list_filter(docs: DataFrame, *, role=None, type=None, status=None, tags=(), path_prefix="") -> DataFrame:
    """Exact listing filters: trimmed, blanks ignored, any of the tags."""
    for column, value in (("kind", role), ("type", type), ("status", status)):
        if value and value.strip():
            docs = docs.where(F.col(column) == value.strip())
    wanted = sorted({t.strip() for t in tags if t.strip()})
    if wanted:
        docs = docs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))
    return path_filter(docs, path_prefix, keep_slash=True)


def quick_open(files: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """First files whose name and path contain the text, case-insensitively."""
    label = F.lower(F.concat_ws(" ", tx.last_segment(F.col("relative_path")), F.col("relative_path")))
    kept = files.where(F.contains(label, F.lit(query.strip().lower())))
    return kept.orderBy("location_id", "relative_path").limit(limit)


def filter_concepts(concepts: DataFrame, types=(), tag: str | None = None) -> DataFrame:
    if types:
        concepts = concepts.where(F.col("type").isin(*types))
    return concepts.where(F.array_contains("tags", tag)) if tag else concepts


def findings_scope(findings: DataFrame, ignored: DataFrame, scope: str = "policy") -> DataFrame:
    """All findings, or those outside the ignored paths."""
    if scope == "all":
        return findings
    keyed = findings.withColumn("_p", F.translate("relative_path", "\\", "/"))
    skip = ignored.select("location_id", F.translate("relative_path", "\\", "/").alias("_p"))
    return keyed.join(skip, ["location_id", "_p"], "left_anti").drop("_p")


def filter_findings(findings: DataFrame, severity: str = "all", query: str = "") -> DataFrame:
    if severity != "all":
        findings = findings.where(F.col("severity") == severity)
    needle = query.strip().lower()
    if needle:
        hit = [F.contains(F.lower(c), F.lit(needle)) for c in ("code", "relative_path", "message")]
        findings = findings.where(hit[0] | hit[1] | hit[2])
    return findings


def filter_history(history: DataFrame, kind: str = "all") -> DataFrame:
    return history if kind == "all" else history.where(F.col("kind") == kind)


# -- ignore policy ---------------------------------------------------------


def _glob_regex(pattern: str) -> str:
    """Glob → regex where ``*`` and ``?`` stay inside a segment and ``**`` spans segments."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            stars = len(pattern) - len(pattern[i:].lstrip("*")) - i
            at_start = i == 0 or pattern[i - 1] == "/"
            at_end = i + stars == n or pattern[i + stars] == "/"
            if stars > 2 or (stars == 2 and not (at_start and at_end)):
                raise ValueError(f"invalid ignore pattern '{pattern}'")
            if stars == 2:
                if i + 2 < n:
                    out.append("(?:[^/]+/)*")
                    i += 3
                else:
                    out.append(".*")
                    i += 2
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 3 if pattern[i + 1:i + 2] == "!" else i + 2)
            if end < 0:
                raise ValueError(f"invalid ignore pattern '{pattern}'")
            body = pattern[i + 1:end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body[1:] if negated else body)
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "".join(out)


def compile_rule(line: str) -> tuple[str, bool] | None:
    """(regex over the whole relative path, negated) of one policy line."""
    value = line.strip()
    if not value or value.startswith("#"):
        return None
    negated = value.startswith("!")
    if negated:
        value = value[1:].strip()
        if not value:
            raise ValueError("The policy contains an empty negated pattern")
    pattern = value.lstrip("/").rstrip("/").replace("\\", "/")
    if not pattern:
        raise ValueError("The policy contains an empty pattern")
    anchored, directory = value.startswith("/"), value.endswith("/")
    bare = pattern[3:] if pattern.startswith("**/") else pattern
    if not anchored and "/" not in bare:
        inner = _glob_regex(bare)
        # A directory rule matches a parent segment; at the top level it matches the name itself.
        return (f"^(?:(?:[^/]*/)*{inner}/.+|{inner})$" if directory else f"^(?:.*/)?{inner}$"), negated
    inner = _glob_regex(pattern)
    return (f"^{inner}/.+$" if directory else f"^{inner}$"), negated


_COMPILED = T.StructType([
    T.StructField("regex", T.StringType()), T.StructField("negated", T.BooleanType()), T.StructField("error", T.StringType())])


@F.arrow_udf(_COMPILED)
def _compile_lines(lines: pa.Array) -> pa.Array:
    rows = []
    for line in lines.to_pylist():
        try:
            rule = compile_rule(line)
            rows.append({"regex": rule[0], "negated": rule[1], "error": None} if rule else None)
        except ValueError as problem:
            rows.append({"regex": None, "negated": None, "error": str(problem)})
    return pa.array(rows, type=pa.struct([("regex", pa.string()), ("negated", pa.bool_()), ("error", pa.string())]))


def compile_policy(lines: DataFrame) -> DataFrame:
    """(location_id, rules ARRAY<STRUCT<regex, negated>>, error) from (location_id, line_no, line).

    Comments and blank lines do not count; a policy with a bad pattern or more
    than 1,024 rules gets an ``error`` and no rules.  Counts are checked before
    the rules of a location are put into one array.
    """
    rules = lines.withColumn("r", _compile_lines("line")).where("r IS NOT NULL")
    checks = rules.groupBy("location_id").agg(F.count("*").alias("n"), F.min("r.error").alias("bad"))
    checks = checks.select("location_id", F.coalesce("bad", F.when(
        F.col("n") > MAX_RULES, F.lit(f"A conformance policy cannot exceed {MAX_RULES} patterns"))).alias("error"))
    usable = rules.join(checks.where("error IS NULL"), "location_id", "left_semi").groupBy("location_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", F.col("r.regex").alias("regex"), F.col("r.negated").alias("negated")))),
            lambda s: F.struct(s["regex"].alias("regex"), s["negated"].alias("negated"))).alias("rules"))
    return checks.join(usable, "location_id", "left")


def ignored_paths(files: DataFrame, policy: DataFrame) -> DataFrame:
    """Files whose last matching rule is not negated.

    The rules of a location are one bounded array, so the join is by location
    and the row count never grows with the number of rules.
    """
    path = F.regexp_replace(F.translate("relative_path", "\\", "/"), r"^\./", "")
    # A policy row holds up to 1,024 rules, so only few of them are broadcast.
    joined = files.join(small(policy.select("location_id", "rules"), 200), "location_id").withColumn("_path", path)
    last = F.try_element_at(F.filter("rules", lambda r: F.rlike(F.col("_path"), r["regex"])), F.lit(-1))
    return joined.where(F.coalesce(~last["negated"], F.lit(False))).drop("rules", "_path")


# -- requests --------------------------------------------------------------


def allowed(requests: DataFrame, allow: DataFrame) -> DataFrame:
    """Requests with an ``error`` code for locations outside the allow list."""
    known = allow.select("location_id").distinct().withColumn("_ok", F.lit(True))
    marked = requests.join(small(known), "location_id", "left")
    return marked.withColumn("error", F.when(F.col("_ok").isNull(), "location_not_allowed")).drop("_ok")


def valid_location_id(location_id: Column) -> Column:
    return location_id.rlike(r"^[A-Za-z0-9_\-]{1,128}\z")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``error`` and clamped limits to (location_ids, query, findings, limit, days)."""
    ids = F.col("location_ids")
    error = (
        F.when(F.size(ids) == 0, "Choose at least one Location to search.")
        .when(F.size(ids) > 100, "Too many Locations were selected.")
        .when(~F.forall(ids, valid_location_id), "The Location identifier is invalid.")
        .when(F.octet_length("query") > 1000, "The search query is too long.")
        .when(~F.col("findings").isin("any", "with", "without"), "The findings filter is invalid.")
    )

    def clamp(name: str, low: int, high: int) -> Column:
        return F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))

    return requests.withColumns({
        "error": error, "search_limit": clamp("limit", 1, 100), "list_limit": clamp("limit", 1, 100),
        "related_limit": clamp("limit", 1, 50), "activity_limit": clamp("limit", 1, 50),
        "activity_days": clamp("days", 1, 15),
    })


def read_documents(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Point reads by (location, normalized path); a miss is a ``document_not_found`` row."""
    keyed = requests.withColumn("relative_path", tx.norm_path(F.col("relative_path")))
    wanted = keyed.select("location_id", "relative_path").distinct()
    found = docs.join(small(wanted), ["location_id", "relative_path"], "left_semi").withColumn("_found", F.lit(True))
    joined = keyed.join(found, ["location_id", "relative_path"], "left")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), "document_not_found")).drop("_found")


def active(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the active generation of each location."""
    current = runs.select("location_id", F.col("active_generation").alias("generation")).where("generation IS NOT NULL")
    return rows.join(small(current), ["location_id", "generation"], "left_semi")


def active_filter_count(requests: DataFrame) -> Column:
    """Number of active filters of a search request row."""
    lists = ["f_types", "f_tags", "f_roles", "f_statuses", "f_trust", "f_freshness"]
    total = sum((F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) for c in lists), F.lit(0))
    prefix = F.coalesce(F.col("f_path_prefix") != "", F.lit(False)).cast("int")
    findings = F.coalesce(F.col("f_findings") != "any", F.lit(False)).cast("int")
    return total + prefix + findings

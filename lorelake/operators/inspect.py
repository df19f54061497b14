"""Corpus inspection: one map over document rows, no shuffle.

``inspect`` takes ``location_id, root_path, relative_path, content`` (other
columns pass through) and adds front matter, metadata, headings, links and
findings as columns.  ``links_table`` and ``findings_table`` explode them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelake.brand import DEFAULT, Brand
from lorelake.functions import blocks as bl
from lorelake.functions import front_matter as fm
from lorelake.functions import markdown as md
from lorelake.functions import text as tx

# Limits and vocabulary of the checked format.
MAX_DOCUMENT_BYTES = 8 * 1024 * 1024
MAX_FRONT_MATTER_BYTES = 1024 * 1024
KNOWN_VERSIONS = ["0.1", "0.2"]
KNOWN_STATUSES = ["draft", "stable", "deprecated"]
TEXT_FIELDS = ["type", "title", "description", "resource", "status"]
NUMBER_FIELDS = ["timestamp", "okf_version", "stale_after"]
KNOWN_FIELDS = [
    "type", "title", "description", "resource", "tags", "timestamp",
    "okf_version", "sources", "generated", "verified", "status", "stale_after",
]

_CLOSED = r"(?dms)\A---\r?\n(?:(.*?)\r?\n)??---[ \t]*\r*(?:\n|\z)"
_LOG_DATE = r"(?dm)^[ \t\r]*## [0-9]{4}-[0-9]{2}-[0-9]{2}[ \t\r]*$"

FINDING = "struct<code:string,severity:string,message:string,start_line:int,start_column:int,end_line:int,end_column:int>"
_NO_FINDINGS = f"cast(array() as array<{FINDING}>)"


def document_kind(path: Column) -> Column:
    """index / log / concept by basename."""
    base = F.lower(tx.last_segment(path))
    return (
        F.when(base.isin("index.md", "index.markdown"), F.lit("index"))
        .when(base.isin("log.md", "log.markdown"), F.lit("log"))
        .otherwise(F.lit("concept"))
    )


def split_front_matter(docs: DataFrame, content: str = "content") -> DataFrame:
    """Add ``front_state`` (none/closed/unclosed), ``yaml``, ``body``, ``body_offset``."""
    text = F.col(content)
    opens = text.rlike(r"\A---\r?\n")
    block = F.when(opens, F.regexp_extract(text, _CLOSED, 0))
    staged = docs.select("*", opens.alias("_opens"), block.alias("_block"))
    closed = F.coalesce(F.col("_block") != "", F.lit(False))
    return staged.select(
        *docs.columns,
        F.when(~F.col("_opens"), "none").when(closed, "closed").otherwise("unclosed").alias("front_state"),
        F.when(closed, F.regexp_extract(F.col("_block"), _CLOSED, 1)).alias("yaml"),
        F.when(closed, F.substring(text, F.length("_block") + 1, F.length(text))).otherwise(text).alias("body"),
        F.when(closed, F.length("_block")).otherwise(0).alias("body_offset"),
    )


def visible_body(docs: DataFrame, brand: Brand = DEFAULT) -> DataFrame:
    """Strip a leading review block from ``body`` and advance ``body_offset``."""
    body = F.col("body")
    has = F.startswith(body, F.lit(brand.review_marker)) & (F.locate("-->", body) > 0)
    length = F.length(F.regexp_extract(body, r"(?s)\A.*?-->(?:\r?\n)?", 0))
    staged = docs.withColumn("_cut", F.when(has, length).otherwise(0))
    return staged.withColumns(
        {
            "body": F.when(F.col("_cut") > 0, F.substring(body, F.col("_cut") + 1, F.length(body))).otherwise(body),
            "body_offset": F.col("body_offset") + F.col("_cut"),
        }
    ).drop("_cut")


def source_position(content: Column, offset: Column) -> tuple[Column, Column]:
    """1-based (line, column) in characters of a 0-based character offset."""
    prefix = F.left(content, offset)
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(prefix, "\n", -1)) + 1
    return line.cast("int"), column.cast("int")


def parse_front_matter(docs: DataFrame) -> DataFrame:
    """Add ``parsed`` (see ``front_matter.PARSED``) for closed blocks within the size limit."""
    text = F.when(F.octet_length("yaml") <= MAX_FRONT_MATTER_BYTES, F.col("yaml"))
    return docs.withColumn("parsed", fm.parse_column(text))


def normalize_metadata(docs: DataFrame) -> DataFrame:
    """Add ``meta`` struct of the normalized fields."""
    nodes = F.coalesce(F.col("parsed.nodes"), F.expr("cast(array() as array<struct<path:string,kind:string,text:string>>)"))
    docs = docs.withColumn("nodes", nodes)
    # Of most documents' nodes few are at the top, and only these are searched for each field.
    top = F.filter("nodes", lambda n: n["path"].rlike("^/[^/]*$"))
    return docs.withColumn("meta", tx.let(top, lambda t: _metadata(F.col("nodes"), t)))


def _metadata(nodes: Column, top: Column) -> Column:
    fields = {name: fm.scalar_at(top, f"/{name}", number=name in NUMBER_FIELDS)
              for name in TEXT_FIELDS + NUMBER_FIELDS}
    tags = fm.node_at(top, "/tags")
    items = F.filter(nodes, lambda n: n["path"].rlike("^/tags/[0-9]+$") & fm.is_value(n))
    tag_list = (
        F.when(tags["kind"] == "sequence",
               F.transform(F.filter(items, lambda n: n["kind"] == "string"), lambda n: n["text"]))
        .when(tags["kind"] == "string", F.array(tags["text"]))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )
    extra = F.transform(
        F.filter(top, lambda n: (n["kind"] == "key") & ~n["text"].isin(KNOWN_FIELDS)),
        lambda n: n["text"],
    )
    generated_at = fm.scalar_at(nodes, "/generated/at")
    return F.struct(
        *[fields[name].alias(name) for name in fields],
        tag_list.alias("tags"),
        F.coalesce(generated_at, fields["timestamp"]).alias("effective_timestamp"),
        extra.alias("extra_names"),
    )


def metadata_links(nodes: Column) -> Column:
    """ARRAY<STRUCT<target, field>> of the path-bearing metadata fields."""
    bearing = r"^/(?:resource|computation|(?:executor|attester)/resource|sources(?:/[0-9]+/resource)?)$"
    return tx.let(F.filter(nodes, lambda n: n["path"].rlike(bearing)), _bearing_links)


def _bearing_links(nodes: Column) -> Column:
    def at(path: str, field: str) -> Column:
        return F.struct(fm.scalar_at(nodes, path).alias("target"), F.lit(field).alias("field"))

    fixed = F.array(
        at("/resource", "resource"),
        at("/computation", "computation"),
        at("/executor/resource", "executor.resource"),
        at("/attester/resource", "attester.resource"),
    )
    is_list = fm.node_at(nodes, "/sources")["kind"] == "sequence"
    listed = F.transform(
        F.filter(
            nodes,
            lambda n: n["path"].rlike("^/sources/[0-9]+/resource$")
            & n["kind"].isin("string", "integer", "float") & is_list,
        ),
        lambda n: F.struct(
            n["text"].alias("target"),
            F.concat(F.lit("sources["), F.regexp_extract(n["path"], "[0-9]+", 0), F.lit("].resource")).alias("field"),
        ),
    )
    return F.filter(F.concat(fixed, listed), lambda s: s["target"].isNotNull())


_FOUND = "array<struct<target:string,line:int,start:int,end_line:int,end:int>>"


def markdown_links(blocks: Column, defs: Column, first_line: Column, first_column: Column) -> Column:
    """ARRAY<STRUCT<target, line, start, end_line, end>> in document order; a link may run over the lines of its block."""
    kept = F.filter(blocks, lambda b: b["text"].rlike(r"[\[<]") & ~(F.contains(b["text"], F.lit("]:")) & b["text"].rlike(md.DEFINITION)))

    def moved(line: Column, column: Column, passed: Column) -> Column:
        """Line and column after ``passed``."""
        breaks = F.length(passed) - F.length(F.replace(passed, F.lit("\n"), F.lit("")))
        return F.struct((line + breaks).alias("line"), F.when(
            breaks > 0, F.length(F.substring_index(passed, "\n", -1)) + 1).otherwise(column + F.length(passed)).alias("column"))

    def step(state: Column, x: Column) -> Column:
        def add(s: Column) -> Column:
            found = F.struct(x["target"].alias("target"), s["a"]["line"].alias("line"), s["a"]["column"].alias("start"),
                             s["b"]["line"].alias("end_line"), s["b"]["column"].alias("end"))
            return F.struct(s["b"]["line"].alias("line"), s["b"]["column"].alias("column"), F.when(
                x["target"].isNotNull(), F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

        before = moved(state["line"], state["column"], x["gap"])
        return tx.let(tx.let(before, lambda a: F.struct(a.alias("a"), moved(a["line"], a["column"], x["found"]).alias("b"))), add)

    def spread(b: Column) -> Column:
        links = tx.let(bl.around(b["text"], md.LINK), lambda parts: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1), lambda i: F.struct(
                F.get(parts, i).alias("found"), F.get(parts, i - 1).alias("gap"),
                md.link_target(F.get(parts, i), defs).alias("target"))))
        start = F.struct((b["line"] + first_line).cast("int").alias("line"), F.when(b["line"] == 0, first_column).otherwise(1).cast(
            "int").alias("column"), F.expr(f"cast(array() as {_FOUND})").alias("out"))
        return F.aggregate(links, start, step, lambda s: s["out"])

    return F.flatten(F.transform(kept, spread))


def resolve_target(target: Column, relative_path: Column, root_path: Column) -> Column:
    """STRUCT<fragment, target_relative_path, status> by lexical resolution only."""
    return resolve_from(target, relative_path, tx.fold_dots(root_path), tx.parent_dir(relative_path))


def resolve_from(target: Column, relative_path: Column, root: Column, folder: Column) -> Column:
    """``resolve_target`` for a folded root and the folder of the path, which all links of a document share."""
    whole_path, fragment = tx.split_target(target)

    def outcome(status: str, where: Column) -> Column:
        return F.struct(fragment.alias("fragment"), where.cast("string").alias("target_relative_path"), F.lit(status).alias("status"))

    def place(s: Column) -> Column:
        prefix = F.concat(F.rtrim(s["root"], F.lit("/")), F.lit("/"))
        inside = (s["full"] == s["root"]) | F.startswith(s["full"], prefix)
        return F.when(inside, outcome("candidate", F.substring(s["full"], F.length(prefix) + 1, F.length(s["full"])))).otherwise(
            outcome("outsideBundle", F.lit(None)))

    def internal(s: Column) -> Column:
        base = F.concat_ws("/", s["root"], F.when(~F.startswith(s["decoded"], F.lit("/")), folder))
        full = tx.let(F.concat(base, F.lit("/"), s["decoded"]), tx.fold_dots)
        return tx.let(F.struct(s["root"].alias("root"), full.alias("full")), place)

    def by_kind(path: Column) -> Column:
        staged = F.struct(root.alias("root"), tx.percent_decode(path).alias("decoded"))
        return F.when(path == "", outcome("fragment", relative_path)).when(
            tx.has_scheme(path) | F.startswith(path, F.lit("//")), outcome("external", F.lit(None))
        ).otherwise(tx.let(staged, internal))

    return tx.let(whole_path, by_kind)


def _finding(code, severity: str, message, line=None, column=None, end_line=None, end_column=None) -> Column:
    def col(value, kind):
        value = value if isinstance(value, Column) else F.lit(value)
        return value.cast(kind)

    return F.struct(
        col(code, "string").alias("code"), F.lit(severity).alias("severity"),
        col(message, "string").alias("message"), col(line, "int").alias("start_line"),
        col(column, "int").alias("start_column"), col(end_line, "int").alias("end_line"),
        col(end_column, "int").alias("end_column"),
    )


def metadata_findings(brand: Brand = DEFAULT) -> list[Column]:
    """Nullable findings of metadata normalization (over ``nodes``/``meta``/``parsed``)."""
    nodes, meta = F.col("nodes"), F.col("meta")
    out = []
    for name in ["type", "title", "description", "resource", "timestamp", "okf_version", "status", "stale_after"]:
        bad = meta[name].isNull() & fm.node_at(nodes, f"/{name}").isNotNull()
        out.append(F.when(bad, _finding(f"OKF_{name.upper()}_INVALID", "warning",
                                        f"The {name} field should be a string.")))
    version, status = meta["okf_version"], meta["status"]
    out.append(F.when(
        version.isNotNull() & ~version.isin(KNOWN_VERSIONS),
        _finding("OKF_VERSION_UNSUPPORTED", "info", F.concat(
            F.lit("OKF version "), version,
            F.lit(f" is newer or unknown; {brand.name} is reading it in compatibility mode.")))))
    out.append(F.when(
        status.isNotNull() & ~status.isin(KNOWN_STATUSES),
        _finding("OKF_STATUS_UNKNOWN", "info", F.concat(
            F.lit("The lifecycle status '"), status, F.lit("' is not defined by OKF v0.2.")))))
    tags = fm.node_at(nodes, "/tags")["kind"]
    out.append(F.when(tags == "string", _finding(
        "OKF_TAGS_SCALAR", "info",
        "A scalar tags value was accepted as a one-item list for compatibility.")))
    out.append(F.when(tags.isNotNull() & ~tags.isin("string", "sequence"), _finding(
        "OKF_TAGS_INVALID", "warning", "The tags field should be a list of strings.")))
    return out


def _findings(brand: Brand) -> Column:
    kind, state = F.col("kind"), F.col("front_state")
    parsed, meta, nodes = F.col("parsed"), F.col("meta"), F.col("nodes")
    has_front = state != "none"
    type_blank = F.coalesce(F.trim(meta["type"]), F.lit("")) == ""
    top_keys = F.filter(nodes, lambda n: F.startswith(n["kind"], F.lit("key")) & n["path"].rlike("^/[^/]*$"))
    only_version = (
        F.col("is_root_index") & meta["okf_version"].isNotNull() & (F.coalesce(parsed["odd_keys"], F.lit(0)) == 0)
        & F.forall(top_keys, lambda n: n["text"] == "okf_version")
    )
    singles = [
        F.when(state == "unclosed", _finding(
            "OKF_FRONTMATTER_UNCLOSED", "error", "The YAML frontmatter block is not closed.")),
        F.when(F.octet_length("yaml") > MAX_FRONT_MATTER_BYTES, _finding(
            "OKF_FRONTMATTER_TOO_LARGE", "error",
            "The YAML frontmatter exceeds the supported limit of 1 MiB.")),
        F.when(parsed["state"] == "deep", _finding("OKF_YAML_DEPTH_EXCEEDED", "error", parsed["error"])),
        F.when(parsed["state"] == "other", _finding(
            "OKF_FRONTMATTER_NOT_MAPPING", "error",
            "YAML frontmatter should be a mapping of field names to values.")),
        F.when(parsed["state"] == "invalid", _finding(
            "OKF_YAML_INVALID", "error",
            F.concat(F.lit("The YAML frontmatter is invalid: "), parsed["error"]),
            parsed["line"], parsed["column"], parsed["line"], parsed["column"] + 1)),
        *metadata_findings(brand),
        F.when((kind == "concept") & ~has_front, _finding(
            "OKF_FRONTMATTER_REQUIRED", "error", "Concept documents need YAML frontmatter.")),
        F.when((kind == "concept") & has_front & type_blank, _finding(
            "OKF_TYPE_REQUIRED", "error", "The required type field is missing.")),
        F.when((kind == "log") & has_front, _finding(
            "OKF_LOG_FRONTMATTER", "warning", "log.md normally has no frontmatter.")),
        F.when((kind == "log") & ~F.col("content").rlike(_LOG_DATE), _finding(
            "OKF_LOG_DATE_HEADING_REQUIRED", "warning",
            "Use ISO date headings (YYYY-MM-DD) for log entries.")),
        F.when((kind == "index") & has_front & ~only_version, _finding(
            "OKF_INDEX_FRONTMATTER", "warning",
            "index.md normally has no frontmatter; a root index may declare only okf_version.")),
    ]
    bad_tags = F.transform(
        F.filter(nodes, lambda n: n["path"].rlike("^/tags/[0-9]+$") & fm.is_value(n) & (n["kind"] != "string")
                 & (fm.node_at(nodes, "/tags")["kind"] == "sequence")),
        lambda n: _finding("OKF_TAG_ITEM_INVALID", "warning", "Every tags entry should be a string."),
    )
    odd_keys = F.array_repeat(
        _finding("OKF_METADATA_KEY_INVALID", "warning", "Top-level frontmatter keys should be strings."),
        F.coalesce(parsed["odd_keys"], F.lit(0)),
    )
    outside = F.transform(
        F.filter("links", lambda k: k["status"] == "outsideBundle"),
        lambda k: _finding(
            "OKF_LINK_OUTSIDE_BUNDLE", "warning",
            F.concat(F.lit("The link '"), k["target"], F.lit("' escapes the bundle root.")),
            k["start_line"], k["start_column"], k["end_line"], k["end_column"]),
    )
    too_large = _finding("OKF_DOCUMENT_TOO_LARGE", "error",
                         "This document exceeds the supported inspection limit of 8 MiB.")
    normal = F.concat(
        F.filter(F.array(*singles), lambda f: f.isNotNull()), odd_keys, bad_tags, outside
    )
    return F.when(F.col("too_large"), F.array(too_large)).otherwise(normal)


def _with_structure(docs: DataFrame) -> DataFrame:
    """Add ``headings`` and ``_found`` (body links), from the text alone."""
    line, column = source_position(F.col("content"), F.col("body_offset"))
    docs = docs.withColumns({"_text": md.without_blocks(F.col("body")), "_line": line, "_column": column})
    docs = docs.withColumn("_blocks", md.marked_blocks(F.col("_text")))
    docs = docs.withColumns({"headings": md.headings(F.col("_blocks")), "_masked": md.without_code(F.col("_blocks"))})
    docs = docs.withColumn("_defs", md.definitions(F.array_join(F.transform("_masked", lambda b: b["text"]), "\n")))
    found = markdown_links(F.col("_masked"), F.col("_defs"), F.col("_line"), F.col("_column"))
    return docs.withColumn("_found", found).drop("_text", "_blocks", "_line", "_column", "_masked", "_defs")


def _with_links(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("_fields", metadata_links(F.col("nodes")))
    none = F.lit(None).cast("int")
    from_body = F.transform("_found", lambda s: F.struct(
        s["target"].alias("target"), F.lit("markdown").alias("origin"), F.lit(None).cast("string").alias("field"),
        s["line"].alias("start_line"), s["start"].alias("start_column"),
        s["end_line"].alias("end_line"), s["end"].alias("end_column")))
    from_meta = F.transform("_fields", lambda s: F.struct(
        s["target"].alias("target"), F.lit("metadata").alias("origin"), s["field"].alias("field"),
        none.alias("start_line"), none.alias("start_column"), none.alias("end_line"), none.alias("end_column")))
    docs = docs.withColumn("_raw_links", F.concat(from_body, from_meta))
    place = F.struct(tx.fold_dots(F.col("root_path")).alias("root"), tx.parent_dir(F.col("relative_path")).alias("folder"))
    staged = tx.let(place, lambda p: F.transform("_raw_links", lambda k: F.struct(
        k.alias("k"), resolve_from(k["target"], F.col("relative_path"), p["root"], p["folder"]).alias("r"))))
    links = F.transform(staged, lambda s: F.struct(
        s["k"]["target"].alias("target"), s["r"]["target_relative_path"].alias("target_relative_path"),
        s["r"]["fragment"].alias("fragment"), s["k"]["origin"].alias("origin"), s["k"]["field"].alias("field"),
        s["r"]["status"].alias("status"), s["k"]["start_line"].alias("start_line"),
        s["k"]["start_column"].alias("start_column"), s["k"]["end_line"].alias("end_line"),
        s["k"]["end_column"].alias("end_column")))
    return docs.withColumn("links", links).drop("_found", "_fields", "_raw_links")


def trust_tier(actors: Column, is_bundle_concept: Column) -> Column:
    """humanReviewed / machineConfirmed / unverified / null from the ``by`` actors."""
    return (
        F.when(F.exists(actors, lambda a: F.startswith(a, F.lit("human:"))), F.lit("humanReviewed"))
        .when((F.size(actors) == 0) & is_bundle_concept, F.lit("unverified"))
        .when(F.size(actors) > 0, F.lit("machineConfirmed"))
    )


def lifecycle_status(status: Column, is_bundle_concept: Column) -> Column:
    return F.coalesce(status, F.when(is_bundle_concept, F.lit("stable")))


def derive_title(meta_title: Column, headings: Column, relative_path: Column) -> Column:
    first = F.get(F.filter(headings, lambda h: h["level"] == 1), F.lit(0))["text"]
    return F.coalesce(meta_title, first, F.element_at(F.split(relative_path, "/"), -1))


def search_projection(docs: DataFrame) -> DataFrame:
    """Add ``search_text``: the eight search fields, non-empty ones joined by newlines."""
    fields = ["title", "description", "type", "tags_text", "relative_path", "headings_text", "body", "metadata_text"]
    return docs.withColumn("search_text", F.concat_ws("\n", *[F.nullif(F.col(f), F.lit("")) for f in fields]))


def inspect(docs: DataFrame, brand: Brand = DEFAULT) -> DataFrame:
    """Front matter, metadata, headings, links and findings of every document."""
    keep = docs.columns
    too_large = F.octet_length("content") > MAX_DOCUMENT_BYTES
    docs = docs.withColumns({
        "kind": document_kind(F.col("relative_path")),
        "is_root_index": F.lower("relative_path") == "index.md",
        "too_large": too_large,
    })
    docs = visible_body(split_front_matter(docs), brand)
    docs = docs.withColumns({
        "yaml": F.when(~F.col("too_large"), F.col("yaml")),
        "body": F.when(~F.col("too_large"), F.col("body")).otherwise(""),
    })
    # The YAML step is not repeatable for the optimizer, so no filter on its results is
    # rewritten into copies of the text expressions below it.
    docs = normalize_metadata(parse_front_matter(_with_structure(docs)))
    docs = _with_links(docs)
    docs = docs.withColumn("findings", _findings(brand))
    return docs.select(
        *keep, "kind", "is_root_index", "front_state", "parsed", "nodes", "meta", "body", "headings", "links", "findings",
        (~F.exists("findings", lambda f: f["severity"] == "error")).alias("is_conformant"),
    )


def documents(inspected: DataFrame, in_bundle: Column | bool = True) -> DataFrame:
    """The document table row of every inspected document."""
    flag = in_bundle if isinstance(in_bundle, Column) else F.lit(in_bundle)
    concept = flag & (F.col("kind") == "concept")
    actors = fm.field_texts(F.col("nodes"), "verified", "by")
    base = inspected.select(
        *[c for c in inspected.columns if c not in
          ("kind", "is_root_index", "front_state", "parsed", "nodes", "meta", "body", "headings", "links", "findings",
           "is_conformant", "content", "root_path")],
        "kind",
        derive_title(F.col("meta.title"), F.col("headings"), F.col("relative_path")).alias("title"),
        F.col("meta.description").alias("description"), F.col("meta.type").alias("type"),
        F.col("meta.tags").alias("tags"), F.array_join("meta.tags", " ").alias("tags_text"),
        "headings", F.array_join(F.transform("headings", lambda h: h["text"]), " ").alias("headings_text"),
        F.col("parsed.json").alias("frontmatter_json"),
        F.array_join(fm.leaf_texts(F.col("nodes")), " ").alias("metadata_text"),
        lifecycle_status(F.col("meta.status"), concept).alias("status"),
        trust_tier(actors, concept).alias("trust_tier"), F.col("meta.stale_after").alias("stale_after"),
        F.col("meta.effective_timestamp").alias("timestamp"), F.col("meta.okf_version").alias("okf_version"),
        F.size("findings").cast("long").alias("finding_count"), "is_conformant",
        F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"), "body",
    )
    return search_projection(base)


def frontmatter_variant(docs: DataFrame) -> DataFrame:
    """Replace ``frontmatter_json`` by the VARIANT column ``frontmatter``."""
    return docs.withColumn("frontmatter", F.parse_json("frontmatter_json")).drop("frontmatter_json")


def format_value(value: Column) -> Column:
    """Display text of a VARIANT: strings as they are, anything else as JSON."""
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def links_table(inspected: DataFrame) -> DataFrame:
    """One row per link, ``position`` is its order in the document."""
    return inspected.select(
        "location_id", F.col("relative_path").alias("source_relative_path"), F.posexplode_outer("links").alias("position", "k")
    ).where("position IS NOT NULL").select("location_id", "source_relative_path", "position", "k.*")


def findings_table(inspected: DataFrame) -> DataFrame:
    """One row per finding, with its tier."""
    rows = inspected.select("location_id", "relative_path", F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    return rows.select("location_id", "relative_path", "f.*", finding_tier(F.col("f.code")).alias("tier"))


# Codes of the conformance tier; broken links are hygiene.
CONFORMANCE_CODES = [
    "OKF_FRONTMATTER_REQUIRED", "OKF_FRONTMATTER_UNCLOSED", "OKF_FRONTMATTER_TOO_LARGE",
    "OKF_FRONTMATTER_NOT_MAPPING", "OKF_YAML_INVALID", "OKF_YAML_DEPTH_EXCEEDED",
    "OKF_TYPE_REQUIRED", "OKF_DOCUMENT_TOO_LARGE", "OKF_FILE_UNREADABLE", "OKF_PATH_UNREADABLE",
    "OKF_LOG_FRONTMATTER", "OKF_LOG_DATE_HEADING_REQUIRED", "OKF_INDEX_FRONTMATTER",
    "OKF_LINK_OUTSIDE_BUNDLE",
]


def finding_tier(code: Column) -> Column:
    return (
        F.when(code.isin(CONFORMANCE_CODES), F.lit("conformance"))
        .when(code == "OKF_LINK_BROKEN", F.lit("hygiene"))
        .otherwise(F.lit("compatibility"))
    )

"""Review comments embedded in documents and their text anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelake.brand import DEFAULT, Brand
from lorelake.functions import text as tx

CONTEXT = 80
COMMENT = "struct<id:string,quote:string,comment:string,created_at:string,anchor:struct<start:int,end:int,prefix:string,suffix:string>>"
_FRONT = r"(?dms)\A---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*\r*(?:\n|\z)"


def _is_text(item: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING", F.lit(False))


def _is_whole(item: Column, path: str) -> Column:
    value = F.try_variant_get(item, path, "double")
    return F.coalesce(F.schema_of_variant(F.try_variant_get(item, path, "variant")).isin("BIGINT", "DECIMAL(1,0)", "DOUBLE")
                      & (value == F.floor(value)) & (value >= 0), F.lit(False))


def _comment(item: Column) -> Column:
    def text(path: str) -> Column:
        return F.try_variant_get(item, path, "string")

    anchor = F.struct(
        F.try_variant_get(item, "$.anchor.start", "int").alias("start"), F.try_variant_get(item, "$.anchor.end", "int").alias("end"),
        text("$.anchor.prefix").alias("prefix"), text("$.anchor.suffix").alias("suffix"))
    has_anchor = F.try_variant_get(item, "$.anchor", "variant").isNotNull()
    ok_anchor = ~has_anchor | (
        _is_whole(item, "$.anchor.start") & _is_whole(item, "$.anchor.end")
        & F.coalesce(anchor["end"] >= anchor["start"], F.lit(False))
        & _is_text(item, "$.anchor.prefix") & _is_text(item, "$.anchor.suffix"))
    valid = ok_anchor & _is_text(item, "$.id") & _is_text(item, "$.quote") & _is_text(item, "$.comment") & _is_text(item, "$.createdAt")
    return F.struct(
        valid.alias("valid"),
        F.struct(text("$.id").alias("id"), text("$.quote").alias("quote"), text("$.comment").alias("comment"),
                 text("$.createdAt").alias("created_at"), F.when(has_anchor, anchor).alias("anchor")).alias("c"))


def review_comments(docs: DataFrame, brand: Brand = DEFAULT) -> DataFrame:
    """One row per comment of a valid review block; an invalid block is one ``error`` row.

    Documents without a block give an empty list instead of being filtered: a filter on
    the parsed text would move below a repartition and parse whole files in one task.
    """
    content = F.col("content")
    opens = content.rlike(r"\A---[ \t]*\r?\n")
    front = F.when(opens, F.regexp_extract(content, _FRONT, 0)).otherwise(F.lit(""))
    # The marker is part of one line, so only documents that contain it are parsed.
    staged = docs.select("location_id", "relative_path", F.when(F.contains(content, F.lit(brand.review_marker)), content).alias("content"))
    staged = staged.withColumns({"_front": front, "_opens": opens})
    body = F.replace(F.substring(content, F.length("_front") + 1, F.length(content)), F.lit("\r\n"), F.lit("\n"))
    staged = staged.withColumn("_body", F.when(~(F.col("_opens") & (F.col("_front") == "")), body)).drop("content", "_front", "_opens")
    marked = staged.withColumn("_body", F.when(F.startswith("_body", F.lit(brand.review_marker)), F.col("_body")))
    head = brand.review_marker + "\n"
    rest = F.substring("_body", len(head) + 1, 1 << 30)
    close = F.locate("\n-->", F.col("_rest"))
    marked = marked.withColumn("_head", F.startswith("_body", F.lit(head))).withColumn("_rest", rest)
    marked = marked.withColumn("_payload", F.when(F.col("_head") & (close > 0), F.substring(F.col("_rest"), F.lit(1), close - 1)))
    parsed = marked.withColumn("_json", F.try_parse_json("_payload"))
    items = F.try_variant_get("_json", "$.comments", "array<variant>")
    is_list = F.startswith(F.schema_of_variant(F.try_variant_get("_json", "$.comments", "variant")), F.lit("ARRAY"))
    checked = parsed.withColumn("_items", F.when(is_list, F.transform(items, _comment)))
    error = (
        F.when(~F.col("_head"), "The review block has an invalid header.")
        .when(F.col("_payload").isNull(), "The review block is not closed.")
        .when(F.col("_items").isNull() | ~F.forall("_items", lambda i: i["valid"]),
              "The review block is invalid: Expected a comments array."))
    rows = checked.withColumn("error", F.when(F.col("_body").isNotNull(), error))
    none = F.lit(None).cast("string")
    listed = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit(None).cast(COMMENT).alias("c"), F.col("error").alias("error")))).when(
        F.col("_body").isNotNull(), F.transform("_items", lambda i: F.struct(i["c"].alias("c"), none.alias("error"))))
    found = rows.select("location_id", "relative_path", F.posexplode_outer(listed).alias("n", "r")).where("r IS NOT NULL")
    return found.select("location_id", "relative_path", F.when(F.col("r.error").isNull(), F.col("n")).alias("position"), "r.c.*", "r.error")


def occurrences(text: Column, quote: Column) -> Column:
    """0-based positions of the non-overlapping occurrences of a literal."""
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    sizes = F.transform(F.split(text, literal, -1), F.length)
    step = F.length(quote)
    scanned = F.aggregate(
        F.slice(sizes, F.lit(1), F.size(sizes) - 1),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n + step).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")))
    return F.when(F.contains(text, quote), scanned["out"]).otherwise(F.expr("cast(array() as array<int>)"))


def create_anchors(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Anchor of the occurrence nearest ``approximate_start``; null when the quote is absent."""
    joined = quotes.join(docs.select("location_id", "relative_path", tx.collapse_ws(F.col("body")).alias("_text")),
                         ["location_id", "relative_path"]).withColumn("_quote", tx.collapse_ws(F.col("quote")))
    found = F.when(F.col("_quote") != "", occurrences(F.col("_text"), F.col("_quote")))
    nearest = F.array_min(F.transform(found, lambda p: F.struct(F.abs(p - F.col("approximate_start")).alias("d"), p.alias("p"))))["p"]
    placed = joined.withColumn("start", nearest)
    end = F.col("start") + F.length("_quote")
    low = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    return placed.withColumns({
        "end": end, "prefix": F.substring(F.col("_text"), low + 1, F.col("start") - low),
        "suffix": F.substring(F.col("_text"), end + 1, F.lit(CONTEXT))}).drop("_text", "_quote")


def resolve_anchors(comments: DataFrame, docs: DataFrame) -> DataFrame:
    """Place every comment in the current text.

    Exact offset, unique occurrence, unique in both contexts, unique by prefix,
    unique by suffix, else detached.  Comments with columns ``quote`` and
    ``anchor``; adds ``start``, ``end`` and ``rule``.
    """
    text = docs.select("location_id", "relative_path", tx.collapse_ws(F.col("body")).alias("_text"))
    joined = comments.join(text, ["location_id", "relative_path"]).withColumn("_quote", tx.collapse_ws(F.col("quote")))
    joined = joined.withColumn("_at", F.when(F.col("_quote") != "", occurrences(F.col("_text"), F.col("_quote"))))
    anchor, size = F.col("anchor"), F.length("_quote")
    prefix, suffix = F.coalesce(anchor["prefix"], F.lit("")), F.coalesce(anchor["suffix"], F.lit(""))

    def cut(start: Column, length: Column) -> Column:
        return F.substring(F.col("_text"), start + 1, length)

    def before_ok(p: Column) -> Column:
        low = F.greatest(p - F.length(prefix), F.lit(0))
        return (prefix == "") | (cut(low, p - low) == prefix)

    def after_ok(p: Column) -> Column:
        return (suffix == "") | (cut(p + size, F.length(suffix)) == suffix)

    exact = F.when((anchor["start"] >= 0) & (cut(anchor["start"], size) == F.col("_quote")), anchor["start"])
    marked = joined.withColumn("_seen", F.transform(
        "_at", lambda p: F.struct(p.alias("p"), before_ok(p).alias("b"), after_ok(p).alias("a"))))

    def unique(keep) -> Column:
        kept = F.filter("_seen", keep)
        return F.when(F.size(kept) == 1, F.get(kept, F.lit(0))["p"])

    rules = [
        ("exact", exact), ("unique", F.when(F.size("_at") == 1, F.get("_at", F.lit(0)))),
        ("context", F.when(anchor.isNotNull(), unique(lambda s: s["a"] & s["b"]))),
        ("prefix", F.when(prefix != "", unique(lambda s: s["b"]))),
        ("suffix", F.when(suffix != "", unique(lambda s: s["a"]))),
    ]
    start, rule = F.coalesce(*[c for _, c in rules]), F.lit("detached")
    for name, column in reversed(rules):
        rule = F.when(column.isNotNull(), F.lit(name)).otherwise(rule)
    blank = F.col("_quote") == ""
    return marked.withColumns({
        "start": F.when(~blank, start), "rule": F.when(blank, F.lit("detached")).otherwise(rule)}).withColumn(
        "end", F.col("start") + size).drop("_text", "_quote", "_at", "_seen")


def review_handoff(comments: DataFrame, brand: Brand = DEFAULT) -> DataFrame:
    """Handoff text per document; a document is at most 8 MiB, so are its comments."""
    entry = F.concat(
        F.lit('<comment id="'), tx.escape_xml_attribute(F.col("id")), F.lit('">\n<quote>'), tx.escape_xml(F.col("quote")),
        F.lit("</quote>\n<feedback>"), tx.escape_xml(F.col("comment")), F.lit("</feedback>\n</comment>"))
    grouped = comments.where("error IS NULL").groupBy("location_id", "relative_path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))), lambda s: s["e"]), "\n\n").alias("entries"))
    text = F.concat(
        F.lit(f"Review the following Markdown document and address every open {brand.name} review comment.\n\nFile: "),
        "relative_path", F.lit("\n\n<review-comments>\n"), "entries", F.lit(
            f"\n</review-comments>\n\nThe comments are also embedded in the document's {brand.slug}-review:v1 block.\n"
            "Update the document itself. Remove comments you addressed from that block and preserve unresolved comments."))
    return grouped.select("location_id", "relative_path", text.alias("text"))

"""Inline Markdown as regular expressions over the blocks of ``functions.blocks``.

Nothing is shuffled: every expression works inside one document row.  Known
gaps against a full CommonMark parser: character entities, a link label that
holds quote markers of its own lines, and table cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorelake.functions import blocks as bl
from lorelake.functions.text import let

FENCED = (
    r"(?dms)^ {0,3}(`{3,})[^`\n]*(?:\n.*?(?:^ {0,3}\1`*[ \t\r]*$|\z)|\z)"
    r"|^ {0,3}(~{3,})[^\n]*(?:\n.*?(?:^ {0,3}\2~*[ \t\r]*$|\z)|\z)"
    r"|<!--.*?-->"
)
CODE_SPAN = r"(?s)(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"

_CONTAINERS = r"^(?:[ \t]*>[ \t]?|[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+)*+[ \t]*"

_RUN = r"(?:[^\[\]\\]++|\\[\s\S])"
_INNER = r"!\[[^\[\]]*\](?:\([^()\s]*\))?|\[[^\[\]]*\](?![(\[])"
_LABEL = rf"(?:[^\[\]\\!]++|\\[\s\S]|{_INNER}|!)*+"
_DEST = r"(?:<[^<>\n]*>|(?:[^\s()\\<]++|\\.|\((?:[^\s()\\]++|\\.)*\))*)"
_GAP = r"[ \t]*\n?[ \t]*"
_TITLE = r"(?:(?:[ \t]+\n?|\n)[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?"
INLINE_LINK = rf"!?\[{_LABEL}\]\({_GAP}({_DEST}){_TITLE}{_GAP}\)"
FULL_REFERENCE = rf"!?\[({_LABEL})\]\[([^\[\]]*)\]"
SHORT_REFERENCE = rf"!?\[({_RUN}+)\]"
URI_AUTOLINK = r"<[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*>"
MAIL_AUTOLINK = r"<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@[A-Za-z0-9.\-]+>"
LINK = rf"(?<!\\)(?:{INLINE_LINK}|{FULL_REFERENCE}|{SHORT_REFERENCE}|{URI_AUTOLINK}|{MAIL_AUTOLINK})"
DEFINITION = rf"(?dm)^ {{0,3}}\[(?!\^)({_RUN}+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s]+)"

_ESCAPE = r"\\([!-/:-@\[-`{-~])"


def without_blocks(body: Column) -> Column:
    """Body with fenced and indented code, HTML blocks and comments blanked."""
    fenced = F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")) | F.contains(body, F.lit("<!--"))
    return bl.without_literals(F.when(fenced, bl.blank_out(body, FENCED)).otherwise(body))


_HEADED = r"#|\n[> \t]*(?:=+|-+)[ \t\r]*\z"


def marked_blocks(text: Column) -> Column:
    """``blocks.inline_blocks`` of a body without literals, of blocks that can hold a heading or link.

    A definition may take its target from the block behind it, so with definitions all blocks stay.
    """
    marked = text.rlike(r"(?dm)[\[<#]|^[> \t]*(?:=+|-+)[ \t\r]*$")
    useful = let(bl.inline_blocks(text), lambda blocks: F.when(F.contains(text, F.lit("]:")), blocks).otherwise(
        F.filter(blocks, lambda b: (b["text"] != "") & b["text"].rlike(rf"[\[<]|{_HEADED}"))))
    return F.when(marked, useful).otherwise(F.expr("cast(array() as array<struct<line:int,text:string>>)"))


def without_code(blocks: Column) -> Column:
    """Blocks with their code spans blanked; a span may run over lines, never into the next block."""
    return F.transform(blocks, lambda b: F.struct(b["line"].alias("line"), F.when(
        F.contains(b["text"], F.lit("`")), bl.blank_out(b["text"], CODE_SPAN)).otherwise(b["text"]).alias("text")))


# A heading without such a character or run is its own text.
_INLINE = r"[\[<*_~`\"'\\]|\.\.\.|--"


def inline_text(raw: Column) -> Column:
    """Visible text of one heading: markup dropped, code kept."""
    return let(raw, lambda r: F.when(r.rlike(_INLINE), _marked_text(r)).otherwise(r))


def _marked_text(raw: Column) -> Column:
    text = F.regexp_replace(raw, r"!?\[((?:[^\[\]\\]++|\\.|!?\[[^\[\]]*\](?:\([^()\s]*\))?)*+)\]\([^()]*\)", "$1")
    text = F.regexp_replace(text, r"!?\[([^\[\]]*)\]\([^()]*\)", "$1")
    text = F.regexp_replace(text, r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*)>", "$1")
    text = F.regexp_replace(text, r"</?[A-Za-z][^<>]*>", "")
    text = F.regexp_replace(text, r"(?s)(\*{1,3})(?=\S)(.+?)(?<=\S)\1", "$2")
    text = F.regexp_replace(text, r"(?s)(?<![\p{L}\p{N}])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?![\p{L}\p{N}])", "$2")
    text = F.regexp_replace(text, r"(?s)~~(?=\S)(.+?)(?<=\S)~~", "$1")
    return F.regexp_replace(let(text, _typeset), _ESCAPE, "$1")


def _typeset(text: Column) -> Column:
    """Curly quotes, dashes and ellipses, unless there is code; its marks are dropped."""
    smart = F.regexp_replace(text, r"(^|[\s(\[{])\"", "$1“")
    smart = F.replace(smart, F.lit('"'), F.lit("”"))
    smart = F.regexp_replace(smart, r"(^|[\s(\[{])'", "$1‘")
    smart = F.replace(smart, F.lit("'"), F.lit("’"))
    for plain, fancy in (("...", "…"), ("---", "—"), ("--", "–")):
        smart = F.replace(smart, F.lit(plain), F.lit(fancy))
    return F.when(F.contains(text, F.lit("`")), F.regexp_replace(text, "`+", "")).otherwise(smart)


def _heading(text: Column) -> Column:
    """Level and text of a block that is a heading, else level null."""
    first = F.substring_index(text, "\n", 1)
    last = F.substring_index(text, "\n", -1)
    quoted, item = first.rlike(bl.QUOTE), first.rlike(bl.ITEM)
    underlined = F.contains(text, F.lit("\n")) & (
        F.when(quoted, last.rlike(r"^(?: {0,3}>[ ]?)+ {0,3}(?:=+|-+)[ \t\r]*$"))
        .when(item, last.rlike(r"^[ \t]{2,}(?:=+|-+)[ \t\r]*$"))
        .otherwise(last.rlike(r"^ {0,3}(?:=+|-+)[ \t\r]*$")))
    inner = F.regexp_replace(text, _CONTAINERS, "")

    def read(s: Column) -> Column:
        return let(F.length(F.regexp_extract(s["inner"], r"^(#{1,6})(?:[ \t]|\r?$)", 1)), lambda hashes: shape(s, hashes))

    def shape(s: Column, hashes: Column) -> Column:
        atx_raw = F.regexp_replace(F.regexp_replace(s["inner"], r"^#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t\r]*$", "")
        lines = F.regexp_replace(F.regexp_replace(s["inner"], r"\n[^\n]*$", ""), r"[ \t\r]*\n[ \t>]*", "\n")
        level = F.when(hashes > 0, hashes).when(s["underlined"], F.when(s["last"].rlike(r"=[ \t\r]*$"), 1).otherwise(2))
        raw = F.regexp_replace(F.when(hashes > 0, atx_raw).otherwise(lines), r"[ \t]*\{[^{}]*\}[ \t\r]*$", "")
        # A line break inside a heading is no text, so the words at both of its sides touch.
        visible = F.replace(F.regexp_replace(inline_text(raw), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(""))
        return F.struct(level.cast("tinyint").alias("level"), F.when(level.isNotNull(), visible).alias("text"))

    return let(F.struct(inner.alias("inner"), underlined.alias("underlined"), last.alias("last")), read)


def headings(blocks: Column) -> Column:
    """ARRAY<STRUCT<level, text>> of the non-empty headings among the blocks."""
    shaped = F.filter(blocks, lambda b: b["text"].rlike(_HEADED))
    return F.filter(F.transform(shaped, lambda b: _heading(b["text"])), lambda h: h["level"].isNotNull() & (h["text"] != ""))


def label_key(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def definitions(text: Column) -> Column:
    """ARRAY<STRUCT<label, target>> of link reference definitions, in order."""
    found = F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(0))
    return F.when(
        F.contains(text, F.lit("]:")),
        F.transform(
            found,
            lambda m: F.struct(
                label_key(F.regexp_extract(m, DEFINITION, 1)).alias("label"),
                F.regexp_extract(m, DEFINITION, 2).alias("target"),
            ),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<label:string,target:string>>)"))


def destination(raw: Column) -> Column:
    bare = let(raw, lambda r: F.when(r.rlike("^<.*>$"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r))
    return F.regexp_replace(bare, _ESCAPE, "$1")


def link_target(match: Column, defs: Column) -> Column:
    """Target of one LINK match, or null when it is no link."""
    anchored = {name: f"^{pattern}$" for name, pattern in (
        ("inline", INLINE_LINK), ("full", FULL_REFERENCE), ("short", SHORT_REFERENCE))}

    def lookup(label: Column) -> Column:
        return F.get(F.filter(defs, lambda d: d["label"] == label_key(label)), F.lit(0))["target"]

    full_label = F.regexp_extract(match, anchored["full"], 2)
    text_label = F.regexp_extract(match, anchored["full"], 1)
    reference = F.when(F.trim(full_label) == "", lookup(text_label)).otherwise(lookup(full_label))
    return (
        F.when(F.startswith(match, F.lit("!")), F.lit(None))
        .when(F.startswith(match, F.lit("<")), F.substring(match, F.lit(2), F.length(match) - 2))
        .when(match.rlike(anchored["inline"]), destination(F.regexp_extract(match, anchored["inline"], 1)))
        .when(match.rlike(anchored["full"]), destination(reference))
        .otherwise(destination(lookup(F.regexp_extract(match, anchored["short"], 1))))
    )

"""Block structure of Markdown: which lines are literal, and which lines belong together.

Both steps work inside one document row, without a shuffle.  ``without_literals``
is one fold over the lines of those documents that can hold literal blocks; its
state is the stack of list items, an open paragraph, fence or HTML block, and it
grows by one number where a literal stretch begins or ends.  Documents whose only
literal blocks are indented code need no fold.  ``inline_blocks`` then cuts the
text where inline markup may not continue.

Null text gives null blocks, empty text gives none.  Lines end at ``\\n``; all
line numbers count from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorelake.functions.text import let

# Element names of the public CommonMark specification that open an HTML block.
HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
)
RAW_NAMES = "pre|script|style|textarea"

ITEM = r"^[ \t]*(?:[-*+]|\d{1,9}[.)])(?=[ \t]|\r?$)"
RULE = r"^[ \t]*(?:(?:\*[ \t]*+){3,}|(?:_[ \t]*+){3,}|(?:-[ \t]*+){3,})\r?$"
UNDERLINE = r"^[ \t]*(?:=+|-+)[ \t\r]*$"
QUOTE = r"^(?: {0,3}>[ ]?)+"
ATX = r"^[ \t]*#{1,6}(?:[ \t]|\r?$)"

_FENCE = r"^(`{3,}(?=[^`]*$)|~{3,})"
_RAW_OPEN = rf"(?i)^ *<(?:{RAW_NAMES})(?:[\s>]|$)"
_RAW_CLOSE = rf"(?i)</(?:{RAW_NAMES})>"
_HTML_OPEN = rf"(?i)^ *</?(?:{HTML_NAMES.replace(' ', '|')})(?:\s|/?>|$)"
_TAG_LINE = r"^ *(?:<[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"
# A document without such a line has no literal blocks beside top-level fences.
_MAYBE_LITERAL = r"(?dm)^[> ]*(?: {4}|\t)[ \t]*[^\s]|^[> ]*</?[A-Za-z]|^[> ]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?:`{3}|~{3})"
# Without such a line or character only blank lines and indentation decide what is indented code.
_STRUCTURED = (
    r"(?dm)\n *(?:[>#<]|(?:[-*+]|\d{1,9}[.)])(?: |$)|(?:=+|-+) *$"
    r"|(?:\* *+){3}|(?:_ *+){3}|(?:- *+){3}|`{3}|~{3})"
)
_OTHER_SPACE = "\t\r\u0085\u2028\u2029"
# One line of indented code: at the top, after a blank line or after another one.
_INDENTED = r"(?d)(?=[ \n])(?:\A|(?m:^) *\n|\G(?<=\n)) {4,}[^ \n][^\n]*(?:\n|\z)"
# Other lines have no marker, rule, heading, quote, fence or tag.
_FEATURED = r"\t|^ *(?:[>#<=*_+`~\-]|\d)|</"
_MARKED_LINE = r"^\s*$|^[ \t]*(?:[>#=*_+\-\[]|\d)"

_STATE = (
    "named_struct('stack', cast(array() as array<int>), 'para', false, 'fence', '', 'html', '', 'quote', false, "
    "'masked', false, 'i', 0, 'at', cast(array() as array<int>))"
)


def around(text: Column, pattern: str) -> Column:
    """Stretches of the text in order: at odd places the matches, at even ones what lies between them.

    ``split`` compiles its pattern for every text, ``regexp_replace`` once; only a text that holds the joint is split by the pattern.
    """
    joint = "\x1d"
    pairs = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.array(p, m)))
    return F.when(F.contains(text, F.lit(joint)), F.slice(pairs, F.lit(1), F.size(pairs) - 1)).otherwise(
        F.split(F.regexp_replace(text, pattern, f"{joint}$0{joint}"), joint, -1))


def blank_out(text: Column, pattern: str) -> Column:
    """Replace matches by spaces, keeping line breaks and every offset."""
    return F.array_join(F.transform(
        around(text, pattern), lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def _line_features(line: Column) -> Column:
    """Features of one line; most lines have none beside their indentation."""
    none = F.struct(
        F.lit(False).alias("quote"), (F.rtrim(F.replace(line, F.lit("\r"), F.lit(""))) == "").alias("blank"),
        (F.length(line) - F.length(F.ltrim(line))).alias("indent"), F.lit(False).alias("item"), F.lit(1).alias("content"),
        F.trim(line).alias("rest"), F.lit(False).alias("closed"), F.lit("").alias("fence"), F.lit("").alias("html"),
        F.lit(False).alias("raw_end"))
    return F.when(line.rlike(_FEATURED), _marked_features(line)).otherwise(none)


def _marked_features(line: Column) -> Column:
    quote = line.rlike(QUOTE)
    inner = F.replace(F.regexp_replace(line, QUOTE, ""), F.lit("\t"), F.lit("    "))

    def look(s: Column) -> Column:
        t, marker = s["t"], F.length(F.regexp_extract(s["t"], ITEM, 0))
        ruled = t.rlike(RULE)
        content = F.length(F.regexp_extract(t, r"^ *(?:[-*+]|\d{1,9}[.)]) {1,4}(?=\S)", 0))
        item = (marker > 0) & ~ruled
        rest = F.when(item, F.ltrim(F.substring(t, marker + 1, F.length(t)))).otherwise(F.ltrim(t))
        return F.struct(
            s["quote"].alias("quote"), (F.rtrim(F.replace(t, F.lit("\r"), F.lit(""))) == "").alias("blank"),
            (F.length(t) - F.length(F.ltrim(t))).alias("indent"), item.alias("item"),
            F.when(content > 0, content).otherwise(marker + 1).alias("content"), F.trim(rest).alias("rest"),
            (ruled | rest.rlike(ATX) | t.rlike(UNDERLINE)).alias("closed"),
            F.regexp_extract(F.trim(rest), _FENCE, 1).alias("fence"),
            F.when(t.rlike(_RAW_OPEN), "raw").when(t.rlike(_HTML_OPEN), "block").when(t.rlike(_TAG_LINE), "tag").otherwise("").alias("html"),
            t.rlike(_RAW_CLOSE).alias("raw_end"),
        )

    return let(F.struct(quote.alias("quote"), inner.alias("t")), look)


def _last(stack: Column) -> Column:
    return F.coalesce(F.get(stack, F.size(stack) - 1), F.lit(0))


def _advance(state: Column, x: Column) -> Column:
    """State after one line; ``masked`` tells whether the line is literal."""
    top = (F.size(state["stack"]) == 0) & (state["fence"] == "") & (state["html"] == "") & ~state["quote"]
    flat = ~x["quote"] & ~x["item"] & (x["fence"] == "") & (x["html"] == "")
    return F.when(top & flat, _advance_flat(state, x)).otherwise(_advance_nested(state, x))


def _advance_flat(state: Column, x: Column) -> Column:
    """``_advance_nested`` outside of items, quotes, fences and HTML: only blank lines, headings and indentation count."""

    def after(code: Column) -> Column:
        masked = F.when(x["blank"], state["masked"]).otherwise(code)
        return F.struct(
            state["stack"].alias("stack"), (~x["blank"] & ~code & ~x["closed"] & (x["rest"] != "")).alias("para"),
            F.lit("").alias("fence"), F.lit("").alias("html"), F.lit(False).alias("quote"), masked.alias("masked"),
            (state["i"] + 1).alias("i"),
            F.when(masked != state["masked"], F.concat(state["at"], F.array(state["i"]))).otherwise(state["at"]).alias("at"))

    return let(~x["blank"] & ~state["para"] & (x["indent"] >= 4), after)


def _advance_nested(state: Column, x: Column) -> Column:
    lazy = state["para"] & ~x["blank"] & ~x["item"]
    moved = (x["quote"] != state["quote"]) & ~(lazy & ~x["quote"])
    before = F.struct(
        F.when(moved, F.expr("cast(array() as array<int>)")).otherwise(state["stack"]).alias("stack"),
        (state["para"] & ~moved).alias("para"),
        F.when(moved, "").otherwise(state["fence"]).alias("fence"),
        F.when(moved, "").otherwise(state["html"]).alias("html"),
    )

    def settle(b: Column) -> Column:
        in_fence = (b["fence"] != "") & (x["blank"] | (x["indent"] >= _last(b["stack"])))
        in_html = (b["html"] != "") & ((b["html"] == "raw") | ~x["blank"])
        stack = F.when(x["blank"] | (b["para"] & ~x["item"] & (x["indent"] < _last(b["stack"]))), b["stack"]).otherwise(
            F.filter(b["stack"], lambda w: w <= x["indent"]))
        return let(F.struct(in_fence.alias("in_fence"), in_html.alias("in_html"), stack.alias("stack")), lambda s: open_up(b, s))

    def open_up(b: Column, s: Column) -> Column:
        inside = s["in_fence"] | s["in_html"]
        near = x["indent"] < _last(s["stack"]) + 4
        code = ~inside & ~x["blank"] & ~b["para"] & ~near
        return let(F.struct(
            inside.alias("inside"), code.alias("code"), (~inside & near & x["item"]).alias("item"),
            (~inside & near & (x["fence"] != "")).alias("fence"),
            (~inside & near & (x["html"] != "") & ~((x["html"] == "tag") & b["para"])).alias("html")), lambda o: after(b, s, o))

    def after(b: Column, s: Column, o: Column) -> Column:
        ends = F.startswith(x["rest"], b["fence"]) & x["rest"].rlike(r"^(?:`{3,}|~{3,})\r?$")
        fence = F.when(s["in_fence"], F.when(ends, "").otherwise(b["fence"])).when(o["fence"], x["fence"]).otherwise("")
        html = (
            F.when(s["in_fence"], "")
            .when(s["in_html"], F.when((b["html"] == "raw") & x["raw_end"], "").otherwise(b["html"]))
            .when(o["html"] & ~((x["html"] == "raw") & x["raw_end"]), F.when(x["html"] == "raw", "raw").otherwise("block"))
            .otherwise("")
        )
        masked = F.when(x["blank"], state["masked"]).otherwise(o["inside"] | o["code"] | o["html"] | (o["fence"] & ~o["item"]))
        plain = ~o["inside"] & ~x["blank"] & ~o["code"] & ~o["fence"] & ~o["html"] & ~x["closed"] & (x["rest"] != "")
        return F.struct(
            F.when(o["item"], F.concat(s["stack"], F.array(x["content"]))).otherwise(s["stack"]).alias("stack"),
            plain.alias("para"), fence.alias("fence"), html.alias("html"),
            F.when(x["blank"], state["quote"] & x["quote"]).otherwise(x["quote"]).alias("quote"), masked.alias("masked"),
            (state["i"] + 1).alias("i"),
            F.when(masked != state["masked"], F.concat(state["at"], F.array(state["i"]))).otherwise(state["at"]).alias("at"),
        )

    return let(before, settle)


def _blank_stretches(lines: Column, at: Column) -> Column:
    """Text of the lines with every second stretch between the bounds ``at`` blanked."""

    def rebuild(bounds: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda j: F.struct(
            (j % 2 == 1).alias("literal"), F.get(bounds, j).alias("a"), F.get(bounds, j + 1).alias("b")))
        texts = F.transform(F.filter(stretches, lambda s: s["b"] > s["a"]), lambda s: F.struct(
            s["literal"].alias("literal"), F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), "\n").alias("text")))
        return F.array_join(F.transform(texts, lambda s: F.when(
            s["literal"], F.regexp_replace(s["text"], r"[^\n]", " ")).otherwise(s["text"])), "\n")

    return let(F.concat(F.array(F.lit(0)), at, F.array(F.size(lines))), rebuild)


def without_literals(text: Column) -> Column:
    """Blank indented code, fences inside list items and HTML blocks; line breaks and offsets stay."""

    def work(lines: Column) -> Column:
        marks = F.aggregate(F.transform(lines, _line_features), F.expr(_STATE), _advance, lambda s: s["at"])
        return _blank_stretches(lines, marks)

    def spaced(t: Column) -> Column:
        return reduce(lambda seen, c: seen | F.contains(t, F.lit(c)), _OTHER_SPACE, F.lit(False))

    return let(text, lambda t: F.when(~t.rlike(_MAYBE_LITERAL), t)
               .when(~(spaced(t) | F.concat(F.lit("\n"), t).rlike(_STRUCTURED)), blank_out(t, _INDENTED))
               .otherwise(let(F.split(t, "\n", -1), work)))


def _line_marks(line: Column) -> Column:
    def alike(mark: bool) -> Column:
        return F.struct(F.lit(False).alias("quote"), F.lit(mark).alias("opens"), F.lit(mark).alias("closes"))

    return F.when(F.trim(line) == "", alike(True)).when(line.rlike(_MARKED_LINE), _full_line_marks(line)).otherwise(alike(False))


def _full_line_marks(line: Column) -> Column:
    inner = F.regexp_replace(line, QUOTE, "")

    def look(s: Column) -> Column:
        t = s["t"]
        blank = t.rlike(r"^\s*$")
        alone = blank | t.rlike(ATX) | t.rlike(r"^ {0,3}\[(?!\^)(?:[^\[\]\\]++|\\.)+\]:")
        dashes = t.rlike(UNDERLINE)
        item = t.rlike(ITEM) & ~t.rlike(r"^[ \t]*-+[ \t\r]*$")
        return F.struct(
            s["quote"].alias("quote"),
            (alone | (~dashes & (item | t.rlike(RULE)))).alias("opens"),
            (alone | dashes | t.rlike(RULE)).alias("closes"),
        )

    return let(F.struct(line.rlike(QUOTE).alias("quote"), inner.alias("t")), look)


def inline_blocks(text: Column) -> Column:
    """ARRAY<STRUCT<line, text>>: consecutive lines over which inline markup may run.

    A block ends before a blank line, heading, list item, rule, quote or link
    definition and after a heading, its underline, a rule or a definition.  Joined
    by line breaks the blocks are the whole text.
    """

    def opens(marks: Column) -> Column:
        def look(m: Column, before: Column) -> Column:
            return m["opens"] | before["closes"] | (m["quote"] & ~before["quote"])

        return F.transform(marks, lambda m, i: F.when(i == 0, False).otherwise(look(m, F.get(marks, i - 1))))

    def cut(lines: Column) -> Column:
        return let(let(F.transform(lines, _line_marks), opens), lambda bounds: pieces(lines, bounds))

    def pieces(lines: Column, bounds: Column) -> Column:
        # An empty line is a block of its own, so an empty line between blocks parts them and nothing else.
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.get(bounds, i))
        joined = F.array_join(F.zip_with(lines, bounds, lambda v, b: F.when(b, F.concat(F.lit("\n"), v)).otherwise(v)), "\n")
        return F.zip_with(starts, F.split(joined, "\n\n", -1), lambda at, t: F.struct(at.alias("line"), t.alias("text")))

    return let(F.split(text, "\n", -1), cut)

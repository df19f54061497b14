"""Golden rows of whole-document inspection."""

import time

from pyspark.sql import functions as F

from lorelake.functions import blocks as bl
from lorelake.operators import graph as gr
from lorelake.operators import inspect as ins

DEMO = [
    ("v01", "index.md", "---\nokf_version: 0.1\n---\n# Old bundle\n"),
    ("v01", "concepts/a.md", "---\ntype: Knowledge Map\ntags: [one, agents]\ntimestamp: 2026-07-20\nowner: Someone\n---\n# A\n"),
    ("v02", "index.md", "---\nokf_version: 0.2\n---\n# Now\n\n- [Revenue](concepts/revenue.md)\n- [Customer](concepts/customer.md)\n"),
    ("v02", "concepts/revenue.md",
     "---\ntype: Metric\ntitle: Revenue\nstale_after: 2026-12-31\ngenerated:\n  by: process:f\n  at: 2026-07-25T12:00:00Z\nverified:\n  - by: human:x\n"
     "sources:\n  - id: p\n    resource: https://example.com/p\ndomain:\n  critical: true\n  owners:\n    - team: fin\n      priority: 1\n---\n# Revenue\n\nTo a [customer](./customer.md).\n"),
    ("v02", "concepts/customer.md",
     "---\ntype: Entity\ntags:\n  - crm\nverified: { by: process:n, at: 2026-07-25T02:00:00Z }\n---\n# Customer\n\nSee [gone](./missing.md).\n"),
    ("future", "concept.md", "---\ntype: Future\nokf_version: 0.9\n---\n# F\n"),
    ("partial", "missing.md", "---\ntitle: T\ncustom:\n  nested: true\n---\n# M\n"),
    ("partial", "malformed.md", "---\ntype: Broken\nnested: [one, two\n---\n# Still\n"),
    ("partial", "plain.md", "# Nothing\n"),
    ("partial", "open.md", "---\ntype: X\n# never closed\n"),
    ("partial", "list.md", "---\n- a\n---\n"),
    ("partial", "empty.md", "---\n---\nx"),
    ("partial", "odd.md", "---\ntype: 5\ntags: [a, 1]\n1: 2\ntitle: [x]\n---\n"),
    ("partial", "tagmap.md", "---\ntype: T\ntags: {a: 1}\nstatus: odd\n---\n"),
    ("partial", "dup.md", "---\ntype: T\ntype: U\n---\n"),
    ("partial", "docs/log.md", "---\ntype: Log\n---\n# Log\n"),
    ("partial", "docs/index.md", "---\nokf_version: 0.1\n---\n# Not root\n"),
    ("partial", "deep.md", "---\ntype: T\nv: " + "[" * 70 + "]" * 70 + "\n---\n"),
]

EXPECTED = {
    ("v01", "index.md"): set(), ("v01", "concepts/a.md"): set(), ("v02", "index.md"): set(),
    ("v02", "concepts/revenue.md"): set(), ("v02", "concepts/customer.md"): set(),
    ("future", "concept.md"): {"OKF_VERSION_UNSUPPORTED"},
    ("partial", "missing.md"): {"OKF_TYPE_REQUIRED"},
    ("partial", "malformed.md"): {"OKF_YAML_INVALID", "OKF_TYPE_REQUIRED"},
    ("partial", "plain.md"): {"OKF_FRONTMATTER_REQUIRED"},
    ("partial", "open.md"): {"OKF_FRONTMATTER_UNCLOSED", "OKF_TYPE_REQUIRED"},
    ("partial", "list.md"): {"OKF_FRONTMATTER_NOT_MAPPING", "OKF_TYPE_REQUIRED"},
    ("partial", "empty.md"): {"OKF_TYPE_REQUIRED"},
    ("partial", "odd.md"): {"OKF_TYPE_INVALID", "OKF_TITLE_INVALID", "OKF_TAG_ITEM_INVALID", "OKF_METADATA_KEY_INVALID", "OKF_TYPE_REQUIRED"},
    ("partial", "tagmap.md"): {"OKF_TAGS_INVALID", "OKF_STATUS_UNKNOWN"},
    ("partial", "dup.md"): {"OKF_YAML_INVALID", "OKF_TYPE_REQUIRED"},
    ("partial", "docs/log.md"): {"OKF_LOG_FRONTMATTER", "OKF_LOG_DATE_HEADING_REQUIRED"},
    ("partial", "docs/index.md"): {"OKF_INDEX_FRONTMATTER"},
    ("partial", "deep.md"): {"OKF_YAML_DEPTH_EXCEEDED", "OKF_TYPE_REQUIRED"},
}


def corpus(spark, rows):
    return spark.createDataFrame(
        [(loc, f"/data/{loc}", path, text) for loc, path, text in rows],
        "location_id string, root_path string, relative_path string, content string")


def test_golden_codes(spark):
    inspected = ins.inspect(corpus(spark, DEMO))
    rows = inspected.select("location_id", "relative_path", F.transform("findings", lambda f: f["code"]).alias("c"), "is_conformant", "parsed.line").collect()
    assert {(r.location_id, r.relative_path): set(r.c) for r in rows} == EXPECTED
    by_path = {r.relative_path: r for r in rows}
    assert by_path["malformed.md"].line == 4
    assert not by_path["missing.md"].is_conformant and by_path["concept.md"].is_conformant


def test_metadata_and_links(spark):
    inspected = ins.inspect(corpus(spark, DEMO))
    docs = {(r.location_id, r.relative_path): r for r in ins.documents(inspected).collect()}
    revenue = docs["v02", "concepts/revenue.md"]
    assert revenue.timestamp == "2026-07-25T12:00:00Z" and revenue.trust_tier == "humanReviewed"
    assert revenue.metadata_text.endswith("domain critical true owners team fin priority 1")
    assert docs["v02", "concepts/customer.md"].trust_tier == "machineConfirmed"
    assert docs["v01", "concepts/a.md"].timestamp == "2026-07-20"
    assert docs["v01", "index.md"].okf_version == "0.1"
    links = gr.resolve_links(ins.links_table(inspected), corpus(spark, DEMO))
    broken = gr.broken_links(links).select("location_id", "relative_path").collect()
    assert [tuple(r) for r in broken] == [("v02", "concepts/customer.md")]


TRICKY = """---
type: T
resource: ../../../etc
executor: {resource: run.md}
sources:
  - resource: ../q.md
  - {resource: 5}
  - note: none
---
<!-- workspace-review:v1
[hid](h.md)
-->
Text [a](<b c.md> "t") and ![img](i.png) [![alt](i.png)](t.md) and [ref][Foo Bar] [foo bar] [nope] `[code](c.md)` <http://x.y/z>

Title *one* `two`
====

```
[f](g.md)
# no
```
## Its [x](y%20z.md#frag) ##
- [ ] [task](/root.md?x#f)
[frag](#here) \\[esc](e.md) [see [in](in.md)]

<!-- [comment](z.md) -->
[foo bar]: ../zz.md
"""


def test_markdown_links(spark):
    rows = ins.links_table(ins.inspect(corpus(spark, [("x", "a/b.md", TRICKY)]))).orderBy("position").collect()
    assert [(r.target, r.target_relative_path, r.fragment, r.status, r.field) for r in rows] == [
        ("b c.md", "a/b c.md", None, "candidate", None), ("t.md", "a/t.md", None, "candidate", None),
        ("../zz.md", "zz.md", None, "candidate", None), ("../zz.md", "zz.md", None, "candidate", None),
        ("http://x.y/z", None, None, "external", None), ("y%20z.md#frag", "a/y z.md", "frag", "candidate", None),
        ("/root.md?x#f", "root.md", "f", "candidate", None), ("#here", "a/b.md", "here", "fragment", None),
        ("in.md", "a/in.md", None, "candidate", None), ("../../../etc", None, None, "outsideBundle", "resource"),
        ("run.md", "a/run.md", None, "candidate", "executor.resource"),
        ("../q.md", "q.md", None, "candidate", "sources[0].resource"), ("5", "a/5", None, "candidate", "sources[1].resource")]
    assert rows[0].start_line == 13 and rows[0].start_column == 6


def test_headings(spark):
    row = ins.inspect(corpus(spark, [("x", "a/b.md", TRICKY)])).select("headings").first()
    assert [(h.level, h.text) for h in row.headings] == [(1, "Title one two"), (2, "Its x")]


def test_hot_document_sizes(spark):
    """Long labels, many brackets and an unclosed fence do not overflow the expressions."""
    text = "---\ntype: T\n---\n" + "[" * 3000 + "\n" + "word " * 40000 + "\n```\n" + "[a](b.md)\n" * 3000
    row = ins.inspect(corpus(spark, [("x", "big.md", text)])).select(F.size("links").alias("n")).first()
    assert row.n == 0


def test_format_value(spark):
    df = spark.sql("select parse_json('\"x\"') a, parse_json('{\"k\": [1, true]}') b")
    row = df.select(ins.format_value(F.col("a")).alias("a"), ins.format_value(F.col("b")).alias("b")).first()
    assert row.a == "x" and row.b == '{"k":[1,true]}'


WRAPPED = [
    # (body, links as (target, line, column, end line, end column), headings)
    ("See [a long\nlabel](x.md) end", [("x.md", 1, 5, 2, 13)], []),
    ("[a](\nx.md\n'title') [b](y.md\n\"t\nu\")", [("x.md", 1, 1, 3, 9), ("y.md", 3, 10, 5, 4)], []),
    ("[a\n\nb](x.md)", [], []),
    ("[a\n# b](x.md)", [], [(1, "b](x.md)")]),
    ("[a\n- b](x.md) [c](d.md)", [("d.md", 2, 12, 2, 21)], []),
    ("`code [a](x.md)\nmore` [b](y.md)", [("y.md", 2, 7, 2, 16)], []),
    ("`open\n\n[a](x.md)`", [("x.md", 3, 1, 3, 10)], []),
    ("[full\ntext][the\nref]\n\n[the ref]: x.md", [("x.md", 1, 1, 3, 5)], []),
    ("text\n    [lazy](x.md)\n\n    [code](y.md)\n\n\t[code](z.md)\n", [("x.md", 2, 5, 2, 17)], []),
    ("# H\n    [code](y.md)\n[a](b.md)", [("b.md", 3, 1, 3, 10)], [(1, "H")]),
    ("- item\n\n  [in](a.md)\n\n      [code](b.md)\n\n    [text](c.md)\n\n[out](d.md)",
     [("a.md", 3, 3, 3, 13), ("c.md", 7, 5, 7, 17), ("d.md", 9, 1, 9, 12)], []),
    ("- a\n  - b\n\n    [in b](a.md)\n\n        [code](c.md)\n\n  [in a](b.md)\n\n      [code](d.md)",
     [("a.md", 4, 5, 4, 17), ("b.md", 8, 3, 8, 15)], []),
    ("1. one\n\n    ```\n    [code](a.md)\n    # no\n    ```\n\n   [b](b.md)", [("b.md", 8, 4, 8, 13)], []),
    ("<div>\n[raw](a.md)\n# raw\n</div>\n\n[b](b.md)", [("b.md", 6, 1, 6, 10)], []),
    ("<pre>\n[raw](a.md)\n\n[raw](a.md)\n</pre>\n[b](b.md)", [("b.md", 6, 1, 6, 10)], []),
    ("text <b>[a](a.md)</b>\n<http://x.y/z> [c](c.md)", [("a.md", 1, 9, 1, 18), ("http://x.y/z", 2, 1, 2, 15), ("c.md", 2, 16, 2, 25)], []),
    ("Two line\nheading\n===\nthen\nthree\nlines\n---\n", [], [(1, "Two lineheading"), (2, "thenthreelines")]),
    ("> quoted [a\n> b](x.md)\nlazy [c](y.md)\n\n> # Q\n> text\n> ---\n", [("x.md", 1, 10, 2, 11), ("y.md", 3, 6, 3, 15)], [(1, "Q"), (2, "text")]),
    ("- foo\n---\n- # In item\n- set\n  ===\n", [], [(1, "In item"), (1, "set")]),
    ("*it* [x](y.md)\n--\n\n***\n---\n", [("y.md", 1, 6, 1, 15)], [(2, "it x")]),
    ("~~~\n    [a](b.md)\n~~~\n    [c](d.md)\n", [], []),
    ("[a\\\nb](x.md)\r\n\r\n[c\r\nd](y.md)", [("x.md", 1, 1, 2, 9), ("y.md", 4, 1, 5, 9)], []),
    ("", [], []), ("\n\n", [], []), ("    \n", [], []),
]


def test_markdown_over_lines(spark):
    """Links, code spans and headings over lines; literal blocks in and out of lists and quotes."""
    rows = [("w", f"n{i:02d}.md", body) for i, (body, _, _) in enumerate(WRAPPED)]
    inspected = ins.inspect(corpus(spark, rows)).select("relative_path", "headings", "links").collect()
    got = {r.relative_path: (
        [(k.target, k.start_line, k.start_column, k.end_line, k.end_column) for k in r.links], [(h.level, h.text) for h in r.headings]) for r in inspected}
    want = {path: (links, titles) for (_, path, _), (_, links, titles) in zip(rows, WRAPPED)}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_blocks_are_the_whole_text(spark):
    """Joined blocks give back the text; blanking keeps every line break and length; null stays null."""
    texts = [body for body, _, _ in WRAPPED] + ["- a\n\n      code\n\n\n      code\nb\n" * 50, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    blank = bl.without_literals(F.col("t"))
    out = df.select("t", blank.alias("b"), F.array_join(F.transform(bl.inline_blocks(F.col("t")), lambda x: x["text"]), "\n").alias("j")).collect()
    for row in out:
        assert row.j == row.t
        assert row.t is None and row.b is None or [len(x) for x in row.b.split("\n")] == [len(x) for x in row.t.split("\n")]
        assert row.t is None or all(x == y or x == " " for x, y in zip(row.b, row.t))


def test_indented_code_needs_no_fold(spark):
    """Text whose only literals are indented code gives the rows of the fold; the fold is forced by a trailing quote."""
    texts = ["    a\n    b\n\n    c\nd\n    e\n", "x\n    lazy\n   \n     code\n\n\n    code\n   text\n", "    only", "\n    a [b](c.md)\n \n  x\n\n      y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    forced = F.substring(bl.without_literals(F.concat("t", F.lit("\n\n> q"))), F.lit(1), F.length("t"))
    for row in df.select(bl.without_literals(F.col("t")).alias("flat"), forced.alias("fold")).collect():
        assert row.flat == row.fold
    assert df.select(bl.without_literals(F.col("t"))).first()[0] == "     \n     \n\n     \nd\n    e\n"
    joint = spark.createDataFrame([("a\x1d `b` c `\x1d`",)], "t string").select(bl.blank_out(F.col("t"), "`[^`]*`")).first()[0]
    assert joint == "a\x1d     c    "


def test_long_document_is_linear(spark):
    """160,000 lines in one document: time is in proportion to its lines."""
    body = "word [a](b.md) line\n\n    [code](no.md)\n\n" * 40000
    started = time.time()
    links = ins.links_table(ins.inspect(corpus(spark, [("w", "n.md", body)]))).where("target = 'b.md' AND start_column = 6")
    assert links.agg(F.count("*"), F.max("start_line")).first() == (40000, 159997)
    assert time.time() - started < 40


def test_written_rows_hold_what_is_read(spark, monkeypatch):
    """Queries that read the inspected corpus several times write no texts and no front-matter nodes for it."""
    from lorelake.plans import catalog

    written = []
    monkeypatch.setattr(catalog.checkpoints, "cut", lambda df: written.append(df.columns) or df)
    for name in ("related_documents", "location_overview"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(written) == 2
    for columns in written:
        assert "links" in columns and not {"content", "body", "nodes", "parsed", "search_text"} & set(columns)

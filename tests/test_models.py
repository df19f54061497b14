"""Operators against small brute-force models, and inline cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorelake.functions import text as tx
from lorelake.operators import filters as fl
from lorelake.operators import graph as gr
from lorelake.operators import history as hi
from lorelake.operators import packs as pk
from lorelake.operators import review as rv


def greedy(rows):
    """First fit in path order, the definition itself."""
    out, free = [], sorted(r for r in rows if r[3] == "added")
    for loc, path, size, _, ms in sorted((r[0], r[1], r[2], r[3], r[4]) for r in rows if r[3] == "removed"):
        for other in free:
            if other[0] == loc and other[2] == size and abs(other[4] - ms) < 2500:
                out.append((loc, path, other[1]))
                free.remove(other)
                break
    return sorted(out)


def test_rename_matching_equals_greedy(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        spread = rng.choice([2000, 9000, 60000])
        rows.append((rng.choice("ab"), f"f{rng.randrange(10**6):06d}-{i}", rng.choice([0, 1, 2]),
                     rng.choice(["added", "removed"]), 10**12 + rng.choice([0, 10**6, 2 * 10**6]) + rng.randrange(spread)))
    df = spark.createDataFrame(rows, "location_id string, relative_path string, size long, change string, modified_at_ms long")
    got = sorted(tuple(r) for r in hi.match_renames(df).select("location_id", "previous_path", "relative_path").collect())
    assert got == greedy(rows)


@pytest.mark.parametrize("segment_rows", [1, 7, 100_000])
def test_first_fit_is_the_same_whatever_the_segments(spark, segment_rows):
    """Chains over many bins: border files are wanted by two segments, and refusals travel from segment to segment."""
    rng = random.Random(11)
    rows = [("a", f"f{rng.randrange(10**6):06d}-{i}", i % 2, rng.choice(["added", "removed"]), 10**12 + i * 250 + rng.randrange(900))
            for i in range(400)]
    # A ladder: each removed file first wants the added file that its neighbour needs.
    rows += [("b", f"r{99 - i:03d}", 5, "removed", 10**12 + i * 2400) for i in range(60)]
    rows += [("b", f"t{i:03d}", 5, "added", 10**12 + i * 2400 + 1200) for i in range(60)]
    df = spark.createDataFrame(rows, "location_id string, relative_path string, size long, change string, modified_at_ms long")
    got = sorted(tuple(r) for r in hi.match_renames(df, segment_rows).select("location_id", "previous_path", "relative_path").collect())
    assert got == greedy(rows)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)]
    edges += [("hub", f"s{i}") for i in range(200)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    want = {(n, find(n)) for e in edges if e[0] != e[1] for n in e}
    got = {tuple(r) for r in hi.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def loop_fill(targets, budget):
    shares = [0] * len(targets)
    while budget:
        active = [i for i, t in enumerate(targets) if shares[i] < t]
        if not active:
            break
        share = max(1, budget // len(active))
        for i in active:
            step = min(share, targets[i] - shares[i], budget)
            shares[i] += step
            budget -= step
    return shares, budget


def loop_split(lengths, shares, budget):
    needs = [n - s for n, s in zip(lengths, shares)]
    total = sum(needs)
    if not total or not budget:
        return shares
    if budget >= total:
        return list(lengths)
    cut = [divmod(budget * n, total) for n in needs]
    shares = [s + c[0] for s, c in zip(shares, cut)]
    left = budget - sum(c[0] for c in cut)
    for i in sorted(range(len(needs)), key=lambda i: (-cut[i][1], -needs[i], i)):
        if left and shares[i] < lengths[i]:
            shares[i] += 1
            left -= 1
    return shares


def model_pack(header, prefixes, bodies, limit):
    """The pack definition as plain loops: lengths of every kept document."""
    note, keep = len(pk.TRUNCATION_NOTE), list(range(len(bodies)))
    available = limit - 200 - header
    cost = lambda i: prefixes[i] + min(bodies[i], 80) + (note if bodies[i] > 80 else 1)
    while keep and sum(map(cost, keep)) > available:
        keep.pop()
    lengths = [bodies[i] for i in keep]
    held = [n > 80 for n in lengths]
    budget = max(0, available - sum(prefixes[i] for i in keep) - sum(note if h else 1 for h in held))
    shares, rest = loop_fill([min(n, 160) for n in lengths], budget)
    shares = loop_split(lengths, shares, rest)
    while True:
        done = [i for i, h in enumerate(held) if h and shares[i] >= lengths[i]]
        if not done:
            return shares
        for i in done:
            held[i] = False
        shares = loop_split(lengths, shares, len(done) * (note - 1))


def test_packs_equal_model(spark):
    rng = random.Random(11)
    packs, refs, docs, want = [], [], [], {}
    for p in range(40):
        limit, n = rng.choice([1000, 1600, 2500, 6000]), rng.randrange(1, 9)
        packs.append((f"p{p}", f"q{p}", limit, 20))
        bodies = [rng.choice([10, 79, 81, 130, 200, 500, 3000]) + rng.randrange(30) for _ in range(n)]
        for i, size in enumerate(bodies):
            refs.append((f"p{p}", i, "loc", f"p{p}/d{i}.md", ""))
            docs.append(("loc", f"p{p}/d{i}.md", f"T{i}", "concept", ("x" * size), 1))
        prefix = [len(f"## T{i}\n\n- Location: `loc`\n- Path: `p{p}/d{i}.md`\n- Role: concept\n- Included because: Selected manually\n\n---\n\n") for i in range(n)]
        header = len(f"# Workspace context pack\n\nQuery: q{p}\n\nBudget: {limit} characters\n\n")
        want[f"p{p}"] = model_pack(header, prefix, bodies, limit)
    items, omissions, whole = pk.build_packs(
        spark.createDataFrame(packs, "pack_id string, query string, max_characters int, max_documents int"),
        spark.createDataFrame(refs, "pack_id string, pos long, location_id string, relative_path string, reason string"),
        spark.createDataFrame(docs, "location_id string, relative_path string, title string, kind string, body string, generation long"))
    got = {p: [] for p in want}
    for r in items.orderBy("pack_id", "pos").collect():
        got[r.pack_id].append(len(r.content))
    assert got == want
    assert all(r.total_characters <= r.max_characters for r in whole.collect())
    n_omitted = {r.pack_id: r.n for r in omissions.groupBy("pack_id").agg(F.count("*").alias("n")).collect()}
    sizes = {}
    for r in refs:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    assert {p: sizes[p] - len(want[p]) for p in want if sizes[p] > len(want[p])} == n_omitted


def test_pack_requests_are_checked(spark):
    packs = spark.createDataFrame([("a", "q", 10, 0), ("b", "x" * 1001, 10, 5), ("c", "q", 10, 5)],
                                  "pack_id string, query string, max_characters int, max_documents int")
    refs = spark.createDataFrame([("a", i, "l", f"{i}", "") for i in range(101)] + [("b", 0, "l", "1", "")],
                                 "pack_id string, pos long, location_id string, relative_path string, reason string")
    valid, rejected = pk.valid_packs(packs, refs)
    assert valid.count() == 0
    assert {r.pack_id: r.error.split(" ")[0] for r in rejected.collect()} == {"a": "Too", "b": "The", "c": "Select"}


def ignored(spark, lines, paths):
    rules = spark.createDataFrame([("l", i, v) for i, v in enumerate(lines)], "location_id string, line_no int, line string")
    files = spark.createDataFrame([("l", p) for p in paths], "location_id string, relative_path string")
    return {r.relative_path for r in fl.ignored_paths(files, fl.compile_policy(rules)).collect()}


def test_policy_cases(spark):
    assert ignored(spark, ["# note", "AGENTS.md", "**/SKILL.md"], ["AGENTS.md", "n/AGENTS.md", "s/e/SKILL.md", "c.md", "agents.md"]) == {
        "AGENTS.md", "n/AGENTS.md", "s/e/SKILL.md"}
    assert ignored(spark, ["drafts/", "!drafts/published.md"], ["drafts/private.md", "drafts/published.md", "x/drafts/a.md", "drafts"]) == {
        "drafts/private.md", "x/drafts/a.md", "drafts"}
    assert ignored(spark, ["generated/**", "/top.md", "a/*/c.md"], ["generated/r.md", "generated/x/r.md", "x/top.md", "top.md", "a/b/c.md", "a/b/d/c.md"]) == {
        "generated/r.md", "generated/x/r.md", "top.md", "a/b/c.md"}


def test_policy_limits(spark):
    lines = ["# c", ""] * 2000 + ["AGENTS.md"]
    assert ignored(spark, lines, ["AGENTS.md"]) == {"AGENTS.md"}
    rules = spark.createDataFrame([("l", i, f"f{i}.md") for i in range(1025)] + [("m", 0, "a***b")],
                                  "location_id string, line_no int, line string")
    errors = {r.location_id: r.error for r in fl.compile_policy(rules).collect()}
    assert "1024" in errors["l"] and "invalid" in errors["m"]


def test_anchor_ladder(spark):
    def place(text, quote, anchor):
        comments = spark.createDataFrame([("l", "d.md", quote, anchor)],
                                         "location_id string, relative_path string, quote string, anchor struct<start:int,end:int,prefix:string,suffix:string>")
        docs = spark.createDataFrame([("l", "d.md", text)], "location_id string, relative_path string, body string")
        row = rv.resolve_anchors(comments, docs).first()
        return row.start, row.rule

    assert place("A unique sentence remains.", "unique sentence", None) == (2, "unique")
    assert place("repeated text and repeated text.", "repeated text", None) == (None, "detached")
    changed = "Introduction. Alpha repeated passage. Beta repeated passage. Gamma."
    assert place(changed, "repeated passage", (29, 45, "Alpha repeated passage. Beta ", ". Gamma.")) == (changed.rfind("repeated"), "context")
    assert place("The replacement claim.", "original claim", (4, 18, "The ", ".")) == (None, "detached")
    assert place("xx yy xx", "xx", (6, 8, "zz ", "")) == (6, "exact")


def test_review_blocks(spark):
    def parse(content):
        docs = spark.createDataFrame([("l", "d.md", content)], "location_id string, relative_path string, content string")
        return rv.review_comments(docs).collect()

    good = '<!-- workspace-review:v1\n{"comments":[{"id":"1","quote":"q","comment":"c","createdAt":"t","anchor":{"start":1,"end":2,"prefix":"","suffix":"s"}}]}\n-->\nBody'
    rows = parse("---\na: 1\n---\n" + good)
    assert rows[0].id == "1" and rows[0].anchor.suffix == "s" and rows[0].error is None
    assert parse(good.replace('"id":"1"', '"id":1'))[0].error.startswith("The review block is invalid")
    assert parse(good.replace("\n-->", ""))[0].error == "The review block is not closed."
    assert parse("Body only") == []


def test_paths(spark):
    rows = spark.createDataFrame([(r"\\?\C:\A\B",), (r"\\?\C:\A",), ("C:/A",), ("/a",), ("a",), (r"C:\X\Y\ ".strip(),)], "p string")
    got = [r[0] for r in rows.select(tx.parent_path(F.col("p"))).collect()]
    assert got == ["\\\\?\\C:\\A", "\\\\?\\C:\\", "C:/", "/", ".", "C:/X"]


def test_percent_decoding(spark):
    rows = spark.createDataFrame([("a+b%20c",), ("100%zz",), ("end%",), ("%FF",), ("%C3%A9",)], "p string")
    assert [r[0] for r in rows.select(tx.percent_decode(F.col("p"))).collect()] == ["a+b c", "100%zz", "end%", "%FF", "é"]


def test_backlinks_of_a_path_that_is_listed_twice(spark):
    """Two rows of one path and title are one linking document."""
    links = spark.createDataFrame([("a", "x.md", "y.md", "resolved")],
                                  "location_id string, source_relative_path string, target_relative_path string, status string")
    docs = spark.createDataFrame([("a", "x.md", "X"), ("a", "x.md", "X"), ("a", "y.md", "Y")], "location_id string, relative_path string, title string")
    assert [tuple(r) for r in gr.backlinks(links, docs, docs).select("relative_path", "other", "title").collect()] == [("y.md", "x.md", "X")]


def test_postings_are_counted_inside_the_document_row(spark):
    """Counts of repeated, accented and mixed tokens; no task adds up the tokens of many documents."""
    from collections import Counter

    from lorelake.operators import search as se

    fields = {"body": ("body", 1.0)}
    words = {"x": ["b", "a", "é", "e", "b", "7", "a", "b"], "y": ["a"], "z": []}
    docs = spark.createDataFrame([("l", k, " ".join(w) if w else None) for k, w in words.items()], "location_id string, relative_path string, body string")
    got = se.postings(docs, fields)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(k, t, len(w), n) for k, w in words.items() for t, n in Counter("e" if t == "é" else t for t in w).items()]
    assert sorted(tuple(r) for r in got.select("relative_path", "term", "dl", "tf").collect()) == sorted(want)
    asked = spark.createDataFrame([("a",)], "term string")
    assert sorted(tuple(r) for r in se.postings(docs, fields, asked).select("relative_path", "tf").collect()) == [("x", 2), ("y", 1)]


def test_review_blocks_are_parsed_after_documents_are_spread(spark):
    docs = spark.createDataFrame([("l", "a.md", "text")], "location_id string, relative_path string, content string").repartition(3)
    plan = rv.review_comments(docs)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan.upper() and "RLIKE" not in plan.upper().partition("EXCHANGE ROUNDROBIN")[2]


def test_refreshed_links_delta_inspects_the_corpus_once(spark, monkeypatch):
    from lorelake.plans import catalog

    calls, stored = [], catalog._stored
    monkeypatch.setattr(catalog, "_stored", lambda *a: calls.append(a) or stored(*a))
    catalog.QUERIES["refreshed_links_delta"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def lexical_model(docs, queries):
    """(query, path) to (rank, score, fields): every term of every query looked for in every field."""
    accents = str.maketrans(tx.ACCENTED, tx.PLAIN)
    fold = lambda s: s.lower().translate(accents)
    weights = {"title": 8.0, "type": 4.0, "path": 2.0, "body": 1.0}
    out = {}
    for number, query, limit, prefix in queries:
        quoted = len(query) > 2 and query.startswith('"') and query.endswith('"') and query[1:-1].strip(" ")
        words = [w.strip(tx.ASCII_PUNCTUATION) for w in re.split(r"[ \t\n\r\x0b\x0c]+", query)]
        strings = [fold(query[1:-1])] if quoted else [fold(w) for w in words if len(w.encode()) >= 2]
        places = []
        for location, path, title, type_, body in docs:
            texts = {"title": title, "type": type_, "path": path, "body": body}
            found = [f for f, t in texts.items() if any(s in fold(t or "") for s in strings)]
            if found and path.startswith(prefix or ""):
                places.append((location, -sum(weights[f] for f in found), path, found))
        for location in {p[0] for p in places}:
            kept = sorted(p[1:] for p in places if p[0] == location)[:min(max(3 * limit, 30), 200)]
            out |= {(number, path): (rank, -score, found) for rank, (score, path, found) in enumerate(kept, 1)}
    return out


def test_lexical_search_equals_loops(spark):
    """Unspaced texts longer than a stretch, terms at stretch borders, phrases over white space, several passes."""
    from lorelake.operators import search as se

    rng = random.Random(5)
    parts = ["a", "b", "é", "E", " ", "\n", "\t", " ", "ç7", "ß", "語", "-", "\x1c"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    docs = [(rng.choice("xy"), f"d/{i:04d}.md", text(9), rng.choice([None, "aé", "語b"]), text(700) if i % 7 else text(3)) for i in range(120)]
    docs += [("x", f"e/{k}.md", None, None, "z" * k + "q語qwÉ" + "z" * 300) for k in range(245, 262)]
    docs += [("y", "e/none.md", None, None, None)]
    queries = [(i, text(8) if i % 3 else f'"{text(6)}"', rng.choice([1, 12, 80]), rng.choice([None, "e/", "d"])) for i in range(140)]
    queries += [(200, "Q語QWe", 20, None), (201, '"\t"', 20, None), (202, "", 20, None), (203, "! ?", 20, None), (204, "é", 20, None)]
    queries += [(205, "a" * 2000 + " q語q", 20, None)]
    rows = spark.createDataFrame(docs, "location_id string, relative_path string, title string, type string, body string").selectExpr(
        "*", "'concept' AS kind", "cast(NULL AS string) AS description", "array('t') AS tags", "'' AS tags_text", "'' AS headings_text",
        "'' AS metadata_text", "'stable' AS status", "'unverified' AS trust_tier", "cast(NULL AS string) AS stale_after", "0 AS finding_count")
    asked = spark.createDataFrame(
        [(i, q, limit, prefix and prefix + "/") for i, q, limit, prefix in queries],
        "query_id long, query string, limit int, f_path_prefix string").selectExpr("*", "'any' AS f_findings")
    want = lexical_model(docs, [(i, q, limit, prefix and prefix.rstrip("/")) for i, q, limit, prefix in queries])
    assert len(want) > 2000 and {200, 201, 204, 205} <= {q for q, _ in want} and not {202, 203} & {q for q, _ in want}
    for batch in (256, 3):
        got = se.search_lexical(rows, asked, "2024-01-31", batch).collect()
        assert len(got) == len({(r["query_id"], r["relative_path"]) for r in got})
        assert {(r["query_id"], r["relative_path"]): (r["rank"], r["score"], r["matched_fields"]) for r in got} == want


def test_lexical_search_reads_each_text_once_for_all_queries(spark):
    """No pairs of documents and queries but the matching ones, and no more of them from a task than the limits ask for."""
    from lorelake.operators import search as se
    from lorelake.sources import adapters as ad

    sf = "/root/testdata/sf0.001"
    found = se.search_lexical(ad.corpus_docs(spark, sf), ad.search_queries(spark, sf).withColumn("limit", F.lit(11)), "2024-01-31")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(batch" not in plan
    assert re.search(r"WindowGroupLimit .*row_number\(\), 33\b", plan)

"""Ranked search against plain loops."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorelake.llm import term_ranking
from lorelake.llm.common import documents


def terms(text):
    return re.findall(term_ranking.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, top):
    """docs: (id, text), items: (id, text); scores of every document for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    number, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = {}
    for item, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * number) // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        if scored:
            out[item] = [(None if none else i, -s) for s, none, i in sorted(scored)[:top]]
    return out


def found(frame, item="item_id"):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r[item] is None, r[item] or 0, r["rank"])):
        assert r["rank"] == len(out.setdefault(r[item], [])) + 1
        out[r[item]].append((r["doc_id"], r["score"]))
    return out


ITEMS = [(1, "The quick brown fox"), (2, "the the THE"), (3, None), (4, "... !"), (5, "naïve 日本語 café"), (5, "word"), (None, "all rights"), (6, "zzzz nothing here"), (7, "½ 7 ٣"), (1, "fox by")]


@pytest.mark.parametrize(("top", "block"), [(50, 200_000), (2, 200_000), (3, 3)])
def test_odd_rows(spark, odd_docs, no_docs, top, block):
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("rank", F.lit("own")).withColumn("score", F.lit("own"))
    want = plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()], ITEMS, top)
    assert found(term_ranking.search(odd_docs, items, top=top, block_terms=block)) == want
    assert term_ranking.search(no_docs, items).count() == 0
    assert term_ranking.search(odd_docs, items.limit(0)).count() == 0


def test_best_rows_are_kept_while_others_come(spark, monkeypatch):
    """Little room: rows are cut to the best again and again, ties by id."""
    monkeypatch.setattr(term_ranking, "CELLS", 8)
    docs = [(i, " ".join(["red"] * (i % 4 + 1) + ["blue"] * (i % 3) + ["grey"] * 5)) for i in range(300)]
    items = [(1, "red"), (2, "blue red"), (3, "grey")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").orderBy(F.xxhash64("doc_id")).coalesce(2)
    got = found(term_ranking.search(frame, spark.createDataFrame(items, "item_id int, text string"), top=5))
    assert got == plain(docs, items, 5)


def test_boundaries_guard_the_automaton():
    machine = term_ranking.automaton_of(["a", "ab", "b"])
    seen = " ab a  b,A".encode().translate(term_ranking.SEEN).decode() + " "
    assert sorted(Counter(n for _, n in machine.iter(seen)).items()) == [(0, 2), (1, 1), (2, 1)]


def test_table(spark, small):
    docs, items = documents(spark, small), spark.read.parquet(f"{small}/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert found(term_ranking.search(docs, items)) == want

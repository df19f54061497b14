"""Exact duplicates, near duplicates and the mix against plain loops."""

import bisect
import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorelake.llm import exact_dedup, mixing, ngram_join
from lorelake.llm.common import documents
from tests.llm.conftest import ROWS


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


@pytest.mark.parametrize("counters", [1, 3, 2048])
def test_exact_marks(odd_docs, no_docs, spark, small, counters):
    for docs in (odd_docs, documents(spark, small)):
        given = docs.select("doc_id", "text").collect()
        groups: dict = {}
        for r in given:
            groups.setdefault(digest(r["text"]), []).append(r["doc_id"])
        rows = exact_dedup.marks(docs, counters=counters).collect()
        assert Counter((r["doc_id"], r["text_sha256"]) for r in rows) == Counter((r["doc_id"], digest(r["text"])) for r in given)
        for r in rows:
            ids = groups[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept = Counter(r["text_sha256"] for r in rows if r["kept"])
        assert set(kept) == set(groups) and set(kept.values()) == {1}
        left = exact_dedup.dedup(docs, counters=counters)
        assert left.columns == docs.columns
        assert sorted(map(str, ((r["doc_id"], digest(r["text"])) for r in left.collect()))) == sorted(str((r["doc_id"], r["text_sha256"])) for r in rows if r["kept"])
    assert exact_dedup.marks(no_docs).count() == exact_dedup.dedup(no_docs).count() == 0


def test_misra_gries_keeps_every_frequent_key():
    values = ["a"] * 40 + ["b"] * 25 + [f"x{i}" for i in range(60)]
    parts = [pd.DataFrame({"digest": values[i::7]}) for i in range(7)]
    held = pd.concat(exact_dedup.summary(4)(iter([p])).__next__() for p in parts).groupby("digest")["n"].sum()
    assert {"a"} <= set(exact_dedup.merge(held, 4).index)  # over 125 / 5
    assert len(exact_dedup.merge(held, 4)) <= 4


def plain_join(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    by: dict = {}
    for i in sorted(sets):
        by.setdefault(sets[i], []).append(i)
    reps = {ids[0]: s for s, ids in by.items()}
    size = {ids[0]: len(ids) for ids in by.values()}
    links: dict = {i: set() for i in reps}
    for a in reps:
        for b in reps:
            if a < b and (u := len(reps[a] | reps[b])) and len(reps[a] & reps[b]) >= 0.8 * u:
                links[a].add(b)
                links[b].add(a)
    group = {}
    for i in sorted(reps):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    return {i: (c, size[c], len(links[c]), sum(size[x] for x in links[c]), group[c], i == group[c]) for s, ids in by.items() for c in ids[:1] for i in ids}


def near_rows():
    """A chain and a crowd of near copies, so that groups have several blocks."""
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(300):
        w = list(words)
        w[(i * 7) % 90] = f"v{i % 5}"
        w[(i * 13) % 90] = f"u{i % 3}"
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates(spark, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 40)
    crowd = near_rows()
    frames = [(spark.createDataFrame(crowd, "doc_id bigint, text string").repartition(5), crowd)]
    docs = documents(spark, small)
    frames.append((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]))
    for frame, given in frames:
        want = plain_join(given)
        got = {r["doc_id"]: (r["class_id"], r["class_size"], r["links"], r["linked_docs"], r["group_id"], r["kept"]) for r in ngram_join.near_duplicates(frame).collect()}
        assert got == want
        assert {r["doc_id"] for r in ngram_join.keep_one(frame).collect()} == {i for i, w in want.items() if w[-1]}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 320


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = ngram_join.near_duplicates(odd_docs).collect()
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert {(r["class_id"], r["class_size"], r["links"]) for r in empty} == {(3, 3, 0)}
    fox = [r for r in rows if r["class_id"] == 1]
    assert len(fox) == 3 and sum(r["kept"] for r in fox) == 1
    left = ngram_join.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 6, 7, 8, 9, 10, 11]
    assert ngram_join.near_duplicates(no_docs).count() == ngram_join.keep_one(no_docs).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), volume=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = volume * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("block", [7, 1024])
def test_mix(odd_docs, no_docs, spark, small, block):
    for docs in (odd_docs, documents(spark, small)):
        given = docs.select("doc_id", "text", "source").collect()
        size = lambda t: len((t or "").encode().split())
        totals: dict = {}
        for r in given:
            totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
        want = plain_targets(totals)
        placed, shares, pieces = mixing.mix(docs, block_words=block)
        for r in shares.collect():
            assert r["source_size"] == totals[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        rows = mixing.taken(docs, block_words=block).collect()
        assert len(rows) == len(given)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        cut = pieces.collect()
        assert all(1 <= p["words"] <= block for p in cut)
        by_source: dict = {}
        for p in cut:
            by_source[p["source"]] = by_source.get(p["source"], 0) + p["words"]
        assert all(abs(by_source.get(s, 0) - t) <= 1 for s, t in want.items())
        # No word is taken more than once in a pass: each stretch of a text comes at most twice.
        starts = Counter((p["row_no"], p["from_word"]) for p in cut)
        assert max(starts.values()) <= 2
        again = mixing.taken(docs, block_words=block).collect()
        key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
        assert sorted(map(key, rows)) == sorted(map(key, again))
        repeated = mixing.repeat(docs, block_words=block)
        assert repeated.columns == docs.columns
        expected: dict = {}
        for r in rows:
            if r["size"]:
                expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + (int(r["taken"] / r["size"] + 0.5))
        if docs is not odd_docs:
            assert Counter(r["doc_id"] for r in repeated.collect()) == Counter({k: v for k, v in expected.items() if v})
    assert mixing.taken(no_docs).count() == mixing.repeat(no_docs).count() == 0


def test_any_stretch_of_the_mix_has_near_its_shares(spark):
    shares = spark.createDataFrame([("a", 10**7, 6e6), ("b", 10**7, 3e6), (None, 10**7, 1e6)], "source string, source_size bigint, target double")
    slots = mixing.schedule(shares, 1000).filter("slot < 10000").toPandas()
    for at in range(0, 10_000, 500):
        part = slots[(slots["slot"] >= at) & (slots["slot"] < at + 500)]
        counts = part["source"].fillna("-").value_counts()
        assert all(abs(counts[s] - n) <= 6 for s, n in (("a", 300), ("b", 150), ("-", 50)))
    assert sorted(slots[slots["source"] == "a"]["rank"]) == list(range((slots["source"] == "a").sum()))


def plain_mix(lines, shares, block):
    """lines: source -> texts in order as (row_no, size); shares: source -> (size, target). The schedule's points decide the slots."""
    order = sorted((s for s in shares if shares[s][1] > 0), key=lambda s: (s is None, s or ""))
    total = sum(shares[s][1] for s in order)
    bounds, at = [], 0.0
    for s in order:
        at += shares[s][1]
        bounds.append(at / total)
    bounds[-1] = 1.0
    count = -(-int(total) // block)
    need = {}
    for s in order:
        size, target = shares[s][0], math.floor(shares[s][1])
        need[s] = [(k, b * block, min((b + 1) * block, size)) for k in range(3) for b in range(-(-size // block)) if k * size + b * block < target]
        need[s] = [(b, min(e, target - k * size)) for k, b, e in need[s]]  # the last block ends at the target
    slots, taken = {s: [] for s in order}, {}
    for slot in range(count):
        x = (slot + 0.5) * mixing.GOLDEN
        s = order[bisect.bisect_right(bounds, x - math.floor(x))]
        if len(slots[s]) < len(need[s]):
            slots[s].append(slot)
    missing = sorted((r, s is None, s or "") for s in order for r in range(len(slots[s]), len(need[s])))
    for slot, (_, none, s) in enumerate(missing, count):
        slots[None if none else s].append(slot)
    for s in order:
        for slot, (b, e) in zip(slots[s], need[s], strict=True):
            at = 0
            for row_no, size in lines[s]:
                words = min(e, at + size) - max(b, at)
                if words > 0:
                    n, w, of = taken.get(row_no, (0, 0, []))
                    taken[row_no] = (n + 1, w + words, [*of, slot])
                at += size
    return {r: (w, n, min(of), max(of)) for r, (n, w, of) in taken.items()}


@pytest.mark.parametrize("block", [37, 1024])
def test_taken_words_and_slots_equal_plain_loops(odd_docs, spark, small, block):
    for docs in (odd_docs, documents(spark, small)):
        lines, shares = {}, {}
        for r in mixing.positions(docs, "doc_id", "source", "text").orderBy("start").collect():
            lines.setdefault(r["source"], []).append((r["row_no"], r["size"]))
        rows = mixing.taken(docs, block_words=block).collect()
        for r in rows:
            shares[r["of"]] = (r["source_size"], r["target"])
        want = Counter()
        sizes = {n: size for line in lines.values() for n, size in line}
        plain = plain_mix(lines, shares, block)
        for n, size in sizes.items():
            want[(size, *plain.get(n, (0, 0, None, None)))] += 1
        assert Counter((r["size"], r["taken"], r["n_slots"], r["first_slot"], r["last_slot"]) for r in rows) == want


def test_the_mix_depends_on_its_points(spark, small, monkeypatch):
    """Near its shares at every stretch with the golden ratio; sources one after the other with points near 0."""

    def worst(slots):
        shares = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 10**6), ("b", 10**6), ("c", 10**6)], "source string, source_size bigint")).collect()}
        given = spark.createDataFrame([(s, 10**6, t) for s, t in shares.items()], "source string, source_size bigint, target double")
        got = sorted((r["slot"], r["source"]) for r in mixing.schedule(given, 1000).collect())[:slots]
        return max(abs(sum(s == x for _, s in got) / slots - shares[x] / sum(shares.values())) for x in shares)

    def result():
        return sorted((r["doc_id"], r["first_slot"] if r["first_slot"] is not None else -1) for r in mixing.taken(documents(spark, small), block_words=64).collect())

    assert worst(500) < 0.02
    golden = result()
    copies = [r["slot"] for r in mixing.repeat(documents(spark, small), slot_col="slot").withColumn("part", F.spark_partition_id()).orderBy("part").collect()]
    assert len(set(copies)) > 100
    monkeypatch.setattr(mixing, "GOLDEN", 1e-6)
    assert worst(500) > 0.2 and result() != golden


def test_many_tiny_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 4), f"s{i}") for i in range(600)], "doc_id bigint, text string, source string")
    rows = mixing.taken(docs).collect()
    assert len(rows) == 600 and all(abs(r["taken"] - r["target"]) <= 1 for r in rows)
    assert len({r["first_slot"] for r in rows if r["n_slots"]}) == sum(r["n_slots"] > 0 for r in rows)


def test_running_sum(spark):
    from lorelake.llm.common import running_sum

    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.floor(F.col("id") / 40).alias("b"), (F.col("id") % 5).alias("v"))
    total: dict = {}
    for r in running_sum(df, ["g"], "b", [F.col("id")], "v", "s").orderBy("id").collect():
        assert r["s"] == total.get(r["g"], 0)
        total[r["g"]] = total.get(r["g"], 0) + r["v"]

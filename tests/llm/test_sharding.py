import random
from collections import Counter

from lorelake.llm import sharding
from lorelake.llm.common import documents
from tests.llm.conftest import ROWS


def test_matrix_has_the_right_sums_and_law():
    counts = [5, 0, 17, 100, 3]
    m = sharding.matrix(counts, 7, seed=3)
    assert [sum(line) for line in m] == counts
    columns = [sum(c) for c in zip(*m, strict=True)]
    assert sum(columns) == 125 and max(columns) - min(columns) <= 1


def test_hypergeometric_is_the_law_of_drawing():
    rng = random.Random(1)
    drawn = Counter(sharding.hypergeometric(7, 5, 6, rng) for _ in range(20_000))
    import math

    for k in range(1, 7):
        p = math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6)
        assert abs(drawn[k] / 20_000 - p) < 0.015
    big = [sharding.hypergeometric(3 * 10**9, 7 * 10**9, 10**6, rng) for _ in range(200)]
    assert abs(sum(big) / 200 - 300_000) < 200


def test_every_row_has_one_place(spark, small):
    docs = documents(spark, small)
    rows = sharding.shard(docs.repartition(7), 40, block_bytes=2000).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_reruns_agree_and_seeds_differ(spark, small):
    docs = documents(spark, small)
    place = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, seed=seed).collect()}
    assert place(1) == place(1) != place(2)


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 5).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in ROWS)
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 2, 3, 3, 3]
    assert all(r["ends"] == "own ends" and r["law"] == "rows" for r in rows)
    assert sharding.shard(no_docs, 5).count() == 0

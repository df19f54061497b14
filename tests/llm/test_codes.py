"""Vector codes against plain Lloyd rounds."""

import math

import numpy as np

from lorelake.llm import queries, vector_codes


def plain(rows, parts, entries, rounds, scale):
    """rows: (id, vector). Every part is compared with every entry in every round, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, xs in members.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = []
    for (i, _), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(e for _, e in found), sum(d for d, _ in found)))
    return out, books


def same(spark, rows, **limits):
    given = {"parts": 8, "entries": 16, "rounds": 6, "scale": 4096} | limits
    frame = spark.createDataFrame([(i, v, k % 3 or None, "own") for k, (i, v) in enumerate(rows)], "vec_id bigint, embedding array<double>, label int, codes string")
    got, books = vector_codes.compress(frame.repartition(3), **limits)
    want, plain_books = plain(rows, **given)
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["vec_id"], bytes(r["codes"]), r["error"]) for r in got.collect()), key=order) == sorted(want, key=order)
    assert books.tolist() == plain_books
    return got


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(200)]
    same(spark, rows)
    # Few values: many ties between entries and distances.
    rows = [(i, rng.integers(0, 3, 16).astype(float).tolist()) for i in range(150)]
    same(spark, rows, scale=1)
    same(spark, rows, scale=1, entries=5, rounds=3, parts=4)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (40, None), (41, [None] * 8), (42, [math.nan] * 8), (43, [math.inf] + [0.0] * 7)]
    got = same(spark, rows)
    assert got.count() == 33
    full = vector_codes.with_label_error(got).collect()
    for label in (None, 1, 2):
        of = [r for r in full if r["label"] == label]
        assert of and {r["label_error"] for r in of} == {sum(r["error"] for r in of)}
    same(spark, rows[:3])
    odd = spark.createDataFrame([(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [], 0), (4, [1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    assert {r["vec_id"] for r in vector_codes.compress(odd)[0].collect()} == {1, 2}
    assert vector_codes.compress(odd.limit(0))[0].count() == 0
    assert vector_codes.digest(vector_codes.compress(odd.limit(0))[1])


def test_fixed_parts_compare_moved_entries_only():
    rng = np.random.default_rng(8)
    values, book = rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (16, 4))
    entry, distance = np.full(400, -1), np.zeros(400, np.int64)
    stats = {}
    vector_codes.assign(values, book, np.ones(16, bool), entry, distance, stats)
    assert stats["compared"] == 400 * 16
    moved = np.zeros(16, bool)
    moved[[3, 9]] = True
    after = book.copy()
    after[[3, 9]] += rng.integers(-9, 9, (2, 4))
    of_moved, stats = int(moved[entry].sum()), {}
    vector_codes.assign(values, after, moved, entry, distance, stats)
    want, exact = vector_codes.nearest(values, after)
    assert (entry == want).all() and (distance == exact).all()
    assert stats["compared"] == of_moved * 16 + (400 - of_moved) * 2 < 400 * 16


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(2**28 + i * 7 + k) for k in range(8)]) for i in range(20)]
    same(spark, rows, scale=1, entries=4)


def test_query(spark, small):
    rows = queries.op12_vector_codes(spark, small).collect()
    assert len(rows) == 500 and all(len(r["code"]) == 16 for r in rows) and len({r["codebooks_sha256"] for r in rows}) == 1

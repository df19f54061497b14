"""Retrieval packing against plain loops and the tokenizer library."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorelake.llm import queries, retrieval_packing, word_ids
from lorelake.llm.common import documents

PATH = queries.WORD_TOKENIZER


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def plain_windows(rests, df, number, mean, window):
    """The same greedy rule with dictionaries: all unused rests are scored for each seed."""
    idf = lambda x: math.log1p((number - df[x] + 0.5) / (df[x] + 0.5))
    k1, b = retrieval_packing.K1, retrieval_packing.B
    weight = [{x: idf(x) * r.count(x) * (k1 + 1) / (r.count(x) + k1 * (1 - b + b * len(r) / mean)) for x in set(r)} for r in rests]
    unused, out, cut = set(range(len(rests))), [], None
    while unused or cut:
        if cut is None:
            cut = (min(unused), 0)
            unused.discard(cut[0])
        seed, at = cut
        taken, cut = [(seed, at, len(rests[seed]) - at)], None
        room = window - taken[0][2]
        scores = {j: sum(weight[j].get(x, 0.0) for x in sorted(weight[seed])) for j in unused} if room else {}
        for j in sorted(scores, key=lambda j: (-scores[j], j)):
            n = min(room, len(rests[j]))
            taken.append((j, 0, n))
            unused.discard(j)
            room -= n
            if not room:
                cut = (j, n) if n < len(rests[j]) else None
                break
        out.append(taken)
    return out


def test_windows_follow_the_plain_rule():
    rng = random.Random(5)
    for size, window in ((1, 16), (40, 64), (300, 64)):
        rests = [[rng.choice([rng.randrange(8), rng.randrange(60)]) for _ in range(rng.randint(1, window - 1))] for _ in range(size)]
        rests[size // 2] = rests[0]
        df = np.zeros(61, np.int64)
        for r in rests:
            df[list(set(r))] += 1
        mean = sum(map(len, rests)) / size
        idf = np.log1p((size - df + 0.5) / (df + 0.5))
        got = list(retrieval_packing.windows([np.array(r, "<u2") for r in rests], idf, mean, window))
        assert got == plain_windows(rests, df.tolist(), size, mean, window)


def held(pieces, docs, ids_of, window):
    """Check all laws of a packing; returns sequences as lists of pieces."""
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, [*ids_of(r["text"]), 2]) for r in docs.select("doc_id", "text").collect())
    sequences, by_doc = {}, {}
    for r in pieces.collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for parts in sequences.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total == window or total < window and total & (total - 1) == 0
    found = []
    for (doc, tokens), parts in by_doc.items():
        # Full repeats of a row have equal pieces more than once: as many texts as there are first pieces.
        copies = sum(len(ids) for _, ids in parts) // tokens
        whole = {start: ids for start, ids in parts} if copies == 1 else None
        text = [x for s in sorted(whole) for x in whole[s]] if whole else None
        found += [(doc is None, doc or 0, text)] * copies
    assert [x[:2] for x in want] == sorted((x[:2] for x in found))
    texts = {x[:2]: x[2] for x in found}
    assert all(texts[a, b] is None or texts[a, b] == ids for a, b, ids in want)
    return sequences


def test_pack_odd_rows(odd_docs, no_docs):
    held(retrieval_packing.pack(odd_docs, PATH), odd_docs, library(), 4096)
    held(retrieval_packing.pack(odd_docs, PATH, window=16, shard_tokens=200, part_tokens=1000), odd_docs, library(), 16)
    assert retrieval_packing.pack(no_docs, PATH).count() == 0


def test_query(spark, small):
    docs = documents(spark, small)
    pieces = retrieval_packing.pack(docs, PATH)
    sequences = held(pieces, docs, library(), 4096)
    assert sum(len(p) > 1 for p in sequences.values()) > 10
    sums = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in pieces.collect()}
    rows = queries.op11_pack(spark, small).collect()
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows} == sums
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_copies_share_windows(spark):
    """Rests with the same rare words are neighbours of each other before all others."""
    words = [f"{a}{b}" for a in ("tiger", "walnut", "comet", "harbor") for b in ("", "s", "like", "land")]
    rows = [(i, " ".join([words[i % 16]] * 30 + ["the of and"] * 3)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = {}
    for r in retrieval_packing.pack(docs, PATH, window=256).collect():
        of.setdefault(r["sequence_id"], []).append(r["doc_id"] % 16)
    kinds = [len(set(x)) for x in of.values() if len(x) > 2]
    assert sum(kinds) / len(kinds) <= 3


def ids_of_all(words, texts):
    ids, starts = words.ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_word_ids_equal_the_library(spark):
    words, ids_of, rng = word_ids.Words(open(PATH, encoding="utf-8").read()), library(), random.Random(3)
    pool = [chr(c) for c in [*range(0x300), 0x307, 0x3A3, 0x3C2, 0xFB01, 0x2028, 0x3000, 0x4E00, 0xAC00, 0x1F600, 0x660]] + ["'s", "'LL", " ", "\n", "<|endoftext|>"] * 30
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(500)] + ["a" * 100_000, "日本" * 20_000, "a b" * 30_000, "", None, " \n "]
    texts += [t for c in range(0x400) for t in (f"a{chr(c)}b", f"{chr(c)}{chr(c)} '{chr(c)}s", f"A{chr(c)}.")]
    texts += [r["text"] for r in documents(spark, "/root/testdata/sf0.001").collect()]
    assert words.by_word
    assert ids_of_all(words, texts) == [ids_of(t) for t in texts]
    assert ids_of_all(words, []) == [] and ids_of_all(words, [None]) == [[]]
    words.by_word = False
    assert ids_of_all(words, ["Some Text, it's", None]) == [ids_of("Some Text, it's"), []]


def test_caches_are_bounded():
    words, ids_of = word_ids.Words(open(PATH, encoding="utf-8").read(), most=50), library()
    texts = [" ".join(f"w{'abc'[i % 3]}{'xyzuv'[i % 5] * (i % 40)}" for i in range(2000)), "k" * 1000]
    for _ in range(2):
        assert ids_of_all(words, texts) == [ids_of(t) for t in texts]
        assert 0 < len(words.parts) <= 50 and len(words.older) <= 50 and "k" * 1000 not in words.parts


def test_order_key_is_the_same_for_equal_texts(spark):
    spec = spark.sparkContext.broadcast(open(PATH, encoding="utf-8").read())
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green blue"), (3, "other things here")], "row bigint, text string")
    keys = {r["row"]: r["order_key"] for r in docs.mapInArrow(retrieval_packing.encoder(spec, 2), "row bigint, doc_tokens bigint, packed binary, order_key bigint").select("row", F.col("order_key")).collect()}
    assert keys[1] == keys[2] != keys[3]

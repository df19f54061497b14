"""Forward passes, counts and codec against the SentencePiece library and against plain loops."""

import base64
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

import corpus_pipeline
from lorelake.llm import pieces, sentencepiece_codec, token_counts
from lorelake.llm.common import documents
from tests.llm.conftest import LONG, ROWS

DATA = open(corpus_pipeline.MODEL_PATH, "rb").read()
ODD = ["", "a", " ", "  x   y ", "a\nb\n\n c\t", "😀𝔘日本語 中文", "<s>x</s>", "ab" * 50, "hello" * 30, "the " * 5 + " " * 40 + "end", "a\x00b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=DATA)


def sane_unigram(step: float = 64.0) -> bytes:
    """The same pieces as a unigram file; at the default step single precision adds the scores exactly."""
    proto = pb.ModelProto()
    proto.ParseFromString(DATA)
    proto.trainer_spec.model_type = pieces.UNIGRAM
    rng = random.Random(1)
    for i, p in enumerate(proto.pieces):
        if p.type == pieces.NORMAL:
            p.score = -round(step * (math.log(i + 2) + rng.random() / 2)) / step
    return proto.SerializeToString()


def random_texts(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["th", "in", "hello", "worldthe", "日本", "😀", "ing", "er", "\n", "a", "e", "st ", "   "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 150))) for _ in range(count)]


@pytest.mark.parametrize("data", [DATA, sane_unigram()], ids=["bpe", "unigram"])
def test_ids_are_the_librarys(data, spark, small):
    texts = [r["text"] for r in documents(spark, small).select("text").collect()] + ODD + random_texts(80, 2)
    p, lib = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    want = lib.encode(texts)
    assert [x.tolist() for x in p.encode_all([p.marked(t) for t in texts])] == want
    assert p.count_all(texts) == [len(x) for x in want]


# Of unigram paths with equal scores (the same pieces in another order) chunks may take another one than a single pass.
@pytest.mark.parametrize("data", [DATA, sane_unigram(2.0**20)], ids=["bpe", "unigram"])
@pytest.mark.parametrize("size", [7, 16, 33, 300])
def test_chunks_give_the_same_ids(data, size):
    p = pieces.Pieces(data)
    for text in [t for t in ODD if t] + random_texts(25, size):
        s = p.marked(text)
        cuts = [*range(0, len(s), size), len(s)]
        mats = [p.transfer(s, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        reach = [np.zeros((1, 1))]
        for m in mats:
            reach.append(pieces.maxplus(reach[-1], m))
        states = [0]
        for k in range(len(mats) - 1, -1, -1):
            states.append(int(np.argmax(reach[k][0] + mats[k][:, states[-1]])))
        states.reverse()
        ids = [p.chunk_ids(s, a, b, states[k], states[k + 1]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        got, want = np.concatenate(ids), p.encode_all([s])[0]
        if p.bpe:
            assert got.tolist() == want.tolist(), text
        assert p.decode(got) == p.decode(want)
        assert math.isclose(sum(p.score[i] for i in got), sum(p.score[i] for i in want), rel_tol=1e-9), text


def test_combining_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.normal(size=(4, 4))) for _ in range(3))
    left, right = pieces.maxplus(pieces.maxplus(a, b), c), pieces.maxplus(a, pieces.maxplus(b, c))
    assert np.allclose(np.nan_to_num(left, neginf=-1e9), np.nan_to_num(right, neginf=-1e9))


def plain_unigram(p: pieces.Pieces, text: str) -> float:
    s, best = p.marked(text), [0.0]
    for i in range(1, len(s) + 1):
        options = [best[i - k] + p.score[p.ids[s[i - k : i]]] for k in range(1, min(i, p.longest) + 1) if s[i - k : i] in p.ids]
        if s[i - 1] not in p.ids:
            options.append(best[i - 1] + p.worst)
        best.append(max(options))
    return best[-1]


def test_unigram_pass_has_the_best_score():
    p = pieces.Pieces(sane_unigram())
    for text in random_texts(20, 9):
        s = p.marked(text)
        ids = p.back(s, p.run(s, 0, pieces.RESET, len(s))[0], len(s))
        # Runs of byte ids are unknown characters.
        score = sum(p.score[i] for i in ids if p.text[i] in p.ids) + p.worst * sum(c not in p.ids for c in s)
        assert math.isclose(score, plain_unigram(p, text), rel_tol=1e-9)


def test_token_counts(odd_docs, no_docs, library):
    rows = token_counts.token_counts(odd_docs, corpus_pipeline.MODEL_PATH).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["n_tokens"] == len(library.encode(r["text"] or ""))
        assert (r["n_unigram"] > 0) == bool(r["text"])
        assert r["key"] == "own key"
    assert token_counts.token_counts(no_docs, corpus_pipeline.MODEL_PATH).count() == 0


def test_both_counts_are_those_of_the_single_passes(spark, small):
    texts = [r["text"] for r in documents(spark, small).select("text").collect()] + ODD
    own, uni = pieces.Pieces(DATA), pieces.Pieces(DATA, "unigram")
    assert token_counts.counts_of(DATA, texts) == list(zip(own.count_all(texts), uni.count_all(texts), strict=True))


@pytest.mark.parametrize("chunk", [1000, 65_536])
def test_codec(odd_docs, no_docs, library, chunk):
    encoded = sentencepiece_codec.encode(odd_docs, corpus_pipeline.MODEL_PATH, chunk_chars=chunk, round_trip=True)
    rows = sentencepiece_codec.decode(encoded, corpus_pipeline.MODEL_PATH).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["chunk_no"]):
        key = (r["doc_id"], r["source"], r["lang"])
        got.setdefault(key, []).append(r)
        assert r["done"] == "own done"
        assert r["decoded"] == (r["text"].replace("▁", " ") if r["text"] is not None else None)
        assert r["round_trip"] == (r["decoded"] == r["text"])
    for doc_id, text, lang, source in ROWS:
        parts = got[(doc_id, source, lang)]
        if text is None:
            assert [p["ids"] for p in parts] == [None]
            continue
        copies = Counter((r[0], r[3], r[2]) for r in ROWS)[(doc_id, source, lang)]
        assert [i for p in parts for i in p["ids"]][: len(library.encode(text))] == library.encode(text) or copies > 1
        assert sum(len(p["ids"]) for p in parts) == copies * len(library.encode(text))
        if copies == 1:
            assert "".join(p["text"] for p in parts) == text
    assert max(r["n_chunks"] for r in rows) == -(-(len(LONG) + 1) // chunk)
    assert sentencepiece_codec.encode(no_docs, corpus_pipeline.MODEL_PATH).count() == 0


def test_chunks_of_one_text_are_work_of_many_tasks(spark, library):
    data = spark.sparkContext.broadcast(DATA)
    long = spark.createDataFrame([(1, LONG)], "key bigint, text string").coalesce(1)
    rows = sentencepiece_codec.chunks(long, "key", "text", data, 1000).withColumn("task", F.spark_partition_id()).collect()
    assert [r["chunk_no"] for r in sorted(rows, key=lambda r: r["chunk_no"])] == list(range(151))
    assert len({r["task"] for r in rows}) > 1
    p = pieces.Pieces(DATA)
    assert all(r["matrix"] == p.transfer(r["stretch"], r["p0"], r["p1"]).tobytes() and len(r["stretch"]) <= 1000 + 4 * p.longest for r in rows)


def unbroken():
    rng = random.Random(11)
    mixed = "".join(chr(rng.choice([rng.randrange(0x4E00, 0x9FA5), rng.randrange(0x3041, 0x3097), rng.randrange(0xE01, 0xE2F), rng.randrange(0xAC00, 0xD7A0)])) for _ in range(65_000))
    return {"one letter": "한" * 60_000, "many letters": mixed, "encoded data": base64.b64encode(rng.randbytes(48_000)).decode()}


@pytest.mark.parametrize("name", list(unbroken()))
def test_long_texts_without_borders_take_linear_memory(library, name):
    text = unbroken()[name]
    p = pieces.Pieces(DATA)
    tracemalloc.start()
    ids = p.encode_all([p.marked(text)])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == library.encode(text)
    assert peak < 60_000_000
    # Such a word is not kept.
    assert all(len(w) <= pieces.LONG_WORD for part in p.caches["ids"] for w in part)
    assert token_counts.counts_of(DATA, [text])[0][0] == len(ids)


def test_long_texts_without_borders_in_both_paths(spark, library):
    texts = unbroken() | {"giant": unbroken()["many letters"] * 3}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    for size in (65_536, 4_000):  # the second one: several rounds of neighbours
        rows = sentencepiece_codec.encode(docs, corpus_pipeline.MODEL_PATH, chunk_chars=size, round_trip=True).collect()
        assert all(r["round_trip"] for r in rows)
        for k, text in enumerate(texts.values()):
            own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["chunk_no"])
            assert [i for r in own for i in r["ids"]] == library.encode(text)
            assert "".join(r["text"] for r in own) == text


def test_neighbours_are_combined_a_few_at_a_time(spark, monkeypatch):
    """States of many chunks from rounds of few neighbours are those of one pass over all of them."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for key, count in enumerate((1, 2, 3, 17, 40)):
        widths = [1, *rng.integers(1, 4, count - 1).tolist(), 1]
        mats = [rng.normal(size=(a, b)) for a, b in zip(widths, widths[1:], strict=False)]
        rows += [(key, k, *m.shape, m.tobytes()) for k, m in enumerate(mats)]
        reach = [np.zeros((1, 1))]
        for m in mats:
            reach.append(pieces.maxplus(reach[-1], m))
        states = [0]
        for k in range(count - 1, -1, -1):
            states.append(int(np.argmax(reach[k][0] + mats[k][:, states[-1]])))
        states.reverse()
        want |= {(key, k): (states[k], states[k + 1]) for k in range(count)}
    monkeypatch.setattr(sentencepiece_codec, "FAN", 3)
    parts = spark.createDataFrame(rows, "key bigint, chunk_no int, n_left int, n_right int, matrix binary")
    assert {(r["key"], r["chunk_no"]): (r["entry"], r["leave"]) for r in sentencepiece_codec.edge_states(parts).collect()} == want

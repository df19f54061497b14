"""License scan, quality rules, quality classifier and language against plain loops and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from lorelake.llm import compression_quality, crf, language_crf, license_scan, quality_rules
from lorelake.llm.common import documents, labels
from tests.llm.conftest import ROWS

SMALL = "/root/testdata/sf0.01"


def plain_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(license_scan.WORD, lower)


def plain_scan(text):
    w, places = plain_words(text), []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    found = {label for _, label in places}
    for label, (words, phrases) in license_scan.TEMPLATES.items():
        t = words.split()
        offsets = [(license_scan.find(t, p.split()), p.split()) for p in phrases]
        if any(all(w[s + o : s + o + len(p)] == p for o, p in offsets if s + o >= 0) and all(s + o >= 0 for o, _ in offsets) for s in range(-len(t), len(w))):
            found.add(label)
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(found))


def test_license_scan(odd_docs, no_docs, spark):
    phrases = " ".join(words for words, _ in license_scan.TEMPLATES.values())
    extra = spark.createDataFrame([(50, phrases), (51, "cc by cc by"), (52, "reserved all rights"), (53, "Public License version 3 of the GNU"), (54, "by nc 4 0")], "doc_id bigint, text string")
    for docs in (odd_docs, extra, documents(spark, SMALL)):
        for r in license_scan.scan(docs).collect():
            got = tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
            assert got == plain_scan(r["text"]), r["text"][:200]
            assert (r["score"] > 0) == bool(r["labels"]) and 0 <= r["score"] <= 1
            assert len(r["places"] or []) >= r["n_base"]
    assert {r["hits"] for r in license_scan.scan(odd_docs).collect()} == {"own hits"}
    assert license_scan.scan(no_docs).count() == 0


def plain_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered, seen, repeats = Counter(windows), set(), set(), 0
    for i, g in enumerate(windows):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


def test_line_words_are_the_base_words():
    """Other spaces than ASCII ones do not part words, alone or beside ASCII ones."""
    for text in ("a\u00a0b\u3000c", "\u00a0\n\u3000x y\u2003z\nplain words here", "\x1ca\x85b\n\n \t"):
        lines = quality_rules.lines_of(text)
        assert quality_rules.line_features(lines)[1].sum() == quality_rules.base_counts(text)[0] == plain_base(text)[0]


def test_quality_rules(odd_docs, no_docs, spark):
    docs, marked = documents(spark, SMALL), labels(spark, SMALL)
    model = quality_rules.fit(docs, marked)
    known = {r["doc_id"]: r["quality"] for r in marked.collect()}
    right = seen = 0
    for frame in (odd_docs, docs):
        for r in quality_rules.apply_rules(frame, model).collect():
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_base(r["text"])
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and r["content_share"] >= 0.5)
            if frame is docs and r["doc_id"] in known and not r["base_failed"]:
                seen, right = seen + 1, right + (r["kept"] == (known[r["doc_id"]] == 1))
    assert right >= 0.97 * seen
    turned = marked.withColumn("quality", F.when(compression_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality_rules.fit(docs, turned).chain
    assert (other.weights == model.chain.weights).all() and (other.transitions == model.chain.transitions).all()
    assert quality_rules.apply_rules(no_docs, quality_rules.fit(no_docs, marked)).count() == 0


def test_quality_classifier(odd_docs, no_docs, spark):
    docs, marked = documents(spark, SMALL), labels(spark, SMALL)
    model = compression_quality.fit(docs, marked)
    scored = {r["doc_id"]: r["score"] for r in compression_quality.score(docs, model).collect()}
    out = [(scored[r["doc_id"]] >= 0.3, r["quality"] == 1) for r in marked.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(out) > 40 and np.mean([a == b for a, b in out]) > 0.95
    rows = compression_quality.score(odd_docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["key"] == "own key" for r in rows)
    # Neither labels nor documents: the same score for all.
    bare = compression_quality.fit(no_docs, marked.limit(0))
    assert {r["score"] for r in compression_quality.score(odd_docs, bare).collect()} == {0.5}
    assert compression_quality.score(no_docs, model).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, marked = documents(spark, SMALL), labels(spark, SMALL)
    from pyspark.sql import functions as F

    turned = marked.withColumn("quality", F.when(compression_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (compression_quality.fit(docs, m) for m in (marked, turned))
    assert (a.good, a.bad, a.weights) == (b.good, b.bad, b.weights)


def test_language(odd_docs, no_docs, spark):
    docs = documents(spark, SMALL)
    model = language_crf.fit(docs)
    rows = language_crf.predict(docs, model).collect()
    out = [r["lang"] == r["lang_pred"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) > 150 and np.mean(out) > 0.95
    for r in language_crf.predict(odd_docs, model).collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") != letters and 0 <= r["score"] <= 1
    none = language_crf.fit(no_docs)
    assert {r["lang_pred"] for r in language_crf.predict(odd_docs, none).collect()} == {"und"}
    assert language_crf.predict(no_docs, model).count() == 0


def test_code_switching_is_labelled_word_by_word(spark):
    docs = documents(spark, SMALL)
    model = language_crf.fit(docs)
    texts = {lang: language_crf.words_of(docs.filter(f"lang = '{lang}'").orderBy("doc_id").first()["text"].lower())[:40] for lang in ("de", "fr")}
    p = model.word_marginals([texts["de"] + texts["fr"]]).argmax(1)
    want = [model.languages.index("de")] * len(texts["de"]) + [model.languages.index("fr")] * len(texts["fr"])
    assert np.mean(p == want) > 0.85


def plain_chain(e, a):
    n, k = e.shape
    lse = lambda x, axis: np.log(np.exp(x - x.max()).sum(axis)) + x.max()
    alpha, v, vit, pointers = [], np.zeros(k), np.zeros(k), []
    for t in range(n):
        v = lse(v[:, None] + a, 0) + e[t]
        alpha.append(v)
        m = vit[:, None] + a
        pointers.append(m.argmax(0))
        vit = m.max(0) + e[t]
    beta, b = [], np.zeros(k)
    for t in range(n - 1, -1, -1):
        beta.append(b)
        b = lse(a + (b + e[t])[None], 1)
    p = np.exp(np.array(alpha) + np.array(beta[::-1]) - lse(alpha[-1], 0))
    s, path = int(vit.argmax()), []
    for t in range(n - 1, -1, -1):
        path.append(s)
        s = pointers[t][s]
    return p / p.sum(1, keepdims=True), path[::-1]


def test_chunked_passes_are_single_passes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        k, lengths = int(rng.integers(1, 5)), rng.integers(1, 150, size=4)
        e, a, at = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k)), 0
        p, labels_ = crf.marginals(e, lengths, a), crf.best_labels(e, lengths, a)
        for n in lengths:
            want, path = plain_chain(e[at : at + n], a)
            assert np.allclose(want, p[at : at + n], atol=1e-8) and path == labels_[at : at + n].tolist()
            at += n


def test_many_templates_are_data(spark):
    """The plan of 500 templates is that of 13; results equal plain loops over a table of templates."""
    import random

    rng = random.Random(4)
    names = [f"word{i}" for i in range(400)] + ["license", "the", "of"] * 60
    table = {}
    for k in range(500):
        words = [rng.choice(names) for _ in range(rng.randint(6, 14))]
        a = rng.randrange(len(words) - 3)
        table[f"t{k:03d}"] = (" ".join(words), [" ".join(words[a : a + 3])])
    given = spark.createDataFrame([(k, *v) for k, v in table.items()], "label string, words string, phrases array<string>")
    texts = [" ".join(rng.choices(names, k=200)) for _ in range(10)] + [" ".join(rng.sample([w for w, _ in table.values()], 3)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = license_scan.scan(docs, templates_given=given).collect()
    listed = license_scan.templates(given)
    assert len(listed) == 503
    for r in rows:
        w, want = plain_words(r["text"]), set()
        for label, t, phrases, _ in listed:
            offsets = [(license_scan.find(t, p), p) for p in phrases]
            for s in range(-len(t), len(w)):
                if all(s + o >= 0 and w[s + o : s + o + len(p)] == p for o, p in offsets):
                    want.add((label, s))
        assert {(p["label"], p["start"]) for p in r["places"] or []} == want
        assert r["labels"] == ",".join(sorted({x for x, _ in want}))
    assert sum(len(r["places"] or []) for r in rows) > 30


def test_postings_are_intersected_before_phrases_are_verified(spark):
    """A lone rare word implies a start; only where the other postings agree is it left."""
    listed = license_scan.templates()
    vocabulary = sorted({w for _, ws, _, _ in listed for w in ws})
    numbers = license_scan.Codes(spark, vocabulary)
    postings, _, _ = license_scan.indexed(listed, {w: 1.0 + (w == "apache") for w in vocabulary})
    texts = ["apache " * 50, "the apache license version 2 0", "license version 2 0 apache", "nothing of the kind"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    coded = docs.select("k", numbers.coded(license_scan.words_of(F.col("text"))).alias("codes")).withColumn("spots", license_scan.spots_of(F.col("codes"), numbers, postings))
    rounds = license_scan.starts_of(F.col("spots"), numbers, postings)
    apache = next(t for t, x in enumerate(listed) if x[0] == "apache-2.0") * license_scan.SHIFT
    rows = coded.select("k", "spots", *[r.alias(f"r{i}") for i, r in enumerate(rounds)]).orderBy("k").collect()
    of = lambda keys: {x for x in keys or [] if apache <= x < apache + license_scan.SHIFT}
    first, agreed = [of(r["r0"]) for r in rows], [set.intersection(*[of(r[f"r{i}"]) for i in range(len(rounds))]) for r in rows]
    assert [len(x) for x in first[:3]] == [50, 1, 1] and rows[3]["spots"] is None
    assert [len(x) for x in agreed[:3]] == [0, 1, 0]


def test_words_are_those_of_the_pattern(spark):
    text = "".join(map(chr, range(256))) + " a\x00b  É_x½ 日本　語 ｆ"
    assert spark.createDataFrame([(text,), (None,)], "t string").select(license_scan.words_of(F.col("t")).alias("w")).collect() == [(plain_words(text),), ([],)]

"""License scan with a positional index of rare license words.

Templates are license texts as word sequences; some of their words are mandatory key
phrases. They are data: a few built-in ones, or a table of any length.

1. Every text is split into words once. Each word becomes the code of that template word,
   or 0; the codes are written to the shared folder, and all that follows reads only them.
2. Document frequencies of the template words are counted over all documents. A template's
   postings are the rarest words of its key phrases, with their positions, rarest first.
3. A file's highest-IDF license words are those with a first posting. Each place of one gives
   a template and the start that it implies (file position minus template position). These
   starts are intersected with those of the second postings, the third, and so on (a template
   with fewer postings repeats its first), so a start stays only if all its postings agree.
4. Key phrases are verified word by word at the starts that are left.

A base phrase is its own template and key phrase. Every match holds all words of its key
phrases, so the intersection loses none. The index is array literals looked up by code;
the plan does not grow with the templates. Words are lower-cased A-Z only.

Null and empty texts have no words: counts are 0, places null, labels empty. Of equally rare
words the earlier one comes first. Repeated rows are separate files. An empty table gives no
rows. Columns named like added ones are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelake.llm.common import adding, fresh, stash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Labels of the method, each with the words of its template and its key phrases.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "license version 3"]),
    "gpl-2.0": ("this program is licensed under the gnu general public license version 2", ["gnu general public license", "license version 2"]),
    "lgpl": ("licensed under the gnu lesser general public license", ["lesser general public license"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc0": ("dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "proprietary": ("this software is proprietary and confidential all rights reserved", ["proprietary and confidential"]),
}
RARE_WORDS = 4  # words of a template that count for its score, besides the rarest one of each phrase
POSTINGS = 4  # words of a template's key phrases that are intersected
SLOT_WORDS = 8  # code = slot * SLOT_WORDS + place in the slot, from 1
SHIFT, BIAS = 1 << 32, 1 << 24  # key of a start: template * SHIFT + start + BIAS


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())  # the characters that WORD leaves out, but for A-Z


def words_of(text: Column) -> Column:
    """Matches of WORD in the lower-cased text; one pass over its characters and a split at spaces."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def templates(given: dict | DataFrame | None = None) -> list[tuple[str, list[str], list[list[str]], bool]]:
    """(label, words, key phrases, base) of all templates; base phrases come first.

    ``given`` replaces the built-in templates: label to (words, phrases), or a table with
    label, words and phrases (array), which has to be small enough for the driver.
    """
    if isinstance(given, DataFrame):
        given = {r["label"]: (r["words"], r["phrases"]) for r in given.select("label", "words", "phrases").orderBy("label").collect()}
    base = [(label, phrase.split(), [phrase.split()], True) for phrase, label in BASE.items()]
    return base + [(label, words.split(), [p.split() for p in phrases], False) for label, (words, phrases) in (TEMPLATES if given is None else given).items()]


def find(sequence: list[str], part: list[str]) -> int:
    return next(i for i in range(len(sequence)) if sequence[i : i + len(part)] == part)


def constant(value, kind: str) -> Column:
    """A literal of any nested type; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


class Codes:
    """Numbers of the template words: a slot by hash and the place in it, so a lookup reads one slot."""

    def __init__(self, spark: SparkSession, vocabulary: list[str]):
        slots = 64
        while slots < 4 * len(vocabulary):
            slots *= 2
        table = spark.createDataFrame([(w,) for w in vocabulary], "word string")
        while True:
            self.slots = slots
            held: list[list[str]] = [[] for _ in range(slots)]
            for r in table.select("word", self.slot(F.col("word")).alias("slot")).collect():
                held[r["slot"]].append(r["word"])
            if max(map(len, held)) < SLOT_WORDS:
                break
            slots *= 2
        self.held = [sorted(words) for words in held]
        self.of = {w: h * SLOT_WORDS + k + 1 for h, words in enumerate(self.held) for k, w in enumerate(words)}

    def slot(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.slots)).cast("int")

    def coded(self, words: Column) -> Column:
        """The code of each word, 0 for words of no template."""
        listed = constant(self.held, "array<array<string>>")
        place = lambda w: F.array_position(F.get(listed, self.slot(w)), w)
        return F.transform(words, lambda w: F.when(place(w) > 0, (self.slot(w) * SLOT_WORDS + place(w)).cast("int")).otherwise(F.lit(0)))

    def by_code(self, values: dict[int, list], kind: str) -> Column:
        """An array literal of lists, looked up by code."""
        return constant([values.get(c) for c in range(max(values, default=0) + 1)], f"array<array<{kind}>>")


def indexed(listed, idf: dict[str, float]) -> tuple[list[list[tuple[int, str]]], list[list[tuple[int, str]]], list[list[tuple[int, str]]]]:
    """For each template (position, word) of its postings (rarest first), of its scored words and of its key phrases."""
    postings, scored, phrased = [], [], []
    for _, words, phrases, _ in listed:
        rarity = lambda i: (-idf[words[i]], i)  # noqa: B023, E731
        spans = [range(find(words, p), find(words, p) + len(p)) for p in phrases]
        held = sorted({i for span in spans for i in span}, key=rarity)
        anchors = {min(span, key=rarity) for span in spans}
        rare = set(sorted(range(len(words)), key=rarity)[:RARE_WORDS])
        postings.append([(i, words[i]) for i in held[:POSTINGS]])
        scored.append([(i, words[i]) for i in sorted(anchors | rare)])
        phrased.append([(i, words[i]) for i in sorted(held)])
    return postings, scored, phrased


def spots_of(codes: Column, numbers: Codes, postings: list[list[tuple[int, str]]]) -> Column:
    """Places of posted words in files that have a first posting: the highest-IDF license words; null for other files."""
    firsts = F.array(*[F.lit(c) for c in sorted({numbers.of[held[0][1]] for held in postings})])
    index = numbers.by_code({numbers.of[w]: [1] for held in postings for _, w in held}, "int")
    placed = F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["c"] > 0) & F.get(index, x["c"]).isNotNull())
    return F.when(F.arrays_overlap(codes, firsts), placed)


def starts_of(spots: Column, numbers: Codes, postings: list[list[tuple[int, str]]]) -> list[Column]:
    """Keys of the starts that each round of postings implies for a file."""

    def keys(index: Column) -> Column:
        own = F.filter(spots, lambda x: F.get(index, x["c"]).isNotNull())
        return F.flatten(F.transform(own, lambda x: F.transform(F.get(index, x["c"]), lambda p: p + x["i"])))

    rounds = []
    for r in range(max(map(len, postings))):
        by_code: dict[int, list] = {}
        for t, held in enumerate(postings):
            at, word = held[r] if r < len(held) else held[0]
            by_code.setdefault(numbers.of[word], []).append(t * SHIFT + BIAS - at)
        rounds.append(keys(numbers.by_code(by_code, "bigint")))
    return rounds


def scan(docs: DataFrame, text_col: str = "text", templates_given: dict | DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``places`` to every row.

    ``places`` lists (label, start, score) of every verified start. The score of a start is
    the IDF share of its template's rare words that stand at their place; a row's score is
    the largest, 0 without any. ``keep`` names the columns to return besides (default: all).
    """
    spark = docs.sparkSession
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    kept = adding(docs, *names)
    kept = kept if keep is None else kept.select(*[F.col(c) for c in kept.columns if c in keep])
    codes, spots, starts, checked, at = fresh(kept, "codes", "spots", "starts", "checked", "at")
    listed = templates(templates_given)
    vocabulary = sorted({w for _, ws, _, _ in listed for w in ws})
    numbers = Codes(spark, vocabulary)
    split = docs.select(*kept.columns, words_of(docs[text_col]).alias(codes))
    coded = stash(split.withColumn(codes, numbers.coded(F.col(codes))))

    # One slot more than there are words counts the documents themselves.
    counted = coded.select(F.explode(F.array_union(F.array(F.lit(0)), F.array_distinct(F.col(codes)))).alias("code")).groupBy("code").count()
    counts = {r["code"]: r["count"] for r in counted.collect()}
    total = counts.get(0, 0)
    idf = {w: math.log((total + 1) / (counts.get(numbers.of[w], 0) + 1)) + 1e-9 for w in vocabulary}
    postings, scored, phrased = indexed(listed, idf)

    weight_of = [sum(idf[w] for _, w in held) for held in scored]
    score_index = constant([[{"at": i, "c": numbers.of[w], "x": idf[w] / weight_of[t]} for i, w in held] for t, held in enumerate(scored)], "array<array<struct<at:int,c:int,x:double>>>")
    phrase_index = constant([[{"at": i, "c": numbers.of[w]} for i, w in held] for held in phrased], "array<array<struct<at:int,c:int>>>")
    label = constant([x[0] for x in listed], "array<string>")
    is_base = constant([x[3] for x in listed], "array<boolean>")

    def stands(start: Column, word: Column) -> Column:
        # get() gives null outside the array, so a phrase cut off by the file's edge fails.
        return F.coalesce(F.get(F.col(codes), start + word["at"]) == word["c"], F.lit(False))

    first, *others = starts_of(F.col(spots), numbers, postings)
    agreed = F.array_distinct(F.col(starts))
    for other in others:
        agreed = F.array_intersect(agreed, other)
    parted = F.transform(agreed, lambda k: F.struct(F.floor(k / SHIFT).cast("int").alias("t"), (F.pmod(k, F.lit(SHIFT)) - BIAS).cast("int").alias("start")))
    verified = F.filter(parted, lambda h: F.forall(F.get(phrase_index, h["t"]), lambda w: stands(h["start"], w)))
    share = lambda h: F.aggregate(F.get(score_index, h["t"]), F.lit(0.0), lambda a, w: a + F.when(stands(h["start"], w), w["x"]).otherwise(0.0))
    empty = "array<struct<t:int,start:int>>"
    base = coded.withColumn(spots, spots_of(F.col(codes), numbers, postings))
    base = base.withColumn(starts, first)
    base = base.withColumn(checked, F.when(F.coalesce(F.size(starts), F.lit(0)) > 0, verified).otherwise(F.array().cast(empty)))
    base = base.select(
        *kept.columns, F.size(codes).cast("long").alias("n_words"),
        F.when(F.size(checked) > 0, F.transform(checked, lambda h: F.struct(F.get(label, h["t"]).alias("label"), h["start"].alias("start"), share(h).alias("score"), F.get(is_base, h["t"]).alias("base")))).alias(at),
    )
    own = F.coalesce(F.filter(at, lambda p: p["base"]), F.array().cast("array<struct<label:string,start:int,score:double,base:boolean>>"))
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    places_of_base = F.transform(own, lambda p: p["start"])
    return base.select(
        *kept.columns, "n_words", F.size(own).cast("long").alias("n_base"),
        F.array_min(places_of_base).cast("long").alias("first_word"), F.array_max(places_of_base).cast("long").alias("last_word"),
        F.coalesce(joined(own), F.lit("")).alias("base_labels"), F.coalesce(joined(F.col(at)), F.lit("")).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform(at, lambda p: p["score"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.transform(at, lambda p: F.struct(p["label"], p["start"], p["score"])).alias("places"),
    )

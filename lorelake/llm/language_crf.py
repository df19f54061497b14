"""Language of words and texts by a linear-chain conditional random field.

Features of a word are its affixes, its character trigrams and the languages in whose
lexicon of frequent words it stands; transitions between neighbouring words' languages
are learned on windows pieced together from texts of different languages, so texts that
switch between languages are labelled word by word. Forward-backward gives each word's
probabilities; a text's language is the one with the largest expected share of its
words (first in order of names if equal), its score that share.

The model is fitted on at most ``per_language`` texts of each language, chosen by a hash
of their id, and at most ``windows`` windows of each; every text is labelled whole.
Null texts and texts without a letter are ``und`` with score 0, as are all texts when
there is no language to learn.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelake.llm import crf
from lorelake.llm.common import adding, fresh

PER_LANGUAGE, WINDOWS, WINDOW_WORDS = 300, 4, 24
LEXICON, BITS = 2000, 18
SLICES = 16
MAX_CACHED = 300_000
UNKNOWN = "und"
runs_of = re.compile(r"[^\W\d_]+").findall
crc = zlib.crc32


def words_of(text: str) -> list[str]:
    """Runs of letters; number signs that are no decimal digits may stand inside but do not make a word."""
    words = runs_of(text)
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class Model:
    languages: list[str]
    chain: crf.Chain | None
    lexicon: dict[str, list[int]]
    _rows: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": {}, "_table": None}

    def features(self, word: str) -> list[int]:
        return features(word, self.lexicon)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of the words; scores of words seen before are kept."""
        k = len(self.languages)
        known = self._rows
        missing = [w for w in dict.fromkeys(words) if w not in known]
        if self._table is None or len(known) + len(missing) > MAX_CACHED:
            known.clear()
            missing, self._table = list(dict.fromkeys(words)), np.zeros((0, k))
        if missing:
            lists = [features(w, self.lexicon) for w in missing]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in lists])])
            flat = np.fromiter((i for f in lists for i in f), np.int64, offsets[-1])
            at = len(known)
            if at + len(missing) > len(self._table):
                grown = np.zeros((max(2 * len(self._table), at + len(missing)), k))
                grown[:at] = self._table[:at]
                self._table = grown
            self._table[at : at + len(missing)] = self.chain.emissions(flat, offsets)
            known.update(zip(missing, range(at, at + len(missing)), strict=True))
        return self._table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def word_marginals(self, texts: list[list[str]]) -> np.ndarray:
        flat = [w for words in texts for w in words]
        return crf.marginals(self.emissions(flat), np.array([len(w) for w in texts if w]), self.chain.transitions)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of((t or "").lower()) for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        full = [i for i, w in enumerate(split) if w]
        if not full or not self.languages:
            return names, scores
        p = self.word_marginals([split[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(split[i]) for i in full])[:-1]])
        share = np.add.reduceat(p, starts, axis=0)
        share /= share.sum(1, keepdims=True)
        for i, row in zip(full, share, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = self.languages[best], float(min(1.0, row[best]))
        return names, scores


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Feature ids of a lower-case word, hashed; the lexicon's come first in their own range."""
    mask = (1 << BITS) - 1
    padded = f"^{word}$"
    out = [crc(padded[i : i + 3].encode()) & mask for i in range(len(padded) - 2)]
    out += [crc(f"p{word[:2]}".encode()) & mask, crc(f"q{word[:4]}".encode()) & mask, crc(f"s{word[-2:]}".encode()) & mask, crc(f"t{word[-4:]}".encode()) & mask]
    # Words outside every lexicon share one feature.
    out += [mask + 2 + i for i in lexicon.get(word, ())] or [mask + 1]
    return out


def train(samples: dict[str, list[str]], windows: int = WINDOWS, seed: int = 5) -> Model:
    """Fit on texts by language, in a fixed order."""
    languages = sorted(samples)
    rng = np.random.default_rng(seed)
    split = {lang: [w for t in samples[lang] if (w := words_of(t.lower()))] for lang in languages}
    languages = [lang for lang in languages if split[lang]]
    if not languages:
        return Model([], None, {})
    lexicon: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        # Words in several texts, so that no single text makes the lexicon.
        seen = Counter(w for words in split[lang] for w in set(words))
        for word, _ in sorted(((w, n) for w, n in seen.items() if n > 2), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, []).append(i)
    sequences = []
    half = WINDOW_WORDS // 2
    for i, lang in enumerate(languages):
        for words in split[lang]:
            for _ in range(windows):
                at = int(rng.integers(0, max(1, len(words) - WINDOW_WORDS + 1)))
                window, labels = words[at : at + WINDOW_WORDS], [i] * len(words[at : at + WINDOW_WORDS])
                if rng.random() < 0.3 and len(languages) > 1:  # the second half comes from another language
                    j = int(rng.integers(0, len(languages)))
                    other = split[languages[j]][int(rng.integers(0, len(split[languages[j]])))]
                    at = int(rng.integers(0, max(1, len(other) - half + 1)))
                    window, labels = window[:half] + other[at : at + half], labels[:half] + [j] * len(other[at : at + half])
                sequences.append(([np.array(features(w, lexicon), np.int64) for w in window], np.array(labels)))
    chain = crf.train(sequences, (1 << BITS) + 1 + len(languages), len(languages), epochs=3)
    return Model(languages, chain, lexicon)


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids whose language is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of texts with a language that are not held out (null ids are not used).

    Ids are chosen from the narrow columns first; only the chosen texts reach the driver.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("id is not null and lang is not null").filter(~held_out(F.col("id")))
    order = F.xxhash64(F.lit("lang"), "id")
    # First inside slices of a language, so that no task meets candidates from all others.
    ids = narrow.select("id", "lang").withColumn("slice", F.pmod(order, F.lit(SLICES)))
    for group in (["lang", "slice"], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(order, "id"))).filter(F.col("n") <= per_language)
    rows = narrow.filter("text is not null").join(F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "id", "text").toPandas()
    rows = rows.drop_duplicates().sort_values(["lang", "id", "text"])
    return train({lang: part["text"].tolist() for lang, part in rows.groupby("lang")})


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    kept = adding(docs, "lang_pred", "score")
    (c,) = fresh(kept, "predicted")
    return kept.withColumn(c, run.asNondeterministic()(docs[text_col].cast("string"))).select(*kept.columns, f"{c}.lang_pred", f"{c}.score")

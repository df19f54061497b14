"""Quality rules: exact base counts, and a line labeller that finds boilerplate.

A linear-chain conditional random field labels the lines of a text (those with a word)
as content or boilerplate by Viterbi decoding; its features are the line's length,
symbols, capitals, digits, ending, word variety and repetition, its transitions are
learned. A text is kept if its content lines hold at least ``min_share`` of its words
and no base rule fails.

Training lines come from at most ``per_class`` labelled texts of each class, chosen by
a hash of their id among those that are not held out (a fifth of the ids): lines of texts labelled good are content unless they repeat an
earlier line, lines of texts labelled bad are boilerplate; a line found in texts of both
classes is content. All texts are read whole. Null and empty texts have no words, fail
the base rules and are not kept. Repeated rows are judged alike, each on its own; an
empty table gives no rows and, as training data, a model for which every line is content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelake.llm import crf
from lorelake.llm.common import adding, fresh
from lorelake.llm.compression_quality import held_out
from lorelake.llm.grams import window_hashes, word_hashes

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SHARE = 20, 30, 0.5
PER_CLASS, SEQUENCE_LINES = 1500, 24
CONTENT, BOILERPLATE = 0, 1
HASHES: dict[bytes, int] = {}  # of words, kept by each worker process
letters_of = re.compile(r"[^\W\d_]").findall
# Upper bounds of the feature steps.
STEPS = {
    "words": (1, 2, 4, 8, 16, 32, 64), "symbols": (0.0, 0.01, 0.05, 0.15), "capitals": (0.1, 0.3, 0.7), "digits": (0.0, 0.05, 0.2),
    "variety": (0.2, 0.4, 0.6, 0.8, 0.95), "marks": (0.02, 0.05, 0.1, 0.2), "length": (2.0, 4.0, 7.0, 10.0, 14.0),
}
FLAGS = ("ends", "repeats", "first", "last")
OFFSETS = {name: sum(len(STEPS[n]) + 1 for n in list(STEPS)[:i]) for i, name in enumerate(STEPS)}
FLAG_AT = sum(len(s) + 1 for s in STEPS.values())
N_FEATURES = FLAG_AT + 2 * len(FLAGS)


def lines_of(text: str) -> list[str]:
    """The \\n-split lines that have a word."""
    return [line for line in text.split("\n") if line.strip(BLANKS)]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = lines_of(text)
    repeated = 0
    if len(words) > WINDOW:
        h = window_hashes(word_hashes(words, HASHES), WINDOW)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(words) + 1, np.int32)
        at = np.flatnonzero(twice)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
        repeated = int((np.cumsum(edges)[:-1] > 0).sum())
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features) ids of one text's lines, and their numbers of words."""
    seen: set[str] = set()
    values = np.zeros((len(lines), len(STEPS)))
    flags = np.zeros((len(lines), len(FLAGS)), np.int64)
    for i, line in enumerate(lines):
        words = line.encode().split()  # at ASCII white space only, as the base counts
        chars = max(1, len(line) - line.count(" "))
        alpha = len(letters_of(line))
        upper = sum(1 for c in line if c.isupper()) if line != line.lower() else 0
        values[i] = (
            len(words), sum(map(line.count, SYMBOLS)) / chars, upper / max(1, alpha), sum(map(line.count, "0123456789")) / chars,
            len(set(words)) / max(1, len(words)), (chars - alpha) / chars, chars / max(1, len(words)),
        )
        flags[i] = (line.rstrip(BLANKS)[-1:] in ".!?…", line in seen, i == 0, i == len(lines) - 1)
        seen.add(line)
    ids = [OFFSETS[name] + np.searchsorted(STEPS[name], values[:, j], side="left") for j, name in enumerate(STEPS)]
    ids += [FLAG_AT + 2 * j + flags[:, j] for j in range(len(FLAGS))]
    return np.stack(ids, axis=1).astype(np.int64), values[:, 0].astype(np.int64)


@dataclass
class Model:
    chain: crf.Chain

    def shares(self, texts: list[str]) -> list[float]:
        """Share of each text's words that stand in content lines; 0 without words."""
        parts = [line_features(lines_of(t)) for t in texts]
        full = [i for i, (_, n) in enumerate(parts) if len(n)]
        out = [0.0] * len(texts)
        if not full:
            return out
        features = np.concatenate([parts[i][0] for i in full])
        words = np.concatenate([parts[i][1] for i in full])
        lengths = np.array([len(parts[i][1]) for i in full])
        labels = crf.best_labels(self.chain.weights[features].sum(axis=1), lengths, self.chain.transitions)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        content = np.add.reduceat(words * (labels == CONTENT), starts) / np.maximum(np.add.reduceat(words, starts), 1)
        for i, share in zip(full, content, strict=True):
            out[i] = float(share)
        return out


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, label) rows in a fixed order; without rows every line is content."""
    good = {line for text, label in rows if label for line in lines_of(text)}
    windows = []
    for text, label in rows:
        lines = lines_of(text)
        if not lines:
            continue
        ids, _ = line_features(lines)
        repeats = ids[:, len(STEPS) + FLAGS.index("repeats")] == FLAG_AT + 2 * FLAGS.index("repeats") + 1
        y = np.array([BOILERPLATE if (r if label else line not in good) else CONTENT for line, r in zip(lines, repeats, strict=True)])
        for at in range(0, len(lines), SEQUENCE_LINES):
            windows.append((list(ids[at : at + SEQUENCE_LINES]), y[at : at + SEQUENCE_LINES]))
    if not windows:
        weights = np.zeros((N_FEATURES, 2))
        weights[:, CONTENT] = 1.0
        return Model(crf.Chain(weights, np.zeros((2, 2))))
    return Model(crf.train(windows, N_FEATURES, 2, epochs=6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of labelled rows that are not held out.

    Ids labelled both ways, null ids and null labels are not used; of an id that has several rows each text counts once.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("id")))
    clear = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label")
    order = F.xxhash64(F.lit("lines"), "id")
    chosen = clear.filter("label = 0").orderBy(order, "id").limit(per_class).union(clear.filter("label = 1").orderBy(order, "id").limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").toPandas().drop_duplicates().sort_values(["id", "text"])
    return train(list(rows[["text", "label"]].itertuples(index=False, name=None)))


def apply_rules(docs: DataFrame, model: Model, text_col: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_share: float = MIN_SHARE) -> DataFrame:
    """Add the base counts (long), ``base_failed``, ``content_share`` (double) and ``kept`` to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf(f"struct<{', '.join(f'{n}: bigint' for n in names)}, content_share: double>")
    def run(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(names))
        shares = pa.array(sent.value.shares(texts), pa.float64())
        return pa.StructArray.from_arrays([*[pa.array(counts[:, i]) for i in range(len(names))], shares], [*names, "content_share"])

    kept = adding(docs, *names, "base_failed", "content_share", "kept")
    (c,) = fresh(kept, "measured")
    out = kept.withColumn(c, run.asNondeterministic()(docs[text_col].cast("string"))).select(*kept.columns, f"{c}.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= min_share))

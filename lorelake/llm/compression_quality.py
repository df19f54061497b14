"""Quality classifier by compression with class dictionaries.

Two zstandard dictionaries are trained, one from texts labelled good, one from texts
labelled bad. A text is cut into windows (all of it), each window is compressed with
both, and the sizes are summed. The normalised difference of the sums, with the text's
length and compression ratio for calibration, becomes a probability by a logistic
curve fitted on labelled texts that no dictionary has seen.

The model is fitted on at most ``per_class`` labelled texts of each class, chosen by a
hash of their id, and at most ``windows`` windows of each; every text is scored whole.
Lines that occur in two texts of that sample are left out of the dictionaries, so that
shared passages speak for neither class. Null counts as empty; an empty text gets the
score of the calibrated curve at zero size.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelake.llm.common import adding, fresh

PER_CLASS, WINDOWS, WINDOW_BYTES = 2000, 4, 1000
DICTIONARY_BYTES, LEVEL = 112_640, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    _made: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def compressors(self) -> tuple:
        if self._made is None:
            made = []
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data) if data else None
                if d:
                    d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._made = tuple(made)
        return self._made

    def features(self, text: str | None) -> list[float]:
        data = (text or "").encode()
        good, bad = self.compressors()
        g = b = 0
        for at in range(0, len(data), WINDOW_BYTES):
            window = data[at : at + WINDOW_BYTES]
            g += len(good.compress(window))
            b += len(bad.compress(window))
        difference = (b - g) / max(b, g, 1)
        ratio = min(g, b) / max(len(data), 1)
        size = np.log1p(len(data))
        return [difference, difference * min(size, 7.0), ratio, ratio * ratio, size, max(0.0, 6.0 - size)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = (np.array([self.features(t) for t in texts]) - self.means) / self.scales
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (constant first) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def windows_of(text: str, shared: set[str], rng: random.Random, most: int) -> list[bytes]:
    data = "\n".join(line for line in text.split("\n") if line not in shared).encode()
    starts = list(range(0, len(data), WINDOW_BYTES))
    return [data[a : a + WINDOW_BYTES] for a in (starts if len(starts) <= most else rng.sample(starts, most))]


def train(rows: list[tuple[str, int]], share_good: float, most_windows: int = WINDOWS) -> Model:
    """Fit on (text, label) rows in a fixed order; even rows make dictionaries, odd rows the curve.

    ``share_good`` is the share of good texts among all labelled ones; with it the curve
    speaks for the whole, not for the evened-out sample. Without both classes every score is that share.
    """
    lines = Counter(line for text, _ in rows for line in set(text.split("\n")))
    shared = {line for line, n in lines.items() if n > 1}
    rng = random.Random(7)
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for text, label in rows[::2]:
        samples[label] += windows_of(text, shared, rng, most_windows)
    made = {}
    for label, windows in samples.items():
        try:
            made[label] = zstandard.train_dictionary(DICTIONARY_BYTES, [w for w in windows if len(w) > 8]).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few windows for a dictionary
            made[label] = b""
    model = Model(made[1], made[0])
    y = np.array([label for _, label in rows[1::2]], float)
    if not 0 < y.sum() < len(y):
        share = min(max(share_good, 1e-6), 1 - 1e-6)
        model.weights, model.means, model.scales = [float(np.log(share / (1 - share))), *[0.0] * 6], [0.0] * 6, [1.0] * 6
        return model
    x = np.array([model.features(text) for text, _ in rows[1::2]])
    model.means, model.scales = x.mean(0).tolist(), np.maximum(x.std(0), 1e-9).tolist()
    w = logistic((x - model.means) / model.scales, y)
    share = min(max(share_good, 1e-6), 1 - 1e-6)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    model.weights = w.tolist()
    return model


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of labelled rows that are not held out.

    Ids labelled both ways, null ids and null labels are not used. The ids are chosen from
    the narrow label table first; only chosen texts reach the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
    clear = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label")
    shares = {r["label"]: r["count"] for r in clear.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit("quality"), "id")
    chosen = None
    for label in (0, 1):
        part = clear.filter(F.col("label") == label).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").toPandas()
    found["at"] = found["id"].map(lambda i: hash_order(str(i)))
    found = found.drop_duplicates(["id", "text"]).sort_values(["at", "id", "text"])
    rows = [r for label in (0, 1) for r in found.loc[found["label"] == label, ["text", "label"]].itertuples(index=False, name=None)]
    total = sum(shares.values())
    return train(rows, shares.get(1, 0) / total if total else 0.5)


def hash_order(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that each whole text is good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts.to_pylist()), pa.float64())

    return adding(docs, out).withColumn(out, run.asNondeterministic()(docs[text_col].cast("string")))


def keep(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """Rows whose score reaches the threshold, with the columns of ``docs``."""
    (c,) = fresh(docs, "quality_score")
    return score(docs, model, text_col, c).filter(F.col(c) >= threshold).drop(c)

"""``text.analyze`` over whole Arrow columns: the same tokens, without an object for each of them.

Lower-casing looks around a letter and stays with Spark; what is a letter or a number is asked of
the JVM's own regular expressions once, so both ways read the same alphabet.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorelake.functions import text as tx

# The accented letters are the bytes C3 xx: the plain letter of each xx, else 0.
_PLAIN = np.zeros(256, np.uint8)
for _from, _to in zip(tx.ACCENTED, tx.PLAIN, strict=True):
    _lead, _byte = _from.encode()
    assert _lead == 0xC3
    _PLAIN[_byte] = ord(_to)


@functools.lru_cache(maxsize=1)
def kinds(spark: SparkSession) -> bytes:
    """Packed table of all code points: the alternative of ``TOKEN_PATTERN`` that matches it, counted from 1, or 0."""
    point = F.when(F.col("id").between(0xD800, 0xDFFF), 0).otherwise(F.col("id"))
    letter = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    kind = F.lit(0)
    for number, pattern in enumerate(tx.TOKEN_PATTERN.split("|"), 1):
        kind = F.when(letter.rlike(f"^(?:{pattern})$"), number).otherwise(kind)
    rows = spark.range(0x110000).select("id", kind.alias("kind")).groupBy(F.expr("id DIV 4096").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("id", "kind"))).alias("row")).select("page", F.array_join("row.kind", "").alias("row"))
    return zlib.compress("".join(r["row"] for r in sorted(rows.collect())).encode())


def table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8) - ord("0")


def runs(texts: pa.StringArray, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Tokens of lower-cased texts one after the other, accents dropped, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = np.frombuffer(bytearray(data.tobytes().translate(table[:128].tobytes() + bytes(128))), np.uint8)
    plain, dropped = data, None
    for low, high, bits, width in ((0xC0, 0xDF, 31, 2), (0xE0, 0xEF, 15, 3), (0xF0, 0xF7, 7, 4)):
        leads = np.flatnonzero((data >= low) & (data <= high))
        point = (data[leads] & bits).astype(np.int32)
        for k in range(1, width):
            point = point << 6 | data[leads + k] & 63
        for k in range(width):
            kind[leads + k] = table[point]
        if width == 2 and len(leads):
            dropped = leads[(data[leads] == 0xC3) & (_PLAIN[data[leads + 1]] > 0)]
            plain = data.copy()
            plain[dropped + 1] = _PLAIN[data[dropped + 1]]
    starts = kind > 0
    kept = starts.copy()
    if dropped is not None:
        kept[dropped] = False
    first = ends[:-1][ends[:-1] < len(data)]
    at_first = starts[first]
    starts[1:] &= kind[1:] != kind[:-1]
    starts[first] = at_first
    at = np.flatnonzero(starts)
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kept, out=before[1:])
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(before[np.append(at, len(data))]), pa.py_buffer(plain[kept]))
    return found, np.diff(np.searchsorted(at, ends))


def encoded(tokens: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """(number of each token's term, distinct terms in order)."""
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))

"""Product codes of vectors by Lloyd rounds that compare active entries only.

Vectors become integers ``floor(scale * x)`` and are cut into equal consecutive parts, each
with a codebook of its own that starts as the parts of the smallest ids. Every row keeps,
for each part, the assigned entry and the exact squared distance to it. In a round a part
whose entry did not move compares the moved entries against the stored distance: no
unmoved entry can have come nearer. Parts whose entry moved look at all entries again.
Ties go to the lower index in both cases, so the result is that of plain Lloyd rounds.

Each round is one pass over the rows, written with its assignments to the shared folder;
the round before is deleted when the new one is there. Sums for the new entries are
added up in each task first, so only ``entries * (dimension + parts)`` numbers reach the driver.

Rows whose vector is null or holds null or non-finite components are dropped, and so are
vectors whose length is not the most frequent one (they cannot be cut like the others).
Repeated rows and equal ids count as often as they are there; null ids come last. Fewer
rows than entries give a smaller codebook; an empty table gives no rows. Squared
distances have to fit in 64 bits; beyond, the job ends in an overflow error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelake import checkpoints, sizes
from lorelake.llm.common import adding, fresh

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
STATE = "codes binary, distances array<bigint>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``values``; the first of equal ones."""
    gap = values[:, None, :] - book[None]
    distances = (gap * gap).sum(axis=2)
    entry = distances.argmin(axis=1)
    return entry, distances[np.arange(len(values)), entry]


def assign(values: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, distance: np.ndarray, stats: dict | None = None) -> None:
    """Assign one part of all rows in place. ``entry`` is -1 where a row has none yet."""
    again = (entry < 0) | moved[entry]
    rescan = np.flatnonzero(again)
    if len(rescan):
        entry[rescan], distance[rescan] = nearest(values[rescan], book)
    active, fixed = np.flatnonzero(moved), np.flatnonzero(~again)
    if len(active) and len(fixed):
        to, found = nearest(values[fixed], book[active])
        to = active[to]
        better = (found < distance[fixed]) | ((found == distance[fixed]) & (to < entry[fixed]))
        entry[fixed[better]], distance[fixed[better]] = to[better], found[better]
    if stats is not None:
        stats["compared"] = stats.get("compared", 0) + len(rescan) * len(book) + len(fixed) * len(active)


def lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assigner(books, parts: int):
    """One round over rows of (…, values, codes, distances); the books and moved entries are broadcast."""

    def run(batches):
        book, moved = books.value  # (parts, entries, width), (parts, entries)
        width = book.shape[2]
        largest = int(np.abs(book).max(initial=0))
        for batch in batches:
            place = {name: i for i, name in enumerate(batch.schema.names)}
            n = batch.num_rows
            values = lists(batch.column(place["values"]), parts * width).reshape(n, parts, width)
            # Numbers too large for 64-bit products are compared as Python's.
            exact = (int(np.abs(values).max(initial=0)) + largest) ** 2 * width >= 1 << 63
            kind = object if exact else np.int64
            held = batch.column(place["codes"])
            if held.null_count:
                codes, distances = np.full((n, parts), -1, np.int64), np.zeros((n, parts), kind)
            else:
                codes = np.frombuffer(b"".join(held.to_pylist()), np.uint8).astype(np.int64).reshape(n, parts)
                distances = lists(batch.column(place["distances"]), parts).astype(kind)
            for p in range(parts):
                entry, distance = codes[:, p].copy(), distances[:, p].copy()
                assign(values[:, p].astype(kind), book[p].astype(kind), moved[p], entry, distance)
                codes[:, p], distances[:, p] = entry, distance
            raw = codes.astype(np.uint8)
            offsets = pa.array(np.arange(0, (n + 1) * parts, parts, dtype=np.int32))
            new = {
                "codes": pa.array([r.tobytes() for r in raw], pa.binary()),
                "distances": pa.ListArray.from_arrays(offsets, pa.array(distances.ravel().tolist(), pa.int64())),
            }
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(i)) for name, i in place.items()], batch.schema.names)

    return run


def adder(parts: int, entries: int, width: int):
    """Sums of one task for each entry: place ``width`` of an entry counts its parts."""

    def run(batches):
        total = np.zeros((parts, entries, width + 1), object)
        for batch in batches:
            place = {name: i for i, name in enumerate(batch.schema.names)}
            values = lists(batch.column(place["values"]), parts * width).reshape(batch.num_rows, parts, width)
            codes = np.frombuffer(b"".join(batch.column(place["codes"]).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                own = np.zeros((entries, width + 1), np.int64)
                np.add.at(own[:, :width], codes[:, p], values[:, p])
                own[:, width] = np.bincount(codes[:, p], minlength=entries)
                total[p] += own
        flat = total.ravel()
        hit = np.flatnonzero(flat != 0)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array([int(x) for x in flat[hit]], pa.int64())], ["cell", "total"])

    return run


def written(df: DataFrame) -> tuple[DataFrame, str]:
    path = checkpoints.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): all columns of the usable rows but the vector, with ``codes`` (binary, an
    entry for each part) and ``error`` (long); the codebooks as integers by part, entry and place.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry has to fit in a byte")
    spark = vectors.sparkSession
    plain = adding(vectors, "codes", "error")
    held, values, codes, distances = fresh(plain, "held", "whole", "code_bytes", "exact")
    kept = plain.filter(usable(F.col(vector_col).cast("array<double>")))
    rest = [c for c in plain.columns if c != vector_col]
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("bigint"))
    table = kept.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias(held), F.col(id_col).alias("id"), whole.alias("values"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<bigint>").alias("distances"))
    table, path = written(table)
    common = table.groupBy(F.size("values").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dimension = common["n"] if common else 0
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    width = dimension // parts
    table = table.filter(F.size("values") == dimension)
    first = [r["values"] for r in table.orderBy(F.col("id").isNull(), "id", "values").limit(entries).select("values").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2) if first else np.zeros((parts, 0, width), np.int64)
    moved = np.ones(books.shape[:2], bool)
    if first:
        for number in range(rounds + 1):
            shared = spark.sparkContext.broadcast((books, moved))
            before = path
            table, path = written(table.mapInArrow(assigner(shared, parts), table.schema))
            remove(spark, before)
            if number == rounds:
                break
            sums = table.select("values", "codes").mapInArrow(adder(parts, len(first), width), "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total"))
            total = np.zeros(parts * len(first) * (width + 1), object)
            for r in sums.collect():
                total[r["cell"]] = r["total"]
            total = total.reshape(parts, len(first), width + 1)
            after = books.copy()
            for p, e in np.argwhere(total[:, :, width] > 0):
                after[p, e] = [int(s) // int(total[p, e, width]) for s in total[p, e, :width]]
            books, moved = after, (after != books).any(axis=2)
    error = F.aggregate("distances", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table.select(f"{held}.*", "codes", error.alias("error")), books


def remove(spark, path: str) -> None:
    """Delete a table that a newer one has replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in order, comma-joined."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def with_label_error(rows: DataFrame, label_col: str = "label", out: str = "label_error") -> DataFrame:
    """Add the sum of errors over rows of the same label, null labels together."""
    of, total = fresh(rows, "of_label", "label_total")
    sums = rows.groupBy(F.col(label_col).alias(of)).agg(F.sum("error").alias(total))
    joined = rows.join(sizes.small(sums), F.col(label_col).eqNullSafe(F.col(of)))
    return adding(joined, out).withColumn(out, F.col(total)).drop(of, total)

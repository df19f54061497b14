"""Document and link tables on Parquet that are merged when they are read.

A run writes only what it changed: ``<base>/<table>/<attempt>/rows`` holds new rows and
``…/keys`` the touched keys, whether they have rows or are gone.  ``<base>/runs`` has one
small row per location and finished run with the run's attempt.  That row is written last
and decides what is visible, so an attempt that died is never read; a repeat writes a
folder of its own, or, if the batch has a key, the same folder again.

Readers take the newest base attempt of a location and the attempts after it; of a key the
newest generation wins.  ``compact`` writes a new base where these attempts have grown.
One writer at a time works on a location.
"""

from __future__ import annotations

import functools
import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelake import checkpoints, sizes

KEYS = ["location_id", "relative_path"]
RUNS = ("location_id string, active_generation bigint, state string, indexed bigint, failed bigint, changed bigint, "
        "removed bigint, complete boolean, error string, finished_at timestamp, attempt string, is_base boolean, batch_key string")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def _all_runs(spark: SparkSession, base: str) -> DataFrame:
    if not _exists(spark, f"{base}/runs"):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).parquet(f"{base}/runs").where("complete")


def read_runs(spark: SparkSession, base: str) -> DataFrame:
    """Newest complete run per location."""
    runs = _all_runs(spark, base)
    newest = runs.groupBy("location_id").agg(F.max_by(
        F.struct(*[c for c in runs.columns if c != "location_id"]), F.struct("active_generation", "is_base")).alias("r"))
    return newest.select("location_id", "r.*")


def finished_batch(spark: SparkSession, base: str, batch_key: str) -> DataFrame:
    """Run rows of a batch that has been applied; none if it has not."""
    return _all_runs(spark, base).where(F.col("batch_key") == batch_key)


def attempt_name(batch_key: str | None = None) -> str:
    """Folder name of one attempt: its own, or that of the batch, so that a repeat replaces it."""
    return uuid.uuid4().hex if batch_key is None else hashlib.sha256(batch_key.encode()).hexdigest()[:32]


def live_attempts(spark: SparkSession, base: str) -> DataFrame:
    """(location_id, generation, attempt, is_base) that a reader needs."""
    runs = _all_runs(spark, base).select("location_id", F.col("active_generation").alias("generation"), "attempt", "is_base")
    bases = runs.where("is_base").groupBy("location_id").agg(F.max(F.struct("generation", "attempt")).alias("b"))
    after = runs.where("NOT is_base").join(bases, "location_id").where("generation > b.generation").drop("b")
    return bases.select("location_id", "b.generation", "b.attempt", F.lit(True).alias("is_base")).unionByName(after)


def _listed(spark: SparkSession, base: str, most: int = 50_000) -> tuple[list[str], DataFrame, DataFrame]:
    """(names of live attempts, base attempts, later attempts); the latter two (location_id, attempt), local rows if they are few."""
    live = live_attempts(spark, base).select("location_id", "attempt", "is_base")
    few = live.limit(most + 1).collect()
    if len(few) <= most:
        live = spark.createDataFrame(few, "location_id string, attempt string, is_base boolean")
    names = {r["attempt"] for r in few} if len(few) <= most else {r["attempt"] for r in live.select("attempt").distinct().toLocalIterator()}
    return sorted(names), live.where("is_base").drop("is_base"), live.where("NOT is_base").drop("is_base")


def _key_of(schema: str) -> str:
    return "source_relative_path" if "source_relative_path" in schema else "relative_path"


def read_table(spark: SparkSession, base: str, table: str, schema: str) -> DataFrame:
    """Rows of a table as of the newest finished runs; only folders of live attempts are opened."""
    names, bases, after = _listed(spark, base)
    names = [n for n in names if _exists(spark, f"{base}/{table}/{n}")]
    if not names:
        return spark.createDataFrame([], schema)
    key = _key_of(schema)
    columns = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(schema + ", attempt string").parquet(*[f"{base}/{table}/{n}/rows" for n in names])
    keys = spark.read.schema(f"location_id string, {key} string, generation bigint, attempt string").parquet(*[f"{base}/{table}/{n}/keys" for n in names])
    own = ["location_id", "attempt"]
    based = rows.join(bases, own, "left_semi").select(*columns)
    newest = keys.join(after, own, "left_semi").groupBy("location_id", key).agg(F.max("generation").alias("generation"))
    if after.isEmpty():
        return based
    changed = rows.join(after, own, "left_semi").join(newest, ["location_id", key, "generation"], "left_semi")
    return based.join(newest, ["location_id", key], "left_anti").select(*columns).unionByName(changed.select(*columns))


def write_attempt(rows: DataFrame, keys: DataFrame, base: str, table: str, attempt: str) -> None:
    """Write the rows and touched keys of one attempt; both carry location_id and generation.

    Rows are spread by key before the write, so a large location becomes many files
    instead of one task.
    """
    key = "source_relative_path" if "source_relative_path" in rows.columns else "relative_path"
    for name, part in (("rows", rows), ("keys", keys.select("location_id", key, "generation"))):
        spread = part.withColumn("attempt", F.lit(attempt)).repartition("location_id", F.pmod(F.xxhash64(key), F.lit(64)))
        spread.write.mode("overwrite").parquet(f"{base}/{table}/{attempt}/{name}")


def finish_run(runs: DataFrame, base: str) -> None:
    """Make attempts visible: the last write of a run, one file."""
    schema = [f.strip().split(" ") for f in RUNS.split(",")]
    runs.select(*[F.col(name).cast(kind) for name, kind in schema]).coalesce(1).write.mode("append").parquet(f"{base}/runs")


def grown(spark: SparkSession, base: str, table: str, schema: str, share: float = 0.25, most: int = 16) -> DataFrame:
    """Locations with more than ``most`` attempts after their base, or with more touched keys in these than ``share`` of its rows."""
    key, own = _key_of(schema), ["location_id", "attempt"]
    names, bases, after = _listed(spark, base)
    names = [n for n in names if _exists(spark, f"{base}/{table}/{n}")]
    counts = after.groupBy("location_id").agg(F.count("*").alias("attempts"))
    if not names:
        return counts.select("location_id").limit(0)
    rows = spark.read.schema("location_id string, attempt string").parquet(*[f"{base}/{table}/{n}/rows" for n in names])
    keys = spark.read.schema(f"location_id string, {key} string, attempt string").parquet(*[f"{base}/{table}/{n}/keys" for n in names])
    based = rows.join(bases, own, "left_semi").groupBy("location_id").agg(F.count("*").alias("n_rows"))
    touched = keys.join(after, own, "left_semi").groupBy("location_id").agg(F.count("*").alias("n_keys"))
    sized = counts.join(based, "location_id", "left").join(touched, "location_id", "left").fillna(0, ["n_rows", "n_keys"])
    return sized.where((F.col("attempts") > most) | (F.col("n_keys") > share * F.col("n_rows"))).select("location_id")


def compact(spark: SparkSession, base: str, schemas: dict[str, str], share: float = 0.25, most: int = 16) -> int:
    """Write a new base for every grown location and return their number; ``schemas`` names all tables, the first decides."""
    table, schema = next(iter(schemas.items()))
    chosen = checkpoints.cut(grown(spark, base, table, schema, share, most))
    count = chosen.count()
    if count:
        attempt = attempt_name()
        pick = sizes.small(chosen)
        for name, columns in schemas.items():
            rows = read_table(spark, base, name, columns).join(pick, "location_id", "left_semi")
            write_attempt(rows, rows.limit(0), base, name, attempt)
        runs = read_runs(spark, base).join(pick, "location_id", "left_semi")
        finish_run(checkpoints.cut(runs.withColumns({"attempt": F.lit(attempt), "is_base": F.lit(True), "batch_key": F.lit(None).cast("string")})), base)
    return count


def drop_generations(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Only the rows of active generations (a logical drop of the others)."""
    active = runs.select("location_id", F.col("active_generation").alias("generation"))
    return rows.join(active, ["location_id", "generation"], "left_semi")


def drop_location(rows: DataFrame, location_id: str) -> DataFrame:
    return rows.where(F.col("location_id") != location_id)


def vacuum(spark: SparkSession, base: str, table: str, older_ms: int = 86_400_000) -> int:
    """Delete the folders of attempts that no reader needs and that are older than any run; driver work is per folder."""
    live = {r["attempt"] for r in live_attempts(spark, base).select("attempt").distinct().toLocalIterator()}
    target, system = _path(spark, f"{base}/{table}")
    before, deleted = time.time() * 1000 - older_ms, 0
    for status in system.listStatus(target):
        if status.getPath().getName() not in live and status.getModificationTime() <= before:
            system.delete(status.getPath(), True)
            deleted += 1
    return deleted


POSTINGS = ("location_id string, relative_path string, field string, term string, dl bigint, tf bigint, generation bigint, bucket int")


def write_postings(postings: DataFrame, path: str, buckets: int = 256) -> None:
    """Term index partitioned by term hash, so a term lookup reads few folders.

    The document salt keeps a very frequent term from landing in one task.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    (postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("relative_path"), F.lit(8)))
     .sortWithinPartitions("bucket", "location_id", "field", "term").write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_postings(spark: SparkSession, paths: str | list[str], vocabulary: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """Postings of a query vocabulary (None: all); only the folders of its term buckets are read.

    The driver sees bucket numbers only, at most ``buckets`` of them.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if not paths:
        return spark.createDataFrame([], POSTINGS).drop("bucket")
    rows = functools.reduce(DataFrame.unionByName, [spark.read.schema(POSTINGS).parquet(path) for path in paths])
    if vocabulary is not None:
        words = vocabulary.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        asked = sorted(r["bucket"] for r in words.select("bucket").distinct().collect())
        rows = rows.where(F.col("bucket").isin(asked)).join(sizes.small(words.drop("bucket"), 200_000), "term", "left_semi")
    return rows.drop("bucket")


def write_lines(blocks: DataFrame, path: str, order: list, text: str = "text") -> None:
    """Write ordered text blocks, one folder per location."""
    (blocks.repartitionByRange("location_id", *order).sortWithinPartitions("location_id", *order)
     .select("location_id", text).write.mode("overwrite").partitionBy("location_id").text(path))

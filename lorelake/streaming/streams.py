"""Structured Streaming jobs over change and activity logs.

The corpus model has no notion of late data: every event counts.  Counters and
history are reduced inside each micro-batch and merged in stored tables, which
expire what is too old, so these streams keep no state; a watermark bounds the
state of bursts where one is set with ``with_bounds``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelake import checkpoints
from lorelake.brand import DEFAULT, Brand
from lorelake.operators import history as hi
from lorelake.operators import report as rp

CHANGES = "location_id string, path string, at timestamp"
ACTIVITY = "location_id string, relative_path string, kind string, at timestamp"


def read_changes(spark: SparkSession, path: str, schema: str = CHANGES) -> DataFrame:
    """Change log folder as a stream; watchers append Parquet files to it."""
    return spark.readStream.schema(schema).parquet(path)


def with_bounds(stream: DataFrame, delay: str = "1 day", column: str = "at") -> DataFrame:
    """Watermark to bound state; late rows are still published in update mode."""
    return stream.withWatermark(column, delay)


def coalesce_changes(changes: DataFrame, gap: str = "450 milliseconds", brand: Brand = DEFAULT) -> DataFrame:
    """One refresh per quiet period and location; a policy file change forces re-inspection.

    Works on a stream (with a watermark) and on a batch alike.  Rows without a
    path are heartbeats: they move the watermark on and are no changes.
    """
    name = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    return changes.groupBy("location_id", F.session_window("at", gap).alias("burst")).agg(
        F.count("path").alias("changes"), F.bool_or(name == brand.ignore_file).alias("force")).where("changes > 0").select(
        "location_id", F.col("burst.start").alias("started_at"), F.col("burst.end").alias("due_at"), "changes", "force")


def append_heartbeat(instants: DataFrame, path: str) -> None:
    """Append heartbeats (``at``) to a change log: quiet locations' open sessions end with the watermark.

    A heartbeat has a location of its own, so it never prolongs a session.
    """
    instants.select(F.lit("").alias("location_id"), F.lit(None).cast("string").alias("path"), "at").write.mode("append").parquet(path)


RUN = T.StructType([
    T.StructField("location_id", T.StringType()), T.StructField("at_ms", T.LongType()), T.StructField("applied", T.BooleanType())])
LAST = T.StructType([T.StructField("last_ms", T.LongType())])


def _throttle(minimum_ms: int):
    import pandas as pd

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        times = sorted({t for pdf in batches for t in pdf["at_ms"]})
        flags = []
        for t in times:
            fire = last is None or not 0 <= t - last < minimum_ms
            flags.append(fire)
            last = t if fire else last
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"location_id": [key[0]] * len(times), "at_ms": times, "applied": flags})

    return step


def throttle_runs(requests: DataFrame, minimum_ms: int = 5_000) -> DataFrame:
    """Skip a run request younger than the minimum interval after the last applied one.

    Requests: location_id, at_ms.  The state of a location is one instant; the
    distinct instants are taken before the stateful step.
    """
    return requests.select("location_id", "at_ms").groupBy("location_id").applyInPandasWithState(
        _throttle(minimum_ms), RUN, LAST, "append", "NoTimeout")


def throttle_batch(requests: DataFrame, minimum_ms: int = 5_000) -> DataFrame:
    """Batch twin of ``throttle_runs`` over distinct request instants (one number per row)."""
    def fold(table):
        import pyarrow as pa

        last, flags, times = None, [], sorted(table["at_ms"].to_pylist())
        for t in times:
            fire = last is None or t - last >= minimum_ms
            flags.append(fire)
            last = t if fire else last
        return pa.table({"location_id": pa.array([table["location_id"][0].as_py()] * len(times), pa.string()),
                         "at_ms": pa.array(times, pa.int64()), "applied": pa.array(flags, pa.bool_())})

    return requests.select("location_id", "at_ms").distinct().groupBy("location_id").applyInArrow(fold, RUN)


# -- merged tables -----------------------------------------------------------


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of append-mode rows: a folder for each micro-batch, written again by a repeat."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the whole ``base=N`` and ``batch=N`` folders of a merged table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for status in system.listStatus(root) if system.exists(root) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return found


def read_merged(spark: SparkSession, path: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
    """Rows of the newest base and of the batches after it (``before``: as they were before that batch)."""
    found = _folders(spark, path)
    upto = [n for n in found["base"] if before is None or n < before]
    base = max(upto, default=-1)
    after = sorted(n for n in found["batch"] if n > base and (before is None or n < before))
    folders = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in after]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merged_sink(path: str, reduce: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame],
                every: int = 16) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of a table that its batches add up to; the stream itself keeps no state.

    A batch writes its ``reduce``d rows to a folder of its own. The last of each ``every``
    batches writes a base instead, the ``merge`` of all rows so far, and deletes what is
    older than the base before it. A batch that is repeated after a failure thus still finds
    what it merges and replaces its own folder; at most twice ``every`` folders stay.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        spark, fresh = rows.sparkSession, reduce(rows)
        if (batch_id + 1) % every:
            fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            return
        # Cut, so that what merge asks about its rows and the write read the batch once.
        whole = checkpoints.cut(read_merged(spark, path, fresh.schema, batch_id).unionByName(fresh))
        merge(whole).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
        found = _folders(spark, path)
        keep = max((n for n in found["base"] if n < batch_id), default=-1)
        for kind, numbers in found.items():
            for number in numbers:
                if number < keep or (kind == "batch" and number <= keep):
                    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={number}")
                    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def _run_merged(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    return (events.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


DAILY = "location_id string, day string, relative_path string, " + ", ".join(
    f"{k}_count bigint" for k in rp.KINDS) + ", last_changed_at timestamp, last_served_at timestamp"


def _expired(daily: DataFrame, days: int | None) -> DataFrame:
    """Rows of the newest day and the ``days`` before it; all without a limit."""
    newest = None if days is None else daily.agg(F.max("day")).first()[0]
    return daily if newest is None else rp.expire_activity(daily, newest, days)


def run_activity(events: DataFrame, table: str, checkpoint: str, days: int | None = rp.ACTIVITY_DAYS, every: int = 16):
    """Start the daily counters into ``table`` for what is available now.

    Every event counts, however late, unless its day has expired: a new base leaves out
    days more than ``days`` before the newest day seen (None: nothing expires).
    """
    merge = lambda rows: rp.summed_activity(_expired(rows, days))
    return _run_merged(events, merged_sink(table, rp.activity_daily, merge, every), checkpoint)


def read_activity(spark: SparkSession, table: str, days: int | None = rp.ACTIVITY_DAYS) -> DataFrame:
    """Daily counters from the table, expired days left out whether they are still stored or not."""
    return rp.summed_activity(_expired(read_merged(spark, table, DAILY), days))


EVENT = "event_id bigint, location_id string, path string, previous_path string, kind string, observed_at bigint"


def newest_events(events: DataFrame) -> DataFrame:
    """Newest event of each (location, path), and of each rename edge as a row of its own.

    Identity needs the edges after the events that carried them are no longer the newest.
    The function may be applied to its own results.
    """
    own = events.withColumn("previous_path", F.lit(None).cast("string"))
    both = own.unionByName(events.where("previous_path <> ''"))
    first = F.min_by(F.struct("event_id", "kind", "observed_at"), F.struct((-F.col("observed_at")).alias("age"), "event_id"))
    return both.groupBy("location_id", "path", "previous_path").agg(first.alias("e")).select(
        "e.event_id", "location_id", "path", "previous_path", "e.kind", "e.observed_at")


def _recent(rows: DataFrame, days: int | None) -> DataFrame:
    newest = None if days is None else rows.agg(F.max("observed_at")).first()[0]
    return rows if newest is None else rows.where(F.col("observed_at") >= newest - days * 86_400_000)


def run_history(events: DataFrame, table: str, checkpoint: str, days: int | None = hi.HISTORY_DAYS,
                cap: int | None = hi.HISTORY_CAP, every: int = 16):
    """Keep the newest event per path and the rename edges; ``read_history`` merges renamed paths.

    A new base forgets events older than ``days`` before the newest, edges included, and
    files behind the ``cap`` newest ones (None: no limit). Their rename edges stay as long as
    the window lasts: a path that changes again later is still the same file.
    """
    def merge(rows: DataFrame) -> DataFrame:
        kept = newest_events(_recent(rows, days))
        if cap is None or kept.where("previous_path IS NULL").count() <= cap:
            return kept
        named = checkpoints.cut(hi.file_identity(kept))
        top = hi.newest_per_identity(named).orderBy(F.desc("observed_at"), "event_id").limit(cap)
        own = named.where("previous_path IS NULL").join(top.select("identity"), "identity", "left_semi")
        return own.unionByName(named.where("previous_path IS NOT NULL")).drop("identity")

    return _run_merged(events, merged_sink(table, newest_events, merge, every), checkpoint)


def read_history(spark: SparkSession, table: str, days: int | None = hi.HISTORY_DAYS, cap: int | None = hi.HISTORY_CAP) -> DataFrame:
    """Latest event per file identity from the history table, newest ``cap`` of the last ``days`` days."""
    rows = newest_events(_recent(read_merged(spark, table, EVENT), days))
    # Edges tell what is one file; its events are the rows without one.
    named = hi.file_identity(rows).where("previous_path IS NULL")
    latest = hi.newest_per_identity(named).select("identity", "location_id", "path", "event_id", "kind", "observed_at")
    return latest if cap is None else latest.orderBy(F.desc("observed_at"), "event_id").limit(cap)


def sync_stream(bursts: DataFrame, locations: DataFrame, base: str, checkpoint: str, brand: Brand = DEFAULT):
    """Reconcile the touched locations of every micro-batch of change bursts, each batch once.

    The batch key is the checkpoint's own name and the batch id, so a batch that is repeated
    after a failure replaces what its dead attempt wrote and is skipped if it had finished.
    """
    from lorelake.operators.sync import reconcile

    def apply(rows: DataFrame, batch_id: int) -> None:
        touched = locations.join(rows.select("location_id").distinct(), "location_id", "left_semi")
        reconcile(rows.sparkSession, base, touched, brand, f"{checkpoint}/{batch_id}")

    return (bursts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def await_all(query, seconds: int | None = None) -> None:
    """Wait for an ``availableNow`` query to end; only a caller that gives ``seconds`` has it stopped."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not finish")

"""Files on disk → tables, incremental runs, lint, and streams equal to their batch twins."""

import os
import re
import shutil

from pyspark.sql import functions as F

from lorelake.operators import history as hi
from lorelake.operators import report as rp
from lorelake.operators import sync
from lorelake.sources import adapters as ad
from lorelake.sources import corpus, tables
from lorelake.streaming import streams as st

SF = "/root/testdata/sf0.001"


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(text if isinstance(text, bytes) else text.encode())


def locations(spark, root):
    return spark.createDataFrame([("loc", str(root), "Loc", True)], "location_id string, path string, name string, okf_bundle boolean")


def test_scan(spark, tmp_path):
    write(tmp_path, {"a.md": "x", ".agents/b.MD": "y", "_d/c.markdown": "z", "node_modules/n.md": "n", "x/Build/y.md": "n", "t.txt": "t",
                     ".md": "bare", "bad.md": b"\xff\xfe"})
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    files = corpus.scan_corpus(locations(spark, tmp_path))
    good, failed = corpus.decode_text(files)
    assert {r.relative_path for r in good.collect()} == {"a.md", ".agents/b.MD", "_d/c.markdown"}
    assert [r.relative_path for r in failed.collect()] == ["bad.md"]


def test_incremental_runs(spark, tmp_path):
    root, base = tmp_path / "kb", str(tmp_path / "tables")
    write(root, {"index.md": "# I\n[a](a.md)", "a.md": "---\ntype: T\n---\n# A\n[b](b.md)", "b.md": "---\ntype: T\n---\n# B\n", "bad.md": b"\xff"})
    where = locations(spark, root)
    first = sync.reconcile(spark, base, where).first()
    assert (first.state, first.indexed, first.failed, first.changed) == ("degraded", 3, 1, 3)
    docs = tables.read_table(spark, base, "documents", sync.DOCUMENT_SCHEMA)
    ids = {r.relative_path: r.continuity_id for r in docs.collect()}
    links = {r.source_relative_path: r.status for r in tables.read_table(spark, base, "links", sync.LINK_SCHEMA).collect()}
    assert links == {"index.md": "resolved", "a.md": "resolved"}
    os.remove(root / "b.md")
    write(root, {"a.md": "---\ntype: T\n---\n# A2 longer\n[b](b.md)", "bad.md": "---\ntype: T\n---\n# fine"})
    second = sync.reconcile(spark, base, where).first()
    assert (second.state, second.indexed, second.removed, second.changed, second.active_generation) == ("ready", 3, 1, 2, 2)
    docs = tables.read_table(spark, base, "documents", sync.DOCUMENT_SCHEMA)
    rows = {r.relative_path: r for r in docs.collect()}
    assert rows["a.md"].title == "A2 longer" and rows["a.md"].continuity_id == ids["a.md"]
    links = {r.source_relative_path: r.status for r in tables.read_table(spark, base, "links", sync.LINK_SCHEMA).collect()}
    assert links == {"index.md": "resolved", "a.md": "unresolved"}
    activity = {(r.relative_path, r.kind) for r in sync.read_activity(spark, base).collect()}
    assert activity == {("a.md", "changed"), ("bad.md", "created"), ("b.md", "removed")}
    third = sync.reconcile(spark, base, where).first()
    assert (third.changed, third.removed, third.indexed) == (0, 0, 3)
    assert tables.vacuum(spark, base, "documents", 0) == 0
    before = {t: sorted(map(str, tables.read_table(spark, base, t, s).collect())) for t, s in sync.SCHEMAS.items()}
    assert sync.compact(spark, base) == 1 and sync.compact(spark, base) == 0
    assert tables.live_attempts(spark, base).count() == 1
    assert {t: sorted(map(str, tables.read_table(spark, base, t, s).collect())) for t, s in sync.SCHEMAS.items()} == before
    assert tables.vacuum(spark, base, "documents") == 0  # too young
    assert tables.vacuum(spark, base, "documents", 0) == 3
    assert {t: sorted(map(str, tables.read_table(spark, base, t, s).collect())) for t, s in sync.SCHEMAS.items()} == before


def snapshot(spark, base):
    """Tables and activity without the attempts' names and times."""
    rows = {t: sorted(map(str, tables.read_table(spark, base, t, s).collect())) for t, s in sync.SCHEMAS.items()}
    return rows | {"activity": sorted((r.location_id, r.relative_path, r.kind) for r in sync.read_activity(spark, base).collect())}


def test_a_run_that_died_is_repeated(spark, tmp_path, monkeypatch):
    """Killed after the activity and before the run rows: nothing is seen of it, and its repeat equals a run that lived."""
    root = tmp_path / "kb"
    write(root, {f"d{i}.md": f"---\ntype: T\n---\n# D{i}\n[n](d{i + 1}.md)" for i in range(40)} | {"bad.md": b"\xff", "l.md": "[b](bad.md)"})
    where, finish = locations(spark, root), tables.finish_run
    bases = {key: str(tmp_path / f"t{key}") for key in (None, "q/7")}
    lived = str(tmp_path / "lived")
    sync.reconcile(spark, lived, where)
    for base in bases.values():
        shutil.copytree(lived, base)
    os.remove(root / "d3.md")
    os.remove(root / "bad.md")
    write(root, {"d5.md": "---\ntype: T\n---\n# changed", "d40.md": "# new"})

    def die(*_):
        raise RuntimeError("killed")

    for key, base in bases.items():
        before = snapshot(spark, base)
        monkeypatch.setattr(tables, "finish_run", die)
        try:
            sync.reconcile(spark, base, where, batch_key=key)
            raise AssertionError("the run did not die")
        except RuntimeError:
            pass
        monkeypatch.setattr(tables, "finish_run", finish)
        assert snapshot(spark, base) == before
        sync.reconcile(spark, base, where, batch_key=key)
    sync.reconcile(spark, lived, where)
    want = snapshot(spark, lived)
    assert want["activity"] == [("loc", "d3.md", "removed"), ("loc", "d40.md", "created"), ("loc", "d5.md", "changed")]
    for key, base in bases.items():
        assert snapshot(spark, base) == want
        # Only the changed rows were written: two documents, three touched keys.
        names = [r.attempt for r in tables.live_attempts(spark, base).where("NOT is_base").collect()]
        assert len(names) == 1
        assert spark.read.parquet(f"{base}/documents/{names[0]}/rows").count() == 2
        assert spark.read.parquet(f"{base}/documents/{names[0]}/keys").count() == 3
        assert {r.source_relative_path for r in spark.read.parquet(f"{base}/links/{names[0]}/keys").collect()} == {"d2.md", "d3.md", "d39.md", "d40.md", "d5.md", "l.md"}
    again = sync.reconcile(spark, bases["q/7"], where, batch_key="q/7").collect()
    assert [r.batch_key for r in again] == ["q/7"] and snapshot(spark, bases["q/7"]) == want
    links = {(r.source_relative_path, r.status) for r in tables.read_table(spark, lived, "links", sync.LINK_SCHEMA).collect()}
    assert {("l.md", "unresolved"), ("d2.md", "unresolved"), ("d39.md", "resolved"), ("d1.md", "resolved")} <= links


def test_lint(spark, tmp_path):
    write(tmp_path, {"index.md": "---\nokf_version: 0.2\n---\n# I", "a.md": "# no front\n[t](skip/t.md) [g](gone.md)", "skip/t.md": "# ignored",
                     "bad.md": b"\xff", ".workspaceignore": "skip/\n"})
    findings, bundles = sync.lint(locations(spark, tmp_path))
    codes = sorted((r.relative_path, r.code) for r in findings.collect())
    assert codes == [("a.md", "OKF_FRONTMATTER_REQUIRED"), ("a.md", "OKF_LINK_BROKEN"), ("bad.md", "OKF_FILE_UNREADABLE")]
    bundle = bundles.first()
    assert (bundle.documents, bundle.ignored_documents, bundle.declared_version) == (3, 1, "0.2")
    report = rp.lint_report(findings, bundles, limit=1).first()
    assert report.truncated and "Output limited to 1 of 3 findings." in report.text and report.failed


def test_registry(spark, tmp_path):
    path = tmp_path / "locations.json"
    path.write_text('{"locations": [{"id": "a", "path": "/x", "name": "A", "okfBundle": true}, {"id": "b", "path": "/y", "name": "B", "okfMode": "disabled"}]}')
    rows = {r.location_id: r for r in corpus.read_locations(spark, str(path)).collect()}
    assert rows["a"].okf_bundle and rows["a"].okf_mode == "auto" and rows["b"].okf_mode == "disabled"


def log(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(str(path))
    return str(path)


def test_activity_stream_equals_batch(spark, tmp_path):
    events = ad.activity_events(spark, SF)
    source = log(spark, events, tmp_path / "events")
    stream = spark.readStream.schema(st.ACTIVITY).option("maxFilesPerTrigger", 1).parquet(source)
    st.await_all(st.run_activity(stream, str(tmp_path / "daily"), str(tmp_path / "cp"), days=None, every=2))
    got = st.read_activity(spark, str(tmp_path / "daily"), days=None)
    want = rp.activity_daily(events)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_burst_stream_equals_batch(spark, tmp_path):
    changes = ad.activity_events(spark, SF).select(
        "location_id", F.when(F.col("kind") == "removed", "kb/.workspaceignore").otherwise("kb/a.md").alias("path"),
        F.timestamp_millis((F.unix_millis("at") / 1000).cast("long")).alias("at"))
    source = log(spark, changes, tmp_path / "changes", 1)
    st.append_heartbeat(changes.agg((F.max("at") + F.expr("INTERVAL 2 DAYS")).alias("at")), source)
    stream = st.coalesce_changes(st.with_bounds(st.read_changes(spark, source)))
    query = (stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    st.await_all(query)
    # The heartbeat closes the newest sessions too, and is no session itself.
    got, want = sorted(map(tuple, spark.table("bursts").collect())), sorted(map(tuple, st.coalesce_changes(changes).collect()))
    assert got and got == want


def test_deep_folders_are_listed(spark, tmp_path):
    deep = "/".join(["d"] * 12)
    write(tmp_path, {f"{deep}/x.md": "x", "y.md": "y"})
    assert {r.relative_path for r in corpus.list_files(locations(spark, tmp_path)).collect()} == {f"{deep}/x.md", "y.md"}


def test_throttle_stream_equals_batch(spark, tmp_path):
    requests = ad.activity_events(spark, SF).select("location_id", F.unix_millis("at").alias("at_ms"))
    source = log(spark, requests, tmp_path / "requests", 1)
    stream = spark.readStream.schema("location_id string, at_ms bigint").parquet(source)
    query = (st.throttle_runs(stream, 3_600_000).writeStream.outputMode("append").format("memory").queryName("throttled")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    st.await_all(query)
    batch = st.throttle_batch(requests, 3_600_000)
    assert sorted(map(tuple, spark.table("throttled").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.where("applied").count() < batch.count()


def test_history_stream_equals_batch(spark, tmp_path):
    events = ad.history_events(spark, SF)
    source = log(spark, events, tmp_path / "history")
    stream = spark.readStream.schema(st.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    st.await_all(st.run_history(stream, str(tmp_path / "table"), str(tmp_path / "cp"), days=None, cap=None, every=2))
    got = st.read_history(spark, str(tmp_path / "table"), days=None, cap=None).select("identity", "event_id", "observed_at")
    want = hi.dedupe_history(events).select("identity", "event_id", "observed_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sixty_days_leave_fifteen(spark, tmp_path):
    """Stored rows and folders stay bounded, the stream has no state, late events of kept days count."""
    start, table, source = 1_704_067_200, str(tmp_path / "daily"), str(tmp_path / "events")
    days = [(f"d{d}", d) for d in range(60)]
    rows = [("a", path, "changed", start + 86_400 * d + 60) for path, d in days] + [("a", "late", "served", start + 86_400 * 50)]
    events = spark.createDataFrame(rows, "location_id string, relative_path string, kind string, s long").selectExpr(
        "location_id", "relative_path", "kind", "timestamp_seconds(s) AS at")
    for low in range(0, 60, 10):  # the late event arrives last
        last = "OR relative_path = 'late'" if low == 50 else "AND relative_path <> 'late'"
        day = f"(unix_seconds(at) - {start}) div 86400"
        events.where(f"{day} >= {low} AND {day} < {low + 10} {last}").coalesce(1).write.mode("append").parquet(source)
        query = st.run_activity(spark.readStream.schema(st.ACTIVITY).parquet(source), table, str(tmp_path / "cp"), every=2)
        st.await_all(query)
        assert not any(p["stateOperators"] for p in query.recentProgress)
    want = rp.expire_activity(rp.activity_daily(events), "2024-02-29")
    got = st.read_activity(spark, table)
    assert got.count() == 16 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    folders = sorted(p.name for p in tmp_path.joinpath("daily").iterdir() if "=" in p.name)
    assert folders == ["base=3", "base=5", "batch=4"]
    assert spark.read.parquet(f"{table}/base=5").count() == 16


def test_a_base_can_be_written_again(spark, tmp_path):
    sink = st.merged_sink(str(tmp_path / "t"), rp.activity_daily, rp.summed_activity, every=2)
    rows = spark.createDataFrame([("a", "x", "changed")], "location_id string, relative_path string, kind string").withColumn(
        "at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    for batch in (0, 0, 1, 1, 2, 3, 3, 3):
        sink(rows, batch)
    assert [r.changed_count for r in st.read_activity(spark, str(tmp_path / "t")).collect()] == [4]


def test_history_keeps_the_newest_files_of_the_window(spark, tmp_path):
    day, source, table = 86_400_000, str(tmp_path / "events"), str(tmp_path / "table")
    rows = [(d * 10 + i, "a", f"p{d}-{i}", f"p{d - 1}-{i}" if i == 0 and d % 3 else None, "renamed" if i == 0 and d % 3 else "modified", d * day + i)
            for d in range(48) for i in range(4)]
    events = spark.createDataFrame(rows, st.EVENT)
    for low in range(0, 48, 12):
        events.where(f"observed_at >= {low * day} AND observed_at < {(low + 12) * day}").coalesce(1).write.mode("append").parquet(source)
        st.await_all(st.run_history(spark.readStream.schema(st.EVENT).parquet(source), table, str(tmp_path / "cp"), days=30, cap=50, every=2))
    recent = events.where(f"observed_at >= {47 * day + 3 - 30 * day}")
    want = hi.cap_history(hi.dedupe_history(recent), 47 * day + 3, cap=50).select("identity", "event_id", "path", "observed_at")
    got = st.read_history(spark, table, days=30, cap=50).select(want.columns)
    assert got.count() == 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{table}/base=3").where("previous_path IS NULL").count() <= 70


def test_rename_edges_outlive_the_files_a_base_forgets(spark, tmp_path):
    """old -> new is behind the cap when the base is written; both names change again later and are still one file."""
    source, table = str(tmp_path / "events"), str(tmp_path / "table")
    first = [(1, "a", "new", "old", "renamed", 10)] + [(i, "a", f"p{i}", None, "modified", 100 + i) for i in range(2, 8)]
    later = [(20, "a", "old", None, "created", 1000), (21, "a", "new", None, "modified", 1001)]
    for rows in (first, later):
        spark.createDataFrame(rows, st.EVENT).coalesce(1).write.mode("append").parquet(source)
        st.await_all(st.run_history(spark.readStream.schema(st.EVENT).parquet(source), table, str(tmp_path / "cp"), days=30, cap=3, every=1))
    got = st.read_history(spark, table, days=30, cap=3).select("event_id").collect()
    assert sorted(r.event_id for r in got) == [6, 7, 21]


def test_sync_stream(spark, tmp_path):
    root, base = tmp_path / "kb", str(tmp_path / "tables")
    write(root, {"a.md": "---\ntype: T\n---\n# A"})
    changes = spark.createDataFrame([("loc", str(root / "a.md"))], "location_id string, path string").withColumn("at", F.current_timestamp())
    source = log(spark, changes, tmp_path / "changes", 1)
    st.await_all(st.sync_stream(st.read_changes(spark, source), locations(spark, root), base, str(tmp_path / "cp")))
    assert tables.read_table(spark, base, "documents", sync.DOCUMENT_SCHEMA).count() == 1


def test_postings_table(spark, tmp_path):
    from lorelake.operators import search as se

    docs = ad.corpus_docs(spark, SF)
    tokens = se.query_tokens(ad.search_queries(spark, SF))
    path = str(tmp_path / "postings")
    tables.write_postings(se.postings(docs), path, buckets=4)
    stored = tables.read_postings(spark, path, tokens, buckets=4)
    fresh = se.postings(docs, vocabulary=tokens.select("term").distinct())
    scored = se.bm25(stored, se.field_stats(docs), tokens)
    assert stored.count() == fresh.count()
    assert scored.count() == se.bm25(fresh, se.field_stats(docs), tokens).count()


def test_kept_index_equals_the_scan(spark, tmp_path):
    """After changes, removals, a dead refresh and compaction; only the buckets of the batch are opened."""
    from lorelake.operators import search as se
    from lorelake.sources.search_index import SearchIndex

    docs, queries = ad.corpus_docs(spark, SF), ad.search_queries(spark, SF)
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=16)
    first = docs.withColumn("body", F.concat("body", F.lit(" the old words of a first version")))
    index.refresh(first)
    gone = docs.where("relative_path LIKE '%7.md'").select("location_id", "relative_path")
    kept = docs.join(gone, ["location_id", "relative_path"], "left_anti")
    number = index.refresh(kept.where("relative_path LIKE '%1.md'"), gone)
    shutil.rmtree(tmp_path / "index" / f"delta={number}" / "stats")
    index.refresh(kept, gone)

    def rows(found):
        return sorted(tuple(r) for r in found.withColumn("weighted_score", F.round("weighted_score", 5)).select(
            "query_id", "location_id", "relative_path", "candidate_rank", "weighted_score").collect())

    assert gone.count()
    want = rows(se.candidates(kept, queries, "2024-01-31"))
    assert want and rows(se.candidates(kept, queries, "2024-01-31", index=index)) == want
    index.compact()
    assert rows(se.candidates(kept, queries, "2024-01-31", index=index)) == want
    plan = index.postings(spark.createDataFrame([("the",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)


def test_kept_index_is_small(spark, tmp_path):
    """A refresh writes less than half of the texts it has indexed."""
    from lorelake.sources.search_index import SearchIndex

    docs = ad.corpus_docs(spark, "/root/testdata/sf0.01")
    read = docs.select(F.sum(F.octet_length("body"))).first()[0]
    SearchIndex(spark, str(tmp_path / "index"), buckets=4).refresh(docs)
    written = sum(f.stat().st_size for f in (tmp_path / "index" / "delta=0").rglob("*.parquet"))
    assert 0 < written < read / 2


def test_packed_postings_and_tokens_are_exact(spark):
    """Numbers of one to five bytes; letters, numbers and accents of many alphabets as the JVM's pattern sees them."""
    import random

    import numpy as np
    import pyarrow as pa

    from lorelake.functions import text as tx
    from lorelake.functions import tokens
    from lorelake.sources import search_index as si

    documents, counts = np.array([0, 7, 8, 200, 3, 70_000, 5, 3 << 28]), np.array([1, 2, 129, 1 << 21, 1, 1, 1 << 14, 1 << 28])
    many, got, tf = si._decoded(si._encoded(np.array([0, 4, 6]), documents, counts))
    assert (many.tolist(), got.tolist(), tf.tolist()) == ([4, 2, 2], documents.tolist(), counts.tolist())
    random.seed(7)
    pool = "aZ09 .,İıΣσς'áÀçÿß\u0301\u00ad\U00010400\U0001d7d8٣Ⅷ½中ひ\ufffd\n_ſǅẞ\ufeff\U0001f600"
    texts = ["", *("".join(random.choices(pool, k=random.randrange(25))) for _ in range(500)), "ÉÉ1", "", "ΑΣ' Σ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select(
        "i", F.lower("x").alias("x"), tx.analyze(F.col("x")).alias("want")).orderBy("i").collect()
    found, lengths = tokens.runs(pa.array(["no", *(r.x for r in rows)]).slice(1), tokens.table(tokens.kinds(spark)))
    code, terms = tokens.encoded(found)
    assert lengths.tolist() == [len(r.want) for r in rows] and terms.take(pa.array(code)).to_pylist() == [t for r in rows for t in r.want]


def test_files_are_read_in_many_tasks_and_few_batches(spark, tmp_path, monkeypatch):
    """Short paths do not put all files in one task; contents are passed on together up to a size, in order."""
    import pyarrow as pa

    write(tmp_path, {f"d/{i}.md": f"text {i}" for i in range(300)})
    where = spark.createDataFrame([("b", str(tmp_path), True)], "location_id string, path string, okf_bundle boolean")
    read = corpus.read_contents(corpus.list_files(where)).withColumn("task", F.spark_partition_id())
    got = read.select("relative_path", F.col("content").cast("string").alias("text"), "task").collect()
    assert {r.relative_path: r.text for r in got} == {f"d/{i}.md": f"text {i}" for i in range(300)}
    assert len({r.task for r in got}) > 4
    (tmp_path / "d/7.md").unlink()
    paths = pa.RecordBatch.from_pydict({"path": [str(tmp_path / f"d/{i}.md") for i in range(20)]})
    whole = list(corpus._read_files([paths]))
    monkeypatch.setattr(corpus, "READ_BYTES", 20)
    parts = list(corpus._read_files([paths]))
    assert len(whole) == 1 and len(parts) > 5 and pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()
    assert [r["path"] for r in whole[0].to_pylist() if r["error"]] == [str(tmp_path / "d/7.md")]
    monkeypatch.setattr(corpus, "LISTED_ROWS", 100)
    folder = pa.RecordBatch.from_pydict({"location_id": ["b"], "root_path": [str(tmp_path)], "path": [str(tmp_path / "d")]})
    pieces = list(corpus._list_folders([folder]))
    assert [b.num_rows for b in pieces] == [100, 100, 99]

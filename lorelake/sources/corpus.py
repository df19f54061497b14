"""Corpus sources: file listing, file reading, registry and policy files.

``binaryFile`` skips names that start with a dot or an underscore, but hidden
directories belong to a corpus, so folders are listed level by level as rows:
one task lists one folder, and a location with very many files is spread over
its folders.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelake import checkpoints
from lorelake.brand import DEFAULT, Brand
from lorelake.operators.filters import IGNORED_DIRECTORIES, MAX_RULE_BYTES
from lorelake.operators.inspect import MAX_DOCUMENT_BYTES

ENTRY = T.StructType([
    T.StructField("location_id", T.StringType()), T.StructField("root_path", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("is_dir", T.BooleanType()),
    T.StructField("size", T.LongType()), T.StructField("modified_at_ms", T.LongType()),
    T.StructField("error", T.StringType())])
CONTENT = [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]

# Entries a listing task holds; files a reading task gets, and bytes of them it holds, or one larger file.
LISTED_ROWS, READ_FILES, READ_BYTES = 10_000, 10_000, 1 << 22

_IGNORED = {name.lower() for name in IGNORED_DIRECTORIES}
_MARKDOWN = re.compile(r"(?i)[^/]\.(md|markdown)$")


def _children(folder: str):
    """(path, is_dir, size, mtime_ms) of one folder; symbolic links are left out."""
    if "://" not in folder:
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_symlink():
                    continue
                info = entry.stat(follow_symlinks=False)
                yield entry.path, entry.is_dir(follow_symlinks=False), info.st_size, info.st_mtime_ns // 1_000_000
        return
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://", 1)[0]
    prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else scheme + "://"
    for info in system.get_file_info(fs.FileSelector(base)):
        stamp = (info.mtime_ns or 0) // 1_000_000
        yield prefix + info.path, info.type == fs.FileType.Directory, info.size or 0, stamp


def _entries(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(ENTRY)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, (
            pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()))],
        names=ENTRY.names)


def _list_folders(batches):
    """Entries of the folders; a large folder is passed on piece by piece."""
    for batch in batches:
        rows = []
        for location_id, root, folder in zip(*(batch[c].to_pylist() for c in ("location_id", "root_path", "path"))):
            try:
                for path, is_dir, size, stamp in _children(folder):
                    name = path.rsplit("/", 1)[-1]
                    if is_dir and name.lower() not in _IGNORED or not is_dir and _MARKDOWN.search(path):
                        rows.append((location_id, root, path, is_dir, size, stamp, None))
                    if len(rows) >= LISTED_ROWS:
                        yield _entries(rows)
                        rows = []
            except OSError as problem:
                rows.append((location_id, root, folder, False, None, None, f"Could not inspect this path: {problem.strerror}"))
        yield _entries(rows)


def list_files(locations: DataFrame) -> DataFrame:
    """(location_id, root_path, relative_path, path, size, modified_at_ms, error) below every root.

    Ignored directory names are never entered.  A folder that cannot be listed
    is a row with ``error``.  The loop runs once per folder level.
    """
    frontier = locations.select(
        "location_id", F.regexp_replace("path", "(?<=.)/+$", "").alias("root_path")).withColumn("path", F.col("root_path"))
    found = None
    while True:
        spread = frontier.select("location_id", "root_path", "path").repartition(F.col("path"))
        level = checkpoints.cut(spread.mapInArrow(_list_folders, ENTRY))
        files = level.where("NOT is_dir")
        found = files if found is None else found.unionByName(files)
        frontier = level.where("is_dir")
        if frontier.limit(1).count() == 0:
            break
    relative = F.substring(F.col("path"), F.length("root_path") + 2, F.length("path"))
    return found.select("location_id", "root_path", relative.alias("relative_path"), "path", "size", "modified_at_ms", "error")


def _content(path: str) -> tuple[bytes | None, str | None]:
    try:
        if "://" in path:
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_stream(name) as stream:
                return stream.read(), None
        with open(path, "rb", buffering=0) as stream:
            return stream.read(), None
    except OSError as problem:
        return None, f"Could not read this Markdown file: {problem.strerror}"


def _read_files(batches):
    """Each row with its file's content; files of ``READ_BYTES`` are held at a time, or one file."""
    for batch in batches:
        place = batch.schema.get_field_index("path")
        start, held, read = 0, 0, []

        def rows(stop):
            own = batch.slice(start, stop - start)
            contents, errors = zip(*read)
            return pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=[*own.schema.names, "content", "error"])

        for i, path in enumerate(batch.column(place).to_pylist()):
            content, error = _content(path)
            if read and held + len(content or b"") > READ_BYTES:
                yield rows(i)
                start, held, read = i, 0, []
            held += len(content or b"")
            read.append((content, error))
        if read:
            yield rows(batch.num_rows)


def read_contents(files: DataFrame) -> DataFrame:
    """Add binary ``content`` and a read ``error``; files are spread by path before they are read, contents stay where they are.

    Paths are short and what is done with the contents is not, so the files are counted for the number of tasks.
    """
    many = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // READ_FILES))
    spread = files.drop("error").repartition(many, F.col("path"))
    return spread.mapInArrow(_read_files, T.StructType([*spread.schema.fields, *CONTENT]))


def _file_system(folder: str):
    """(file system, path in it) of a folder, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _each_file(root: str, work):
    def run(batches):
        system, base = _file_system(root)
        if base == root:
            system = None
        made = set()
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for location, path, content in zip(column["location_id"], column["relative_path"], column["content"]):
                work(system, f"{base}/{location}/{path}", content, made)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def _write_file(system, path: str, content: str, made: set[str]) -> None:
    """``system`` is None for plain local files; ``made`` are folders that this task has seen."""
    folder = path.rsplit("/", 1)[0]
    if folder not in made:
        os.makedirs(folder, exist_ok=True) if system is None else system.create_dir(folder, recursive=True)
        made.add(folder)
    with open(path, "wb", buffering=0) if system is None else system.open_output_stream(path) as stream:
        stream.write(content.encode())


def _remove_file(system, path: str, *_) -> None:
    if system is None:
        if os.path.isfile(path):
            os.remove(path)
    elif system.get_file_info(path).is_file:
        system.delete_file(path)


def write_files(files: DataFrame, root: str) -> int:
    """Write (location_id, relative_path, content) as files below ``root``, from the executors; a repeat overwrites."""
    spread = files.select("location_id", "relative_path", "content").repartition("location_id", "relative_path")
    return spread.mapInArrow(_each_file(root, _write_file), "n bigint").agg(F.sum("n")).first()[0] or 0


def remove_files(files: DataFrame, root: str) -> int:
    """Remove files below ``root`` that ``write_files`` wrote."""
    return files.select("location_id", "relative_path", "content").mapInArrow(_each_file(root, _remove_file), "n bigint").agg(F.sum("n")).first()[0] or 0


def scan_corpus(locations: DataFrame) -> DataFrame:
    """Listing plus content of all Markdown files up to 8 MiB."""
    files = list_files(locations)
    return read_contents(files.where(f"error IS NULL AND size <= {MAX_DOCUMENT_BYTES}"))


def checked_text(files: DataFrame) -> DataFrame:
    """Contents as text with a ``message`` where they cannot be read or decoded; such a text is empty."""
    good = F.col("error").isNull() & F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    message = F.coalesce("error", F.lit("Could not read this Markdown file: stream did not contain valid UTF-8"))
    staged = files.withColumn("message", F.when(~good, message))
    return staged.withColumn("content", F.when(F.col("message").isNull(), F.col("content").cast("string")).otherwise("")).drop("error")


def decode_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded documents, failed files): undecodable or unreadable files do not stop a run."""
    checked = checked_text(files)
    return checked.where("message IS NULL").drop("message"), checked.where("message IS NOT NULL").select("location_id", "relative_path", "message")


def unreadable_findings(failed: DataFrame, code: str = "OKF_FILE_UNREADABLE") -> DataFrame:
    none = F.lit(None).cast("int")
    return failed.select(
        "location_id", "relative_path", F.lit(code).alias("code"), F.lit("error").alias("severity"), "message",
        none.alias("start_line"), none.alias("start_column"), none.alias("end_line"), none.alias("end_column"),
        F.lit("conformance").alias("tier"))


REGISTRY = ("locations array<struct<id:string,path:string,name:string,available:boolean,okfBundle:boolean,okfMode:string>>")


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Location registry JSON → one row per location."""
    rows = spark.read.schema(REGISTRY).json(path, multiLine=True).select(F.inline("locations"))
    return rows.select(
        F.col("id").alias("location_id"), "path", "name", F.coalesce("available", F.lit(True)).alias("available"),
        F.coalesce("okfBundle", F.lit(False)).alias("okf_bundle"), F.coalesce("okfMode", F.lit("auto")).alias("okf_mode"))


def read_policy_lines(locations: DataFrame, extra: DataFrame | None = None, brand: Brand = DEFAULT) -> DataFrame:
    """(location_id, line_no, line) of every ignore file, extra patterns after them.

    A missing file is no policy; a file above 64 KiB gives one line that the
    rule compiler rejects, so the location gets an error instead of a part policy.
    """
    files = locations.select("location_id", F.concat(
        F.regexp_replace("path", "(?<=.)/+$", ""), F.lit(f"/{brand.ignore_file}")).alias("path"), F.lit(None).alias("error"))
    read = read_contents(files).where("content IS NOT NULL")
    text = F.when(F.length("content") <= MAX_RULE_BYTES, F.col("content").cast("string")).otherwise(F.lit("!"))
    lines = read.select("location_id", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    if extra is not None:
        lines = lines.unionByName(extra.select(
            "location_id", (F.col("line_no") + MAX_RULE_BYTES + 1).cast("int").alias("line_no"), "line"))
    return lines

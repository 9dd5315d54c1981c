"""Files of documents in, payloads out."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.text import (file_suffix, html_to_text, markdown_to_text,
                                    stored_doc_id)
from corpusq.session import keep

# Files that `land_files` puts into one folder.
FOLDER_FILES = 1000
TASK_FILES = 20_000             # files that a task reads at most, and
FEW_FILES = 200                 # so many at least, if all cores have tasks
BATCH_BYTES = 16 * 1024 * 1024  # bytes of files handed to Spark at once


def land_files(rows: DataFrame, folder: str) -> list[str]:
    """Write rows (name STRING, content BINARY) as one file each; returns the folders written.

    Tasks write the files themselves, as an upload does: Spark's writers make a folder, a
    checksum and a rename for every file. A task that runs again writes to folders of its
    own, and only those of the attempt that counts are returned. Rows that repeat a name lie
    in different folders. A null content is an empty file. `folder` is one that Spark and
    pyarrow can open: local, hdfs, s3, gs.
    """
    path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    conf = rows.sparkSession._jsparkSession.sessionState().newHadoopConf()
    uri = path.getFileSystem(conf).makeQualified(path).toUri().toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        made, held = [], set()
        for batch in batches:
            for name, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not made or len(held) == FOLDER_FILES or name in held:
                    made.append(uuid.uuid4().hex)
                    store.create_dir(f"{root}/{made[-1]}")
                    held = set()
                held.add(name)
                with store.open_output_stream(f"{root}/{made[-1]}/{name}", compression=None) as out:
                    out.write(content or b"")
        yield pa.RecordBatch.from_pydict({"folder": pa.array(made, pa.string())})

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root)
    written = rows.select("name", "content").mapInArrow(write, "folder string").collect()
    return [f"{folder}/{r.folder}" for r in written] or [folder]


def _found(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """Paths with their scheme; None if only Spark can open one of them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for given in [path] if isinstance(path, str) else path:
        if any(c in given for c in "*?[{\\"):
            there = hadoop(given)
            found += [s.getPath().toString() for s in there.getFileSystem(conf).globStatus(there) or []]
        else:
            found.append(given)
    if not all(":/" in p for p in found):
        here = hadoop(".").getFileSystem(conf)
        root = here.makeQualified(hadoop("/")).toString()    # file:/
        found = [p if ":/" in p else root + p.lstrip("/") if p.startswith("/")
                 else here.makeQualified(hadoop(p)).toString() for p in found]
    found = [p.replace(":///", ":/", 1) for p in found]
    try:
        for root in {_split(p)[0] for p in found}:
            fs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError, NotImplementedError):
        return None
    return found


def _split(path: str) -> tuple[str, str]:
    """Root that pyarrow opens, and the path below it."""
    scheme, rest = path.split(":/", 1)
    host, _, below = rest[1:].partition("/") if rest.startswith("/") else ("", "", rest)
    return f"{scheme}://{host}/", below


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(spark: SparkSession, found: list[str]) -> DataFrame:
    """(path, n_bytes, modified_ms) of all files that are not empty, recursively.

    Tasks list the folders, level by level, and write what they see to a table: the driver,
    where Spark's file sources hold every file, holds none.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                root, below = _split(path)
                store, base = fs.FileSystem.from_uri(root)
                own = store.get_file_info(f"{base.rstrip('/')}/{below}" if base else below)
                if own.type == fs.FileType.NotFound:
                    raise FileNotFoundError(path)
                inside = own.type == fs.FileType.Directory
                seen = store.get_file_info(fs.FileSelector(own.path)) if inside else [own]
                seen = [f for f in seen if not inside or not _hidden(f.base_name)]
                is_folder = [f.type == fs.FileType.Directory for f in seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{path.rstrip('/')}/{f.base_name}" if inside else path for f in seen], pa.string()),
                     pa.array([f.size for f in seen], pa.int64()),
                     pa.array([f.mtime_ns and f.mtime_ns // 1_000_000 for f in seen], pa.int64()),
                     pa.array(is_folder, pa.bool_())], ["path", "n_bytes", "modified_ms", "is_folder"])

    schema = "path string, n_bytes bigint, modified_ms bigint, is_folder boolean"
    folders, levels = spark.createDataFrame([(p,) for p in found], "path string"), []
    while many := folders.count():
        levels.append(keep(folders.repartition(_tasks(spark, many, 1)).mapInArrow(work, schema)))
        folders = levels[-1].where("is_folder").select("path")
    files = spark.createDataFrame([], schema)
    for level in levels:
        files = files.union(level)
    return files.where("NOT is_folder AND n_bytes > 0").drop("is_folder")


def _read(files: DataFrame, unpack: bool = False) -> DataFrame:
    """Listed files + `content` BINARY, read by tasks of at most some ten thousand files; with
    `unpack` compressed ones (.gz, .bz2) are opened, as Spark's text source does."""
    spark, kinds = files.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in rows[0]}, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = {}
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                root, below = _split(row["path"])
                store, base = stores.get(root) or stores.setdefault(root, fs.FileSystem.from_uri(root))
                place = f"{base.rstrip('/')}/{below}" if base else below
                with store.open_input_stream(place, compression="detect" if unpack else None) as file:
                    rows.append(row | {"content": file.read()})
                held += len(rows[-1]["content"])
                if held >= BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    types = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in files.schema] + [("content", pa.binary())])
    many = files.count()
    tasks = max(_tasks(spark, many, FEW_FILES), math.ceil(many / TASK_FILES))
    return files.repartition(tasks).mapInArrow(work, f"{kinds}, content binary")


def _tasks(spark: SparkSession, many: int, least: int) -> int:
    """A few tasks for each core, of `least` rows each if there are so many."""
    return max(1, min(4 * max(spark.sparkContext.defaultParallelism, 8), math.ceil(many / least)))


def _named(df: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.withColumn("filename", name).withColumn("file_type", file_suffix(name))


def scan_files(spark: SparkSession, path: str | list[str],
               keep_unsupported: bool = False, content: bool = True) -> DataFrame:
    """(path, filename, file_type, n_bytes, modified_at, content BINARY), recursively.

    Files are listed by tasks, when this is called, and read by tasks, when the result is used;
    without `content` no byte is read and there is no such column. Where only Spark can open a
    path, its file source lists it on the driver.
    """
    found = _found(spark, path)
    if found is None:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select("path", F.col("length").alias("n_bytes"),
                         F.unix_millis("modificationTime").alias("modified_ms"), "content"))
    else:
        files = _listed(spark, found)
    supported = file_suffix(F.regexp_extract("path", r"([^/]+)$", 1)).isin(fv.SUPPORTED_SUFFIXES)
    files = files if keep_unsupported else files.where(supported)
    files = _read(files) if content and found is not None else files
    return _named(files.select(
        "path", "n_bytes", F.timestamp_millis("modified_ms").alias("modified_at"), *["content"] * content))


def load_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per text file: (path, filename, file_type, content).

    Tasks list the files and read them once into a table in the shared folder; where only Spark
    can open a path, its file source lists it on the driver.
    """
    found = _found(spark, path)
    if found is None:
        raw = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
               .select(F.input_file_name().alias("path"), F.col("value").alias("content")))
    else:
        raw = keep(_read(_listed(spark, found).select("path"), unpack=True).select(
            "path", F.col("content").cast("string").alias("content")))
    return _named(raw)


Parser = Callable[[bytes], list[str]]


def extract_text(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Files + `pages` ARRAY<STRING>; text, markdown and HTML are decoded in the JVM.

    `parsers` maps a suffix to a function from bytes to page texts; files of a type
    nobody can read get NULL pages. Parsers run on Arrow batches.
    """
    text = F.decode("content", "UTF-8")
    suffix = F.col("file_type")
    built_in = (F.when(suffix == ".txt", F.array(text))
                .when(suffix == ".md", F.array(markdown_to_text(text)))
                .when(suffix.isin(".html", ".htm"), F.array(html_to_text(text))))
    if not parsers:
        return files.withColumn("pages", built_in)

    @F.pandas_udf("array<string>")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, contents in batches:
            yield pd.Series([parsers[k](c) if k in parsers else None
                             for k, c in zip(kinds, contents)])

    custom = suffix.isin(list(parsers))
    # only files with a caller's parser cross into Python
    own = files.where(custom).withColumn("pages", parse(suffix, F.col("content")))
    return files.where(~custom).withColumn("pages", built_in).unionByName(own)


def attach_payload(files: DataFrame, registry: DataFrame, requests: DataFrame,
                   isolated: bool = True) -> DataFrame:
    """Requests (doc_id, user_id) + stored bytes; 404 for unknown, foreign or lost files.

    The id is the first part of the stored file's name.
    """
    stored = files.select(stored_doc_id(F.col("path")).alias("doc_id"), "path", "content")
    docs = registry.select("doc_id", "filename", F.col("user_id").alias("_owner"))
    found = requests.join(docs, "doc_id", "left")
    if isolated:
        found = found.withColumn("_mine", F.col("_owner") == F.col("user_id"))
    else:
        found = found.withColumn("_mine", F.col("_owner").isNotNull())
    mine = F.coalesce("_mine", F.lit(False))
    # bytes stay on the probe side until the narrow request set has filtered them
    wanted = stored.join(found.where(mine).select("doc_id"), "doc_id", "left_semi")
    return (found.join(wanted, "doc_id", "left").select(
        "doc_id", "user_id",
        F.when(mine, F.col("filename")).alias("filename"),
        F.when(mine, F.col("path")).alias("path"),
        F.when(mine, F.col("content")).alias("content"),
        F.when(~mine | F.col("path").isNull(), F.lit(fv.NOT_FOUND)).alias("error_code")))

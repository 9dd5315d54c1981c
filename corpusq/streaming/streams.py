"""Continuous forms of ingestion, duplicate removal and chat memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusq import fixed_values as fv
from corpusq.config import EngineConfig
from corpusq.functions.text import file_suffix
from corpusq.plans.ingest import ingest, uploads_from_files
from corpusq.schemas import REGISTRY
from corpusq.sources.files import extract_text

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
DEDUP_SALTS = 16


def _registry_before(spark: SparkSession, root: str, epoch: int) -> DataFrame:
    """Documents registered by earlier micro-batches."""
    from corpusq.sources.tables import _fs
    fs, jvm = _fs(spark, root)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/registry")):
        return spark.createDataFrame([], REGISTRY)
    schema = spark.createDataFrame([], REGISTRY).withColumn("batch", F.lit(0)).schema
    return (spark.read.schema(schema).parquet(f"{root}/registry")
            .where(F.col("batch") < epoch).drop("batch"))


def ingest_batches(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], root: str,
                   checkpoint: str, config: EngineConfig = EngineConfig(),
                   splitter: str = "recursive", available_now: bool = False) -> StreamingQuery:
    """Ingest each micro-batch of a stream; `prepare` turns it into uploads.

    A batch overwrites its own `batch=` folders, so one that runs again after a failure
    leaves the same files. The registry is written last: it is what the next batch reads.
    """
    def write_batch(batch: DataFrame, epoch: int) -> None:
        known = _registry_before(batch.sparkSession, root, epoch)
        out = ingest(prepare(batch), known, config, splitter, materialise=True)
        for table in ("document_collections", "chunks", "rejects", "registry"):
            out[table].write.mode("overwrite").parquet(f"{root}/{table}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stream(spark: SparkSession, landing: str, root: str, checkpoint: str,
                  config: EngineConfig = EngineConfig(), user_id: str = fv.DEFAULT_USER,
                  files_per_trigger: int = 1000, parsers: dict | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Ingest the files of a landing folder as they arrive."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILES)
             .option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", files_per_trigger).load(landing))

    def prepare(batch: DataFrame) -> DataFrame:
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        named = batch.select(
            "path", F.col("length").alias("n_bytes"),
            F.col("modificationTime").alias("modified_at"), "content",
            name.alias("filename"), file_suffix(name).alias("file_type"))
        return uploads_from_files(extract_text(named, parsers), user_id)

    return ingest_batches(files, prepare, root, checkpoint, config, available_now=available_now)


def dedup_stream(uploads: DataFrame, horizon: str, isolated: bool = True) -> DataFrame:
    """First copy of each (owner, hash) inside the horizon of the event time `uploaded_at`.

    Two rounds: first by key and salt, then by key. A very frequent hash is thinned out on
    DEDUP_SALTS tasks before one task sees it.
    """
    keys = ["user_id", "file_hash"] if isolated else ["file_hash"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(DEDUP_SALTS)).cast("int")
    return (uploads.withWatermark("uploaded_at", horizon).withColumn("_salt", salt)
            .dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
            .dropDuplicatesWithinWatermark(keys))


MEMORY_OUT = ("session_id string, expired boolean, last_access_us long, "
              "ids array<long>, contents array<string>")
MEMORY_STATE = "ts array<long>, ids array<long>, contents array<string>"


def chat_memory_stream(log: DataFrame, max_messages: int = fv.MEMORY_MAX_MESSAGES,
                       ttl: int = fv.MEMORY_TTL_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """Memory of each session after every micro-batch, from a log (session_id, ts, id,
    content).

    The state is the newest max_messages of the current island; input of a session is read
    batch by batch and cut to that size each time. A session idle for ttl expires when the
    watermark passes; gaps above ttl inside the data also start afresh.
    """
    step = ttl * 1_000_000

    def cut(rows: list[tuple]) -> list[tuple]:
        rows = sorted(set(rows))[-max_messages:]
        start = 0
        for i in range(1, len(rows)):
            if rows[i][0] - rows[i - 1][0] > step:
                start = i
        return rows[start:]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = max(state.get[0])
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "expired": [True],
                                "last_access_us": [last], "ids": [[]], "contents": [[]]})
            return
        rows = list(zip(*state.get)) if state.exists else []
        newest = []
        for b in batches:
            # keep more than one island's worth until all of the micro-batch is seen
            newest = sorted(set(newest) | set(zip(b["ts_us"].tolist(), b["id"].tolist(),
                                                  b["content"].tolist())))[-max_messages:]
        rows = cut(rows + newest)
        state.update(tuple(list(c) for c in zip(*rows)))
        wake = (rows[-1][0] + step) // 1000 + 1
        if wake > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(wake)
        else:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame({"session_id": [key[0]], "expired": [False],
                            "last_access_us": [rows[-1][0]],
                            "ids": [[r[1] for r in rows]],
                            "contents": [[r[2] for r in rows]]})

    return (log.withWatermark("ts", lateness)
            .select("session_id", "ts", F.unix_micros("ts").alias("ts_us"), "id", "content")
            .groupBy("session_id")
            .applyInPandasWithState(update, MEMORY_OUT, MEMORY_STATE, "update",
                                    GroupStateTimeout.EventTimeTimeout))

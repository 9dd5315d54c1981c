"""Chat sessions, replay, and the streaming forms."""

import uuid

from pyspark.sql import functions as F

from corpusq.checks.base import check
from corpusq.checks.derived import sql
from corpusq.checks.relational import INGESTED_CHUNKS, chunk_columns, uploads_of
from corpusq.operators import chat
from corpusq.session import shared_folder
from corpusq.streaming.streams import chat_memory_stream, dedup_stream, ingest_batches

_NOW = 7200


def _now(t):
    return F.timestamp_seconds(F.unix_seconds(t.day0) + _NOW)


def _second(t, c):
    return F.unix_seconds(c) - F.unix_seconds(t.day0)


@check("f12_expired", sql("SELECT session_id, last_second < 7200 - 3600 AS expired FROM chat_sessions", "chat_sessions"))
def _(t):
    return t.chat_sessions.select("session_id", chat.expired(F.col("last_access"), _now(t)).alias("expired"))


@check("a6_message_counts", sql("SELECT session_id, count(*) AS messages FROM chat_messages GROUP BY 1", "chat_messages"))
def _(t):
    return chat.message_counts(t.chat_messages)


@check("k6_ordered_messages", sql("SELECT session_id, id, role, content FROM chat_messages ORDER BY session_id, second, id",
                                  "chat_messages"))
def _(t):
    return chat.ordered_messages(t.chat_messages).select("session_id", "id", "role", "content")


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY second DESC, id DESC) AS n FROM chat_messages"


@check("w3_trim", sql("SELECT session_id, id FROM numbered WHERE n <= 4", "chat_messages", numbered=_NUMBERED))
def _(t):
    return chat.trim(t.chat_messages, 4).select("session_id", "id")


@check("k8_surplus", sql("SELECT session_id, id FROM numbered WHERE n > 4", "chat_messages", numbered=_NUMBERED))
def _(t):
    return chat.surplus(t.chat_messages, 4).select("session_id", "id")


@check("h1_session_history", sql("""SELECT s.session_id, s.user_id, coalesce(string_agg(role || ': ' || content, '|' ORDER BY second, id)
    FILTER (WHERE last_second >= 3600), '') AS history FROM chat_sessions s LEFT JOIN numbered m USING (session_id)
    GROUP BY 1, 2""", "chat_messages", "chat_sessions", numbered=_NUMBERED))
def _(t):
    h = chat.session_history(t.chat_sessions, t.chat_messages, _now(t))
    return h.withColumn("history", F.array_join(F.transform(
        "history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|"))


@check("q11_refresh_access", sql("""SELECT session_id, greatest(last_second, coalesce(second, 0)) AS last_second
    FROM chat_sessions LEFT JOIN (SELECT session_id, max(second) AS second FROM chat_messages GROUP BY 1)
    USING (session_id)""", "chat_messages", "chat_sessions"))
def _(t):
    """Every message as a read of its session."""
    asked = t.chat_messages.select("session_id", F.col("created_at").alias("at"))
    return chat.refresh_access(t.chat_sessions, asked).select(
        "session_id", _second(t, F.col("last_access")).alias("last_second"))


_EXCHANGES = """SELECT item_id + 100000000000 AS x, CAST(item_id * 3 AS VARCHAR) AS session_id, text AS question,
    reverse(text) AS answer, 86400 + item_id AS second FROM benchmark"""
_ADDED = """SELECT id, session_id, role, content, second FROM chat_messages UNION ALL
    SELECT x * 2, session_id, 'human', question, second FROM exchanges UNION ALL
    SELECT x * 2 + 1, session_id, 'ai', answer, second FROM exchanges"""


def _appended(t):
    x = t.benchmark.select(
        (F.col("item_id") + 100000000000).alias("exchange_id"),
        (F.col("item_id") * 3).cast("string").alias("session_id"), F.col("text").alias("question"),
        F.reverse("text").alias("answer"),
        F.timestamp_seconds(F.unix_seconds(t.day0) + 86400 + F.col("item_id")).alias("at"))
    return chat.append_exchanges(t.chat_sessions, t.chat_messages, x, 4)


@check("h2_append_messages", sql("""SELECT id, session_id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY second DESC, id DESC) AS n FROM added) WHERE n <= 4 OR session_id NOT IN (SELECT session_id FROM exchanges)""",
    "chat_messages", exchanges=_EXCHANGES, added=_ADDED))
def _(t):
    return _appended(t)[1].select("id", "session_id", "role", "content")


@check("h2_append_sessions", sql("""SELECT coalesce(s.session_id, e.session_id) AS session_id, coalesce(s.user_id, '') AS user_id,
    coalesce(greatest(last_second, second), last_second, second) AS last_second FROM chat_sessions s FULL JOIN exchanges e
    ON e.session_id = s.session_id""", "chat_sessions", exchanges=_EXCHANGES))
def _(t):
    s = _appended(t)[0]
    return s.select("session_id", F.coalesce("user_id", F.lit("")).alias("user_id"),
                    _second(t, F.col("last_access")).alias("last_second"))


@check("h4_expire_sessions", sql("""SELECT session_id, id FROM chat_messages JOIN chat_sessions USING (session_id)
    WHERE last_second >= 3600""", "chat_messages", "chat_sessions"))
def _(t):
    return chat.expire_sessions(t.chat_sessions, t.chat_messages, _now(t))[1].select("session_id", "id")


_ISLANDS = """SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY us, id) AS island FROM (SELECT *, CASE WHEN us - lag(us)
    OVER (PARTITION BY session_id ORDER BY us, id) > 3600000000 THEN 1 ELSE 0 END AS g FROM log)"""


@check("w5_session_islands", sql("SELECT session_id, id, CAST(island AS BIGINT) AS island FROM islands", "log", islands=_ISLANDS))
def _(t):
    return chat.session_islands(t.log).select("session_id", "id", "island")


@check("h3_history_replay", sql("""SELECT session_id, id, coalesce(string_agg(CAST(id AS VARCHAR) || content, '|') OVER (PARTITION BY
    session_id, island ORDER BY us, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), '') AS history FROM islands""",
    "log", islands=_ISLANDS))
def _(t):
    return chat.history_replay(t.log, ["content"]).select(
        "session_id", "id", F.array_join(F.transform(
            "history", lambda m: F.concat(m["id"].cast("string"), m["content"])), "|").alias("history"))


_FINAL = """SELECT session_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY us, id) AS ids FROM (SELECT *, row_number() OVER (
    PARTITION BY session_id ORDER BY us DESC, id DESC) AS n, max(island) OVER (PARTITION BY session_id) AS last FROM islands)
    WHERE n <= 20 AND island = last GROUP BY 1"""


@check("h3_final_memory", sql(_FINAL, "log", islands=_ISLANDS))
def _(t):
    m = chat.final_memory(t.log, ["content"])
    return m.select("session_id", F.array_join(F.transform(
        "memory", lambda x: x["id"].cast("string")), ",").alias("ids"))


# --- streams ---------------------------------------------------------------------------------

def _work_folder(spark) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/corpusq-{uuid.uuid4().hex}"


@check("x3_chat_memory_stream", sql(_FINAL, "log", islands=_ISLANDS))
def _(t):
    """All events as a stream; the last state of each session."""
    folder = _work_folder(t.spark)
    source = t.stream("events")
    log = source.select(F.col("user_id").cast("string").alias("session_id"),
                        F.col("ts").cast("timestamp").alias("ts"),
                        F.col("event_id").alias("id"), F.col("event_type").alias("content"))

    def save(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    run = (chat_memory_stream(log).writeStream.outputMode("update").foreachBatch(save)
           .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    run.awaitTermination()
    out = t.spark.read.parquet(f"{folder}/out").where(~F.col("expired"))
    latest = out.groupBy("session_id").agg(F.max_by(
        "ids", F.struct("last_access_us", "batch")).alias("ids"))
    return latest.select("session_id", F.array_join(
        F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@check("x1_ingest_stream", INGESTED_CHUNKS)
def _(t):
    """Documents arriving as a stream of uploads; the chunks that were stored."""
    folder = _work_folder(t.spark)
    source = t.stream("documents")
    ingest_batches(uploads_of(source, t.day0), lambda batch: batch, f"{folder}/out",
                   f"{folder}/checkpoint", splitter="fixed", available_now=True).awaitTermination()
    return chunk_columns(t.spark.read.parquet(f"{folder}/out/chunks"))


@check("x2_dedup_stream", """SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS user_id,
    sha256(event_type || props) AS file_hash FROM events""")
def _(t):
    """Events as uploads: each (user, content) once inside a horizon longer than the data."""
    folder = _work_folder(t.spark)
    source = t.stream("events")
    uploads = source.select(
        F.col("event_id").cast("string").alias("doc_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.sha2(F.concat("event_type", "props").cast("binary"), 256).alias("file_hash"),
        F.col("ts").cast("timestamp").alias("uploaded_at"))
    run = (dedup_stream(uploads, "3650 days").writeStream.outputMode("append").format("parquet")
           .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("user_id", "file_hash")

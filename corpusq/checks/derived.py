"""Engine tables derived from the given ones, twice: as DataFrames and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import capitalize_name, content_hash, file_suffix
from corpusq.functions.validate import map_role

DAY0 = "2024-01-01 00:00:00"


def _dealt(df: DataFrame) -> DataFrame:
    """A table given as fewer files than there are cores would be few tasks' work: one small
    file is often one row group. Tables of many files are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


class Tables:
    """Given parquet tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._read = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._read[name] = _dealt(df) if name in ("documents", "pages") else df
        return self._read[name]

    def stream(self, name: str) -> DataFrame:
        """A given table as a stream, be it one file or a folder of files: a pattern finds both."""
        schema = getattr(self, name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/[{name[0]}]{name[1:]}.parquet")

    @property
    def day0(self):
        return F.lit(DAY0).cast("timestamp")

    @property
    def docs(self) -> DataFrame:
        return self.documents.withColumn("doc_id", F.col("doc_id").cast("string"))

    @property
    def users(self) -> DataFrame:
        return self.documents.select(F.col("source").alias("user_id")).distinct().select(
            "user_id", capitalize_name(F.col("user_id")).alias("display_name"),
            self.day0.alias("created_at"))

    @property
    def registry(self) -> DataFrame:
        name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.documents.select(
            F.col("doc_id").cast("string").alias("doc_id"), name.alias("filename"),
            file_suffix(name).alias("file_type"), F.lit(0).alias("chunk_count"),
            F.col("source").alias("user_id"), content_hash(F.col("text")).alias("file_hash"),
            F.timestamp_seconds(F.unix_seconds(self.day0) + F.col("doc_id")).alias("uploaded_at"))

    @property
    def collections(self) -> DataFrame:
        docs = self.documents.select("doc_id", "lang")
        labels = self.labels.select("doc_id", "quality")
        names = F.array_compact(F.array(
            F.col("lang"),
            F.when(F.col("quality") == 1, F.lit("quality")),
            F.when(F.col("quality").isNull(), F.lit("other"))))
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").cast("string").alias("doc_id"), F.explode(names).alias("collection"))

    @property
    def chunks(self) -> DataFrame:
        """Fixed windows over whole texts."""
        from corpusq.functions.chunking import chunk_fixed, explode_chunks
        from corpusq.functions.text import chunk_id
        docs = self.docs.select("doc_id", "source", chunk_fixed(F.col("text")).alias("chunks"))
        name = F.concat("source", F.lit("_"), "doc_id", F.lit(".txt"))
        return explode_chunks(docs).select(
            chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id",
            "chunk_index", F.lit(None).cast("int").alias("page"), name.alias("source_file"),
            "content", F.create_map(F.lit("source"), F.col("source")).alias("extra"))

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").cast("string").alias("chunk_id"),
            F.col("vec_id").cast("string").alias("doc_id"), "embedding")

    @property
    def vector_queries(self) -> DataFrame:
        """Every vector asks for its neighbours; top_k runs from 1 to 20."""
        return self.embeddings.select(
            F.col("vec_id").cast("string").alias("query_id"),
            F.col("embedding").alias("vector"),
            (F.col("vec_id") % 20 + 1).cast("int").alias("top_k"))

    @property
    def scoped_queries(self) -> DataFrame:
        """Every benchmark item asks as some owner, partly with a collection or an id list."""
        i = F.col("item_id")
        return self.benchmark.select(
            i.cast("string").alias("query_id"), F.col("text").alias("question"),
            (i % 20 + 1).cast("int").alias("top_k"),
            F.concat(F.lit("src"), (i % 23).cast("string")).alias("user_id"),
            F.when(i % 3 == 1, F.lit("en")).when(i % 3 == 2, F.lit("")).alias("collection"),
            F.when(i % 4 == 0, F.transform(F.sequence(F.lit(0), F.lit(9)),
                                           lambda j: (i * j + j).cast("string")))
            .when(i % 4 == 1, F.array().cast("array<string>")).alias("doc_ids"))

    def _vector_of(self, rows: DataFrame, number) -> DataFrame:
        """Rows + the given vector whose number is `number` modulo how many there are."""
        n = self.embeddings.count()
        return rows.withColumn("vec_id", F.pmod(number, F.lit(n))).join(
            self.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")

    @property
    def passage_store(self) -> DataFrame:
        """Every chunk of every document."""
        return self.chunks

    @property
    def passage_vectors(self) -> DataFrame:
        """A given vector for every chunk; chunks may share one."""
        number = F.col("doc_id").cast("bigint") * 31 + F.col("chunk_index")
        return self._vector_of(self.chunks, number).select("chunk_id", "doc_id", "embedding")

    @property
    def passage_queries(self) -> DataFrame:
        """Every benchmark item asks with its text, a vector, an owner, and partly with a
        collection or an id list."""
        return self._vector_of(self.scoped_queries, F.col("query_id").cast("bigint")
                               ).withColumnRenamed("embedding", "vector")

    @property
    def messages(self) -> DataFrame:
        """Turns as stored messages; ids grow with (conversation, turn)."""
        return self.conversations.select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
            F.col("conv_id").cast("string").alias("session_id"),
            map_role(F.col("role")).alias("role"), F.col("text").alias("content"),
            F.timestamp_seconds(F.unix_seconds(self.day0) + F.col("turn")).alias("created_at"))

    @property
    def chat_messages(self) -> DataFrame:
        return self.messages.where(F.col("role").isin("human", "ai"))

    @property
    def chat_sessions(self) -> DataFrame:
        """Last access ten minutes apart per conversation number."""
        return self.conversations.select("conv_id").distinct().select(
            F.col("conv_id").cast("string").alias("session_id"),
            F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("user_id"),
            self.day0.alias("created_at"),
            F.timestamp_seconds(F.unix_seconds(self.day0) + F.col("conv_id") * 600)
            .alias("last_access"))

    @property
    def log(self) -> DataFrame:
        """Events as timed accesses of sessions."""
        return self.events.select(
            F.col("user_id").cast("string").alias("session_id"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
            F.col("event_type").alias("content"))


CTES = {
    "docs": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents",
    "users": """SELECT DISTINCT source AS user_id,
        upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS display_name FROM documents""",
    "registry": """SELECT CAST(doc_id AS VARCHAR) AS doc_id,
        source || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, '.txt' AS file_type,
        source AS user_id, sha256(text) AS file_hash, doc_id AS uploaded_second FROM documents""",
    "collections": """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.lang AS collection FROM documents d
        UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 'quality' FROM documents d
            JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1
        UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 'other' FROM documents d
            LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL""",
    "chunk_starts": """SELECT doc_id, source, text,
        unnest(range(0, greatest(length(text) - 200 - 1, 0) + 1, 800)) AS p
        FROM docs WHERE length(text) > 0""",
    "chunks": """SELECT doc_id || '_chunk_' || CAST(p // 800 AS VARCHAR) AS chunk_id, doc_id,
        p // 800 AS chunk_index, source || '_' || doc_id || '.txt' AS source_file, source,
        substr(text, CAST(p + 1 AS BIGINT), 1000) AS content FROM chunk_starts""",
    "vectors": """SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(vec_id AS VARCHAR) AS doc_id,
        CAST(embedding AS DOUBLE[]) AS e FROM embeddings""",
    "vector_queries": """SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS v,
        vec_id % 20 + 1 AS top_k FROM embeddings""",
    "scoped_queries": """SELECT CAST(item_id AS VARCHAR) AS query_id, text AS question,
        item_id % 20 + 1 AS top_k, 'src' || CAST(item_id % 23 AS VARCHAR) AS user_id,
        CASE item_id % 3 WHEN 1 THEN 'en' END AS collection,
        CASE item_id % 4 WHEN 0 THEN list_transform(range(0, 10),
            lambda j: CAST(item_id * j + j AS VARCHAR)) END AS doc_ids FROM benchmark""",
    "passages": """SELECT c.chunk_id, c.doc_id, c.source_file, c.source, c.content, v.e FROM chunks c
        JOIN vectors v ON CAST(v.doc_id AS BIGINT) = (CAST(c.doc_id AS BIGINT) * 31 + c.chunk_index)
        % (SELECT count(*) FROM vectors)""",
    "passage_queries": """SELECT q.*, v.e AS v FROM scoped_queries q JOIN vectors v
        ON CAST(v.doc_id AS BIGINT) = CAST(q.query_id AS BIGINT) % (SELECT count(*) FROM vectors)""",
    "valid_passage_queries": """SELECT * FROM passage_queries
        WHERE length(question) BETWEEN 1 AND 2000""",
    "messages": """SELECT conv_id * 100000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id,
        CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS role,
        text AS content, turn AS second FROM conversations""",
    "chat_messages": "SELECT * FROM messages WHERE role IN ('human', 'ai')",
    "chat_sessions": """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id,
        'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id, conv_id * 600 AS last_second
        FROM conversations""",
    "log": """SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS us, event_id AS id,
        event_type AS content FROM events""",
}

NEEDS = {
    "chunk_starts": ["docs"], "chunks": ["docs", "chunk_starts"],
    "passages": ["docs", "chunk_starts", "chunks", "vectors"],
    "passage_queries": ["vectors", "scoped_queries"],
    "valid_passage_queries": ["vectors", "scoped_queries", "passage_queries"],
    "chat_messages": ["messages"],
}


def sql(body: str, *ctes: str, **extra: str) -> str:
    """SELECT `body` after the named CTEs (and what they need) and extra ones in order."""
    order: list[str] = []
    for name in ctes:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body

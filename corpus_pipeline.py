"""Corpus preparation: documents to packed training batches, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in
the shared folder and reads it again for the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.language import fold, language, learn_dictionaries
from corpusq.llm.minhash import BROADCAST_IDS, near_duplicates
from corpusq.llm.packing import pack
from corpusq.llm.secrets import learn_secrets, secrets
from corpusq.session import apply_runtime_conf, cut_lineage, shared_folder

# Similarity of near-duplicates; twelve halves miss a pair at 0.8 with probability 1e-5.
PERCENT, HALVES = 80, 12

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents it rejects (no letters, or too narrow a margin) go; `lang` of
    the others becomes the predicted language.

    Without any labelled text there is nothing to tell languages by, and only documents
    without letters go.
    """
    apply_runtime_conf(spark)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    dictionaries = learn_dictionaries(docs.where(~held_out))
    if not dictionaries:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*DOCUMENTS)
    judged = docs.select(*DOCUMENTS, language(F.col("text"), dictionaries).alias("_l"))
    return judged.where(~F.col("_l.rejected")).select(
        *[F.col("_l.lang_pred").alias("lang") if c == "lang" else F.col(c) for c in DOCUMENTS])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup at a similarity of 0.8: of each component the document with the
    smallest id stays.

    Rows without id stay. Of rows that repeat an id one stays.
    """
    apply_runtime_conf(spark)
    found = cut_lineage(near_duplicates(docs, percent=PERCENT, halves=HALVES))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.select(*DOCUMENTS).join(gone, "doc_id", "left_anti")
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    repeated = cut_lineage(repeated)
    if repeated.isEmpty():
        return left.select(*DOCUMENTS)
    single = left.join(repeated, "doc_id", "left_anti")
    several = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(*DOCUMENTS[1:])).alias("r")).select("doc_id", "r.*")
    return single.select(*DOCUMENTS).union(several.select(*DOCUMENTS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark; all documents stay. `n_chars`
    follows the text."""
    apply_runtime_conf(spark)
    scanned = docs.select(*DOCUMENTS, secrets(
        F.col("text"), learn_secrets(docs), redact=True)["redacted"].alias("_r"))
    text = F.coalesce("_r", "text")
    length = F.when(F.col("_r").isNull(), F.col("n_chars")).otherwise(
        F.length("_r").cast("bigint"))
    return scanned.select(*[{"text": text, "n_chars": length}.get(c, F.col(c)).alias(c)
                            for c in DOCUMENTS])


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the place of every document in a training batch."""
    apply_runtime_conf(spark)
    return pack(docs)


STAGES = [("language_id", keep_identified), ("near_dedup", drop_near_duplicates),
          ("secret_scan", redact_secrets), ("packing", pack_batches)]

# Compression, trained tagging and components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

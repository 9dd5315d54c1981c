"""Registered queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusq.llm.bpe import bpe_round_trip
from corpusq.llm.language import identify_language
from corpusq.llm.licenses import scan_licenses
from corpusq.llm.merkle import merkle_manifest
from corpusq.llm.minhash import near_duplicates
from corpusq.llm.packing import BUCKETS, BUDGET, FINE, SHARD_ROWS, pack
from corpusq.llm.hamming import hamming_topk
from corpusq.llm.phrases import collocations
from corpusq.llm.pii import find_private
from corpusq.llm.rabitq import ann_search
from corpusq.llm.repeats import remove_repeats
from corpusq.llm.secrets import scan_secrets
from corpusq.llm.token_fst import count_tokens
from corpusq.session import apply_runtime_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register `fn(spark, folder)` under its name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(apply_runtime_conf(spark), folder)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_bpe_codec(spark, folder):
    """Encode and decode every document with the word vocabulary."""
    return bpe_round_trip(table(spark, folder, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_token_count(spark, folder):
    """Tokens of every document under the byte-level vocabulary."""
    return count_tokens(table(spark, folder, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_minhash_dedup(spark, folder):
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


@query
def op6_packing(spark, folder):
    """Batches of all documents under a token budget."""
    return pack(table(spark, folder, "documents"))


@query
def op10_language_id(spark, folder):
    """Language of every document."""
    return identify_language(table(spark, folder, "documents"))


@query
def op5_secret_scan(spark, folder):
    """Secrets in every document."""
    return scan_secrets(table(spark, folder, "documents"))


@query
def op8_pii_disclosure(spark, folder):
    """Personal data in every document, and the terms that give it away."""
    return find_private(table(spark, folder, "documents"))


@query
def op3_ann_search(spark, folder):
    """Five nearest vectors of every fiftieth, by rotated one-bit codes."""
    rows = table(spark, folder, "embeddings")
    return ann_search(rows, rows.where("vec_id % 50 = 0"))


@query
def op4_hamming_topk(spark, folder):
    """Ten nearest sign codes of every twentieth vector, exactly."""
    rows = table(spark, folder, "embeddings")
    return hamming_topk(rows, rows.where("vec_id % 20 = 0"))


ORACLES["op4_hamming_topk"] = """
WITH coded AS (
  SELECT DISTINCT vec_id, list_sum(list_transform(range(1, 33), lambda i:
           CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (32 - i) ELSE 0 END))::BIGINT AS hi,
         list_sum(list_transform(range(33, 65), lambda i:
           CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (64 - i) ELSE 0 END))::BIGINT AS lo
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) >= 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         min(bit_count(xor(q.hi, c.hi)) + bit_count(xor(q.lo, c.lo)))::BIGINT AS distance
  FROM coded q JOIN coded c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY ALL)
SELECT query_id, row_number() OVER w AS rank, vec_id, distance FROM near
WINDOW w AS (PARTITION BY query_id ORDER BY distance, vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query
def op9_license_scan(spark, folder):
    """Licence families of every document."""
    return scan_licenses(table(spark, folder, "documents"))


@query
def op12_suffix_dedup(spark, folder):
    """What is left of every document without the strings of 200 bytes that repeat."""
    return remove_repeats(table(spark, folder, "documents"))


@query
def op13_merkle_manifest(spark, folder):
    """Leaf, proof and check of every document in the dataset's Merkle tree."""
    return merkle_manifest(table(spark, folder, "documents"))


@query
def op11_collocations(spark, folder):
    """The 2,000 strongest phrases of each language over all documents."""
    return collocations(table(spark, folder, "documents"))


def _packing_sql(buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS,
                 fine: int = FINE) -> str:
    """One step of the dynamic program for each bucket; `path` holds the boundaries so far."""
    level = """SELECT j, cost, path FROM (SELECT h.j, d.cost + h.top * (h.upto - d.upto) AS cost,
        list_append(d.path, h.top) AS path, d.upto, row_number() OVER (PARTITION BY h.j
        ORDER BY d.cost + h.top * (h.upto - d.upto), d.j) AS r
        FROM h JOIN (SELECT p.*, coalesce(x.upto, 0) AS upto FROM {before} p LEFT JOIN h x USING (j)) d
        ON d.j < h.j) WHERE r = 1 UNION ALL SELECT 0, 0, []::BIGINT[]"""
    levels = ", ".join(f"d{b} AS ({level.format(before=f'd{b - 1}')})" for b in range(1, buckets + 1))
    return f"""WITH sized AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''),
        '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    stepped AS (SELECT *, greatest(1, pow(2, floor(log2(greatest(n_tokens, 1) + 0.5) - log2({fine}))))::BIGINT
        AS step FROM sized),
    binned AS (SELECT doc_id, n_tokens, (ceil(n_tokens / step) * step)::BIGINT AS top FROM stepped),
    bins AS (SELECT top, count(*) AS c FROM binned WHERE n_tokens > 0 GROUP BY 1),
    h AS (SELECT top, row_number() OVER (ORDER BY top) AS j, sum(c) OVER (ORDER BY top)::BIGINT AS upto FROM bins),
    d0 AS (SELECT 0 AS j, 0 AS cost, []::BIGINT[] AS path), {levels},
    bounds AS (SELECT unnest(path) AS bucket FROM d{buckets} WHERE j = (SELECT max(j) FROM h)),
    put AS (SELECT doc_id, n_tokens, CASE WHEN n_tokens = 0 THEN 0 ELSE (SELECT min(bucket) FROM bounds
        WHERE bucket >= top) END AS bucket FROM binned),
    dealt AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
        % greatest(1, ceil(count(*) OVER (PARTITION BY bucket) / {shard_rows}))::BIGINT AS shard FROM put),
    placed AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS i,
        greatest(1, {budget} // greatest(bucket, 1)) AS room FROM dealt)
    SELECT doc_id, n_tokens, bucket::BIGINT AS bucket, CASE WHEN bucket > 0 THEN bucket || '-' || shard || '-' || (i // room)
        END AS batch, CASE WHEN bucket > 0 THEN (i % room + 1)::BIGINT END AS slot,
        CASE WHEN bucket > 0 THEN (bucket - n_tokens)::BIGINT ELSE 0 END AS padding FROM placed"""


ORACLES["op6_packing"] = _packing_sql()

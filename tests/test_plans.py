"""What the plans must look like."""

from pyspark.sql import functions as F

import pytest

import __spark_entry__  # noqa: F401 (registers the queries)
from corpusq.checks.base import ORACLES, QUERIES
from corpusq.checks.derived import Tables
from corpusq.operators import chat, registry, topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trim_cuts_before_the_shuffle(t):
    text = plan(chat.trim(t.chat_messages, 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_per_query_k_still_cuts_early(t):
    hits = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"),
                           F.col("value").alias("score"), (F.col("event_id") % 5).alias("k"))
    assert "WindowGroupLimit" in plan(topk.rank_per_query(hits, 20, F.col("k")))


def test_single_list_uses_heaps(t):
    scored = t.events.select(F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    assert "TakeOrderedAndProject" in plan(topk.top_k(scored, 5))


def test_owner_filter_reaches_the_scan(t):
    docs = t.spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("source").alias("user_id"))
    text = plan(registry.owner_filter(docs, "src3"))
    assert "EqualTo(source,src3)" in text and "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_membership_is_a_semi_join(t):
    assert "LeftSemi" in plan(registry.list_by_collection(t.registry, t.collections, "en"))


PYTHON_BY_NATURE = ("c1_", "r1_", "r2_", "r4_", "r5_", "r6_", "r7_", "r8_", "e2_", "e3_", "e5_score",
                    "s10_ingest_un", "x2_", "x3_")


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith(PYTHON_BY_NATURE)))
def test_stays_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text

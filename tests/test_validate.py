"""Row checks give codes, never exceptions."""

import pytest
from pyspark.sql import functions as F

from corpusq.config import EngineConfig
from corpusq.functions import validate


def codes(spark, values, fn, type_):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_question_bounds(spark):
    q = ["", "x", "x" * 2000, "x" * 2001, None, "ß" * 2000]
    assert codes(spark, q, validate.question_error, "string") == [422, None, None, 422, 422, None]


def test_top_k_bounds(spark):
    assert codes(spark, [0, -1, 1, 20, 21, None], validate.top_k_error, "int") == [422, 422, None, None, 422, None]


def test_user_ids(spark):
    ids = ["test-user", "user-123_test", "", "a b", "é", "x" * 50, "x" * 51, None]
    got = codes(spark, ids, lambda c: validate.user_error(c, F.lit("Name")), "string")
    assert got == [None, None, 422, 422, 422, None, 422, 422]
    names = ["", "n", "n" * 100, "n" * 101]
    assert codes(spark, names, lambda c: validate.user_error(F.lit("u"), c), "string") == [422, None, None, 422]


def test_uploads(spark):
    df = spark.createDataFrame([("malware.exe", 1), ("photo.jpg", 1), ("a.TXT", 52428800), ("a.txt", 52428801),
                                ("x.pdf", 0), ("noext", 99999999)], "filename string, n_bytes long")
    got = [r.error_code for r in validate.check_uploads(df).collect()]
    assert got == [400, 400, None, 413, None, 400]


def test_roles_and_lists(spark):
    assert codes(spark, ["human", "ai", "system", None], validate.role_error, "string") == [None, None, 422, 422]
    assert codes(spark, [["a"], [], None], validate.collections_error, "array<string>") == [None, 422, 422]


def test_length_caps(spark):
    df = spark.createDataFrame([("a" * 32, "f" * 500), ("a" * 33, "f"), ("a", "f" * 501), (None, None)],
                               "doc_id string, filename string")
    got = [r[0] for r in df.select(validate.length_error(df, "registry")).collect()]
    assert got == [None, 422, 422, None]


@pytest.mark.parametrize("bad", [dict(isolation="x"), dict(filter_mode="x"), dict(search="x"), dict(metric="x"),
                                 dict(chunk_overlap=1000), dict(bm25_weight=1.5), dict(max_messages=0)])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        EngineConfig(**bad)


def test_config_defaults():
    c = EngineConfig()
    assert (c.chunk_size, c.chunk_overlap, c.default_top_k, c.rerank_top_n, c.max_messages, c.session_ttl,
            c.default_user, c.isolation, c.max_upload_bytes) == (1000, 200, 4, 4, 20, 3600, "admin", "all", 52428800)
    assert EngineConfig(isolation="documents").isolated and not EngineConfig(isolation="none").isolated


def test_bound_of_top_k_is_the_configured_one(spark):
    from corpusq.config import EngineConfig
    asked = spark.createDataFrame([(15, "u"), (45, "u"), (51, "u"), (None, "u"), (3, "no/body"), (3, None), (3, "")],
                                  "top_k int, user_id string").withColumn("question", F.lit("why"))
    codes = lambda n: [r.error_code for r in validate.check_queries(asked, EngineConfig(max_top_k=n)).collect()]
    assert codes(10) == [422, 422, 422, None, 422, None, None]
    assert codes(50) == [None, None, 422, None, 422, None, None]

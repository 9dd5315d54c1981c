"""Registry reads and table changes on the two-owner fixture."""

import pytest
from pyspark.sql import functions as F

from corpusq.operators import classify, mutations, registry as reg
from corpusq.schemas import REGISTRY

def at():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    docs = [("d1", "a.pdf", "admin"), ("d2", "b.pdf", "admin"), ("d3", "c.txt", "jason"), ("d4", "d.md", "jason")]
    registry = spark.createDataFrame(docs, "doc_id string, filename string, user_id string").select(
        "doc_id", "filename", F.lit(".pdf").alias("file_type"), F.lit(5).alias("chunk_count"), "user_id",
        F.lit(None).cast("string").alias("file_hash"), at().alias("uploaded_at")).to(REGISTRY)
    members = spark.createDataFrame([("d1", "legal"), ("d1", "contracts"), ("d2", "legal"), ("d3", "legal"),
                                     ("d3", "medical")], "doc_id string, collection string")
    users = spark.createDataFrame([("admin", "Admin"), ("jason", "Jason")], "user_id string, display_name string"
                                  ).withColumn("created_at", at())
    return registry, members, users


def test_list_all(tables, rows):
    registry, members, _ = tables
    got = {r.doc_id: r.collections for r in reg.list_documents(registry, members).collect()}
    assert got == {"d1": ["contracts", "legal"], "d2": ["legal"], "d3": ["legal", "medical"], "d4": []}
    assert [r.doc_id for r in reg.list_documents(registry, members, "jason").orderBy("doc_id").collect()] == ["d3", "d4"]
    assert reg.list_documents(registry, members, "jason", isolated=False).count() == 4


def test_by_collection(tables):
    registry, members, _ = tables
    got = {r.doc_id: r.collections for r in reg.list_by_collection(registry, members, "legal").collect()}
    assert got == {"d1": ["contracts", "legal"], "d2": ["legal"], "d3": ["legal", "medical"]}
    assert [r.doc_id for r in reg.list_by_collection(registry, members, "legal", "jason").collect()] == ["d3"]
    assert reg.list_by_collection(registry, members, "none").count() == 0


def test_collection_names(tables):
    registry, members, _ = tables
    names = lambda df: [r.collection for r in df.collect()]
    assert names(reg.list_collections(registry, members)) == ["contracts", "legal", "medical"]
    assert names(reg.list_collections(registry, members, "jason")) == ["legal", "medical"]
    assert len(names(reg.known_collections(members, with_taxonomy=True))) == 14


def test_counts(tables, rows):
    registry, members, users = tables
    assert rows(reg.document_count(registry)) == [(4,)]
    assert rows(reg.collection_facets(members)) == [("contracts", 1), ("legal", 3), ("medical", 1)]
    asked = registry.select(F.concat("user_id", F.lit("x")).alias("user_id")).union(registry.select("user_id"))
    assert rows(reg.user_exists(asked, users)) == [("admin", True), ("adminx", False), ("jason", True), ("jasonx", False)]


def test_add_documents(spark, tables, rows):
    registry, members, _ = tables
    new = registry.where("doc_id = 'd1'").withColumn("filename", F.lit("twice.pdf")).union(
        registry.where("doc_id = 'd2'").withColumn("doc_id", F.lit("d9")))
    new = new.withColumn("collections", F.when(F.col("doc_id") == "d9", F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    r2, m2 = mutations.add_documents(registry, members, new)
    assert r2.count() == 5 and r2.where("filename = 'twice.pdf'").count() == 0
    assert rows(m2.where("doc_id = 'd9'")) == [("d9", "a"), ("d9", "b")]
    empty = new.where("doc_id = 'd9'").withColumn("doc_id", F.lit("d8")).withColumn(
        "collections", F.array().cast("array<string>"))
    assert rows(mutations.add_documents(registry, members, empty)[1].where("doc_id = 'd8'")) == [("d8", "other")]


def test_targets_respect_owner(spark, tables, rows):
    registry, _, _ = tables
    asked = spark.createDataFrame([("d1", "admin"), ("d3", "admin"), ("zz", "admin")], "doc_id string, user_id string")
    got = {r.doc_id: r.error_code for r in mutations.check_targets(asked, registry).collect()}
    assert got == {"d1": None, "d3": 404, "zz": 404}
    got = {r.doc_id: r.error_code for r in mutations.check_targets(asked, registry, isolated=False).collect()}
    assert got == {"d1": None, "d3": None, "zz": 404}


def test_delete_cascades(spark, tables, rows):
    registry, members, _ = tables
    gone = spark.createDataFrame([("d1",), ("nope",)], "doc_id string")
    r2, m2 = mutations.delete_documents(gone, registry, members)
    assert rows(r2, "doc_id") == [("d2",), ("d3",), ("d4",)] and m2.where("doc_id = 'd1'").count() == 0


def test_replace_collections(spark, tables, rows):
    registry, members, _ = tables
    updates = spark.createDataFrame([("d1", ["new", "new"]), ("zz", ["x"])], "doc_id string, collections array<string>")
    assert rows(mutations.replace_collections(members, registry, updates)) == [
        ("d1", "new"), ("d2", "legal"), ("d3", "legal"), ("d3", "medical")]


def test_merge_metadata(spark):
    chunks = spark.createDataFrame([("c1", "d1", {"a": "1", "b": "2"}), ("c2", "d2", None), ("c3", "d3", {"a": "0"})],
                                   "chunk_id string, doc_id string, extra map<string,string>")
    updates = spark.createDataFrame([("d1", {"b": "9", "c": "3"}), ("d2", {"z": "1"})],
                                    "doc_id string, updates map<string,string>")
    got = {r.chunk_id: r.extra for r in mutations.merge_metadata(chunks, updates).collect()}
    assert got == {"c1": {"a": "1", "b": "9", "c": "3"}, "c2": {"z": "1"}, "c3": {"a": "0"}}


def test_users(spark, tables, rows):
    _, _, users = tables
    seen = spark.createDataFrame([("jason",), ("nEW-one",), ("nEW-one",), (None,)], "user_id string")
    assert rows(mutations.ensure_users(users, seen, at()), "user_id", "display_name") == [
        ("admin", "Admin"), ("jason", "Jason"), ("nEW-one", "New-one")]
    asked = spark.createDataFrame([("jason",), ("x",)], "user_id string")
    assert rows(mutations.create_users(users, asked)) == [("jason", 409), ("x", None)]


def test_delete_user(spark, tables, rows):
    registry, members, users = tables
    sessions = spark.createDataFrame([("s1", "admin"), ("s2", "jason"), ("s3", None)], "session_id string, user_id string")
    chunks = registry.select(F.concat("doc_id", F.lit("_0")).alias("chunk_id"), "doc_id")
    out = mutations.delete_users(users.where("user_id = 'admin'"), users, registry, members, chunks, sessions)
    assert rows(out["users"], "user_id") == [("jason",)]
    assert rows(out["registry"], "doc_id") == [("d3",), ("d4",)]
    assert rows(out["chunks"], "doc_id") == [("d3",), ("d4",)]
    assert rows(out["chat_sessions"]) == [("s1", None), ("s2", "jason"), ("s3", None)]


def test_reclassify(spark, tables, rows):
    registry, members, _ = tables
    chunks = spark.createDataFrame(
        [("d1_1", "d1", 1, "tax return", {"k": "v"}), ("d1_0", "d1", 0, "vat notice tax", {}), ("d3_0", "d3", 0, "?", {})],
        "chunk_id string, doc_id string, chunk_index int, content string, extra map<string,string>")
    asked = spark.createDataFrame([("d1", "admin"), ("d2", "admin"), ("d3", "admin"), ("zz", "admin")],
                                  "doc_id string, user_id string")
    out = classify.reclassify(asked, registry, members, chunks)
    assert rows(out["errors"]) == [("d2", 404), ("d3", 404), ("zz", 404)]
    assert {r.collection for r in out["document_collections"].where("doc_id = 'd1'").collect()} >= {"finance-accounting", "tax"}
    extra = out["chunks"].where("chunk_id = 'd1_1'").first().extra
    assert extra["k"] == "v" and extra["collections_csv"].startswith("finance-accounting|tax")
    replies = spark.createDataFrame([("d1", '["My Label"]')], "doc_id string, reply string")
    again = classify.reclassify(asked, registry, members, chunks, replies)
    assert rows(again["document_collections"].where("doc_id = 'd1'")) == [("d1", "my-label")]


def test_orphans(spark, tables, rows):
    registry, members, users = tables
    bad = members.union(spark.createDataFrame([("zz", "x"), ("zz", "y")], members.schema))
    got = rows(reg.orphan_check(users.where("user_id = 'admin'"), registry, bad))
    assert got == [("document_collections.doc_id", "zz", 2), ("registry.user_id", "jason", 2)]

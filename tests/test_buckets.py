"""Copy on write by bucket."""

import pytest
from pyspark.sql import functions as F

from corpusq.operators import mutations
from corpusq.sources import buckets
from corpusq.schemas import DOCUMENT_COLLECTIONS, REGISTRY


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(
        [(f"d{i}", f"f{i}.txt", ".txt", i % 5, f"u{i % 3}", f"h{i}", None) for i in range(400)], REGISTRY)


def content(df):
    return sorted(map(repr, df.collect()))


def test_a_small_change_rewrites_its_buckets_only(spark, tmp_path, registry):
    table = buckets.create(registry, str(tmp_path / "r"), buckets=32)
    assert content(table.rows()) == content(registry)
    three = registry.where("doc_id in ('d1', 'd2', 'd399')").withColumn("filename", F.lit("new"))
    after = table.upsert(three)
    moved = {b for b in after.folders if after.folders[b] != table.folders[b]}
    assert 1 <= len(moved) <= 3 and moved == set(table.buckets_of(three))
    assert content(after.rows()) == content(registry.withColumn("filename", F.when(
        F.col("doc_id").isin("d1", "d2", "d399"), "new").otherwise(F.col("filename"))))
    # readers of the old version, held or reopened, see what they saw
    assert content(table.rows()) == content(registry)
    assert content(buckets.load(spark, table.root, 0).rows()) == content(registry)
    assert buckets.load(spark, table.root).version == 1


def test_changes_equal_those_of_whole_tables(spark, tmp_path, registry):
    members = registry.select("doc_id", F.explode(F.array(F.lit("a"), "user_id")).alias("collection"))
    members = spark.createDataFrame(members.collect(), DOCUMENT_COLLECTIONS)
    held = buckets.create(members, str(tmp_path / "c"), buckets=16)
    updates = spark.createDataFrame([("d7", ["x", "x", "y"]), ("d8", []), ("unknown", ["z"])],
                                    "doc_id string, collections array<string>")
    now = buckets.replace_collections(held, registry, updates)
    assert content(now.rows()) == content(mutations.replace_collections(members, registry, updates))
    gone = spark.createDataFrame([("d3",), ("d4",), ("nobody",)], "doc_id string")
    assert content(now.delete(gone).rows()) == content(now.rows().where("doc_id not in ('d3', 'd4')"))
    chunks = registry.select(F.concat("doc_id", F.lit("_0")).alias("chunk_id"), "doc_id",
                             F.create_map(F.lit("source"), F.col("user_id")).alias("extra"))
    stored = buckets.create(chunks, str(tmp_path / "k"), buckets=16)
    merged = spark.createDataFrame([("d9", {"lang": "en"})], "doc_id string, updates map<string,string>")
    rows = lambda df: sorted((r.chunk_id, sorted(r.extra.items())) for r in df.collect())
    assert rows(buckets.merge_metadata(stored, merged).rows()) == rows(mutations.merge_metadata(chunks, merged))
    stored = buckets.create(chunks, str(tmp_path / "k2"), buckets=16)
    again = stored.insert_if_absent(chunks.where("doc_id < 'd2'"), "chunk_id")
    assert rows(again.rows()) == rows(chunks)


def test_odd_cases(spark, tmp_path, registry):
    table = buckets.create(registry.limit(0), str(tmp_path / "e"), buckets=8)
    assert table.rows().count() == 0 and buckets.load(spark, table.root).rows().count() == 0
    assert table.upsert(registry.limit(0)) is table
    full = table.upsert(registry)
    assert content(full.rows()) == content(registry)
    assert full.delete(registry.select("doc_id")).rows().count() == 0
    with pytest.raises(Exception, match="without doc_id"):
        full.upsert(registry.limit(1).withColumn("doc_id", F.lit(None).cast("string")).union(registry.limit(1)))
    with pytest.raises(Exception, match="(?i)exists"):
        table.upsert(registry)                    # version 1 is there already
    with pytest.raises(FileNotFoundError):
        buckets.load(spark, str(tmp_path / "nowhere"))


def test_old_folders_go(spark, tmp_path, registry):
    table = buckets.create(registry, str(tmp_path / "r"), buckets=8)
    for name in ("x", "y", "z"):
        table = table.upsert(registry.where("doc_id = 'd5'").withColumn("filename", F.lit(name)))
    assert buckets.drop_old_folders(table, keep_versions=1) == 3
    assert buckets.load(spark, table.root).rows().where("doc_id = 'd5'").first().filename == "z"
    assert buckets.load(spark, table.root).rows().count() == 400
    with pytest.raises(FileNotFoundError):
        buckets.load(spark, table.root, 0)


def test_a_bucketed_registry_is_joined_where_it_lies(spark, registry):
    """Nothing above the scan of the registry is shuffled; the batch alone moves."""
    from corpusq.operators.dedup import duplicate_probe
    from corpusq.sources.tables import save_bucketed
    spark.sql("DROP TABLE IF EXISTS probed_registry")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")               # as for a registry and batch of any size
    try:
        stored = save_bucketed(registry, "probed_registry", ["user_id", "file_hash"], 4)
        asked = registry.where("chunk_count = 2").select("doc_id", "user_id", "file_hash")
        found = duplicate_probe(asked, stored)
        assert content(found.select("doc_id", "existing_filename")) == content(
            registry.where("chunk_count = 2").select("doc_id", F.col("filename").alias("existing_filename")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        above = plan.split("Bucketed: true")[0].splitlines()
        depth = above[-1].index("FileScan")
        path = []
        for line in reversed(above[:-1]):         # the scan's ancestors, by indentation
            at = len(line) - len(line.lstrip(" :+-*"))
            if at < depth:
                path.append(line)
                depth = at
        assert path and not any("Exchange" in line for line in path)
    finally:
        spark.conf.set(threshold, before)
        spark.sql("DROP TABLE IF EXISTS probed_registry")

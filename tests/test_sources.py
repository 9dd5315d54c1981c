"""Files, versions, index, legacy import, ingestion of a folder."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusq.functions.embed import embed_column
from corpusq.plans.ingest import ingest, uploads_from_files
from corpusq.schemas import REGISTRY
from corpusq.sources import files, tables
from corpusq.streaming import streams

def stamp():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "landing"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("Hello é\n\nworld " * 200, encoding="utf-8")
    (root / "sub" / "b.MD").write_text("# Title\n\nsome *text*")
    (root / "c.html").write_text("<p>One</p><script>no()</script><p>Two</p>")
    (root / "copy.txt").write_text("Hello é\n\nworld " * 200, encoding="utf-8")
    (root / "photo.jpg").write_bytes(b"\x00\x01")
    (root / "d.pdf").write_bytes(b"page one\x0cpage two")
    return root


def test_scan(spark, landing, rows):
    got = rows(files.scan_files(spark, str(landing)), "filename", "file_type")
    assert got == [("a.txt", ".txt"), ("b.MD", ".md"), ("c.html", ".html"), ("copy.txt", ".txt"), ("d.pdf", ".pdf")]
    assert files.scan_files(spark, str(landing), keep_unsupported=True).count() == 6
    text = files.load_text(spark, str(landing / "a.txt")).first()
    assert text.filename == "a.txt" and text.content.startswith("Hello é\n\nworld")


def test_landed_files(spark, tmp_path, rows):
    """One file for each row, in few folders, odd names of the folder and repeated names included."""
    n = 2 * files.FOLDER_FILES + 5
    df = spark.range(n, numPartitions=1).selectExpr(
        "concat(if(id = 7, 6, id), '.txt') AS name", "if(id = 3, NULL, cast(concat('é', id) AS binary)) AS content")
    for folder in (str(tmp_path / "a b%20"), f"file://{tmp_path}/c"):
        found = files.land_files(df, folder)
        assert len(found) == 3
        got = rows(files.scan_files(spark, found), "filename", "content")
        assert len(got) == n - 1                          # Spark's readers pass over empty files
        assert [bytes(c).decode() for f, c in got if f == "6.txt"] == ["é6", "é7"]
        assert files.load_text(spark, found).where("content LIKE 'é%'").count() == n - 1
        none = files.land_files(df.limit(0), f"{folder}-none")
        assert files.scan_files(spark, none).count() == files.load_text(spark, none).count() == 0


@pytest.mark.parametrize("name", ["s1_scan_files", "s2_load_text"])
def test_documents_as_files(spark, tmp_path, rows, monkeypatch, name):
    """Repeated, null and negative ids keep a file each; there is no folder for each document."""
    from corpusq.checks import hooks
    from corpusq.checks.base import QUERIES
    data = [(i, f"text {i}\nmore\n") for i in [*range(300), 5, 5, -4, None, None]]
    spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    monkeypatch.setattr(hooks, "_folder", lambda t: str(tmp_path / "landed"))
    got = rows(QUERIES[name](spark, str(tmp_path / "t")), "doc_id", "n_bytes" if name == "s1_scan_files" else "hash")
    assert got == sorted([(None if i is None else str(i), len(t) + 1 if name == "s1_scan_files" else
                           hashlib.sha256(f"{t}\n".encode()).hexdigest()) for i, t in data], key=repr)
    assert len([p for p in (tmp_path / "landed").rglob("*") if p.is_dir()]) < 30


def test_files_are_listed_by_tasks(spark, tmp_path, rows):
    """The driver holds no list of files; folders in folders, hidden, empty, packed and single
    files and patterns are taken as Spark's own sources take them."""
    import gzip
    deep = tmp_path / "x y%20" / "_k=1" / "sub"
    (tmp_path / "_hidden").mkdir()
    deep.mkdir(parents=True)
    for place in (tmp_path / "a.txt", tmp_path / ".b.txt", tmp_path / "_hidden" / "c.txt", deep / "d é.txt", deep / "_e.txt"):
        place.write_text(place.name)
    (deep / "empty.txt").write_text("")
    (deep / "z.gz").write_bytes(gzip.compress(b"packed"))
    for path in (f"file://{tmp_path}", [f"{tmp_path}/a.txt", f"{tmp_path}/x*"]):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        got = files.scan_files(spark, path, keep_unsupported=True)
        assert rows(got, "path", "n_bytes", "modified_at", "content") == rows(
            own, "path", "length", "modificationTime", "content") and got.count() == 3
        text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        assert rows(files.load_text(spark, path), "content") == rows(text, "value")
        listed = files.scan_files(spark, path, content=False)
        assert "content" not in listed.columns and rows(listed, "filename") == [("a.txt",), ("d é.txt",)]
        for df in (got, listed, files.load_text(spark, path)):
            assert not any("a.txt" in f or "z.gz" in f for f in df.inputFiles())
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.scan_files(spark, str(tmp_path / "none"))


def test_extract(spark, landing):
    scanned = files.scan_files(spark, str(landing))
    plain = {r.filename: r.pages for r in files.extract_text(scanned).collect()}
    assert plain["c.html"] == ["One\n\nTwo"] and plain["b.MD"] == ["Title\n\nsome text"] and plain["d.pdf"] is None
    own = files.extract_text(scanned, {".pdf": lambda b: b.decode().split("\x0c")})
    assert {r.filename: r.pages for r in own.collect()}["d.pdf"] == ["page one", "page two"]


def ingest_folder(spark, landing, **kw):
    found = files.extract_text(files.scan_files(spark, str(landing), keep_unsupported=True),
                               {".pdf": lambda b: b.decode().split("\x0c")})
    found = found.withColumn("collections_raw", F.when(F.col("filename") == "c.html", F.lit("x, y,x")))
    return ingest(uploads_from_files(found, "ann"), spark.createDataFrame([], REGISTRY), **kw)


@pytest.mark.parametrize("materialise", [False, True])
def test_ingest_folder(spark, landing, rows, materialise):
    out = ingest_folder(spark, landing, materialise=materialise)
    docs = {r.filename: r for r in out["registry"].collect()}
    assert len(docs) == 4 and ("a.txt" in docs) != ("copy.txt" in docs)
    digest = hashlib.sha256(("Hello é\n\nworld " * 200).encode()).hexdigest()
    assert digest in {r.file_hash for r in docs.values()}
    rejects = {r.filename: (r.error_code, r.existing_filename) for r in out["rejects"].collect()}
    assert rejects["photo.jpg"] == (400, None) and {v[0] for v in rejects.values()} == {400, 409}
    chunks = out["chunks"].orderBy("doc_id", "chunk_index").collect()
    by_doc = {}
    for c in chunks:
        assert c.chunk_id == f"{c.doc_id}_chunk_{c.chunk_index}" and len(c.content) <= 1000
        by_doc.setdefault(c.doc_id, []).append(c)
    for d in docs.values():
        assert d.chunk_count == len(by_doc[d.doc_id])
    pdf = by_doc[docs["d.pdf"].doc_id]
    assert [(c.page, c.content) for c in pdf] == [(0, "page one"), (1, "page two")]
    assert by_doc[docs["c.html"].doc_id][0].page is None
    assert by_doc[docs["c.html"].doc_id][0].extra == {"collections_csv": "x|y"}
    assert rows(out["document_collections"].where(F.col("doc_id") == docs["c.html"].doc_id), "collection") == [("x",), ("y",)]


def test_ingest_repeats_itself(spark, landing, rows):
    a, b = ingest_folder(spark, landing), ingest_folder(spark, landing)
    assert rows(a["chunks"], "chunk_id", "content") == rows(b["chunks"], "chunk_id", "content")


def test_every_upload_is_accounted_for(spark):
    """Ids cut so short that they collide, copies, and uploads nobody could read."""
    data = [(str(i), f"f{i}.txt", None if i % 10 == 9 else [f"text {i % 30}"], f"h{i % 30}") for i in range(60)]
    up = spark.createDataFrame(data, "upload_id string, filename string, pages array<string>, content_hash string").select(
        "*", F.lit("u").alias("user_id"), F.lit(False).alias("paged"), F.lit(1).alias("n_bytes"),
        F.lit(None).cast("string").alias("collections_raw"), F.lit(False).alias("auto_suggest"), stamp().alias("uploaded_at"))
    for length in (1, 32):
        out = ingest(up, spark.createDataFrame([], REGISTRY), id_length=length)
        registry, rejects = out["registry"].collect(), out["rejects"].collect()
        assert len(registry) + len(rejects) == 60
        assert len({r.doc_id for r in registry}) == len(registry)
        codes = [r.error_code for r in rejects]
        assert codes.count(400) == 6 and codes.count(409) == len(rejects) - 6
        assert len(registry) == (27 if length == 32 else len({r.doc_id for r in registry}))


def test_auto_suggest(spark):
    up = spark.createDataFrame(
        [("1", "t.txt", ["the tax return, vat and tax notice"], None, True), ("2", "m.txt", ["tax return"], "mine", True),
         ("3", "n.txt", ["tax"], None, False)], "upload_id string, filename string, pages array<string>, "
        "collections_raw string, auto_suggest boolean").select(
        "*", F.lit("u").alias("user_id"), F.lit(False).alias("paged"), F.lit(1).alias("n_bytes"),
        F.col("upload_id").alias("content_hash"), stamp().alias("uploaded_at"))
    got = {r.filename: r for r in ingest(up, spark.createDataFrame([], REGISTRY))["responses"].collect()}
    assert got["t.txt"].collections[:2] == ["finance-accounting", "tax"]
    assert got["t.txt"].message.endswith("AI suggested: " + ", ".join(got["t.txt"].collections))
    assert got["m.txt"].collections == ["mine"] and got["m.txt"].suggested_collections is None
    assert got["n.txt"].collections == ["other"] and "suggested" not in got["n.txt"].message


def test_payload(spark, tmp_path, rows):
    for name in ("0123456789ab_x.txt", "0123456789ac_y.txt", "ffffffffffff_z.txt"):
        (tmp_path / name).write_text(name)
    registry = spark.createDataFrame([("0123456789ab", "x.txt", "ann"), ("0123456789ac", "y.txt", "bob"),
                                      ("000000000000", "lost.txt", "ann")], "doc_id string, filename string, user_id string")
    asked = spark.createDataFrame([(d, "ann") for d in ("0123456789ab", "0123456789ac", "000000000000", "nope")],
                                  "doc_id string, user_id string")
    stored = files.scan_files(spark, str(tmp_path))
    got = {r.doc_id: (r.filename, r.content and bytes(r.content).decode(), r.error_code)
           for r in files.attach_payload(stored, registry, asked).collect()}
    assert got == {"0123456789ab": ("x.txt", "0123456789ab_x.txt", None), "0123456789ac": (None, None, 404),
                   "000000000000": ("lost.txt", None, 404), "nope": (None, None, 404)}


def test_versions(spark, tmp_path, rows):
    root = str(tmp_path / "store")
    assert tables.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        tables.load_version(spark, root, ["users"])
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    tables.save_version({"t": one}, root, 1)
    tables.save_version({"t": tables.load_version(spark, root, ["t"])["t"].withColumn("v", F.col("v") + 1)}, root, 2)
    (tmp_path / "store" / "version=00000003").mkdir()          # an unfinished write
    assert rows(tables.load_version(spark, root, ["t"])["t"]) == [("a", 2)]


def test_table_io(spark, tmp_path, rows):
    reg = spark.createDataFrame([("d", "f.txt", ".txt", 1, "u", None)], "doc_id string, filename string, "
                                "file_type string, chunk_count int, user_id string, file_hash string").withColumn("uploaded_at", stamp())
    for fmt in ("parquet", "orc", "json"):
        tables.write_table(reg, "registry", str(tmp_path / fmt), fmt)
        assert rows(tables.read_table(spark, "registry", str(tmp_path / fmt), fmt)) == rows(reg)


def test_index(spark, tmp_path, rows):
    chunks = spark.createDataFrame([(f"d{i % 7}_chunk_{i}", f"d{i % 7}", "x") for i in range(70)],
                                   "chunk_id string, doc_id string, content string")
    posts = spark.createDataFrame([("t1", "c1", 2), ("t2", "c1", 1)], "term string, chunk_id string, tf int")
    tables.save_index({"chunks": chunks, "postings": posts}, str(tmp_path / "ix"), buckets=4)
    assert rows(tables.load_index(spark, str(tmp_path / "ix"), "chunks")) == rows(chunks)
    some = tables.load_index(spark, str(tmp_path / "ix"), "chunks", ["d1", "d2"], buckets=4)
    assert rows(some) == rows(chunks.where("doc_id IN ('d1', 'd2')"))
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().toString() or "bucket" in some._jdf.queryExecution().toString()
    assert rows(tables.load_index(spark, str(tmp_path / "ix"), "postings", ["t2"], buckets=4)) == [("t2", "c1", 1)]


def test_legacy_import(spark, tmp_path, rows):
    (tmp_path / "u.json").write_text(json.dumps({"users": {"ann": {"display_name": "Ann A."}, "jOE": {}, "old": {"display_name": "New"}}}, indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"documents": {
        "a1": {"filename": "a.txt", "file_type": ".txt", "chunk_count": 3, "collections": ["x", "y", "x"], "user_id": "ann", "file_hash": "h"},
        "b1": {"filename": "b.pdf", "collection": "single"}, "c1": {"collections": [], "user_id": "zed"}, "have": {"filename": "new"}}}, indent=1))
    users = spark.createDataFrame([("old", "Old")], "user_id string, display_name string").withColumn("created_at", stamp())
    registry = spark.createDataFrame([("have", "h.txt", ".txt", 1, "old", None)], "doc_id string, filename string, file_type string, "
                                     "chunk_count int, user_id string, file_hash string").withColumn("uploaded_at", stamp())
    members = spark.createDataFrame([("have", "k")], "doc_id string, collection string")
    out = tables.import_legacy_registry(spark, str(tmp_path / "u.json"), str(tmp_path / "d.json"), users, registry, members, stamp())
    assert rows(out["users"], "user_id", "display_name") == [("admin", "Admin"), ("ann", "Ann A."), ("jOE", "Joe"), ("old", "Old"), ("zed", "Zed")]
    assert rows(out["registry"], "doc_id", "filename", "file_type", "chunk_count", "user_id") == [
        ("a1", "a.txt", ".txt", 3, "ann"), ("b1", "b.pdf", ".pdf", 0, "admin"), ("c1", "unknown", ".pdf", 0, "zed"), ("have", "h.txt", ".txt", 1, "old")]
    assert rows(out["document_collections"]) == [("a1", "x"), ("a1", "y"), ("b1", "single"), ("c1", "other"), ("have", "k")]
    bare = tables.import_legacy_registry(spark, None, None, users, registry, members, stamp())
    assert rows(bare["users"], "user_id") == [("admin",), ("old",)]


def test_embedding(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", "x y z"), ("c", ""), ("d", None), ("e", "other words")], "k string, t string")
    got = {r.k: r.embedding for r in embed_column(df, "t", dims=64).collect()}
    assert got["a"] == got["b"] != got["e"]
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and not any(got["c"]) and not any(got["d"])


def test_embedding_hook(spark):
    def model(batches):
        for s in batches:
            yield s.map(lambda t: [float(len(t)), 1.0])
    from typing import Iterator
    import pandas as pd
    model.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    df = spark.createDataFrame([("abc",)], "t string")
    assert embed_column(df, "t", model=model).first().embedding == [3.0, 1.0]


# --- streams ------------------------------------------------------------------------------

def test_ingest_stream(spark, landing, tmp_path, rows):
    root, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        streams.ingest_stream(spark, str(landing), root, ck, user_id="ann", files_per_trigger=2, available_now=True).awaitTermination()
        return spark.read.parquet(f"{root}/registry")

    first = run()
    assert {r.filename for r in first.collect()} >= {"b.MD", "c.html"} and first.count() == 3   # .pdf has no parser: rejected
    (landing / "again.txt").write_text("Hello é\n\nworld " * 200, encoding="utf-8")
    (landing / "fresh.txt").write_text("brand new")
    after = run()
    assert after.count() == 4 and after.where("filename = 'fresh.txt'").count() == 1
    codes = {(r.filename, r.error_code) for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert ("again.txt", 409) in codes and ("photo.jpg", 400) in codes
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == after.agg(F.sum("chunk_count")).first()[0]


def write_parts(df, folder, parts):
    for i in range(parts):
        df.where(f"part = {i}").drop("part").coalesce(1).write.parquet(f"{folder}/p{i}")


def test_dedup_stream(spark, tmp_path, rows):
    data = [(f"d{i}", f"u{i % 2}", "hot" if i % 3 == 0 else f"h{i % 17}", i, i * 4 // 300) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id string, user_id string, file_hash string, s int, part int").withColumn(
        "uploaded_at", F.timestamp_seconds("s")).drop("s")
    write_parts(df, str(tmp_path / "in"), 4)
    source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = (streams.dedup_stream(source, "1 hour").writeStream.format("parquet").outputMode("append")
         .option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o")), "user_id", "file_hash") == rows(df.select("user_id", "file_hash").distinct())


def test_chat_memory_stream(spark, tmp_path):
    from corpusq.operators.chat import final_memory
    data = [("hot" if i % 3 else f"s{i % 5}", i * 7 % 40 + (i // 40) * 50, i, i // 40) for i in range(160)]
    df = spark.createDataFrame(data, "session_id string, s int, id long, part int").select(
        "session_id", F.timestamp_seconds("s").alias("ts"), "id", F.concat(F.lit("m"), "id").alias("content"), "part")
    write_parts(df, str(tmp_path / "in"), 4)
    source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = {}

    def keep(batch, epoch):
        for r in batch.collect():
            seen[r.session_id] = [] if r.expired else r.ids

    streams.chat_memory_stream(source, 6, 30).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = {r.session_id: [m.id for m in r.memory] for r in final_memory(df, ["content"], 6, 30).collect()}
    assert {s: v for s, v in seen.items() if v} == {s: want[s] for s in seen if seen[s]} and seen["hot"]


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    """The registered streams give the same for a table that is a folder of files."""
    import shutil

    from corpusq.checks import chatting  # noqa: F401 (register)
    from corpusq.checks.base import QUERIES
    given = "/root/testdata/sf0.001"
    shutil.copytree(given, tmp_path / "t")
    for name in ("documents", "events"):
        (tmp_path / "t" / f"{name}.parquet").unlink()
        spark.read.parquet(f"{given}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / "t" / f"{name}.parquet"))
    for name in ("x1_ingest_stream", "x2_dedup_stream", "x3_chat_memory_stream"):
        one, many = (sorted(map(tuple, QUERIES[name](spark, str(f)).collect())) for f in (given, tmp_path / "t"))
        assert one and one == many, name

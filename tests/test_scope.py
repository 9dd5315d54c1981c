"""Every line of the scope table, both isolation levels."""

import pytest

from corpusq.config import EngineConfig
from corpusq.operators.scope import resolve_scope, scope_sizes

DOCS = {"d1": ("ann", ["x"]), "d2": ("ann", ["x", "y"]), "d3": ("bob", ["x"]), "d4": ("bob", [])}
QUERIES = [
    ("ids+coll", "ann", "x", ["d1", "d3", "zz"]), ("coll", "ann", "x", None), ("ids", "ann", None, ["d2", "d3"]),
    ("owner", "ann", None, None), ("nodocs", "eve", None, None), ("empty-ids", "bob", None, []),
    ("empty-coll", "bob", "", None), ("no-match", "ann", "zzz", None), ("foreign", "eve", "x", ["d1"]),
    ("anon", None, None, None),
]


def allowed(user, coll, ids, isolated):
    docs = set(DOCS) | (set(ids or []) if not isolated and not coll else set())
    if isolated:
        docs = {d for d in docs if DOCS[d][0] == (user or "admin")}
    if coll:
        docs = {d for d in docs if coll in DOCS[d][1]}
    if ids:
        docs &= set(ids)
    return docs


@pytest.mark.parametrize("isolation", ["all", "documents", "none"])
def test_scope_table(spark, isolation):
    registry = spark.createDataFrame([(d, u) for d, (u, _) in DOCS.items()], "doc_id string, user_id string")
    members = spark.createDataFrame([(d, c) for d, (_, cs) in DOCS.items() for c in cs], "doc_id string, collection string")
    queries = spark.createDataFrame(QUERIES, "query_id string, user_id string, collection string, doc_ids array<string>")
    config = EngineConfig(isolation=isolation)
    s = resolve_scope(queries, registry, members, config)
    docs = {}
    for r in s.docs.collect():
        docs.setdefault(r.scope_id, []).append(r.doc_id)
    assert all(len(v) == len(set(v)) for v in docs.values())
    for r in s.queries.collect():
        free = not config.isolated and not r.collection and not r.doc_ids
        assert (r.scope_id is None) == free
        if not free:
            want = allowed(r.user_id, r.collection, r.doc_ids, config.isolated)
            assert set(docs.get(r.scope_id, [])) == want, r
    sizes = {r.query_id: r.visible_documents for r in scope_sizes(s).collect()}
    assert sizes["nodocs"] == (0 if config.isolated else -1)


def test_same_scope_is_shared(spark):
    queries = spark.createDataFrame([(str(i), "ann", None, None) for i in range(50)],
                                    "query_id string, user_id string, collection string, doc_ids array<string>")
    registry = spark.createDataFrame([(f"d{i}", "ann") for i in range(20)], "doc_id string, user_id string")
    members = spark.createDataFrame([], "doc_id string, collection string")
    assert resolve_scope(queries, registry, members).docs.count() == 20


def test_names_with_marks_have_scopes_of_their_own(spark):
    asked = [("1", "src1", "en|c:", None), ("2", "src1|c:en", None, None), ("3", "ann", None, ["a,b"]),
             ("4", "ann", None, ["a", "b"]), ("5", "ann", "null", None), ("6", "ann", None, None)]
    queries = spark.createDataFrame(asked, "query_id string, user_id string, collection string, doc_ids array<string>")
    registry = spark.createDataFrame([("d", "src1|c:en")], "doc_id string, user_id string")
    members = spark.createDataFrame([("d", "en|c:")], "doc_id string, collection string")
    s = resolve_scope(queries, registry, members)
    assert s.queries.select("scope_id").distinct().count() == len(asked)
    mine = s.queries.where("query_id = '2'").first().scope_id
    assert [tuple(r) for r in s.docs.collect()] == [(mine, "d")]

"""Literal fixtures for names, labels, snippets and markup."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions import taxonomy, text


def apply(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_suffix(spark):
    names = ["A.PDF", "a.tar.gz", "noext", ".hidden", "dir.x/file", "x.", "ü.TxT", ""]
    assert apply(spark, names, text.file_suffix) == [".pdf", ".gz", "", "", "", "", ".txt", ""]


def test_capitalize(spark):
    assert apply(spark, ["jASON-x y", "a", "éCOLE", ""], text.capitalize_name) == ["Jason-x y", "A", "École", ""]


def test_parse_collections(spark):
    got = apply(spark, [" a, b,,a ", "", " , ,", None, "x"], text.parse_collections)
    assert got == [["a", "b"], [], [], None, ["x"]]


def test_resolve_collections(spark):
    df = spark.createDataFrame(
        [(["m"], True, ["s"]), ([], True, ["s"]), (None, True, []), (None, False, ["s"]), (None, None, None)],
        "m array<string>, a boolean, s array<string>")
    got = [r[0] for r in df.select(text.resolve_collections(F.col("m"), F.col("a"), F.col("s"))).collect()]
    assert got == [["m"], ["s"], ["other"], ["other"], ["other"]]


def test_label_replies(spark):
    replies = ['["Legal Compliance", "x"]', '```json\n["a b"]\n```', '```\n["A\'b"]\n``` tail',
               '["unfinished', '{"a": 1}', '["", "  "]', f'["{"y" * 51}", "ok"]',
               "I think: HR personal.", "", None, "no idea", "both legal-compliance and hr-personal"]
    assert apply(spark, replies, text.parse_label_reply) == [
        ["legal-compliance", "x"], ["a-b"], ["ab"], ["other"], ["other"], ["other"], ["ok"],
        ["hr-personal"], ["other"], ["other"], ["other"], ["legal-compliance"]]


def plain_cut(s, limit):
    if len(s) <= limit:
        return s
    for mark in [". ", ".\n", "! ", "? "]:
        at = s[:limit].rfind(mark)
        if at > limit / 2:
            return s[:at + 1]
    at = s[:limit].rfind(" ")
    return s[:at] + "..." if at > limit / 2 else s[:limit] + "..."


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\né😀", max_size=60), min_size=40, max_size=60))
def test_truncate_like_plain_statement(spark, texts):
    assert apply(spark, texts, lambda c: text.smart_truncate(c, 20)) == [plain_cut(t, 20) for t in texts]


def test_truncate_cases(spark):
    cases = ["x" * 20, "a" * 9 + ". " + "b" * 20, "a" * 10 + ". " + "b" * 20, "a" * 11 + ". " + "b" * 20,
             "a" * 11 + ". bb! cc", "a" * 11 + "! " + "bb. " * 9, "z" * 40, "a" * 12 + " " + "b" * 20]
    assert apply(spark, cases, lambda c: text.smart_truncate(c, 20)) == [plain_cut(t, 20) for t in cases]


def test_ids(spark):
    a, b = (apply(spark, ["x"], lambda c: text.derived_doc_id(c, F.lit("y"))) for _ in range(2))
    assert a == b and len(a[0]) == 32
    r = spark.range(50).select(text.random_doc_id().alias("i")).collect()
    assert len({x.i for x in r}) == 50 and all(len(x.i) == 32 for x in r)
    assert apply(spark, ["/u/0123456789ab_a_b.txt", "/u/zz_a.txt", "/u/" + "0f" * 16 + "_x"], text.stored_doc_id) == [
        "0123456789ab", "", "0f" * 16]
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c")], "x string, y string")
    assert pairs.select(text.derived_doc_id(F.col("x"), F.col("y"))).distinct().count() == 4


def test_html(spark):
    page = ("<html><head><title>T &amp; x</title><style>a{}</style></head><body><!-- no --><script>var a='<p>';"
            "</script><h1>Head</h1><p>One <b>bold</b> &lt;tag&gt;</p></body></html>")
    assert apply(spark, [page], text.html_to_text) == ["Head\n\nOne bold <tag>"]
    assert apply(spark, [page], text.html_title) == ["T &amp; x"]


def test_markdown(spark):
    md = "# Title\n\n> quote **bold**\n\n- item [link](http://x)\n![pic](y)\n```py\ncode\n```\n\n---\nend *em*"
    assert apply(spark, [md], text.markdown_to_text) == [
        "Title\n\nquote bold\n\nitem link\npic\n\ncode\n\nend em"]


def test_size_and_message(spark):
    assert apply(spark, [0, 1048575, 1048576, 52428801], text.size_mb, "long") == [0, 0, 1, 50]
    assert apply(spark, [None, [], ["a", "b"]], text.upload_message, "array<string>") == [
        fv.UPLOAD_MESSAGE, fv.UPLOAD_MESSAGE, fv.UPLOAD_MESSAGE + ". AI suggested: a, b"]


def test_taxonomy(spark):
    t = taxonomy.taxonomy_table(spark)
    assert (t.count(), t.select("domain").distinct().count(), t.select("primary_name").distinct().count(),
            t.select("sub_domain").distinct().count()) == (159, 39, 11, 158)
    assert taxonomy.taxonomy_text().splitlines()[-1] == "- other: [unclassified]"


def test_suggest_labels(spark):
    docs = ["the tax return and a vat notice", "nothing here", "payslip payroll bonus, employment", None]
    got = apply(spark, docs, lambda c: taxonomy.suggest_labels(
        taxonomy.taxonomy_tokens(F.coalesce(c, F.lit("")))))
    assert got[0][:2] == ["finance-accounting", "tax"]
    assert got[1] == ["other"] and got[3] == ["other"]
    assert got[2][0] == "hr-personal" and set(got[2][1:]) == {"payroll", "employment"}

"""Secrets, personal data and licences."""

import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusq.llm import crf, licenses, pii, secrets
from corpusq.llm.spans import Layout, find_secrets


def plain_secrets(text):
    assign = re.compile(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def plain_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


@pytest.fixture(scope="module")
def strings():
    dice = random.Random(3)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", '"', "'", " ", "  ", ":", "=",
             "AKIA", "ABCDEFGHIJ1234", "deadbeef", "0123456789abcdef", "é", "日", "a.b@c.de", "@",
             "x@y", ".", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111",
             "4111111111111111", "-", "+1 (437) 555-0689", "+4", "(", "\n", "abcdefghijkl",
             "\x00", "00", "_", "+", "K", "ſ"]
    out = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 25))) for _ in range(6000)]
    return [*out, None, "", "1" * 50_000, "1." * 20_000, "a@" * 10_000, "+1" * 10_000]


def test_base_spans(strings):
    texts = pa.array(strings, pa.string())
    assert secrets._scan(texts, None, False).field("spans").to_pylist() == [
        plain_secrets(t or "") for t in strings]
    assert pii._scan(texts).field("spans").to_pylist() == [
        plain_personal(t or "") for t in strings]


# --- the field ---------------------------------------------------------------------------

def best_path(scores, moves):
    best, came = scores[0].astype(float), []
    for s in scores[1:]:
        steps = best[:, None] + moves
        came.append(steps.argmax(0))
        best = steps.max(0) + s
    path = [int(best.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return float(best.max()), path[::-1]


def test_viterbi_is_exact():
    dice = np.random.default_rng(1)
    for _ in range(60):
        sizes = dice.integers(1, 30, 5)
        row = np.repeat(np.arange(5), sizes)
        scores = dice.normal(0, 2, (len(row), 3)).astype(np.float32)
        scores[:, 0] += dice.choice([0, 6, 30], len(row))
        moves = dice.normal(0, 1, (3, 3)).astype(np.float32)
        tags = crf.Model(np.zeros((1, 3)), moves).decode(scores, row)
        for r in range(5):
            own, got = scores[row == r], tags[row == r]
            value = own[np.arange(len(got)), got].sum() + moves[got[:-1], got[1:]].sum()
            assert abs(value - best_path(own, moves)[0]) < 1e-3


def test_marginals():
    dice = np.random.default_rng(2)
    scores, moves = dice.normal(size=(1, 4, 3)), dice.normal(size=(3, 3))
    weight = {}
    for path in np.ndindex(3, 3, 3, 3):
        weight[path] = np.exp(sum(scores[0, t, p] for t, p in enumerate(path))
                              + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
    marginal, joint = crf.forward_backward(scores, moves)
    total = sum(weight.values())
    for t in range(4):
        for k in range(3):
            want = sum(w for p, w in weight.items() if p[t] == k) / total
            assert abs(marginal[0, t, k] - want) < 1e-9
    assert abs(joint[1, 2] - sum(
        w * sum(p[t] == 1 and p[t + 1] == 2 for t in range(3)) for p, w in weight.items())
        / total) < 1e-9


@pytest.fixture(scope="module")
def tagger():
    dice = random.Random(2)
    words = "the of and to in is that it was for value name when start".split()
    text = lambda n: " ".join(dice.choice(words) for _ in range(n))
    hexes = lambda: "".join(dice.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{text(30)} token = "{hexes()}" {text(30)}' for _ in range(80)]
    return secrets.train_tagger(texts + [text(60) for _ in range(300)])


def test_field_finds_held_out_and_adds_new_ones(tagger):
    upper = "".join(c.upper() for c in "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")
    texts = ['it was token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" when',
             f'start is that key = "{upper}" of and', "the of and to in is that it was for"]
    layout = Layout.of(pa.array(texts))
    found = [layout.raw[a:b].decode() for a, b in secrets._tagged(layout, tagger)]
    assert found == [upper.lower(), upper]
    assert not find_secrets(Layout.of(pa.array(texts[1:])))["assign"]
    spans = secrets._scan(pa.array(texts), tagger, True)
    assert spans.field("spans").to_pylist()[1] == f"crf:21:{21 + 40}"
    assert spans.field("redacted").to_pylist() == [
        'it was [SECRET]" when', 'start is that key = "[SECRET]" of and', None]


def test_secret_rows(odd, odd_rows, none, documents):
    assert secrets.scan_secrets(odd).count() == len(odd_rows)
    assert secrets.scan_secrets(none).count() == 0
    text = {r.doc_id: r.text for r in documents.collect()}
    got = secrets.scan_secrets(documents).collect()
    assert len(got) == len(text)
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("crf"))
        assert base == plain_secrets(text[r.doc_id])
        assert r.n_assign + r.n_access + r.n_hex == len(list(filter(None, base.split(","))))


# --- disclosure ------------------------------------------------------------------------------

def test_disclosing_terms(spark):
    """A name that only stands with one address discloses it; a common word does not."""
    rows = [(i, f"note {i} Zorbulax writes ann@example.org for the report") for i in range(5)]
    rows += [(10 + i, f"nothing for the report number {i} here") for i in range(40)]
    rows += [(60 + i, f"write bob{i}@example.org for the report") for i in range(20)]
    rows += [(90, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pii.find_private(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.spans for r in got}
    text = dict(rows)

    def words(i, kind):
        return {text[i][int(a):int(b)] for k, a, b in (s.split(":") for s in by_id[
            i].split(",") if s) if k == kind}

    assert "Zorbulax" in words(0, "removed") and "Zorbulax" in words(4, "removed")
    assert not words(0, "removed") & {"for", "the", "report"}
    assert by_id[90] == by_id[0] == by_id[None]
    assert all(by_id[10 + i] == "" for i in range(40))
    assert all(not words(60 + i, "removed") for i in range(20))


def test_disclosure_anywhere_in_a_text_and_without_the_entity(spark):
    """A heading far from the address discloses it; its name is marked wherever it stands."""
    filler = "plain words of the report follow " * 10
    rows = [(i, f"Zorbulax heads note {i} {filler} write ann@example.org") for i in range(20)]
    rows += [(50, f"later Zorbulax came, and {filler} zorbulax went")]
    rows += [(60 + i, f"nothing in {filler} number {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for held in (pii.HELD_TERMS, 0):
        pii.HELD_TERMS, kept = held, pii.HELD_TERMS
        by_id = {r.doc_id: r.spans for r in pii.find_private(df, generalise=0.9).collect()}
        pii.HELD_TERMS = kept
        last = len(rows[20][1])
        assert by_id[50] == f"removed:6:14,removed:{last - 13}:{last - 5}"
        assert "removed:0:8" in by_id[3].split(",") and by_id[3].startswith("email:")
        assert by_id[70] == ""


def test_disclosure_values(spark):
    rows = [(i, f"Zed a{i} x@y.zz") for i in range(4)] + [(9, "Zed alone"), (10, "else")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(
        "fp", pii.text_print(F.col("text")))
    found = docs.select("fp", pii.personal(F.col("text")).alias("r")).select("fp", "r.*")
    want = np.log(6 * 4 / (5 * 4)) / np.log(6 / 4)
    for held in (pii.HELD_TERMS, 0):      # counting by a filter in place, and by a shuffle
        pii.HELD_TERMS, kept = held, pii.HELD_TERMS
        got = pii.disclosing_terms(found, docs, 3).collect()
        pii.HELD_TERMS = kept
        assert len(got) == 1 and abs(got[0].disclosure - want) < 1e-9


def test_personal_rows(odd, odd_rows, none, documents):
    assert pii.find_private(odd).count() == len(odd_rows)
    assert pii.find_private(none).count() == 0
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.find_private(documents).collect():
        base = ",".join(s for s in r.spans.split(",") if s[:1] not in ("r", "g"))
        assert base == plain_personal(text[r.doc_id])


# --- licences --------------------------------------------------------------------------------

def test_every_template_has_evidence():
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            assert set(re.findall(licenses.WORD, t.lower())) & set(licenses.EVIDENCE), t


def test_families(spark, documents):
    filler = "hand there onan thing eronble shtion ner thouti " * 20
    rows = [(1, "Released under the MIT License."), (2, filler), (3, None), (4, ""),
            (5, filler + "licensed UNDER!! the Apache License,!! Version 2.0. " + filler),
            (6, "This work is licensed under CC BY-SA 4.0.\nReleased under the MIT license"),
            (7, "All rights reserved."), (8, "we asked for permission to enter the public park"),
            (None, "This work is licensed under the GNU General Public License, version 3."),
            (1, "Released under the MIT License.")]
    texts = documents.where("doc_id >= 20").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    df = spark.createDataFrame(rows, "doc_id bigint, text string").union(texts)
    got = [(r.doc_id, r.families, r.unknown) for r in licenses.scan_licenses(df).where(
        "doc_id < 100 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([
        (1, "MIT", False), (1, "MIT", False), (2, "", False), (3, "", False), (4, "", False),
        (5, "Apache-2.0", False), (6, "CC-BY-SA,MIT", False), (7, "", True), (8, "", False),
        (None, "GPL", False)], key=str)


def test_gate_holds_for_whatever_a_family_is_confirmed_by():
    """Fewer triples of a template than confirm it lack what the gate looks for."""
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            word = re.findall(licenses.PART, t.lower())
            triples = {" ".join(w) for w in zip(word, word[1:], word[2:], strict=False)}
            without = [w for w in triples if not re.search(licenses.GATE, w)]
            assert len(without) < licenses.LEAST_SHARED * len(triples), t
    for t in [t for ts in licenses.SHORT_FORMS.values() for t in ts] + licenses.OTHER_NOTICES:
        assert re.search(licenses.GATE, t.lower()), t


def test_short_forms(spark, documents):
    rows = [(1, "SPDX-License-Identifier: MIT"), (2, "# SPDX-License-Identifier: GPL-3.0-or-later"),
            (3, "This library is MIT-licensed."), (4, "See the licenses: GPL-3.0"),
            (5, "Distributed under Apache-2.0"), (6, "// SPDX-License-Identifier: LGPL-2.1-only"),
            (7, "SPDX-License-Identifier: CC-BY-SA-4.0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").union(documents.where(
        "doc_id >= 20").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    got = {r.doc_id: r.families for r in licenses.scan_licenses(df).where("doc_id < 100").collect()}
    assert got == {1: "MIT", 2: "GPL", 3: "MIT", 4: "GPL", 5: "Apache-2.0", 6: "LGPL",
                   7: "CC-BY-SA"}


def test_license_rows(odd, odd_rows, none, documents):
    assert licenses.scan_licenses(odd).count() == len(odd_rows)
    assert licenses.scan_licenses(none).count() == 0
    names = {"MIT": "mit license", "GPL": "gnu general public license",
             "Apache-2.0": "apache license", "CC-BY-NC": "cc by-nc"}
    got = {r.doc_id: set(filter(None, r.families.split(",")))
           for r in licenses.scan_licenses(documents).collect()}
    for r in documents.collect():
        plain = " ".join(re.findall(licenses.WORD, r.text.lower()))
        assert got[r.doc_id] == {k for k, n in names.items() if n in plain}


def test_wrapped_notices(spark, documents):
    permission = licenses.TEMPLATES["MIT"][2]
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(permission, 60))
    commons = "This work is licensed under a Creative Commons\nAttribution{} 4.0 International\nLicense"
    rows = [(1, f"/*\n{wrapped}\n */\nint main() {{}}"), (2, commons.format("-NonCommercial")),
            (3, commons.format("-ShareAlike")), (4, commons.format("")),
            (5, "# Licensed under the GNU Lesser\n# General Public License, version\n# 3.\n#\n"
                "# Released under the\n# MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").union(documents.where(
        "doc_id >= 20").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    got = {r.doc_id: r.families for r in licenses.scan_licenses(df).where("doc_id < 100").collect()}
    assert got == {1: "MIT", 2: "CC-BY-NC", 3: "CC-BY-SA", 4: "CC-BY", 5: "LGPL,MIT"}


def test_one_secret_in_very_many_rows_gives_a_field(spark):
    """However rare secrets are, and wherever in a text: the sample is drawn around them."""
    rows = [(i, f"plain words number {i} and nothing else") for i in range(20_000)]
    rows.append((20_000, "some words " * 500 + 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    windows = secrets.labelled_windows(docs, "doc_id", "text", 10)
    assert len(windows) >= 1 and all("9f86d0" in w for w in windows)
    assert secrets.learn_secrets(docs) is not None
    assert secrets.learn_secrets(docs.where("doc_id < 100")) is None


def test_secrets_that_no_pattern_finds(spark):
    """Recall on planted keys without a word before them, precision on the rest: all of 40
    mixed characters are found, and nothing else is added in 1,000 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.learn_secrets(docs)
    dice = random.Random(4)
    texts = [r.text for r in docs.select("text").collect()]
    added = lambda got: [s for r in got.field("spans").to_pylist() for s in r.split(",")
                         if s.startswith("crf")]
    assert len(added(secrets._scan(pa.array(texts), model, False))) <= 2
    key = lambda: "".join(dice.choice("ABCDEFGHabcdefgh0123456789XYZxyz") for _ in range(40))
    planted = [f"{t[:200]} {key()} {t[200:400]}" for t in texts[:200]]
    assert len(added(secrets._scan(pa.array(planted), model, False))) >= 180

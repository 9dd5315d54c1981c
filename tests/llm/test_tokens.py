"""BPE codec and token counts against the tokenizers library."""

import hashlib
import random
import struct
import sys
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusq.llm import bpe
from corpusq.llm.bpe import bpe_round_trip, codec, decode, encode
from corpusq.llm.token_fst import CHUNK, count_tokens, transducer

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(3)
    letters = "ab 'stmdrevlSTL  \n\t \x1c\x85ÉéΣσςİKſ12½٣,.!-<|>日本語𐍈́ 　\x00"
    out = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 80))) for _ in range(1500)]
    return out + ["", " ", "\n \n", "I'll we've 're 's  'd   x\n\n y ", "''s '''ll x'",
                  "a<|endoftext|>b's  <|endoftext|>", "<|startoftext|>x<|endoftext|>",
                  "a" * 4000 + "-" * 3000 + "aab" * 2000, "x " * CHUNK, " " * (2 * CHUNK + 1)]


def test_encode_and_decode_as_library(texts):
    coder, lib = codec(WORD), library(WORD)
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text[:80]
        assert coder.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_small_memos_and_groups(texts, monkeypatch):
    """Forgetting words and merging few fragments at a time changes nothing."""
    want = codec(WORD).encode_all(texts)
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 3)
    coder = bpe.WordCodec(WORD)
    assert [i for t in range(0, len(texts), 100) for i in coder.encode_all(texts[t:t + 100])] == want


def test_new_words_are_learned_together():
    """Less than one call for each new word, however many fragments it has."""
    dice = random.Random(11)
    words = ["".join(dice.choice("abcdeqxz'-7éß日") for _ in range(dice.randint(1, 40))) for _ in range(20_000)]
    coder, calls = bpe.WordCodec(WORD), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        coder.encode_all([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < len(words), calls


def test_fragments_join_to_the_word(texts):
    coder = codec(WORD)
    for letters in ("hello", "qzxqzj", "aaaaaaaa"):
        parts = coder.fragments_of(letters)
        assert "".join(parts) == letters
        for a, b in zip(parts, parts[1:], strict=False):
            assert not any(a[-1] + b[0] in token for token in coder.ids)


def test_counts_as_library(texts):
    lib = library(BYTE)
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = transducer(BYTE)
    assert counter.texts(pa.array(texts)) == want
    assert [counter.texts(pa.array([t]))[0] for t in texts[-60:]] == want[-60:]


def test_counts_of_random_bytes():
    dice = random.Random(5)
    counter = transducer(BYTE)
    for _ in range(1500):
        word = "".join(dice.choice("aehintsrou") for _ in range(dice.randint(1, 40))).encode()
        assert counter.count(word) == len(counter.plain(word))


def test_documents(documents):
    lib_w, lib_b = library(WORD), library(BYTE)
    coded = {r.doc_id: r for r in bpe_round_trip(documents, WORD).collect()}
    counted = {r.doc_id: r for r in count_tokens(documents, BYTE).collect()}
    for r in documents.collect():
        ids = lib_w.encode(r.text, add_special_tokens=False).ids
        got = coded[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(
            lib_w.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        n = len(lib_b.encode(r.text, add_special_tokens=False).ids)
        assert (counted[r.doc_id].n_tokens, counted[r.doc_id].over_limit) == (n, n > 1024)
        assert counted[r.doc_id].n_bytes == len(r.text.encode())


def test_columns_both_ways(spark):
    df = spark.createDataFrame([("Hello World",), ("",), (None,)], "t string")
    got = df.select(encode(F.col("t"), WORD).alias("ids")).select(
        "ids", decode(F.col("ids"), WORD).alias("back")).collect()
    assert got[0].back == "hello</w> world</w>"
    assert (got[1].ids, got[1].back, got[2].ids, got[2].back) == ([], "", None, None)


def test_odd_rows(odd, none, odd_rows):
    for df in (bpe_round_trip(odd, WORD), count_tokens(odd, BYTE)):
        got = sorted((r.doc_id or 0, r.n_tokens) for r in df.collect())
        assert len(got) == len(odd_rows)
        assert all(n == 0 for i, n in got if i in (1, 2))
    assert bpe_round_trip(none, WORD).count() == count_tokens(none, BYTE).count() == 0

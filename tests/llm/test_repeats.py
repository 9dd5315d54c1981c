"""Removal of repeated strings against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusq.llm.repeats import REACH, WIDTH, Prints, remove_repeats, units

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + WIDTH] for _, t in data for p in range(len(t) - WIDTH + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - WIDTH + 1):
            if seen[t[p:p + WIDTH]] > 1:
                gone[p:p + WIDTH] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        left = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        out.append((i, len(t), int(gone.sum()), int((edge == 1).sum()),
                    hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def check(df, **kw):
    got = sorted((tuple(r) for r in remove_repeats(df, **kw).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in df.collect()])
    return got


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def test_documents(documents):
    assert any(r[2] for r in check(documents))


def test_many_ranges(documents):
    """Runs of equal prefixes that cross ranges."""
    check(documents, range_rows=7)


def test_odd_rows(odd):
    check(odd)


def test_empty(none, spark):
    assert remove_repeats(none).collect() == []
    check(frame(spark, ["a" * 199, "a" * 199, None, ""]))


def test_exact_lengths(spark):
    """Repeats of 199 to 450 bytes at every offset, partners that differ on either side."""
    dice = random.Random(5)
    noise = lambda n: "".join(dice.choice("abcdefghij ") for _ in range(n))
    texts = []
    for size in [199, 200, 201, 215, 263, 264, 280, 330, 450]:
        shared = noise(size)
        texts += [noise(dice.randint(0, 150)) + shared + noise(dice.randint(0, 150)) for _ in range(3)]
        cut = dice.randint(0, 60)
        texts += [noise(90) + shared[cut:] + noise(90), noise(70) + shared[:size - cut] + noise(30)]
    dice.shuffle(texts)
    assert any(r[2] for r in check(frame(spark, texts)))
    check(frame(spark, texts), range_rows=3)


def test_inside_one_text(spark):
    """Overlapping repeats, periodic texts, many bytes a character."""
    dice = random.Random(6)
    line = "".join(dice.choice("äöü€xyz ") for _ in range(150))
    check(frame(spark, ["q" * 700, "ab" * 260 + "c", line * 3, line + "1" + line, "é" * 150 + "!"]))
    check(frame(spark, ["q" * 201]))
    check(frame(spark, ["q" * 200, "x" + "q" * 200]))


def test_one_passage_everywhere(spark):
    """A passage in most texts, each with its own surroundings, over many ranges."""
    dice = random.Random(8)
    noise = lambda n: "".join(dice.choice("abcdefghijklmnop ") for _ in range(n))
    shared = noise(230)
    texts = [noise(dice.randint(0, 99)) + shared + noise(dice.randint(0, 99)) for _ in range(150)]
    texts += [texts[0]] * 80 + [noise(400) for _ in range(40)]
    got = check(frame(spark, texts), range_rows=20)
    assert all(r[2] >= 230 for r in got if r[0] < 230)


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(spark, seed):
    """Copies with changed, dropped and added characters."""
    dice = random.Random(seed)
    base = ["".join(dice.choice("abcde \n") for _ in range(900)) for _ in range(4)]
    texts = list(base)
    for _ in range(40):
        t = list(dice.choice(base))
        for _ in range(dice.randint(0, 5)):
            at = dice.randrange(len(t))
            t[at:at + dice.randint(0, 2)] = dice.choice(["", "Z", "zz", "é"])
        texts.append("".join(t)[dice.randint(0, 300):])
    check(frame(spark, texts), range_rows=dice.choice([5, 50, 5000]))


def test_every_start_has_one_sample():
    dice = np.random.default_rng(2)
    data = dice.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 150, 350, 351, 2000, 5000])
    row, x, lo, hi = units(data, at, Prints(data, 0))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    want = [p for a, b in zip(at[:-1], at[1:], strict=True) for p in range(a, b - WIDTH + 1)]
    assert starts.tolist() == want
    assert ((x >= hi) & (x - lo < REACH) & (at[row] <= lo) & (hi + WIDTH <= at[row + 1])).all()

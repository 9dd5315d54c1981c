"""Secret scans: fixed patterns, and a linear-chain conditional random field for the rest.

The patterns give the base spans. The field is trained here, on a bounded sample of windows
around base spans and of plain texts, with the secret parts of the base spans as labels and
with words hidden at random, and tags every token of every text. A tagged span
of at least LEAST characters with a digit that touches no base span is added as kind `crf`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm import crf
from corpusq.llm.arrow_text import by_slice, slices
from corpusq.llm.sampling import sample_texts
from corpusq.llm.spans import (DIGITS, LOWER_CASE, UPPER_CASE, Layout, by_row, find_secrets,
                               written)

# Bounds of the training sample: base spans (chosen by a hash) with the bytes around them, and
# plain texts with the characters of each.
SAMPLE_SPANS = 1000
AROUND = 300
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 1500
WINDOW = 24             # tokens of a training sequence
PLAIN_PER_SECRET = 5    # sequences without a secret for each one with
SLICE_DOCS = 200        # sampled texts whose features are computed together
LEAST = 12
DIGIT = re.compile("[0-9]")
KINDS = ["assign", "access", "hex"]
# What secrets are made of beside what the patterns find.
ALPHABETS = [UPPER_CASE + LOWER_CASE + DIGITS, UPPER_CASE + DIGITS, LOWER_CASE + DIGITS]

FOUND = ("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, "
         "spans: string, redacted: string>")
_KIND = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS]
                  + [("base_sha256", pa.string()), ("spans", pa.string()),
                     ("redacted", pa.string())])


def _labels(tokens: crf.Tokens, layout: Layout) -> np.ndarray:
    """Tags that the secret parts of the base spans give."""
    tags = np.zeros(len(tokens.start), np.int8)
    parts = sorted(part for found in find_secrets(layout).values() for _, part in found)
    for start, end in parts:
        i = int(np.searchsorted(tokens.end, start, "right"))
        j = int(np.searchsorted(tokens.start, end, "left"))
        if not tags[i:j].any():
            tags[i:j] = crf.INSIDE
            tags[i:i + 1] = crf.BEGIN
    return tags


def sequences(tokens: int, window: int) -> np.ndarray:
    """(sequences, window): numbers of the tokens, each in at least one sequence. The last
    sequence ends with the last token; fewer tokens than a window are repeated."""
    if not tokens:
        return np.zeros((0, window), np.int64)
    first = np.append(np.arange(0, tokens - window, window), max(tokens - window, 0))
    return (first[:, None] + np.arange(window)) % tokens


def disguise(layout: Layout, dice: np.random.Generator) -> Layout:
    """The same texts with the letters and digits of each secret drawn anew from one of a few
    alphabets, so that the field learns more shapes than the patterns know."""
    data = layout.data.copy()
    for start, end in sorted({part for f in find_secrets(layout).values() for _, part in f}):
        alphabet = np.frombuffer(ALPHABETS[int(dice.integers(len(ALPHABETS)))], np.uint8)
        on = np.flatnonzero(crf.CLASS[data[start:end]] & 7) + start
        data[on] = dice.choice(alphabet, len(on))
    return Layout(data, layout.at)


def train_tagger(texts: list[str], window: int = WINDOW,
                 plain_per_secret: int = PLAIN_PER_SECRET) -> crf.Model | None:
    """Fit the field on sequences cut from texts; None when they hold no secret."""
    found: dict[bool, list] = {True: [], False: []}
    dice = np.random.default_rng(9)
    for i, disguised in ((i, d) for i in range(0, len(texts), SLICE_DOCS) for d in (False, True)):
        layout = Layout.of(pa.array(texts[i:i + SLICE_DOCS], pa.string()))
        tokens = crf.tokens_of(layout)
        tags = _labels(tokens, layout)
        if disguised:
            tokens = crf.tokens_of(disguise(layout, dice))
        at = sequences(len(tags), window)
        rows, features = tags[at], tokens.features[:, at]
        secret = rows.any(1)
        for kind in (True,) if disguised else (True, False):
            on = secret == kind
            found[kind].append((features[:, on], rows[on]))
    many = sum(len(rows) for _, rows in found[True])
    if not many:
        return None
    parts = []
    for kind, pieces in found.items():
        features = np.concatenate([f for f, _ in pieces], 1)
        rows = np.concatenate([r for _, r in pieces])
        if not kind and len(rows) > plain_per_secret * many:
            some = np.linspace(0, len(rows) - 1, plain_per_secret * many).astype(int)
            features, rows = features[:, some], rows[some]
        parts.append((features, rows))
    return crf.train(np.concatenate([f for f, _ in parts], 1),
                     np.concatenate([r for _, r in parts]))


def _tagged(layout: Layout, model: crf.Model) -> list[tuple[int, int]]:
    tokens = crf.tokens_of(layout)
    if not len(tokens.start):
        return []
    tags = model.decode(model.emissions(tokens.features), tokens.row)
    inside = np.flatnonzero(tags > 0)
    if not len(inside):
        return []
    new = np.ones(len(inside), bool)
    new[1:] = ((np.diff(inside) > 1) | (tags[inside[1:]] == crf.BEGIN)
               | (np.diff(tokens.row[inside]) > 0))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return list(zip(tokens.start[inside[first]].tolist(), tokens.end[inside[last]].tolist(),
                    strict=True))


def _scan(texts: pa.Array, model: crf.Model | None, redact: bool) -> pa.Array:
    layout = Layout.of(texts)
    base = {kind: by_row(layout, [whole for whole, _ in found])
            for kind, found in find_secrets(layout).items()}
    added = by_row(layout, _tagged(layout, model)) if model else {}
    nothing = {"base_sha256": hashlib.sha256(b"").hexdigest(), "spans": "",
               **{f"n_{k}": 0 for k in KINDS}}
    out: list[dict] = [nothing] * len(texts)
    for row in sorted(set(added).union(*base.values())):
        own = sorted(((k, *layout.in_text(row, s)) for k in KINDS for s in base[k].get(row, ())),
                     key=lambda s: (s[1], KINDS.index(s[0])))
        new = [("crf", *layout.in_text(row, s)) for s in added.get(row, ())]
        own_text = texts[row].as_py() if new else ""
        new = [s for s in new if s[2] - s[1] >= LEAST and DIGIT.search(own_text, s[1], s[2])
               and not any(s[1] < e and b < s[2] for _, b, e in own)]
        every = sorted(own + new, key=lambda s: (s[1], (*KINDS, "crf").index(s[0])))
        out[row] = {**{f"n_{k}": len(base[k].get(row, ())) for k in KINDS},
                    "base_sha256": hashlib.sha256(written(own).encode()).hexdigest(),
                    "spans": written(every)}
        if redact and every:
            out[row]["redacted"] = blank_out(texts[row].as_py(), every)
    return pa.array(out, _KIND)


def blank_out(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or union of overlapping spans, replaced by [SECRET]."""
    out, done = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if end <= done:
            continue
        if start >= done:
            out += [text[done:start], "[SECRET]"]
        done = end
    return "".join([*out, text[done:]])


def secrets(text: Column, model: crf.Model | None, redact: bool = False) -> Column:
    """Counts, spans and (with `redact`) the text without secrets, null where it has none."""
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_slice(texts, lambda part: _scan(part, model, redact), _KIND)
    return scan(text)


def labelled_windows(docs: DataFrame, id_col: str, text_col: str, spans: int) -> list[str]:
    """At most `spans` windows of text around base spans, wherever in the table these are.

    All texts are scanned; a task passes on the `spans` windows with the smallest hash."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch.column(0)):
                layout = Layout.of(part)
                for start, end in sorted({w for f in find_secrets(layout).values() for w, _ in f}):
                    row = int(layout.row(np.array([start]))[0])
                    a, b = layout.at[row], layout.at[row + 1] - 1
                    piece = layout.data[max(a, start - AROUND):min(b, end + AROUND)].tobytes()
                    found.append(piece.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["piece"])

    pieces = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(
        work, "piece string")
    return [r[0] for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(spans).collect()]


def learn_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sample_spans: int = SAMPLE_SPANS, sample_docs: int = SAMPLE_DOCS,
                  sample_chars: int = SAMPLE_CHARS) -> crf.Model | None:
    """The field, fitted on windows around base spans and on plain texts; None only when no
    text holds a base span."""
    windows = labelled_windows(docs, id_col, text_col, sample_spans)
    if not windows:
        return None
    return train_tagger(windows + sample_texts(docs, id_col, text_col, sample_docs, sample_chars))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per input row.

    A null or empty text has no spans. Spans are code points, end exclusive. When no text
    holds a secret there is no field and only base spans are returned. Rows that repeat an
    id, or have none, are scanned each by itself; other columns are not looked at.
    """
    model = learn_secrets(docs, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"),
                       secrets(F.col(text_col), model).alias("_r")).select(
        "doc_id", *[f"_r.n_{k}" for k in KINDS], "_r.base_sha256", "_r.spans")

"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged across, so the
text may be cut there: the fragments between such cuts are encoded one by one and their ids
concatenated, with the same result as encoding the word as a whole. White space is such a
cut everywhere in this vocabulary; inside a word the table of pairs says where.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.arrow_text import by_slice

# Entries kept by each memo of a Python worker; a full memo is emptied. It bounds memory
# only: a forgotten word is encoded again.
MEMO = 250_000
WIDTHS = (6, 10, 16, 28)  # fragments up to these lengths are merged side by side

SIDE_BY_SIDE = 20_000    # as many at a time
NEWLINE = ord("\n")
LINE_END = b"\xff" * 4    # no id, and as ids are below 2 ** 24 no part of two

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|\n|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
# str.split() takes these four for white space, Unicode's property does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges, lowest rank first and leftmost among equals, in O(n log n)."""
    n = len(symbols)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    queue = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))
             if p in ranks]
    heapq.heapify(queue)
    parts: list[str | None] = list(symbols)
    while queue:
        rank, i = heapq.heappop(queue)
        left, j = parts[i], after[i]
        if left is None or j < 0 or ranks.get((left, parts[j])) != rank:
            continue                       # one of the two has been merged meanwhile
        parts[i], parts[j] = left + parts[j], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (parts[a], parts[b]) in ranks:
                heapq.heappush(queue, (ranks[parts[a], parts[b]], a))
    return [p for p in parts if p is not None]


class WordCodec:
    """Encoder and decoder for a vocabulary file with word ends ("</w>")."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i
                      for i, m in enumerate(model["merges"])}
        self.letters = dict(enumerate(byte_letters()))
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.special = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.tokens = [""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for token, i in [*self.ids.items(), *self.added.items()]:
            self.tokens[i] = token
        self.joins = self._joins()
        keys = np.array([self.ids[a] << 17 | self.ids[b] for a, b in self.ranks], np.int64)
        self.rank_of_key = np.argsort(keys)
        self.keys = keys[self.rank_of_key]
        self.made = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)
        letters = self.letters.values()
        self.cuts = np.array([[(a, b) not in self.joins for b in letters] for a in letters])
        self.symbols = np.array([self.ids[a] for a in letters], np.int64)
        self.last_symbols = np.array([self.ids[a + self.end] for a in letters], np.int64)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"\n": LINE_END}

    def _joins(self) -> set[tuple[str, str]]:
        """Pairs of byte letters that are neighbours inside some token; all others cut."""
        pairs = set()
        for token in self.ids:
            letters = token.removesuffix(self.end)
            pairs.update(zip(letters, letters[1:], strict=False))
        return pairs

    def fragments_of(self, letters: str) -> list[str]:
        cuts = [i for i in range(1, len(letters))
                if (letters[i - 1], letters[i]) not in self.joins]
        return [letters[a:b] for a, b in
                zip([0, *cuts], [*cuts, len(letters)], strict=True)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of merges where there is none."""
        key = left << 17 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0),
                        self.rank_of_key[at], len(self.keys))

    def _merge_side_by_side(self, parts: np.ndarray) -> None:
        """Merge many short fragments (rows of ids, then -1) at once and in place: in every
        round each fragment does its merge of lowest rank, leftmost among equals."""
        width = parts.shape[1]
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        going = np.arange(len(parts))
        column = np.arange(width)
        while True:
            at = ranks[going].argmin(1)
            rank = ranks[going, at]
            on = rank < len(self.keys)
            going, at, rank = going[on], at[on], rank[on]
            if not len(going):
                break
            closer = np.minimum(column + (column > at[:, None]), width - 1)
            held = np.take_along_axis(parts[going], closer, 1)
            held[:, -1] = -1
            line = np.arange(len(going))
            held[line, at] = self.made[rank]
            # the pair at `at` goes; those around the new part are looked up again
            shifted = ranks[going]
            shifted = np.concatenate([shifted, np.full((len(going), 1), len(self.keys))], 1)
            shifted = np.take_along_axis(
                shifted, column[:-1] + (column[:-1] >= at[:, None]), 1)
            before, after = np.maximum(at - 1, 0), np.minimum(at, width - 2)
            shifted[line, after] = self._ranks(held[line, after], held[line, after + 1])
            shifted[line, before] = self._ranks(held[line, before], held[line, before + 1])
            parts[going], ranks[going] = held, shifted

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. All pieces lie one after the other as bytes; fragments start
        where a piece does and where two neighbours are no pair of a token."""
        data = np.frombuffer("\n".join([*pieces, ""]).encode(), np.uint8)
        ends = np.flatnonzero(data == NEWLINE)
        data, ends = data[data != NEWLINE], ends - np.arange(len(ends))
        begins = np.append(0, ends[:-1])
        starts = np.zeros(len(data), bool)
        starts[1:] = self.cuts[data[:-1], data[1:]]
        starts[begins] = True
        symbols = self.symbols[data]
        symbols[ends - 1] = self.last_symbols[data[ends - 1]]
        start = np.flatnonzero(starts)
        size = np.diff(start, append=len(data))
        # ids of fragment i are put at the place of its first byte; those merged away are -1
        ids = np.full(len(data), -1, np.int64)
        ids[start[size == 1]] = symbols[start[size == 1]]
        least = 1
        for width in WIDTHS:
            these = np.flatnonzero((size > least) & (size <= width))
            least = width
            column = np.arange(width)
            for part in np.split(these, range(SIDE_BY_SIDE, len(these), SIDE_BY_SIDE)):
                inside = column < size[part, None]
                at = (start[part, None] + column)[inside]
                rows = np.full(inside.shape, -1, np.int64)
                rows[inside] = symbols[at]
                self._merge_side_by_side(rows)
                ids[at] = rows[inside]
        for i in np.flatnonzero(size > least).tolist():
            a, n = start[i], size[i]
            merged = merge([self.tokens[x] for x in symbols[a:a + n].tolist()], self.ranks)
            ids[a:a + len(merged)] = [self.ids[m] for m in merged]
        left = np.append(0, np.cumsum(ids >= 0))
        blob = ids[ids >= 0].astype("<u4").tobytes()
        return [blob[a:b] for a, b in zip((4 * left[begins]).tolist(), (4 * left[ends]).tolist(),
                                          strict=True)]

    def _learn(self, raws: list[str]) -> None:
        """Encode stretches without white space, all in one text with a line for each.
        Lower-casing is per character, so a final sigma stays a plain one."""
        text = "\n".join([*raws, ""])
        found = WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if len(self.pieces) > MEMO:
            self.pieces = {"\n": LINE_END}
        pieces = self.pieces
        fresh = list(set(found).difference(pieces))
        if fresh:
            pieces.update(zip(fresh, self._encode_pieces(fresh), strict=True))
        lines = b"".join(map(pieces.__getitem__, found)).split(LINE_END)
        self.words.update(zip(raws, lines[:-1], strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.special.split(text) if "<|" in text else [text]
            split.append([p if n % 2 else
                          p.split() if not SEPARATORS.search(p) else SPACES.split(p)
                          for n, p in enumerate(parts)])
        if len(self.words) > MEMO:
            self.words = {}
        known = self.words
        fresh = set().union(*[words for parts in split for words in parts[::2]])
        self._learn(list(fresh.difference(known)))
        return [b"".join([np.uint32(self.added[p]).tobytes() if n % 2 else
                          b"".join(map(known.__getitem__, p)) for n, p in enumerate(parts)])
                for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Token strings with a blank between them: this vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode(text: Column, vocabulary: str) -> Column:
    """Token ids (array<int>) of a text column. A null text gives null, an empty one [].

    `vocabulary` is the path of a file that every worker can read.
    """
    @F.arrow_udf("array<int>")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(vocabulary)
        for texts in batches:
            yield by_slice(texts, lambda part: pa.array(
                [None if t is None else np.frombuffer(i, "<i4") for t, i in zip(
                    part.to_pylist(), coder.encode_all([t or "" for t in part.to_pylist()]),
                    strict=True)], pa.list_(pa.int32())), pa.list_(pa.int32()))
    return encode_texts(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """Text of a column of token ids. Null gives null, [] the empty text."""
    @F.arrow_udf("string")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(vocabulary)
        for rows in batches:
            yield pa.array([None if r is None else coder.decode(np.array(r, "<u4").tobytes())
                            for r in rows.to_pylist()], pa.string())
    return decode_ids(ids)


DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def codec_digest(text: Column, vocabulary: str) -> Column:
    """Encode and decode in one pass and keep count and hashes only, so that neither ids
    nor decoded texts are copied between Python and the JVM. A null text counts as empty."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                      ("decoded_sha256", pa.string())])

    @F.arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(vocabulary)
        def work(part: pa.Array) -> pa.Array:
            ids = coder.encode_all([t or "" for t in part.to_pylist()])
            return pa.array([{
                "n_tokens": len(i) // 4,
                "ids_sha256": hashlib.sha256(i).hexdigest(),
                "decoded_sha256": hashlib.sha256(coder.decode(i).encode()).hexdigest(),
            } for i in ids], kind)

        for texts in batches:
            yield by_slice(texts, work, kind)
    return digest(text)


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    One row per input row, repeated or null ids included; a null or empty text has no
    tokens. Other columns are not looked at.
    """
    return (docs.select(F.col(id_col).alias("doc_id"),
                        codec_digest(F.col(text_col), vocabulary).alias("_r"))
            .select("doc_id", "_r.n_tokens", "_r.ids_sha256", "_r.decoded_sha256"))

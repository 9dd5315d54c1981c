"""Exact token counts with finite-state transducers compiled from a byte-level BPE file.

Two transducers in a row:

1. The pre-tokenizer is a transducer of eight states over character classes (look-ahead is
   resolved into the class). Text is cut into chunks of equal length; each chunk's state map
   (exit state for every entry state) is computed for all chunks side by side, the maps are
   composed by a parallel prefix scan, and each chunk then runs once from its known entry
   state and marks where words start.
2. The BPE transducer reads the bytes of a word. A transition carries the number of tokens by
   which the encoding grows (or shrinks). States are built when first reached, as lazy
   automata are. All that counts of a prefix is from which of its borders a token can still
   grow, and for each the count there and the edge of the token that ends there.
"""

from __future__ import annotations

import bisect
import json
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.arrow_text import by_slice, char_positions, utf8
from corpusq.llm.bpe import byte_letters, merge

CHUNK = 256             # characters per chunk of the scan
MEMO = 300_000          # words remembered by a worker, then forgotten
LONG_WORD = 64          # bytes from which a word is not remembered
STATES = 200_000        # transducer states kept per worker, then compiled anew
PAIRS = 500_000         # remembered pairs of tokens; all of these bound memory only

# --- transducer 1: where words start ---------------------------------------------------

LETTER, NUMBER, OTHER, QUOTE_2, QUOTE_3, LAST_BLANK, LAST_SPACE, SPACE = range(8)
CUT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, SKIP_1, SKIP_2, IN_SPACES = range(8)


def _lexer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark for (state, symbol); symbols from 8 begin a document."""
    step = np.zeros((8, 16), np.uint8)
    mark = np.ones((8, 16), bool)
    fresh = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, SKIP_1, SKIP_2, JOINED, CUT, IN_SPACES]
    step[:] = fresh * 2

    def go_on(state: int, symbols: list[int], to: int) -> None:
        step[state, symbols], mark[state, symbols] = to, False

    others = [OTHER, QUOTE_2, QUOTE_3]
    go_on(IN_LETTERS, [LETTER], IN_LETTERS)
    go_on(IN_NUMBERS, [NUMBER], IN_NUMBERS)
    go_on(IN_OTHERS, others, IN_OTHERS)
    go_on(JOINED, [LETTER], IN_LETTERS)
    go_on(JOINED, [NUMBER], IN_NUMBERS)
    go_on(JOINED, others, IN_OTHERS)
    go_on(SKIP_1, list(range(8)), CUT)
    go_on(SKIP_2, list(range(8)), SKIP_1)
    go_on(IN_SPACES, [SPACE], IN_SPACES)
    return step, mark


STEP, MARK = _lexer()
ONE = [bytes([b]) for b in range(256)]


@cache
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point, from its Unicode property."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            points = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            out[points] = kind
    return out


def symbols(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Lexer symbols of code points; `begins` are the positions where documents begin."""
    n = len(points)
    kind = char_classes()[points]
    ends = np.zeros(n + 3, bool)            # positions at which a document has ended
    ends[begins] = True
    ends[n:] = True
    follow = np.concatenate([points, np.zeros(3, points.dtype)])
    blank = kind == SPACE
    next_blank = np.concatenate([blank[1:], [True]]) | ends[1:n + 1]
    out = kind.copy()
    last = blank & ~next_blank
    out[last] = LAST_SPACE
    out[last & (points == 32)] = LAST_BLANK
    quotes = np.flatnonzero(points == 39)
    one, two = follow[quotes + 1], follow[quotes + 2]
    inside = ~ends[quotes + 1]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    pairs = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
             | (one == ord("l")) & (two == ord("l")))
    out[quotes[short]] = QUOTE_2
    out[quotes[inside & ~ends[quotes + 2] & pairs]] = QUOTE_3
    out[begins] += 8
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunk, entry) -> exit, in log2(chunks) rounds."""
    maps, width = maps.copy(), 1
    while width < len(maps):
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.intp), 1)
        width *= 2
    return maps


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions at which the pre-tokenizer begins a word."""
    n = len(points)
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = symbols(points, begins)
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.intp)
    flat_step, flat_mark = STEP.ravel(), MARK.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for column in grid:
        maps = flat_step[maps.astype(np.intp) * 16 + column[:, None]]
    entry = np.zeros(chunks, np.intp)
    entry[1:] = compose(maps)[:-1, CUT]
    starts = np.empty((CHUNK, chunks), bool)
    for i, column in enumerate(grid):
        at = entry * 16 + column
        starts[i] = flat_mark[at]
        entry = flat_step[at].astype(np.intp)
    return np.flatnonzero(starts.T.ravel()[:n])


# --- transducer 2: tokens of a word ----------------------------------------------------

class CountTransducer:
    """Bytes in, change of the token count out."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        self.letters = letters
        back = {c: b for b, c in enumerate(letters)}
        model = held["model"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i
                      for i, m in enumerate(model["merges"])}
        self.ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()
                    if all(c in back for c in token)}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.special = [t["content"].encode() for t in held["added_tokens"]]
        self.prefixes = {t[:n] for t in self.ids for n in range(1, len(t))}
        self.splits = self._splits()
        self.merges_of: dict[int, list[int]] = {}     # ranks of merges by their left part
        for (left, _), rank in self.merged.items():
            self.merges_of.setdefault(left, []).append(rank)
        self.class_of: dict[int, int] = {}
        self.classes: dict[tuple | None, int] = {}
        self.examples: list[int] = []
        self.edges: dict[int, tuple[list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, int] = {}
        self._restart()

    def _splits(self) -> dict[int, tuple[int, int, int]]:
        """The merge that makes each token: (left part, right part, rank)."""
        by_letters = {"".join(self.letters[b] for b in t): i for t, i in self.ids.items()}
        self.merged = {(by_letters[a], by_letters[b]): r for (a, b), r in self.ranks.items()}
        return {by_letters[a + b]: (by_letters[a], by_letters[b], r)
                for (a, b), r in reversed(self.ranks.items())}

    def _edges(self, token: int) -> tuple[list, list]:
        """Parts that stand at the left and at the right edge of a token while it is being
        merged, each with the rank of the merge that ends it."""
        found = self.edges.get(token)
        if found is None:
            found = self.edges[token] = ([], [])
            for side in (0, 1):
                part, until = token, len(self.ranks)
                while True:
                    found[side].append((part, until))
                    if part not in self.splits:
                        break
                    until = self.splits[part][2]
                    part = self.splits[part][side]
        return found

    def _restart(self) -> None:
        # A state: the borders from which a token can grow beyond the end, the longest way
        # back first, as (bytes since the border, class of the token that ends at it, count
        # there less the count at the end).
        start = ((b"", self.edge_class(-1), 0),)
        self.numbers = {start: 0}
        self.states = [start]
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def edge_class(self, token: int) -> int:
        """Tokens whose right edges meet the same merges behave alike on their right. -1,
        the start of a word, is a class of its own."""
        found = self.class_of.get(token)
        if found is None:
            key = None
            if token >= 0:
                key = tuple([(part, n) for part, until in self._edges(token)[1] if (
                    n := bisect.bisect_left(self.merges_of.get(part, ()), until))])
            found = self.class_of[token] = self.classes.setdefault(key, len(self.classes))
            if found == len(self.examples):
                self.examples.append(token)
        return found

    def plain(self, data: bytes) -> list[int]:
        """Encoding by merges: which tokens a word can begin with is found by it."""
        parts = merge([self.letters[b] for b in data], self.ranks)
        return [self.ids[bytes(map(self.letters.index, p))] for p in parts]

    def stays(self, left: int, right: int) -> bool:
        """Whether a token is still there after a token of class `left` once all merges of
        their bytes are done. Merges of equal rank go from left to right."""
        known = self.pairs.get((left, right))
        if known is None:
            token = self.examples[left]
            if token < 0:
                known = self.plain(self.tokens[right]) == [right]
            else:
                # no merge across the border comes due while both of its parts stand there
                known = not any(
                    rank < a_until and rank <= b_until
                    for a, a_until in self._edges(token)[1] if a in self.merges_of
                    for b, b_until in self._edges(right)[0]
                    if (rank := self.merged.get((a, b))) is not None)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: (next state, change of the count)."""
        grown = [(since + ONE[byte], left, n) for since, left, n in self.states[state]]
        for since, left, n in grown:              # the longest token that stays is the last
            token = self.ids.get(since)
            if token is not None and self.stays(left, token):
                change = n + 1
                break
        key = (*[(since, left, n - change) for since, left, n in grown
                 if since in self.prefixes], (b"", self.edge_class(token), 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        self.arcs[state][byte] = number, change
        return number, change

    def count(self, word: bytes) -> int:
        """Number of tokens of a word of the pre-tokenizer."""
        if len(self.states) > STATES:
            self._restart()
        state = total = 0
        arcs = self.arcs
        for byte in word:
            found = arcs[state].get(byte)
            state, change = self.arc(state, byte) if found is None else found
            total += change
        return total

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Number of tokens of each text."""
        text = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        if not text:
            return [0] * len(pieces)
        data = np.frombuffer(text, np.uint8)
        chars = char_positions(data)
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        begins = chars[np.unique(np.concatenate([[0], ends[:-1]]))]
        starts = word_starts(points, begins[begins < len(points)])
        bytes_at = np.flatnonzero((data & 0xC0) != 0x80)[starts]
        words, known = [], self.words
        if len(known) > MEMO:
            known.clear()
        bounds = [*bytes_at.tolist(), len(text)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            word = text[a:b]
            n = known.get(word)
            if n is None:
                n = self.count(word)
                if len(word) < LONG_WORD:
                    known[word] = n
            words.append(n)
        total = np.concatenate([[0], np.cumsum(words)])
        at = total[np.searchsorted(bytes_at, np.concatenate([[0], ends]))]
        return np.diff(at).tolist()

    def texts(self, texts: pa.Array) -> list[int]:
        """As `counts`; strings of special tokens inside a text are one token each."""
        data, at = utf8(texts)
        whole = data.tobytes()
        rows = [whole[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        if not any(s in whole for s in self.special):
            return self.counts(rows)
        mark = regex.compile(b"|".join(map(regex.escape, self.special)))
        cut = [mark.split(r) for r in rows]
        flat = self.counts([p for parts in cut for p in parts])
        out, i = [], 0
        for parts in cut:
            out.append(sum(flat[i:i + len(parts)]) + len(parts) - 1)
            i += len(parts)
        return out


@cache
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """Number of tokens of a text column; 0 for a null or empty text."""
    @F.arrow_udf("bigint")
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = transducer(vocabulary)
        for texts in batches:
            yield by_slice(texts, lambda part: pa.array(counter.texts(part), pa.int64()),
                           pa.int64())
    return count_tokens(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    One row per input row, repeated or null ids included; a null text counts as empty. Other
    columns are not looked at.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_count(F.col(text_col), vocabulary).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

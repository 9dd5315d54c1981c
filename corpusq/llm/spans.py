"""Finding patterned spans in a batch of texts in linear time, on one byte array.

Texts are laid out one after the other with a zero byte behind each, which no pattern here
accepts, so no match runs from one text into the next.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from corpusq.llm.arrow_text import char_positions, utf8

Span = tuple[int, int]


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


DIGITS = b"0123456789"
LOWER_CASE = bytes(range(97, 123))
UPPER_CASE = bytes(range(65, 91))
IS_DIGIT = byte_set(DIGITS)
IS_HEX = byte_set(DIGITS + b"abcdef")
TO_LOWER = bytes.maketrans(UPPER_CASE, LOWER_CASE)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches where the mask holds."""
    turn = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


@dataclass
class Layout:
    data: np.ndarray        # bytes of all texts, each followed by a zero byte
    at: np.ndarray          # where each text begins; one more entry for the end

    @classmethod
    def of(cls, texts: pa.Array) -> Layout:
        data, at = utf8(texts)
        row = np.arange(len(texts) + 1)
        out = np.zeros(len(data) + len(texts), np.uint8)
        out[np.arange(len(data)) + np.repeat(row[:-1], np.diff(at))] = data
        return cls(out, at + row)

    @cached_property
    def raw(self) -> bytes:
        return self.data.tobytes()

    @cached_property
    def lower(self) -> bytes:
        return self.raw.translate(TO_LOWER)

    @cached_property
    def chars(self) -> np.ndarray:
        return char_positions(self.data)

    def row(self, position) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1

    def in_text(self, row: int, span: Span) -> Span:
        """A byte span as code points of its text."""
        first = self.chars[self.at[row]]
        return int(self.chars[span[0]] - first), int(self.chars[span[1]] - first)


def occurrences(data: bytes, word: bytes) -> list[int]:
    out, i = [], data.find(word)
    while i >= 0:
        out.append(i)
        i = data.find(word, i + 1)
    return out


def anchored(data: bytes, starts: list[int], pattern: re.Pattern) -> list[re.Match]:
    """Leftmost non-overlapping matches of a pattern that can only begin at `starts`."""
    out, free = [], 0
    for i in sorted(set(starts)):
        if i >= free and (m := pattern.match(data, i)):
            out.append(m)
            free = m.end()
    return out


def digit_chains(layout: Layout, glue: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of digits, and the number of the chain each belongs to: neighbours in a chain
    have exactly one byte of `glue` between them."""
    start, end = runs(IS_DIGIT[layout.data])
    linked = np.zeros(len(start), bool)
    if len(start) > 1:
        linked[1:] = (start[1:] - end[:-1] == 1) & byte_set(glue)[layout.data[end[:-1]]]
    return start, end, np.cumsum(~linked)


# --- secrets -----------------------------------------------------------------------------

# The patterns and least lengths that the rules name.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    rb"([a-z0-9+/_.=-]+)")
ASSIGN_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16


def find_secrets(layout: Layout) -> dict[str, list[tuple[Span, Span]]]:
    """(match, secret part) of each kind, in byte positions."""
    starts = [i for w in ASSIGN_WORDS for i in occurrences(layout.lower, w)]
    assign = [(m.span(), m.span(1)) for m in anchored(layout.lower, starts, ASSIGN)
              if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    keys = anchored(layout.raw, occurrences(layout.raw, b"AKIA"), ACCESS)
    access = [(m.span(), m.span()) for m in keys if m.end() - m.start() >= ACCESS_LEAST]
    start, end = runs(IS_HEX[layout.data])
    long = end - start >= HEX_LEAST
    found = list(zip(start[long].tolist(), end[long].tolist(), strict=True))
    return {"assign": assign, "access": access, "hex": [(s, s) for s in found]}


# --- personal data -------------------------------------------------------------------------

LOCAL = byte_set(LOWER_CASE + UPPER_CASE + DIGITS + b"._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)


def luhn(digits: bytes) -> bool:
    values = [d - 48 for d in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def find_emails(layout: Layout) -> list[Span]:
    """The part before an @ is all of its letters back to the last match."""
    at_signs = occurrences(layout.raw, b"@")
    if not at_signs:
        return []
    outside = np.flatnonzero(~LOCAL[layout.data])
    out, free = [], 0
    for i in at_signs:
        k = int(np.searchsorted(outside, i)) - 1
        start = max(free, int(outside[k]) + 1 if k >= 0 else 0)
        if start < i and (m := DOMAIN.match(layout.raw, i + 1)):
            out.append((start, m.end()))
            free = m.end()
    return out


def find_addresses(layout: Layout) -> list[Span]:
    """Four runs of digits joined by points, taken from the left of each chain."""
    start, end, chain = digit_chains(layout, b".")
    if not len(start):
        return []
    first = np.searchsorted(chain, chain)
    place = np.arange(len(chain)) - first
    size = np.bincount(chain)[chain]
    heads = np.flatnonzero((place % 4 == 0) & (place + 4 <= size))
    out = []
    for i in heads.tolist():
        parts = [layout.raw[start[k]:end[k]] for k in range(i, i + 4)]
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in parts):
            out.append((int(start[i]), int(end[i + 3])))
    return out


def find_cards(layout: Layout) -> list[Span]:
    start, end, chain = digit_chains(layout, b" -")
    if not len(start):
        return []
    digits = np.bincount(chain, weights=end - start)
    least, most = CARD_DIGITS
    out = []
    for c in np.flatnonzero((digits >= least) & (digits <= most)).tolist():
        i, j = np.searchsorted(chain, [c, c + 1])
        span = int(start[i]), int(end[j - 1])
        if luhn(bytes(b for b in layout.raw[span[0]:span[1]] if IS_DIGIT[b])):
            out.append(span)
    return out


def find_phones(layout: Layout) -> list[Span]:
    least, most = PHONE_DIGITS
    found = anchored(layout.raw, occurrences(layout.raw, b"+"), PHONE)
    return [m.span() for m in found
            if least <= sum(48 <= b <= 57 for b in m[0]) <= most]


def find_personal(layout: Layout) -> dict[str, list[Span]]:
    """Spans of each kind, in byte positions."""
    return {"email": find_emails(layout), "ip": find_addresses(layout),
            "card": find_cards(layout), "phone": find_phones(layout)}


def by_row(layout: Layout, spans: list[Span]) -> dict[int, list[Span]]:
    out: dict[int, list[Span]] = {}
    rows = layout.row([s for s, _ in spans]) if spans else []
    for row, span in zip(rows, spans, strict=True):
        out.setdefault(int(row), []).append(span)
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)

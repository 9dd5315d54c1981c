"""A linear-chain conditional random field over tokens: features, training, Viterbi.

Tokens are runs of letters, digits, `+/_-` and all bytes beyond ASCII. A token has one
feature of each family below; its score for a tag is the sum of their weights. Tags: O
outside, B begin, I inside a secret.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusq.llm.shingles import BASE, BASE_INVERSE, BYTE_VALUES, LOWER, mix, powers
from corpusq.llm.spans import DIGITS, LOWER_CASE, UPPER_CASE, Layout, byte_set, runs

OUTSIDE, BEGIN, INSIDE = range(3)

CLASS = np.zeros(256, np.uint8)                     # bit of each byte class
CLASS[byte_set(LOWER_CASE)] = 1
CLASS[byte_set(UPPER_CASE)] = 2
CLASS[byte_set(DIGITS)] = 4
CLASS[byte_set(b"+/_-")] = 8
CLASS[128:] = 16
IN_TOKEN = CLASS > 0
LENGTHS = np.array([2, 4, 8, 12, 16, 20, 32, 40, 64])
TURNS = np.array([1, 3, 6])
HASHED = 2048

# Families: width of each. shape*length*turns, gap before, gap after, three word hashes,
# shape and length of the next token, the file; and coarser ones for shapes that are rare:
# length and turns, length and whether digits and letters mix.
WIDTHS = [32 * 10 * 4, 16, 16, HASHED, HASHED, HASHED, 32 * 10, 16, 10 * 4, 10 * 4]
WORDS = 3, 4, 5         # the families of word hashes
GAPS = 1, 2             # what stands between a token and its neighbours
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])
FEATURES = int(OFFSETS[-1])


@dataclass
class Tokens:
    start: np.ndarray       # byte positions
    end: np.ndarray
    row: np.ndarray
    features: np.ndarray    # (families, tokens), numbers of the features


def tokens_of(layout: Layout) -> Tokens:
    data = layout.data
    start, end = runs(IN_TOKEN[data])
    row = layout.row(start)
    n = len(start)
    if not n:
        return Tokens(start, end, row, np.zeros((len(WIDTHS), 0), np.int32))
    kind = CLASS[data]
    shape = np.bitwise_or.reduceat(kind, start)       # gaps add no bits: their class is 0
    size = end - start
    turn = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind[1:] != kind[:-1], out=turn[2:])
    turns = turn[end] - turn[start + 1]
    length = np.digitize(size, LENGTHS)
    form = shape.astype(np.int32) * 10 + length
    # what stands between neighbours: assignment sign, quote, line break, text border
    marks = np.zeros(256, np.uint8)
    marks[list(b":=")] = 1
    marks[list(b"\"'`")] = 2
    marks[list(b"\n\r")] = 4
    marks[0] = 8
    signs = np.concatenate([[0], np.where(IN_TOKEN[data], 0, marks[data]), [0]]).astype(np.uint8)
    gap = np.bitwise_or.reduceat(signs, np.concatenate([[0], end + 1]))   # before, ..., after
    gap[0] |= 8
    gap[-1] |= 8
    value = BYTE_VALUES[LOWER[data]] * powers(BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    word = mix((total[end] - total[start]) * powers(BASE_INVERSE, len(data))[start])
    word = (word % np.uint64(HASHED - 1)).astype(np.int32) + 1
    word[(shape & 4) > 0] = 0                         # words with digits are not remembered
    after = np.append(form[1:], 0)
    before = np.concatenate([[0], word[:-1]])
    before2 = np.concatenate([[0, 0], word[:-2]])[:n]
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == 4, out=digits[1:])
    code = np.zeros(len(data) + 1, np.int32)
    np.cumsum(byte_set(b"{};=<>()[]")[data], out=code[1:])
    long = np.maximum(np.diff(layout.at), 1)
    share = lambda c: np.digitize(
        (c[layout.at[1:]] - c[layout.at[:-1]]) / long, [0.005, 0.02, 0.08])
    file = (share(digits) * 4 + share(code))[row]
    turned = np.digitize(turns, TURNS)
    mixed = ((shape & 4) > 0) * 2 + ((shape & 19) > 0)
    families = [form * 4 + turned, gap[:-1], gap[1:], word, before, before2, after, file,
                length * 4 + turned, length * 4 + mixed]
    return Tokens(start, end, row, np.stack(
        [f.astype(np.int32) + np.int32(o) for f, o in
         zip(families, OFFSETS[:-1], strict=True)]))


@dataclass
class Model:
    weights: np.ndarray     # (features, 3)
    moves: np.ndarray       # (3, 3): from tag, to tag

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        for family in features:
            out += self.weights[family]
        return out

    def decode(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Tags of the best path of every text (Viterbi).

        Where O leads by more than any two moves can win back, every best path goes through
        O, and the path falls into independent parts there: only what lies between such
        tokens is decoded, all stretches side by side.
        """
        lead = scores[:, 0] - scores[:, 1:].max(1)
        bound = 2 * float(self.moves.max() - self.moves.min())
        tags = np.zeros(len(scores), np.int8)
        open_at = np.flatnonzero(lead <= bound)
        if not len(open_at):
            return tags
        new = np.ones(len(open_at), bool)
        new[1:] = (np.diff(open_at) > 1) | (np.diff(row[open_at]) > 0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(open_at)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        begin = open_at[first]
        fixed = (begin > 0) & (row[np.maximum(begin - 1, 0)] == row[begin])
        best = scores[begin] + np.where(fixed[:, None], self.moves[OUTSIDE], 0)
        came = np.zeros((len(open_at), 3), np.int8)
        held = np.zeros((len(open_at), 3), np.float32)
        held[first] = best
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))
            steps = best[:live, :, None] + self.moves[None]
            came[first[:live] + t] = steps.argmax(1)
            best = steps.max(1) + scores[begin[:live] + t]
            held[first[:live] + t] = best
        last = first + size - 1
        behind = open_at[last] + 1
        inner = (behind < len(scores)) & (row[np.minimum(behind, len(row) - 1)] == row[begin])
        close = held[last] + np.where(inner[:, None], self.moves[:, OUTSIDE], 0)
        tag = close.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            at = np.minimum(first[:live] + t, last[:live])
            here = t < size[:live]
            tags[open_at[at[here]]] = tag[:live][here]
            tag[:live][here] = came[at[here], tag[:live][here]]
        return tags


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, length, 3) and expected moves (3, 3) of sequences of equal length."""
    n, length, _ = scores.shape
    ahead = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        s = ahead[:, t - 1, :, None] + moves
        top = s.max(1, keepdims=True)
        ahead[:, t] = np.log(np.exp(s - top).sum(1)) + top[:, 0] + scores[:, t]
    back = np.zeros_like(scores)
    for t in range(length - 2, -1, -1):
        s = moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :]
        top = s.max(2, keepdims=True)
        back[:, t] = np.log(np.exp(s - top).sum(2)) + top[..., 0]
    top = ahead[:, -1].max(1, keepdims=True)
    norm = np.log(np.exp(ahead[:, -1] - top).sum(1)) + top[:, 0]
    marginal = np.exp(ahead + back - norm[:, None, None])
    joint = np.exp(ahead[:, :-1, :, None] + moves
                   + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - norm[:, None, None, None])
    return marginal, joint.sum((0, 1))


def train(features: np.ndarray, tags: np.ndarray, rounds: int = 12, rate: float = 0.3,
          decay: float = 1e-3, batch: int = 512, hide: float = 0.5, seed: int = 5) -> Model:
    """Fit on sequences of equal length, (families, n, length) and (n, length), by Adagrad on
    the log-likelihood, `batch` sequences at a time.

    Words and signs give away the secrets that follow a known word; in a share `hide` of the
    sequences of each round words are hidden, and in another one signs, so that shape and
    length alone must tell as well.
    """
    n = len(tags)
    dice = np.random.default_rng(seed)
    weights, moves = np.zeros((FEATURES, 3), np.float32), np.zeros((3, 3), np.float32)
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    truth_of = np.eye(3, dtype=np.float32)
    for turn in range(rounds):
        order = dice.permutation(n)
        for begin in range(0, n, batch):
            rows = order[begin:begin + batch]
            own = features[:, rows].copy()
            for families in (WORDS, GAPS):
                hidden = dice.random(len(rows)) < hide
                for family in families:
                    own[family, hidden] = OFFSETS[family]
            part = tags[rows]
            size, length = part.shape
            flat = own.reshape(len(own), -1)
            scores = sum(weights[f] for f in flat).reshape(size, length, 3)
            marginal, joint = forward_backward(scores, moves)
            off = (truth_of[part] - marginal).reshape(-1, 3)
            actual = np.zeros((3, 3), np.float32)
            np.add.at(actual, (part[:, :-1].ravel(), part[:, 1:].ravel()), 1)
            used, place = np.unique(flat, return_inverse=True)
            place = place.reshape(flat.shape)
            slope = np.zeros((len(used), 3), np.float32)
            for f in place:
                for k in range(3):
                    slope[:, k] += np.bincount(f, off[:, k], len(used))
            slope = slope / size - decay * weights[used]
            seen_w[used] += slope ** 2
            weights[used] += rate * slope / np.sqrt(seen_w[used])
            step = (actual - joint) / size - decay * moves
            seen_m += step ** 2
            moves += rate * step / np.sqrt(seen_m)
    return Model(weights, moves)

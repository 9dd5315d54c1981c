"""Phrase collocations: mergeable Misra-Gries summaries find what may be frequent, a second
pass counts it exactly.

Phrases are hashed; the leading bits of the hash name one of a number of hash partitions. Each
task sums up equal phrases of a few million occurrences and sends every partition a summary of
its own. Summaries are merged one partition at a time. A summary with more than twice its
capacity is cut down: the count ranking just below capacity is taken off all counters, and those
at zero go. The capacity of all partitions together exceeds the mass (occurrences of phrases)
divided by the threshold, so what was taken off stays below the threshold and every frequent
phrase survives; the amount is tracked, and never let past that.

Survivors are kept as bits of a filter of bounded size. It may let other phrases through too,
never fewer: the second pass counts what passes exactly, as strings. Words and pairs are
summarised first; of longer phrases only those whose pairs all survive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.llm.arrow_text import slices, utf8
from corpusq.llm.shingles import BASE, BASE_INVERSE, BYTE_VALUES, LOWER, constants, mix, powers
from corpusq.session import keep

LONGEST = 5
LEAST = 100                 # occurrences of a candidate
TOP = 2000                  # phrases reported for each language
UNKNOWN = "und"
COUNTERS = 1 << 17          # of one hash partition, about
FLUSH = 1 << 22             # occurrences a task sums up before it sends them
SLICE = 2 << 20
FILTER_BITS = 16, 28        # least and greatest size of a filter, as powers of two: 32 MB
HELD = 200_000              # exact counts a task holds before it sends them

SPLIT = np.zeros(256, bool)
SPLIT[[*b".,;:!?", *range(10, 14)]] = True
GAP = SPLIT.copy()
GAP[[9, 32]] = True
PLACES = constants(21, LONGEST)
KINDS = constants(22, LONGEST + 1)

SUMMARY = "part int, mass bigint, one binary, many binary, times binary"
_SUMMARY = pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("one", pa.binary()),
                      ("many", pa.binary()), ("times", pa.binary())])
COUNTS = "lang string, phrase string, k int, c bigint"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()),
                     ("c", pa.int64())])


class Words:
    """Words of some texts: hash, piece, first byte and end, salted by language."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, at = utf8(texts)
        self.data = LOWER[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        inside = ~GAP[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(BASE, n), out=total[1:])
        word = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, n)[self.start]
        self.piece = np.cumsum(SPLIT[data] | edge[:n])[self.start]
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.langs = langs
        coded = pc.dictionary_encode(langs)
        self.names = coded.dictionary.to_pylist()
        salts = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.names], np.uint64)
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[self.row].astype(np.int64)
        self.word = mix(word) ^ salts[self.lang] if len(self.names) else word

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words inside a piece, and the number of its first word."""
        many = max(len(self.word) - k + 1, 0)
        if not many:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.piece[:many] == self.piece[k - 1:])
        value = np.full(len(first), KINDS[k], np.uint64)
        for i in range(k):
            value += self.word[first + i] * PLACES[i]
        return mix(value), first


class Filter:
    """A set of hashes as bits; knows more hashes than were put in, never fewer."""

    def __init__(self, bits: np.ndarray, power: int):
        self.bits, self.power = bits, power

    def holds(self, value: np.ndarray) -> np.ndarray:
        at = value >> np.uint64(64 - self.power)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)]
                >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def longer(words: Words, pairs: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, first words) of longer phrases all of whose pairs pass the filter."""
    value, first = words.grams(2)
    good = np.zeros(len(words.word) + 1, bool)
    good[first[pairs.holds(value)]] = True
    for k in range(3, LONGEST + 1):
        value, first = words.grams(k)
        on = good[first]
        for i in range(1, k - 1):
            on &= good[first + i]
        yield k, value[on], first[on]


def parted(value: np.ndarray, parts_power: int) -> pa.RecordBatch:
    """Summaries, one for each hash partition, of some hashes: 32 further bits of those that
    occur once, and of the others with their counts."""
    value = np.sort(value)
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(value)))
    value = value[first]
    parts = 1 << parts_power
    edges = np.searchsorted(value >> np.uint64(64 - parts_power) if parts_power else
                            np.zeros(len(value), np.uint64), np.arange(parts + 1))
    mark = ((value << np.uint64(parts_power)) >> np.uint64(32)).astype(np.uint32)
    rows = []
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b:
            continue
        once = times[a:b] == 1
        rows.append((p, int(times[a:b].sum()), mark[a:b][once].tobytes(),
                     mark[a:b][~once].tobytes(), times[a:b][~once].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5,
                                             _SUMMARY, strict=True)], schema=_SUMMARY)


def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        done = 0
        for part in slices(texts, SLICE):
            yield Words(langs.slice(done, len(part)), part)
            done += len(part)


def summaries(docs: DataFrame, parts_power: int, pairs: Filter | None) -> DataFrame:
    """Summaries of words and pairs, or with `pairs` of longer phrases."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words in worded(batches):
            found = ([words.grams(k)[0] for k in (1, 2)] if pairs is None
                     else [value for _, value, _ in longer(words, pairs)])
            held += found
            size += sum(map(len, found))
            if size >= FLUSH:
                yield parted(np.concatenate(held), parts_power)
                held, size = [], 0
        if size:
            yield parted(np.concatenate(held), parts_power)
    return docs.select("lang", "text").mapInArrow(work, SUMMARY)


class MisraGries:
    """One hash partition's counters. `error` is what has been taken off each count."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least = capacity, least
        self.mark, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.error = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.queued = 0

    def add(self, mark: np.ndarray, times: np.ndarray) -> None:
        self.waiting.append((mark, times))
        self.queued += len(mark)
        if self.queued > max(2 * self.capacity, len(self.mark)):
            self.merge()

    def merge(self) -> None:
        mark = np.concatenate([self.mark, *[m for m, _ in self.waiting]])
        times = np.concatenate([self.times, *[t for _, t in self.waiting]])
        self.waiting, self.queued = [], 0
        order = np.argsort(mark, kind="stable")
        mark, times = mark[order], times[order]
        new = np.ones(len(mark), bool)
        new[1:] = mark[1:] != mark[:-1]
        first = np.flatnonzero(new)
        self.mark = mark[first]
        self.times = np.add.reduceat(times, first) if len(first) else times
        if len(self.mark) > 2 * self.capacity:
            nth = len(self.times) - self.capacity - 1
            cut = min(int(np.partition(self.times, nth)[nth]), self.least - 1 - self.error)
            left = self.times > cut
            self.mark, self.times = self.mark[left], self.times[left] - cut
            self.error += cut

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.mark[self.times + self.error >= self.least]


def merged(summed: DataFrame, parts_power: int, power: int, capacity: int, least: int,
           tasks: int) -> Filter:
    """The filter of what survives. Each partition's piece of it, bits // partitions, comes to
    the driver; the whole has at most 2 ** FILTER_BITS[1] bits."""
    inner = power - parts_power

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            bits = np.zeros(1 << inner, bool)
            bits[state.survivors() >> np.uint32(32 - inner)] = True
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()),
                                               pa.array([packed], pa.binary())],
                                              ["part", "bits"])
        for batch in batches:
            part, _, one, many, times = batch.columns
            for i in range(batch.num_rows):
                p = part[i].as_py()
                if p != now:
                    if state:
                        yield done()
                    now, state = p, MisraGries(capacity, least)
                single = np.frombuffer(one[i].as_buffer(), np.uint32)
                state.add(single, np.ones(len(single), np.int64))
                state.add(np.frombuffer(many[i].as_buffer(), np.uint32),
                          np.frombuffer(times[i].as_buffer(), np.uint32).astype(np.int64))
        if state:
            yield done()

    found = summed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(
        work, "part int, bits binary").collect()
    bits = np.zeros(1 << (power - 3), np.uint8)
    for r in found:
        size = 1 << (inner - 3)
        bits[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, power)


def parts_of(capacity: int, counters: int) -> int:
    """Hash partitions, as a power of two, that share so many counters."""
    return max(5, (capacity // counters).bit_length())


def survivors(docs: DataFrame, mass: int, least: int, counters: int,
              pairs: Filter | None = None) -> Filter:
    """`mass` is a bound on the occurrences; capacity exceeds mass / least."""
    capacity = mass // least + 1
    parts_power = parts_of(capacity, counters)
    power = min(max((16 * capacity).bit_length(), FILTER_BITS[0], parts_power + 3), FILTER_BITS[1])
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return merged(summaries(docs, parts_power, pairs), parts_power, power,
                  (capacity >> parts_power) + 1, least, min(tasks, 1 << parts_power))


class Counts:
    """Exact counts a task holds, by (language, hash partition)."""

    def __init__(self):
        self.held: dict[tuple[str, int], dict[bytes, int]] = {}
        self.size = 0

    def add(self, lang: str, part: int, phrase: bytes, times: int) -> None:
        own = self.held.setdefault((lang, part), {})
        before = len(own)
        own[phrase] = own.get(phrase, 0) + times
        self.size += len(own) - before

    def sent(self) -> pa.RecordBatch:
        keys = list(self.held)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.int32()),
             pa.array([b"\n".join(self.held[k]) for k in keys], pa.binary()),
             pa.array([np.fromiter(self.held[k].values(), np.int64).tobytes() for k in keys],
                      pa.binary())], ["lang", "part", "phrases", "times"])
        self.__init__()
        return batch


def exact_counts(docs: DataFrame, short: Filter, long: Filter, least: int, parts_power: int
                 ) -> DataFrame:
    """(lang, phrase, k, c): exact counts of the phrases that pass the filters and occur
    `least` times; and with k = 0 the number of words of each language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for words in worded(batches):
            found = [(k, *words.grams(k), short) for k in (1, 2)]
            found += [(k, *g, long) for k, *g in longer(words, short)]
            for code, times in enumerate(np.bincount(words.lang, minlength=len(words.names))):
                held.add(words.names[code], 0, b"", int(times))
            raw = words.data.tobytes()
            for k, value, first, kept in found:
                on = kept.holds(value)
                value, at, times = np.unique(value[on], return_index=True, return_counts=True)
                at = first[on][at]
                part = (value >> np.uint64(64 - parts_power)).tolist()
                begin, end = words.start[at].tolist(), words.end[at + k - 1].tolist()
                for b, e, code, p, c in zip(begin, end, words.lang[at].tolist(), part,
                                            times.tolist(), strict=True):
                    held.add(words.names[code], p, b" ".join(raw[b:e].split()), c)
            if held.size >= HELD:
                yield held.sent()
        if held.size:
            yield held.sent()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Counter()

        def done() -> pa.RecordBatch:
            kept = [(p, c) for p, c in own.items() if c >= least or not p]
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(kept), pa.string()),
                 pa.array([p.decode() for p, _ in kept], pa.string()),
                 pa.array([p.count(b" ") + 1 if p else 0 for p, _ in kept], pa.int32()),
                 pa.array([c for _, c in kept], pa.int64())], schema=_COUNTS)

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch["lang"][i].as_py(), batch["part"][i].as_py()
                if key != now:
                    if own:
                        yield done()
                    now, own = key, Counter()
                own.update(dict(zip(batch["phrases"][i].as_py().split(b"\n"), np.frombuffer(
                    batch["times"][i].as_py(), np.int64).tolist(), strict=True)))
        if own:
            yield done()

    sent = docs.select("lang", "text").mapInArrow(
        count, "lang string, part int, phrases binary, times binary")
    return sent.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(
        total, COUNTS)


def joined(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate: the cut that scores lowest counts."""
    words = F.split("phrase", " ")
    size = counts.where("k = 0").select("lang", F.col("c").alias("n"))
    parts = counts.where("k > 0").select("lang", "phrase", F.col("c"))
    cuts = counts.where("k > 1").select(
        "lang", "phrase", F.col("k").alias("len"), F.col("c").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("k")).select(
        "*", joined(words, 1, F.col("k")).alias("left"),
        joined(words, F.col("k") + 1, F.col("len") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")),
                     ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")),
                     ["lang", "right"]).join(size, "lang")
    # products of up to 38 digits; the quotient is below 10 n
    score = F.expr("""(CAST(a AS DECIMAL(15,0)) * CAST(1000 AS DECIMAL(4,0))
                       * CAST(n AS DECIMAL(18,0)))
                      div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))""")
    return cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"),
        F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("s")
    ).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer candidate that a phrase of two
    words or more lies in."""
    words = F.split("phrase", " ")
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: joined(words, i, m))))
    return counts.where("k > 2").select("lang", F.col("c"), F.explode(subs).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("c").alias("longer"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                 least: int = LEAST, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    A-Z are lower-cased, texts split at `[.,;:!?\\x0A-\\x0D]` into pieces, pieces at blanks and
    tabs into words. Phrases of 2 to 5 words that occur `least` times or more are candidates; one
    inside a longer candidate that occurs as often is left out. A null text is empty, a null
    language `und`; both, and empty tables, are no error. Repeated rows count each. Other columns
    are not looked at.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    # a word takes two bytes with what follows it: words and pairs are at most `size`
    short = survivors(docs, size, least, counters)
    long = survivors(docs, size * 3 // 2, least, counters, short)
    counts = keep(exact_counts(docs, short, long, least, parts_of(size // least + 1, counters)))
    rows = scored(counts).join(inside_longer(counts), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
        F.col("score").cast("bigint").alias("score"))

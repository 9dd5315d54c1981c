"""Suffix-array dedup: every byte that a repeated string of WIDTH bytes covers is removed.

A suffix array over all bytes would move rows for every byte of the corpus several times over.
Here the sampled suffixes are chosen by content instead of by position modulo three: of each
REACH consecutive positions the one whose next GRAM bytes hash lowest (its leftmost) is sampled.
As with a difference cover, equal strings of WIDTH bytes hold a sampled position at the same
place, whatever their own places are; but only about one byte in 32 is sampled. The positions
from which one sample is the first one needed form a unit.

1. Samples whose next CORE bytes occur nowhere else (a filter by hashes, which lets through all
   that repeat) cannot lie in a repeated string and are left out.
2. Units that occur as a whole more than once get one name: all their strings repeat, and one of
   them stands for all from here on. The others, at the edges of what repeats, remain.
3. The sampled suffixes of the remaining units, and of named ones that share a core with them,
   are sorted: the suffix array of the sample, to the depth that matters. Adjacent prefixes are
   compared; those that agree for d bytes are a run of the array, whose start names them at
   that depth.
4. The suffixes that are not sampled are merged in: each is its bytes up to the next sample and
   the name of that sample's suffix at the depth that completes WIDTH bytes. It repeats if
   another one has the same pair.

Sorting is by ranges with ties broken by a hash, so equal suffixes may fill many tasks; one
short row a range carries the runs that cross from one into the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.arrow_text import slices, utf8
from corpusq.llm.phrases import SUMMARY, Filter, parted
from corpusq.llm.phrases import merged as several
from corpusq.llm.shingles import constants, mix, powers
from corpusq.session import cut_lineage, keep

WIDTH = 200
REACH = 64                      # a power of two
GRAM = 16
CORE = WIDTH - REACH + 1        # bytes after a sample that every string with it holds
RANGE_ROWS = 50_000             # suffixes sorted in one task
FILTER_BITS = 18, 28
# At edges of ranges: lengths of beginnings compared first, hash partitions of these, counters.
GRID = 2, 4, 8, 16, 32, 48
EDGE_PARTS, EDGE_KEYS = 5, 1 << 20

BASES = constants(31, 2)
BYTES = constants(32, 512).reshape(2, 256)
LEFT = constants(33, REACH)

UNITS = "tk1 bigint, tk2 bigint, x bigint, lo bigint, hi bigint, core bigint, b1 bigint, b2 bigint"
SUFFIXES = ("many boolean, tk1 bigint, tk2 bigint, x bigint, lo bigint, hi bigint, "
            "right binary, left binary")
FOUND = "tk1 bigint, tk2 bigint, lo bigint, hi bigint, cls bigint, len int, head bigint, w int"


class Prints:
    """Hashes of any part of some bytes."""

    def __init__(self, data: np.ndarray, number: int):
        base = BASES[number]
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[number][data] * powers(base, len(data)), out=self.total[1:])
        self.back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.total[end] - self.total[start]) * self.back[start]
        return mix(value + (end - start).astype(np.uint64))


def units(data: np.ndarray, at: np.ndarray, prints: Prints, width: int = WIDTH
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, sample, first and last start of each unit, in order; as positions in `data`."""
    n = len(data) - GRAM + 1
    nothing = np.zeros(0, np.int64)
    if len(data) < width:
        return (nothing,) * 4
    total, back = prints.total, prints.back
    low = (total[GRAM:] - total[:n]) * back[:n]
    low ^= low >> np.uint64(29)
    low *= np.uint64(0xBF58476D1CE4E5B9)
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(n, dtype=np.uint64)
    step = 1
    while step < REACH:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    many = len(data) - width + 1
    sample = (low[:many] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(many + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= width)
    inside[at[long]] += 1
    inside[at[long + 1] - width + 1] -= 1
    inside = np.cumsum(inside[:many], dtype=np.int8) > 0
    edge = np.zeros(many, bool)
    edge[at[long]] = True
    new = inside.copy()
    new[1:] &= (sample[1:] != sample[:-1]) | edge[1:]
    lo = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    hi = np.flatnonzero(last)
    return np.searchsorted(at, lo, "right") - 1, sample[lo], lo, hi


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("tk1"), F.xxhash64(F.lit(1), text).alias("tk2")]


def repeated_cores(texts: DataFrame) -> Filter:
    """A filter, of bounded size, of the hashes of cores that occur more than once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                data, at = utf8(part)
                prints = Prints(data, 0)
                _, x, _, _ = units(data, at, prints)
                core = prints.of(x, x + CORE)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], ["core"])

    cores = keep(texts.select("text").mapInArrow(work, "core bigint").groupBy("core").agg(
        F.count(F.lit(1)).alias("c")).where("c > 1").select("core"))
    return hash_filter(cores)


def hash_filter(hashes: DataFrame) -> Filter:
    """A filter, of bounded size, of a written table of one column of hashes."""
    hashed = F.col(hashes.columns[0])
    power = min(max((32 * hashes.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    # numbers from 1 on fill buckets from 1 on, each of 32768 bits
    bit = F.shiftrightunsigned(hashed, 64 - power) + 1
    chunks = hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    held = np.zeros(((1 << power) // 32768, 4096), np.uint8)
    for r in chunks:
        held[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return Filter(held.reshape(-1), power)


def may_hold(keys: Filter, hashed: Column) -> Column:
    """Whether a hash may be one of the filter's: true for all that are."""
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(keys.holds(batch.to_numpy().view(np.uint64)))
    return holds(hashed)


def candidate_units(texts: DataFrame, cores: Filter) -> DataFrame:
    """Units whose core may repeat, with 128 bits for the whole unit and its place in it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (1, 2)]
            done = 0
            for part in slices(batch.column(0)):
                data, at = utf8(part)
                prints = Prints(data, 0)
                row, x, lo, hi = units(data, at, prints)
                core = prints.of(x, x + CORE)
                on = cores.holds(core)
                row, x, lo, hi, core = row[on], x[on], lo[on], hi[on], core[on]
                place = ((x - lo) * WIDTH + (hi - lo)).astype(np.uint64)
                blocks = [mix(p.of(lo, hi + WIDTH) + mix(place))
                          for p in (prints, Prints(data, 1) if len(x) else prints)]
                start = at[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[done + row]) for k in keys]
                    + [pa.array(v) for v in (x - start, lo - start, hi - start)]
                    + [pa.array(v.view(np.int64)) for v in (core, *blocks)],
                    [c.split()[0] for c in UNITS.split(", ")])
                done += len(part)
    return texts.select("text", "tk1", "tk2").mapInArrow(work, UNITS)


def suffixes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around the samples of the wanted units (many, tk1, tk2, x, lo, hi)."""
    lists = keep(wanted.groupBy("tk1", "tk2").agg(
        F.collect_list(F.struct("many", "x", "lo", "hi")).alias("list")))
    # texts that hold none of the units stay where they are
    texts = texts.where(may_hold(hash_filter(lists.select("tk1")), F.col("tk1")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()                    # copies of a text hold the same units
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if keys in seen:
                    continue
                seen.add(keys)
                own = pa.RecordBatch.from_struct_array(batch.column(3)[i].values)
                many, x, lo, hi = own.columns
                data = memoryview(batch.column(2)[i].as_buffer())
                spans = list(zip(x.to_pylist(), lo.to_pylist(), hi.to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [many, *[pa.array([k] * len(x), pa.int64()) for k in keys], x, lo, hi,
                     pa.array([bytes(data[s:e + WIDTH]) for s, _, e in spans], pa.binary()),
                     pa.array([bytes(data[b:s]) for s, b, _ in spans], pa.binary())],
                    [c.split()[0] for c in SUFFIXES.split(", ")])
    return texts.join(lists, ["tk1", "tk2"]).select("tk1", "tk2", "text", "list").mapInArrow(
        work, SUFFIXES)


def _matrix(values: pa.Array, width: int, right_aligned: bool = False
            ) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of equal width, and their lengths."""
    values = values.cast(pa.large_binary())
    _, offsets, held = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(held or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    size = np.diff(at)
    out = np.zeros((len(size), width), np.uint8)
    column = np.arange(len(data)) - np.repeat(at[:-1], size)
    if right_aligned:
        column += width - np.repeat(size, size)
    out[np.repeat(np.arange(len(size)), size), column] = data
    return out, size


def agreement(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings in equal rows."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(size_a, size_b))


class Suffixes:
    """The sorted suffixes of one range. Depths run from CORE to WIDTH."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        col = {c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type)
               for c in table.column_names}
        self.many = col["many"].to_numpy(zero_copy_only=False)
        self.tk1, self.tk2 = col["tk1"].to_numpy(), col["tk2"].to_numpy()
        self.x, self.lo, self.hi = (col[c].to_numpy() for c in ("x", "lo", "hi"))
        self.right, self.size = _matrix(col["right"], WIDTH)
        self.left, _ = _matrix(col["left"], REACH, right_aligned=True)
        self.common = np.zeros(len(self.x), np.int64)
        self.common[1:] = agreement(self.right[1:], self.right[:-1], self.size[1:], self.size[:-1])

    def starts(self, depth: int) -> np.ndarray:
        """First row of each row's run of suffixes that agree for `depth` bytes."""
        at = np.arange(len(self.common))
        return np.maximum.accumulate(np.where(self.common < depth, at, 0))


def ranges(ordered: DataFrame) -> np.ndarray:
    """(ranges, depths): name of the run that enters each range at each depth, or -1.

    One row a range comes to the driver: its first and last suffix and where its last runs
    begin."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            own = Suffixes([b.drop_columns(["part"]) for b in held])
            last = [int(own.starts(d)[-1]) for d in range(CORE, WIDTH + 1)]
            text = lambda i: own.right[i][:own.size[i]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(b for b in held if b.num_rows)["part"][0].as_py()], pa.int32()),
                 pa.array([text(0)], pa.binary()), pa.array([text(-1)], pa.binary()),
                 pa.array([last], pa.list_(pa.int64()))], ["part", "first", "last", "runs"])
    met = {r["part"]: r for r in ordered.mapInArrow(
        work, "part int, first binary, last binary, runs array<bigint>").collect()}
    depths = np.arange(CORE, WIDTH + 1)
    enter = np.full((max(met, default=-1) + 2, len(depths)), -1, np.int64)
    leave, before = np.full(len(depths), -1, np.int64), b""
    for part in sorted(met):
        r = met[part]
        first = np.frombuffer(r["first"], np.uint8)
        n = min(len(first), len(before))
        differ = np.flatnonzero(first[:n] != np.frombuffer(before, np.uint8)[:n])
        common = int(differ[0]) if len(differ) else n
        enter[part] = np.where(common >= depths, leave, -1)
        runs = np.array(r["runs"])
        leave = np.where((runs == 0) & (enter[part] >= 0), enter[part], (part << 32) + runs)
        before = r["last"]
    return enter


def grouped(rows: np.ndarray, start: np.ndarray, value: np.ndarray, weight: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by (start, value), the group of each, and the weight of every group."""
    order = rows[np.lexsort((value[rows], start[rows]))]
    new = np.ones(len(order), bool)
    new[1:] = (start[order][1:] != start[order][:-1]) | (value[order][1:] != value[order][:-1])
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group, weight[order]).astype(np.int32)


class Edges:
    """The rows of one range whose core occurs in other ranges as well, and how their core's
    run is called in all of them."""

    def __init__(self, own: Suffixes, part: int, enter: np.ndarray, leaving: set[int]):
        self.core = own.starts(CORE)
        entered = enter[part, 0] >= 0
        self.on = np.zeros(len(own.x), bool)
        if entered:
            self.on |= self.core == 0
        if part in leaving:
            self.on |= self.core == self.core[-1]
        name = (part << 32) + self.core
        self.name = np.where(self.core == 0, enter[part, 0], name) if entered else name

    def keys(self, rows: np.ndarray, l: int, value: np.ndarray) -> np.ndarray:
        """Stands for the core's run and the `l` bytes before the sample."""
        return mix(value[rows] + mix(self.name[rows].astype(np.uint64) * np.uint64(REACH)
                                     + np.uint64(l)))


def heads(own: Suffixes) -> Iterator[np.ndarray]:
    """Hash of the 0, 1, 2, ... bytes before each sample."""
    head = np.zeros(len(own.x), np.uint64)
    for l in range(REACH):
        if l:
            head = head + (own.left[:, REACH - l].astype(np.uint64) + np.uint64(1)) * LEFT[l]
        yield mix(head)


def shared_edges(ordered: DataFrame, enter: np.ndarray, leaving: set[int]) -> Filter:
    """A filter of the edges' beginnings that several rows share, whatever their range: if
    nothing else with that core has the same l bytes before it, no longer string repeats."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        part = next(b for b in held if b.num_rows)["part"][0].as_py()
        own = Suffixes([b.drop_columns(["part"]) for b in held])
        edges = Edges(own, part, enter, leaving)
        found = [np.zeros(0, np.uint64)]
        for l, value in enumerate(heads(own)):
            rows = np.flatnonzero(edges.on & (own.x - own.lo >= l)) if l in GRID else []
            if len(rows):
                order, group, total = grouped(rows, edges.core, value, np.ones(len(own.x)))
                one = order[np.append(True, np.diff(group) > 0)]
                found.append(np.repeat(edges.keys(one, l, value), np.minimum(total, 2)))
        value = np.concatenate(found)
        if len(value):
            yield parted(value, EDGE_PARTS)
    tasks = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return several(ordered.mapInArrow(work, SUMMARY), EDGE_PARTS, FILTER_BITS[1] - 4,
                   EDGE_KEYS, 2, min(tasks, 1 << EDGE_PARTS))


def merged(ordered: DataFrame, enter: np.ndarray, leaving: set[int], shared: Filter
           ) -> DataFrame:
    """What is known of the strings of units that are not `many`: starts lo to hi that repeat,
    or, where a run crosses ranges (cls is not null), the start lo = hi with the names that
    decide it, once for equal ones of a range. w = 2 says that the range has several of it, or
    one that is `many`; w = 1 that all depends on the other ranges."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        part = next(b for b in held if b.num_rows)["part"][0].as_py()
        own = Suffixes([b.drop_columns(["part"]) for b in held])
        n = len(own.x)
        edges = Edges(own, part, enter, leaving)
        crosses, alive = edges.on, np.ones(n, bool)
        repeats = np.zeros((n, REACH), bool)
        weight = np.where(own.many, 2, 1)
        for l, value in enumerate(heads(own)):
            if l in GRID:
                at = np.flatnonzero(crosses & alive & (own.x - own.lo >= l))
                alive[at] = shared.holds(edges.keys(at, l, value))
            on = (own.x - own.hi <= l) & (l <= own.x - own.lo)
            start = own.starts(WIDTH - l)
            inner = np.flatnonzero(on & ~crosses)
            if len(inner):
                order, group, total = grouped(inner, start, value, weight)
                repeats[order, l] = total[group] >= 2
            # alone in its run: no other suffix agrees for as many bytes
            first = start == np.arange(n)
            alone = first & np.append(first[1:], False)
            if enter[part, WIDTH - l - CORE] >= 0:
                alone[0] = False
            outer = np.flatnonzero(on & crosses & alive & ~alone)
            if len(outer):
                order, group, total = grouped(outer, start, value, weight)
                repeats[order, l] = total[group] >= 2
                one = order[np.append(True, np.diff(group) > 0)]
                name = (part << 32) + start[one]
                carried = enter[part, WIDTH - l - CORE]
                if carried >= 0:
                    name = np.where(start[one] == 0, carried, name)
                at = own.x[one] - l
                yield _found(own.tk1[one], own.tk2[one], at, at, name,
                             np.full(len(one), l, np.int32), value[one].view(np.int64),
                             np.minimum(total, 2))
        repeats &= ~own.many[:, None]
        marked = np.zeros((n, REACH + 2), np.int8)
        marked[:, 1:-1] = repeats
        turn = np.diff(marked, axis=1)
        row, first = np.nonzero(turn == 1)
        _, after = np.nonzero(turn == -1)
        yield _found(own.tk1[row], own.tk2[row], own.x[row] - after + 1, own.x[row] - first)
    return ordered.mapInArrow(work, FOUND)


def _found(tk1, tk2, lo, hi, *rest) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
    rest = rest or [pa.nulls(len(tk1), k) for k in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in (tk1, tk2, lo, hi)]
        + [r if isinstance(r, pa.Array) else pa.array(r, k)
           for r, k in zip(rest, kinds, strict=True)],
        [c.split()[0] for c in FOUND.split(", ")])


def repeated_starts(texts: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(tk1, tk2, lo, hi): ranges of starts of strings that occur more than once."""
    cands = keep(candidate_units(texts, repeated_cores(texts)))
    names = keep(cands.groupBy("b1", "b2").agg(
        F.count(F.lit(1)).alias("c"),
        F.min(F.struct("tk1", "tk2", "x", "lo", "hi", "core")).alias("u")))
    # equal places of equal texts are equal units, so that no exchange is needed to meet again
    whole = cands.join(names.where("c > 1").select("b1", "b2"), ["b1", "b2"], "left_semi").select(
        "b1", "b2", "tk1", "tk2", "lo", "hi").distinct().drop("b1", "b2")
    single = names.where("c = 1").select("u.*", F.lit(False).alias("many"))
    others = names.where("c > 1").select("u.*", F.lit(True).alias("many")).join(
        single.select("core").distinct(), "core", "left_semi")
    columns = ["many", "tk1", "tk2", "x", "lo", "hi"]
    rows = keep(suffixes(texts, single.select(columns).union(others.select(columns))))
    many = rows.count()
    if not many:
        return whole
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-many // range_rows))
    order = ["right", F.xxhash64("tk1", "tk2", "x")]
    ordered = cut_lineage(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    ordered = ordered.select("*", F.spark_partition_id().alias("part"))
    enter = ranges(ordered)
    entered = np.flatnonzero(enter[:, 0] >= 0).tolist()
    present = sorted(r[0] for r in ordered.select("part").distinct().collect())
    leaving = {a for a, b in zip(present, present[1:]) if b in entered}
    found = keep(merged(ordered, enter, leaving, shared_edges(ordered, enter, leaving)))
    sure = found.where("cls is null").select("tk1", "tk2", "lo", "hi")
    crossing = found.where("cls is not null")
    again = crossing.groupBy("cls", "len", "head").agg(F.sum("w").alias("n")).where(
        "n > 1").drop("n")
    late = crossing.where("w = 1").join(again, ["cls", "len", "head"], "left_semi").select(
        "tk1", "tk2", "lo", "hi")
    return whole.union(sure).union(late)


REMOVED = "struct<n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: binary>"
_REMOVED = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()),
                      ("kept_sha256", pa.string()), ("kept", pa.binary())])


def covered(lo: np.ndarray, hi: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings starting at lo to hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + width)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]


def without(text: Column, spans: Column, texts_too: bool) -> Column:
    @F.arrow_udf(REMOVED)
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for i in range(len(texts)):
                buffer = texts[i].as_buffer() if texts[i].is_valid else None
                data = memoryview(buffer) if buffer is not None else b""
                if not lists[i].is_valid:
                    out.append((0, 0, hashlib.sha256(data).hexdigest(),
                                bytes(data) if texts_too else None))
                    continue
                own = lists[i].values
                start, end = covered(own.field("lo").to_numpy(), own.field("hi").to_numpy())
                left, digest, done = [], hashlib.sha256(), 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(data[done:s])
                    if texts_too:
                        left.append(bytes(data[done:s]))
                    done = e
                digest.update(data[done:])
                out.append((int((end - start).sum()), len(start), digest.hexdigest(),
                            b"".join(left) + bytes(data[done:]) if texts_too else None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _REMOVED, strict=True)],
                fields=list(_REMOVED))
    return remove(text, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   texts_too: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with `texts_too` kept, the bytes
    that remain): one row per input row.

    A byte goes if a string of 200 bytes over it also starts elsewhere, in the same text or
    another one. Strings never cross texts. A null text is empty; nothing of a text below 200
    bytes goes. Rows that repeat an id, or have none, are texts of their own, and repeated rows
    remove one another. An empty table has no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *text_keys(text))
    found = repeated_starts(docs.select("text", "tk1", "tk2").where(
        F.octet_length("text") >= WIDTH), range_rows)
    spans = keep(found.groupBy("tk1", "tk2").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans")))
    # only texts that may have a span move to where the spans are
    on = may_hold(hash_filter(spans.select("tk1")), F.col("tk1"))
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    rows = docs.where(on).join(spans, ["tk1", "tk2"], "left").select(
        "doc_id", size, without(F.col("text"), F.col("spans"), texts_too).alias("r"))
    data = F.col("text").cast("binary")
    whole = docs.where(~on).select(
        "doc_id", size, F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"),
        *([data.alias("kept")] if texts_too else []))
    return rows.select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256",
                       *(["r.kept"] if texts_too else [])).union(whole)

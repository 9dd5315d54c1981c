"""Near-duplicates by MinHash with tensored banding.

A table key is a pair (left half, right half); each half is made of two minhashes out of one
of two small collections. With HALVES halves a side there are HALVES**2 tables from only
4 * HALVES minhashes. A pair of documents meets unless no left half or no right half agrees:
at similarity s that is at most 2 * (1 - s**2) ** HALVES, 2e-5 for s = 0.85 and nine halves.

Documents with equal shingle sets form one class and are searched once. Every candidate link
is confirmed on the full sets. Candidates are not all pairs of a bucket. First each member meets
one leader, and components of the confirmed links follow. Then, in rounds, members outside a
bucket's most frequent component meet a few of its members, as long as that links a good part
of them. Last, all members of different components meet. Inside a component nothing is left
to find, so no component is lost by this.

Groups of texts that are alike, but not enough, would make very many candidates. A sketch of
1024 bits holds the parity of the number of shingles in each bin; two sketches differ in no
more bits than the sets have different shingles. Pairs whose sketches differ in more bits than
the similarity allows are left out inside the join that finds them: that is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.llm.arrow_text import by_slice
from corpusq.llm.components import connected_components
from corpusq.llm.shingles import WIDTH, constants, mix, shingle_set, shingle_sets
from corpusq.session import cut_lineage

HALVES = 9
PERCENT = 85
# Ids sent to every executor at most (16 bytes each there); beyond, texts are shuffled.
BROADCAST_IDS = 1_000_000
TRIALS = 4              # members of the main component that an outsider meets in a round
LEAST_GAIN = 0.1        # share of outsiders a round must link for another one to follow

SKETCH_BITS = 1024
SKETCH_WORDS = SKETCH_BITS // 64

SIGNATURE = ("struct<n: bigint, fp1: bigint, fp2: bigint, "
             "left: array<bigint>, right: array<bigint>, sketch: array<bigint>>")
_KIND = pa.struct([("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
                   ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())),
                   ("sketch", pa.list_(pa.int64()))])


def _signatures(texts: pa.Array, halves: int, width: int) -> pa.Array:
    value, at = shingle_sets(texts, width)
    size = np.diff(at)
    has = np.flatnonzero(size)
    seeds = constants(11, 8 * halves).reshape(4 * halves, 2)
    prints = np.zeros((2, len(size)), np.uint64)
    keys = np.zeros((2 * halves, len(size)), np.uint64)
    if len(has):
        starts = at[has]
        for k, salt in enumerate(constants(12, 2)):
            prints[k, has] = np.add.reduceat(mix(value + salt), starts)
        for k in range(2 * halves):
            for flip, factor in seeds[2 * k:2 * k + 2]:
                low = np.minimum.reduceat((value ^ flip) * factor, starts)
                keys[k, has] = mix(keys[k, has] + low + np.uint64(k))
    order = keys.T.view(np.int64)
    bins = (value >> np.uint64(20)).astype(np.int64) % SKETCH_BITS
    bins += np.repeat(np.arange(len(size)), size) * SKETCH_BITS
    odd = (np.bincount(bins, minlength=len(size) * SKETCH_BITS) & 1).astype(np.uint8)
    sketch = np.packbits(odd).view(np.int64)
    lists_at = pa.array(np.arange(len(size) + 1) * SKETCH_WORDS, pa.int32())
    rows = np.where(size > 0, halves, 0)
    bounds = pa.array(np.concatenate([[0], np.cumsum(rows)]), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(
        order[has][:, side]).ravel())) for side in (slice(0, halves), slice(halves, None))]
    return pa.StructArray.from_arrays(
        [pa.array(size, pa.int64()), *[pa.array(p.view(np.int64)) for p in prints], *lists,
         pa.ListArray.from_arrays(lists_at, pa.array(sketch))],
        fields=list(_KIND))


def signature(text: Column, halves: int = HALVES, width: int = WIDTH) -> Column:
    """Set size, a 128-bit fingerprint of the set, the two collections of half keys, and the
    parity sketch."""
    @F.arrow_udf(SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_slice(texts, lambda part: _signatures(part, halves, width), _KIND)
    return sign(text)


def sizes_allow(n: Column, m: Column, percent: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def sketches_allow(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets with these sketches can reach the similarity. At similarity s sets of n and m
    members differ in (n + m) * (1 - s) / (1 + s) members at most."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
                 for i in range(1, SKETCH_WORDS)),
                F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def table_keys(reps: DataFrame) -> DataFrame:
    """(rep, n, key) for the tables in which a document can meet another one.

    A half that no other document has makes no key that is shared, so halves are counted
    first and only shared ones are paired.
    """
    half = reps.select("rep", "n", F.explode(F.concat(
        F.transform("left", lambda h: F.struct(F.lit(True).alias("is_left"), h.alias("half"))),
        F.transform("right", lambda h: F.struct(F.lit(False).alias("is_left"),
                                                h.alias("half"))))).alias("h"))
    half = half.select("rep", "n", "h.*")
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    half = half.join(shared, "half")
    left = half.where("is_left").select("rep", "n", F.col("half").alias("l"))
    right = half.where("not is_left").select("rep", F.col("half").alias("r"))
    return left.join(right, "rep").select("rep", "n", F.xxhash64("l", "r").alias("key"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """The keys that more than one row has."""
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return keys.join(several, "key")


def sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): full shingle sets of the given ids."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(wanted, "doc_id", "left_semi").select(
        "doc_id", shingle_set(F.col("text"), width).alias("s"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    met = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
           .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"),
                      both.alias("both")).where(
        F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")


def leader_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket with the bucket's smallest id."""
    lead = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"))
    return keys.join(lead, "key").where(
        (F.col("rep") != F.col("lead.rep")) & sizes_allow(F.col("n"), F.col("lead.n"), percent)
    ).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()


def mixed_buckets(keys: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, n, comp, main) of buckets with members of several components; main is the
    component with most members there."""
    own = keys.join(found, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    most = (own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"),
                                F.count(F.lit(1)).alias("comps"))
            .where("comps > 1").drop("comps"))
    return own.join(most, "key")


def trial_pairs(mixed: DataFrame, number: int, percent: int) -> DataFrame:
    """Each member outside a bucket's main component with some members inside it, other ones
    in every round."""
    inside = mixed.where("comp = main").groupBy("key").agg(F.min_by(
        F.struct("rep", "n"), F.xxhash64("rep", "key", F.lit(number))).alias("r"))
    pairs = mixed.where("comp <> main").join(inside, "key").where(
        sizes_allow(F.col("n"), F.col("r.n"), percent)).select(
        F.col("rep").alias("b"), F.col("r.rep").alias("a")).distinct()
    some = Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(number)), "a")
    return pairs.withColumn("i", F.row_number().over(some)).where(
        F.col("i") <= TRIALS).select("a", "b")


def remaining_pairs(mixed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All members of different components that share a bucket and may be similar enough."""
    mixed = mixed.join(sketches, "rep")
    rest = mixed.where("comp <> main").select(
        "key", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"),
        F.col("sketch").alias("sketch2"))
    return mixed.join(rest, "key").where(
        (F.col("comp") != F.col("comp2"))
        & ((F.col("comp") == F.col("main")) | (F.col("rep") < F.col("rep2")))
        & sizes_allow(F.col("n"), F.col("n2"), percent)
        & sketches_allow(F.col("sketch"), F.col("sketch2"), F.col("n"), F.col("n2"), percent)
    ).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def links_of(reps: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that connect everything the tables let meet."""
    keys = cut_lineage(shared_keys(table_keys(reps)))
    ids = cut_lineage(keys.select(F.col("rep").alias("doc_id")).distinct())
    sets = cut_lineage(sets_of(ids, docs, width))
    links = cut_lineage(confirm(leader_pairs(keys, percent), sets, percent))
    number = 0
    while True:
        keys = cut_lineage(mixed_buckets(keys, connected_components(links)))
        outside = keys.where("comp <> main").select("rep").distinct().count()
        if not outside:
            return links
        number += 1
        fresh = cut_lineage(confirm(trial_pairs(keys, number, percent), sets, percent))
        linked = fresh.select("b").distinct().count()
        links = links.union(fresh)
        if linked < LEAST_GAIN * outside:
            break
        keys = keys.select("key", "rep", "n")
    mixed = mixed_buckets(keys.select("key", "rep", "n"), connected_components(links))
    rest = remaining_pairs(mixed, reps.select("rep", "sketch"), percent)
    return links.union(confirm(rest, sets, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, halves: int = HALVES,
                    width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    A null, empty or blank text has no shingles and is linked with nothing. Rows that repeat
    an id are one document with several texts. A row with a null id takes no part: its
    component is null and it is kept. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(docs.select("doc_id", signature(F.col("text"), halves, width).alias(
        "s")).select("doc_id", "s.*"))
    used = signed.where("n > 0 and doc_id is not null")
    same = ["fp1", "fp2", "n"]
    classes = cut_lineage(used.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    reps = used.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same],
                     "left_semi").select(F.col("doc_id").alias("rep"), "n", "left", "right", "sketch")
    links = links_of(reps, docs, percent, width)
    # an id that stands for several sets ties them together
    several = used.join(classes, same).where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = used.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    tied = several.join(repeated, F.col("a") == F.col("doc_id"), "left_semi")
    found = connected_components(links.union(tied))
    placed = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        *same, F.coalesce("component", "rep").alias("component_id"))
    linked = used.join(placed, same).select("doc_id", "n", "component_id")
    alone = signed.where("n = 0 or doc_id is null").select(
        "doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Exact top-k under Hamming distance by incremental multi-index hashing.

A code of 64 bits is the signs of a vector's first 64 components. It is cut into four
segments; each segment's value is an index key. Two codes at distance d differ by at most
d // 4 bits in some segment, so once all segment values within radius r of the query's have
been looked up, every code within 4 * (r + 1) - 1 is known. Radii grow, and a query stops when
its k-th verified distance lies within what is covered.

Equal codes are one index entry with the smallest ids that hold it, so copies cost nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.llm.vectors import vector_rows
from corpusq.session import cut_lineage

SEGMENTS = 4
SEGMENT_BITS = 16
BITS = SEGMENTS * SEGMENT_BITS
FIRST_RADII = 2         # radii 0 and 1 are one round


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components as a bigint, component 0 in the highest bit."""
    return F.aggregate(F.slice(vector, 1, BITS), F.lit(0).cast("bigint"),
                       lambda code, x: F.shiftleft(code, 1).bitwiseOR(
                           F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segment(code: Column, number: Column | int) -> Column:
    """16 bits of a code."""
    n = F.lit(number) if isinstance(number, int) else number
    return F.call_function("shiftrightunsigned", code, n * SEGMENT_BITS).bitwiseAND(
        F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def masks(radius: int) -> Column:
    """All changes of exactly `radius` bits of a segment, as a constant array."""
    found = [m for m in range(1 << SEGMENT_BITS) if m.bit_count() == radius]
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<int>")


def steps() -> list[tuple[list[int], int]]:
    """(radii, distance covered afterwards) of every round."""
    first = list(range(FIRST_RADII))
    return [(first, SEGMENTS * FIRST_RADII - 1)] + [
        ([r], SEGMENTS * (r + 1) - 1) for r in range(FIRST_RADII, SEGMENT_BITS + 1)]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The nearest codes of every query code, enough to hold k documents besides itself: each
    code holds one at least, so k + 1 codes are enough. `within` is the distance in which k + 1
    documents have been found, `codes` the number of codes found."""
    by_q = Window.partitionBy("q")
    nearest = by_q.orderBy(F.col("d").asc_nulls_last(), "first")
    so_far = nearest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (found.repartition("q").dropDuplicates(["q", "code"])
            .withColumn("codes", F.count("code").over(by_q))
            .withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 2)
            .withColumn("sum", F.sum("held").over(so_far))
            .withColumn("within", F.coalesce(F.min(F.when(
                F.col("sum") >= k + 1, F.col("d"))).over(by_q), F.lit(BITS)))
            .select("q", "code", "first", "held", "d", "n", "within", "codes"))


def _by_code(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(q, code, d): the codes among which the k nearest documents of each query code are.

    What is known of a query travels in one table; a row without code stands for a query that
    has found nothing yet. Each round is one join with the index and one exchange by query.
    """
    entries = cut_lineage(index.select("code", "first", "held", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: F.struct(
            s.alias("s"), segment(F.col("code"), s).alias("v")))).alias("e")
    ).select("code", "first", "held", "e.*"))
    total = index.count()
    row = ["q", "code", "first", "held", "d"]
    active = cut_lineage(asked.select(
        "q", F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("bigint").alias("first"),
        F.lit(0).cast("bigint").alias("held"), F.lit(None).cast("int").alias("d"),
        F.lit(1).alias("n"), F.lit(BITS).alias("within"), F.lit(0).cast("bigint").alias("codes")))
    done = []
    for radii, covered in steps():
        probes = active.where("n = 1").select("q", "within", F.explode(
            F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("s"))
        probes = probes.select("q", "within", "s", F.explode(
            F.concat(*[masks(r) for r in radii])).alias("m"))
        probes = probes.select("q", "within", "s", segment(F.col("q"), F.col("s")).bitwiseXOR(
            F.col("m")).alias("v"))
        found = probes.join(entries, ["s", "v"]).where(
            distance(F.col("q"), F.col("code")) <= F.col("within")).select(
            "q", "code", "first", "held", distance(F.col("q"), F.col("code")).alias("d"))
        state = cut_lineage(_ranked(found.union(active.select(*row)), k))
        over = (F.col("within") <= covered) & (F.col("within") < BITS) | (F.col("codes") >= total)
        done.append(state.where(over & F.col("code").isNotNull()).select("q", "code", "d"))
        active = state.where(~over)
        if active.isEmpty():
            break
    done.append(active.where("code is not null").select("q", "code", "d"))
    return reduce(DataFrame.union, done)


def hamming_topk(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest sign codes of every query row, exactly.

    A query is not its own neighbour: rows with its id are left out. Ties go to the smaller
    vec_id; rows repeating an id and code count once. Vectors that are null, zero, not finite
    or shorter than 64, and rows without id, take no part. With fewer candidates than k all
    are returned; an empty table or query set gives no rows. Other columns are not looked at.
    """
    def coded_rows(df: DataFrame) -> DataFrame:
        return vector_rows(df, id_col, vector_col).where(F.size("vector") >= BITS).select(
            "vec_id", sign_code(F.col("vector")).alias("code"))

    coded = cut_lineage(coded_rows(rows).distinct())
    by_id = Window.partitionBy("code").orderBy("vec_id")
    members = cut_lineage(coded.withColumn("n", F.row_number().over(by_id)).where(
        F.col("n") <= k + 1).select("code", "vec_id"))
    index = cut_lineage(members.groupBy("code").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("held")))
    asked = cut_lineage(coded_rows(queries).distinct())
    near = _by_code(asked.select(F.col("code").alias("q")).distinct(), index, k)
    found = (asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
             .join(near, "q").join(members, "code").where("query_id <> vec_id")
             .groupBy("query_id", "vec_id").agg(F.min("d").alias("distance")))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")

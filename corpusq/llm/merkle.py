"""Merkle manifest of a dataset: a leaf for every row, a tree for every group, one root.

Rows get their rank inside the group. The digits of that rank, of base 16, are columns. Inside
a block of 4096 consecutive ranks the digits are grouped away one after the other, the lowest
first: each grouping nests its children's structs in an array, so a block, of bounded size,
becomes one row that holds all its leaves and every digest between them and the block's root.
All three groupings use the partitioning by block, so rows move once. Blocks are the leaves of
the next tree above. Proofs come out of the nested structs by transform and explode.

Only what lies above a block is joined to it: one row for each 4096 leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.session import cut_lineage, keep

DIGIT_BITS = 4                      # four levels of the binary tree in each digit
DIGITS = 3
BLOCK_BITS = DIGIT_BITS * DIGITS
FANOUT, BLOCK = 1 << DIGIT_BITS, 1 << BLOCK_BITS
# Tables of at most this many short rows are sent to every executor.
BROADCAST_ROWS = 100_000

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER = 7
PATH = "array<struct<sib: string, left: boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the inputs, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def small(df: DataFrame) -> DataFrame:
    """With a hint to broadcast it if its measured number of rows allows that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """With `rank`, from 0, inside `grp` by `order` (nulls first), and `many`, the group's size.

    Rows are dealt by ranges of (grp, order) and numbered inside their range; sizes of ranges,
    one row for each and group, turn that into ranks. No group has to fit into a task.
    """
    by = [F.asc_nulls_first(c) for c in ("grp", *order)]
    rows = cut_lineage(nodes.repartitionByRange(*by).sortWithinPartitions(*by))
    rows = rows.select("*", F.spark_partition_id().alias("part"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    sizes = rows.groupBy("part", "grp").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("grp")
    sizes = cut_lineage(sizes.select(
        F.col("part").alias("part2"), F.col("grp").alias("grp2"),
        (F.sum("c").over(whole.orderBy("part")) - F.col("c") - F.col("first")).alias("shift"),
        F.sum("c").over(whole).alias("many")))
    return rows.join(small(sizes), F.col("grp").eqNullSafe(F.col("grp2"))
                     & (F.col("part") == F.col("part2"))).select(
        *nodes.columns, (F.col("i") + F.col("shift")).alias("rank"), "many")


def levels_above(nodes: Column) -> Column:
    """Levels of a tree over so many nodes: the least h with 2 ** h >= nodes."""
    return F.when(nodes > 1, F.length(F.bin(nodes - 1))).otherwise(0).cast("int")


def tree(nodes: Column, levels: Column) -> Column:
    """array<array<string>>: the nodes and each level above them. Every two consecutive ones,
    or the last alone, become their digest."""
    def above(below: Column) -> Column:
        pairs = F.transform(below, lambda x, i: F.struct(x.alias("x"), F.coalesce(
            F.get(below, i + 1), F.lit("")).alias("y"), i.alias("i")))
        pairs = F.filter(pairs, lambda p: p["i"] % 2 == 0)
        return F.transform(pairs, lambda p: digest(p["x"], p["y"]))

    return F.when(levels > 0, F.aggregate(
        F.sequence(F.lit(1), levels), F.array(nodes),
        lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
    ).otherwise(F.array(nodes))


def path(tree_of: Column, i: Column, levels: Column) -> Column:
    """Sibling (null where a node is alone) of node `i` on each level below the top."""
    def step(k: Column) -> Column:
        at = F.call_function("shiftright", i, k)
        return F.struct(F.get(F.get(tree_of, k), at.bitwiseXOR(F.lit(1))).alias("sib"),
                        (at % 2 == 1).alias("left"))
    return F.when(levels > 0, F.transform(F.sequence(F.lit(0), levels - 1), step)).otherwise(
        F.array().cast(PATH))


def rolled_up(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, list[str]]:
    """(grp, block, high, node, kids): one row for each block of ranked (grp, rank, high, node,
    *payload). `high` counts the tree's levels from the given nodes on. `kids` nests structs
    (i, node, kids, path), innermost (i, node, payload, path)."""
    digits = [f"d{k}" for k in range(DIGITS)]
    rank = F.col("rank")
    rows = nodes.select(
        "grp", "high", "node", F.struct(*payload).alias("kids"),
        F.call_function("shiftright", rank, F.lit(BLOCK_BITS)).alias("block"),
        *[F.call_function("shiftright", rank, F.lit(k * DIGIT_BITS)).bitwiseAND(
            F.lit(FANOUT - 1)).cast("int").alias(d) for k, d in enumerate(digits)])
    rows = rows.repartition("grp", "block")
    for k, digit in enumerate(digits):
        rest = ["grp", "block", "high", *digits[k + 1:]]
        levels = F.least(F.greatest(F.col("high") - k * DIGIT_BITS, F.lit(0)), F.lit(DIGIT_BITS))
        rows = rows.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(
            F.col(digit).alias("i"), "node", "kids"))).alias("kids"))
        rows = rows.select(*rest, "kids", levels.alias("levels"))
        rows = rows.withColumn("tree", tree(F.col("kids.node"), F.col("levels")))
        rows = rows.select(*rest, F.get(F.element_at("tree", -1), F.lit(0)).alias("node"),
                           F.transform("kids", lambda c: F.struct(
                               c["kids"].alias("kids"),
                               path(F.col("tree"), c["i"], F.col("levels")).alias("path"))
                           ).alias("kids"))
    return rows, digits


def proofs(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(grp, root, path, *payload) for ranked nodes (grp, rank, many, node, *payload)."""
    nodes = nodes.select("*", levels_above(F.col("many")).alias("high"))
    return _proofs(nodes, payload)


def _proofs(nodes: DataFrame, payload: list[str]) -> DataFrame:
    blocks, digits = rolled_up(nodes, payload)
    blocks = keep(blocks)
    several = blocks.where("block > 0").limit(1).count() > 0
    if several:
        tops = blocks.select(
            "grp", F.col("block").alias("rank"), "block", "node",
            F.greatest(F.col("high") - BLOCK_BITS, F.lit(0)).alias("high"))
        above = keep(_proofs(tops, ["block"])).select(
            F.col("grp").alias("grp2"), F.col("block").alias("block2"), "root",
            F.col("path").alias("upper"))
        blocks = blocks.join(small(above), F.col("grp").eqNullSafe(F.col("grp2"))
                             & (F.col("block") == F.col("block2")))
    else:
        blocks = blocks.select("*", F.col("node").alias("root"), F.array().cast(PATH).alias("upper"))
    rows = blocks.select("grp", "root", "kids", F.col("upper").alias("path"))
    for _ in digits:
        rows = rows.select("grp", "root", F.col("path").alias("upper"), F.explode("kids").alias("k"))
        rows = rows.select("grp", "root", F.col("k.kids").alias("kids"),
                           F.concat("k.path", "upper").alias("path"))
    return rows.select("grp", "root", "path", *[F.col(f"kids.{c}").alias(c) for c in payload])


def folded(start: Column, along: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(along, start, lambda node, s: F.when(
        s["sib"].isNull(), digest(node)).when(s["left"], digest(s["sib"], node)).otherwise(
        digest(node, s["sib"])))


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id",
             fields: list[str] | None = None, tampered: Column | None = None,
             changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row.

    Leaves ascend by id inside their group; a null id comes first, rows that repeat an id
    ascend by their leaf (equal rows may change places, which changes no digest). Groups
    ascend, null first. A lone leaf is its group's subroot, a lone subroot the root. Where
    `tampered` holds, folded_root starts from the leaf of the row with `changed` fields. Texts
    may be null, empty or very long; an empty table has no rows. Other columns are not looked at.
    """
    fields = fields or FIELDS
    true = leaf([F.col(c) for c in fields])
    false = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    if tampered is None:
        tampered = F.lit(False)
    rows = keep(docs.select(
        F.col(group_col).alias("grp"), F.col(id_col).alias("doc_id"), true.alias("node"),
        F.when(F.coalesce(tampered, F.lit(False)), false).alias("other"),
        F.monotonically_increasing_id().alias("at")))
    below = keep(proofs(ranked(rows, ["doc_id", "node", "at"]), ["doc_id", "node", "other"])
                 .withColumnsRenamed({"root": "subroot", "path": "below"}))
    tops = below.groupBy("grp").agg(F.first("subroot").alias("node"))
    tops = ranked(tops.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
    tops = keep(proofs(tops, ["name"]).select("name", "root", F.col("path").alias("upper")))
    rows = below.join(small(tops), F.col("grp").eqNullSafe(F.col("name"))).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root",
        F.concat("below", "upper").alias("path"), F.coalesce("other", "node").alias("start"))
    sibs = F.filter(F.col("path.sib"), lambda s: s.isNotNull())
    return rows.select("doc_id", "leaf", "subroot", "root",
                       F.sha2(F.array_join(sibs, ""), 256).alias("proof_sha256"),
                       folded(F.col("start"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a documents table, with every row whose id's checksum 7 divides checked
    against n_chars plus one. A null id is never tampered with."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return manifest(docs, tampered=check, changed={"n_chars": F.col("n_chars") + 1})

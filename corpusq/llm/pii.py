"""Personal data, and terms that give it away.

Patterns find e-mail and network addresses, card and phone numbers: the protected entities.
A term that stands in the same documents as an entity, wherever in them, discloses it to the
degree that the term says which entity is meant: pointwise mutual information of term and
entity over all documents of the corpus, as a share of the information the entity itself
holds. It is 1 when the term occurs only with the entity and 0 when the two are independent.
Terms at or above the upper threshold are removed, those at or above the lower one
generalised, wherever they occur in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.arrow_text import by_slice, slices, utf8
from corpusq.llm.shingles import word_spans, words
from corpusq.llm.spans import (LOWER_CASE, UPPER_CASE, Layout, byte_set, by_row, find_personal,
                               written)
from corpusq.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
LEAST_TEXTS = 3         # distinct texts in which term and entity stand together
GENERALISE, REMOVE = 0.75, 0.9
# Hashes of terms sent to every task at most (16 bytes each); with more, terms are counted and
# marked by shuffles instead.
HELD_TERMS = 1_000_000
HELD_PAIRS = 1_000_000  # pairs of entity and term that a task holds before it hands them on

TERM_LETTERS = 3        # letters in a row that a term has
NO_TERMS = np.zeros(0, np.int64)
IS_LETTER = byte_set(LOWER_CASE + UPPER_CASE + bytes(range(128, 256)))

FOUND = "struct<entities: array<string>, terms: array<bigint>>"
_FOUND = pa.struct([("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.int64()))])
MARKED = ("struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, "
          "base_sha256: string, spans: string>")
_MARKED = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS]
                    + [("base_sha256", pa.string()), ("spans", pa.string())])
PLACES = "array<struct<term: bigint, first: bigint, last: bigint>>"
_PLACES = pa.list_(pa.struct([("term", pa.int64()), ("first", pa.int64()),
                              ("last", pa.int64())]))


def entity_name(kind: str, raw: bytes) -> str:
    """Spellings of one address or number are one entity."""
    if kind in ("card", "phone"):
        raw = bytes(b for b in raw if 48 <= b <= 57)
    return f"{kind}:{raw.decode().lower()}"


def _term_places(texts: pa.Array, base: dict[int, list[tuple[int, int]]], layout: Layout,
                 among: np.ndarray | None = None
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end (bytes of the layout) of all whole words with enough letters
    that touch no span of `base`, all or those whose hash is `among` given ones."""
    value, row, start, end = word_spans(*utf8(texts))
    value, start, end = value.view(np.int64), start + row, end + row
    if among is not None:
        at = np.minimum(np.searchsorted(among, value), len(among) - 1)
        hit = among[at] == value
        value, row, start, end = value[hit], row[hit], start[hit], end[hit]
    letter = IS_LETTER[layout.data]
    run = letter.copy()
    for k in range(1, TERM_LETTERS):
        run[:-k] &= letter[k:]
        run[len(run) - k:] = False
    before = np.append(0, np.cumsum(run))
    held = end - start >= TERM_LETTERS
    held &= before[np.maximum(end - TERM_LETTERS + 1, start)] > before[start]
    covered = np.zeros(len(layout.data) + 1, np.int64)
    for spans in base.values():
        for first, last in spans:
            covered[first] += 1
            covered[last] -= 1
    taken = np.append(0, np.cumsum(np.cumsum(covered) > 0))
    held &= taken[end] == taken[start]
    return value[held], row[held], start[held], end[held]


def _base(layout: Layout) -> dict[str, dict[int, list[tuple[int, int]]]]:
    return {kind: by_row(layout, found) for kind, found in find_personal(layout).items()}


def _every(base: dict[str, dict[int, list[tuple[int, int]]]]
           ) -> dict[int, list[tuple[int, int]]]:
    return {row: [s for k in KINDS for s in base[k].get(row, ())]
            for row in sorted(set().union(*base.values()))}


def _entities(texts: pa.Array) -> pa.Array:
    """Distinct entities of each text, and distinct terms of those that have one."""
    layout = Layout.of(texts)
    base = _base(layout)
    spans = _every(base)
    out: list[dict] = [{"entities": [], "terms": []}] * len(texts)
    if not spans:
        return pa.array(out, _FOUND)
    rows = list(spans)
    some = texts.take(pa.array(rows, pa.int64()))
    part = Layout.of(some)
    moved = {i: [(a - int(layout.at[r]) + int(part.at[i]), b - int(layout.at[r]) + int(part.at[i]))
                 for a, b in spans[r]] for i, r in enumerate(rows)}
    value, of, _, _ = _term_places(some, moved, part)
    at = np.searchsorted(of, np.arange(len(rows) + 1))
    for i, r in enumerate(rows):
        names = {entity_name(k, layout.raw[a:b]) for k in KINDS for a, b in base[k].get(r, ())}
        out[r] = {"entities": sorted(names), "terms": np.unique(value[at[i]:at[i + 1]])}
    return pa.array(out, _FOUND)


def personal(text: Column) -> Column:
    """The distinct entities, and the distinct terms of a text that has any."""
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_slice(texts, _entities, _FOUND)
    return scan(text)


def _scan(texts: pa.Array, terms: np.ndarray = NO_TERMS,
          removed: np.ndarray = NO_TERMS) -> pa.Array:
    """Counts, base spans and all places of the given terms (ascending hashes)."""
    layout = Layout.of(texts)
    base = _base(layout)
    every = _every(base)
    added: dict[int, list[tuple[str, int, int]]] = {}
    if len(terms):
        value, row, start, end = _term_places(texts, every, layout, terms)
        gone = removed[np.searchsorted(terms, value)]
        for i in range(len(value)):
            added.setdefault(int(row[i]), []).append((
                "removed" if gone[i] else "generalised",
                *layout.in_text(int(row[i]), (int(start[i]), int(end[i])))))
    nothing = {"base_sha256": hashlib.sha256(b"").hexdigest(), "spans": "",
               **{f"n_{k}": 0 for k in KINDS}}
    out: list[dict] = [nothing] * len(texts)
    for row in sorted({*every, *added}):
        own = [(k, *layout.in_text(row, s)) for k in KINDS for s in sorted(base[k].get(row, ()))]
        out[row] = {**{f"n_{k}": len(base[k].get(row, ())) for k in KINDS},
                    "base_sha256": hashlib.sha256(written(own).encode()).hexdigest(),
                    "spans": written(own + sorted(added.get(row, ())))}
    return pa.array(out, _MARKED)


def marked(text: Column, terms: np.ndarray, removed: np.ndarray) -> Column:
    """Counts and spans, with those of the given terms."""
    @F.arrow_udf(MARKED)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_slice(texts, lambda part: _scan(part, terms, removed), _MARKED)
    return scan(text)


def _places(texts: pa.Array) -> pa.Array:
    layout = Layout.of(texts)
    value, row, start, end = _term_places(texts, _every(_base(layout)), layout)
    first = layout.chars[layout.at[row]]
    at = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(
        [pa.array(value), pa.array(layout.chars[start] - first),
         pa.array(layout.chars[end] - first)], names=["term", "first", "last"]))


def term_places(text: Column) -> Column:
    """All terms of a text with their places."""
    @F.arrow_udf(PLACES)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield by_slice(texts, _places, _PLACES)
    return scan(text)


def _distinct(texts: pa.Array, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, all or those `among` given ones; and their texts."""
    value, row = words(*utf8(texts))
    value = value.view(np.int64)
    if among is not None:
        at = np.minimum(np.searchsorted(among, value), len(among) - 1)
        hit = among[at] == value
        value, row = value[hit], row[hit]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def document_counts(docs: DataFrame, among: np.ndarray | None) -> DataFrame:
    """(term, n_term): documents that hold each term. Of few terms a task hands on one count
    each; without such a list every slice of texts hands on its counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0 if among is None else len(among), np.int64)
        for batch in batches:
            for part in slices(batch["text"]):
                value, _ = _distinct(part, among)
                term, n = np.unique(value, return_counts=True)
                if among is None:
                    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=names)
                else:
                    total[np.searchsorted(among, term)] += n
        if among is not None:
            held = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(among[held]), pa.array(total[held])],
                                             names=names)

    names = ["term", "n"]
    return docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n_term"))


def text_print(text: Column) -> Column:
    """128-bit identity of a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(text, F.lit(1)).alias("y"))


def _combined(eid: list[np.ndarray], term: list[np.ndarray], n: list[np.ndarray],
              texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sums of n and texts for each pair of entity and term."""
    e, t, c, x = map(np.concatenate, (eid, term, n, texts))
    order = np.lexsort((t, e))
    e, t, c, x = e[order], t[order], c[order], x[order]
    first = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (t[1:] != t[:-1])))
    return e[first], t[first], np.add.reduceat(c, first), np.add.reduceat(x, first)


def count_pairs(texts: DataFrame, counts: tuple[np.ndarray, np.ndarray] | None, n_docs: int,
                least_disclosure: float) -> DataFrame:
    """(entity, term, both, texts): documents and distinct texts that hold both.

    `texts` has `copies`, `terms` and `entities` (each with its `n_entity`). Pairs are added
    up inside tasks. With the counts of all candidate terms, those are left out that cannot
    reach `least_disclosure` even if every document of the entity holds them: that is exact.
    """
    names = ["entity", "term", "both", "texts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = 0

        def out(parts) -> Iterator[pa.RecordBatch]:
            name = np.array(list(number), object)
            for i in range(0, len(parts[0]), 100_000):
                e, *rest = [p[i:i + 100_000] for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[e], pa.string()), *map(pa.array, rest)], names=names)

        for batch in batches:
            lists, several = batch["terms"], batch["entities"]
            for i, copies in enumerate(batch["copies"].to_pylist()):
                term = lists[i].values.to_numpy()
                if counts is not None and len(term):
                    at = np.minimum(np.searchsorted(counts[0], term), len(counts[0]) - 1)
                    hit = counts[0][at] == term
                    term, n_term = term[hit], counts[1][at[hit]]
                for e in several[i].as_py():
                    own = term
                    if counts is not None and len(term):
                        most = e["n"] * (n_docs / e["n"]) ** (1 - least_disclosure)
                        own = term[n_term <= most * (1 + 1e-9)]
                    if not len(own):
                        continue
                    number.setdefault(e["entity"], len(number))
                    for part, new in zip(held, (
                            np.full(len(own), number[e["entity"]]), own,
                            np.full(len(own), copies), np.ones(len(own), np.int64)), strict=True):
                        part.append(new)
                    size += len(own)
                    if size > HELD_PAIRS:
                        parts = _combined(*held)
                        size = len(parts[0])
                        held = [[p] for p in parts]
                        if size > HELD_PAIRS // 2:
                            yield from out(parts)
                            number, held, size = {}, [[], [], [], []], 0
        if size:
            yield from out(_combined(*held))

    return texts.select("copies", "terms", "entities").mapInArrow(
        count, "entity string, term bigint, both bigint, texts bigint").groupBy(
        "entity", "term").agg(F.sum("both").alias("both"), F.sum("texts").alias("texts"))


def repeated_terms(texts: DataFrame, least_texts: int) -> DataFrame:
    """(term) of those that enough of the texts hold, added up inside tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(batch["terms"].flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    return texts.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least_texts).select("term")


def disclosing_terms(found: DataFrame, docs: DataFrame, least_texts: int = LEAST_TEXTS,
                     least_disclosure: float = 0.0) -> DataFrame:
    """(entity, term, disclosure) of all pairs that stand together in enough distinct texts
    and reach `least_disclosure`.

    `found` has, for every document with an entity, the print `fp` of its text, `entities` and
    `terms`; `docs` has `text`. All counts are of whole documents; copies of a text do not make
    a pair frequent enough.
    """
    texts = cut_lineage(found.where(F.size("entities") > 0).groupBy("fp").agg(
        F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"),
        F.first("terms").alias("terms")))
    each = texts.select("fp", "copies", F.explode("entities").alias("entity"))
    # an entity in fewer texts has no pair in enough of them
    often = each.groupBy("entity").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias(
        "texts")).where(F.col("texts") >= least_texts).select("entity", "n")
    often = cut_lineage(often)
    of_text = each.join(often, "entity").groupBy("fp").agg(F.collect_list(
        F.struct("entity", "n")).alias("entities"))
    texts = cut_lineage(texts.drop("entities").join(of_text, "fp"))
    terms = cut_lineage(repeated_terms(texts, least_texts))
    n = docs.count()
    few = terms.count() <= HELD_TERMS
    among = np.sort(terms.toPandas()["term"].to_numpy(np.int64)) if few else None
    if among is not None and not len(among):
        return often.select("entity", F.lit(0).cast("bigint").alias("term"),
                            F.lit(0.0).alias("disclosure")).limit(0)
    n_term = cut_lineage(document_counts(docs, among))
    counts = None
    if few:
        rows = n_term.toPandas().sort_values("term")
        counts = rows["term"].to_numpy(np.int64), rows["n_term"].to_numpy(np.int64)
    pairs = count_pairs(texts, counts, n, least_disclosure).where(
        F.col("texts") >= least_texts)
    info = F.log(F.lit(n) / F.col("n"))
    shared = F.log(F.lit(n) * F.col("both") / (F.col("n_term") * F.col("n")))
    return pairs.join(often, "entity").join(n_term, "term").select(
        "entity", "term", F.when(info > 0, shared / info).otherwise(0.0).alias("disclosure")
    ).where((F.col("disclosure") >= least_disclosure) | F.lit(least_disclosure <= 0))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least_texts: int = LEAST_TEXTS, generalise: float = GENERALISE,
                 remove: float = REMOVE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per input row.

    Added spans are of kind `generalised` or `removed`, in this order and by start, behind
    the base spans; they are all occurrences of a disclosing term that touch no base span, also
    in texts without the entity. A null or empty text has no spans. Rows that repeat an id, or
    have none, are treated each by itself; rows with equal texts get equal spans. Other columns
    are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.select(text_print(F.col("text")).alias("fp"), personal(F.col("text")).alias(
        "r")).select("fp", "r.*").where(F.size("entities") > 0)
    terms = cut_lineage(disclosing_terms(found, docs, least_texts, generalise).groupBy(
        "term").agg((F.max("disclosure") >= remove).alias("removed")))
    own = [*[f"n_{k}" for k in KINDS], "base_sha256"]
    if terms.count() <= HELD_TERMS:
        held = terms.toPandas().sort_values("term")
        result = marked(F.col("text"), held["term"].to_numpy(np.int64),
                        held["removed"].to_numpy(bool))
        return docs.select("doc_id", result.alias("r")).select(
            "doc_id", *[f"r.{c}" for c in own], "r.spans")
    docs = docs.withColumn("fp", text_print(F.col("text")))
    places = docs.select("fp", F.explode(term_places(F.col("text"))).alias("p")).select(
        "fp", "p.*").join(terms, "term").select("fp", "first", "last", "removed").distinct()
    added = places.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct(
        F.when(F.col("removed"), "removed").otherwise("generalised").alias("kind"),
        "first", "last"))).alias("added"))
    base = docs.select("doc_id", "fp", marked(F.col("text"), NO_TERMS, NO_TERMS).alias("r")).select("doc_id", "fp", "r.*")
    extra = F.concat_ws(",", F.transform("added", lambda s: F.concat_ws(
        ":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))))
    spans = F.concat_ws(",", F.when(F.col("spans") != "", F.col("spans")),
                        F.when(F.col("added").isNotNull(), extra))
    return base.join(added, "fp", "left").select("doc_id", *own, spans.alias("spans"))

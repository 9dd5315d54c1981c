"""BM25 over postings, with statistics of the whole store or of each question's scope.

Only what can still be among a question's best is scored. A word's largest possible share of a
score follows from the largest count and the shortest chunk among its postings. Postings of the
words with the largest shares, the rare ones as a rule, give k chunks whose full scores the k best
reach at least. Words whose shares together stay below it need not be looked up: a chunk
with no other word of the question cannot be among the best. Chunks found by the remaining words
are scored in full from their own row of word counts. A stored index also keeps postings in
blocks of like counts, of which a question reads those whose bound can still reach its score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq import fixed_values as fv
from corpusq.functions.text import words
from corpusq.operators.scope import Scopes
from corpusq.operators.topk import SCORE_DIGITS, rank_per_query
from corpusq.session import keep


def tokenised(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_id", words(F.col("content")).alias("tokens"))


def _word_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a chunk's words: stretches of equal words once sorted."""
    def entries(sorted_words: Column) -> Column:
        n = F.size(sorted_words)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & (
            (i == 0) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1))))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, i: F.struct(
            F.get(sorted_words, at).alias("term"),
            (F.coalesce(F.get(s, i + 1), n) - at).cast("bigint").alias("tf"))))[0]

    return F.transform(F.array(F.sort_array(tokens)), entries)[0]


def counted_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, dl, entries): each chunk's length and words with their counts. Words
    are counted inside the row, so nothing is shuffled."""
    return tokenised(chunks).select(
        "chunk_id", "doc_id", F.size("tokens").cast("bigint").alias("dl"),
        _word_counts(F.col("tokens")).alias("entries"))


def _exploded(counted: DataFrame) -> DataFrame:
    return counted.select("chunk_id", "doc_id", "dl", F.explode("entries").alias("e")).select(
        "e.term", "chunk_id", "doc_id", "e.tf", "dl")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, tf, dl)."""
    return _exploded(counted_chunks(chunks))


BLOCK_CHUNKS = 4096         # a block holds postings of so many chunks at most, about


def posting_blocks(postings: DataFrame, n_chunks: int) -> DataFrame:
    """(term, level, shard, max_tf, min_dl, entries): postings of a word with like shares of a
    score, in blocks. The bounds hold whatever the mean length is; shards, dealt by the chunk,
    keep the blocks of a very common word small."""
    share = F.col("tf") / (F.col("tf") + fv.BM25_K1)
    level = F.floor(share * 8 - F.least(F.col("dl"), F.lit(4000)) / 1000).cast("int")
    shards = max(1, n_chunks // BLOCK_CHUNKS)
    return postings.groupBy(
        "term", level.alias("level"),
        F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard")).agg(
        F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
        F.collect_list(F.struct("chunk_id", "doc_id", "tf", "dl")).alias("entries"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return tokenised(chunks).select("chunk_id", "doc_id",
                                    F.size("tokens").cast("bigint").alias("dl"))


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df): chunks that hold the term."""
    return (tokenised(chunks).select(F.explode(F.array_distinct("tokens")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """(n_chunks, mean_length)."""
    return chunk_lengths(chunks).agg(F.count(F.lit(1)).alias("n_chunks"),
                                     F.avg("dl").alias("mean_length"))


@dataclass(frozen=True)
class LexicalIndex:
    """What keyword search reads: postings and the length of every chunk. Saved with
    `sources.tables.save_index`, postings and blocks lie in buckets of the term, counted chunks
    in buckets of the document. With `counted` chunks are scored from their own rows, with
    `blocks` the postings that cannot matter are not read."""

    postings: DataFrame
    lengths: DataFrame
    counted: DataFrame | None = None
    blocks: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame, blocks: bool = False) -> LexicalIndex:
        """Texts are read once; the counts are kept in a table."""
        counted = keep(counted_chunks(chunks))
        index = cls(_exploded(counted), counted.select("chunk_id", "doc_id", "dl"), counted)
        if not blocks:
            return index
        return replace(index, blocks=keep(posting_blocks(index.postings, counted.count())))

    def rows_of(self, chunk_ids: DataFrame) -> DataFrame:
        """All postings of some chunks."""
        if self.counted is None:
            return self.postings.join(chunk_ids, "chunk_id", "left_semi")
        return _exploded(self.counted.join(chunk_ids, "chunk_id", "left_semi"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope_id, term, qtf); a word said twice counts twice."""
    scope = F.col("scope_id") if "scope_id" in queries.columns else F.lit(None).cast("string")
    return (queries.select("query_id", scope.alias("scope_id"),
                           F.explode(words(F.col("question"))).alias("term"))
            .groupBy("query_id", "scope_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def stored_statistics(frequencies: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, n_chunks, mean_length) from tables kept with the index (term_frequencies,
    corpus_size)."""
    return frequencies.select(
        "term", "df", size.select("n_chunks").scalar().alias("n_chunks"),
        size.select("mean_length").scalar().alias("mean_length"))


def store_statistics(held: DataFrame, lengths: DataFrame) -> DataFrame:
    """The same for the words of `held` postings, with the bounds max_tf and min_dl."""
    size = lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("mean_length"))
    found = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *_bounds())
    return found.crossJoin(F.broadcast(size))


def _bounds() -> list[Column]:
    return [F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")]


def scope_statistics(held: DataFrame, lengths: DataFrame, scope_docs: DataFrame,
                     asked: DataFrame) -> DataFrame:
    """(scope_id, term, df, n_chunks, mean_length, max_tf, min_dl) for the words (scope_id,
    term) that are asked in each scope, from postings with their scopes (see _placed). Sums are
    made inside tasks before anything moves."""
    wanted = F.broadcast(asked) if asked.count() <= WORDS_SENT else asked
    found = (held.join(wanted, ["scope_id", "term"], "left_semi")
             .groupBy("scope_id", "term").agg(F.count(F.lit(1)).alias("df"), *_bounds()))
    doc_size = lengths.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("dl").alias("total"))
    sizes = (doc_size.join(scope_docs, "doc_id").groupBy("scope_id")
             .agg(F.sum("n").alias("n_chunks"), (F.sum("total") / F.sum("n")).alias("mean_length")))
    return found.join(sizes, "scope_id")


def _weight(qtf: Column, df: Column, n: Column) -> Column:
    return qtf * F.log(1 + (n - df + 0.5) / (df + 0.5)) * (fv.BM25_K1 + 1)


def _damped(tf: Column, dl: Column, mean: Column) -> Column:
    return tf / (tf + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * dl / mean))


def _score(qtf: Column, tf: Column, dl: Column, df: Column, n: Column, mean: Column) -> Column:
    return _weight(qtf, df, n) * _damped(tf, dl, mean)


def _share(tf: str = "tf", dl: str = "dl") -> Column:
    return _score(F.col("qtf"), F.col(tf), F.col(dl), F.col("df"), F.col("n_chunks"),
                  F.col("mean_length"))


WORDS_SENT = 200_000    # words of all questions up to which they are sent to every task
TASK_ROWS = 20_000_000  # shares one task adds up, about
SLOTS = 16              # questions whose scores are added up side by side
LOOK_FROM = 5_000_000   # postings to add up from which one chunk in LOOK is scored first
LOOK = 64
SEED_ROWS = 2000        # postings of a question's weightiest words that set its least score
SPARED = 0.5            # part of that score the words that are not looked up may add up to
ROW_WORDS = 200         # words of a chunk's own row, about
SLACK = 2e-6            # scores are compared after rounding to SCORE_DIGITS


def bm25_topk(queries: DataFrame, chunks: DataFrame | LexicalIndex, scopes: Scopes | None = None,
              statistics: DataFrame | None = None, prune_from: int | None = None) -> DataFrame:
    """Best chunks per question by BM25; only chunks sharing a word with it.

    `queries`: query_id, question, top_k and, with `scopes`, scope_id. Every question gets as
    many hits as its top_k says. `chunks` may be an index made before; then no text is read,
    and of a saved one only the asked words' buckets (see `sources.tables.load_index`).
    Statistics come from the filtered set; `statistics` replaces them by those of the whole
    store (see stored_statistics). The questions' words go to the chunks, not the other way
    round: a chunk's words lie in one task, which adds up its scores and keeps k per question,
    so neither postings nor scored pairs are shuffled. From `prune_from` postings to add up,
    over all questions, those that cannot matter are spared; it pays for short questions over
    posting blocks only, so nothing is pruned by default.
    """
    index = chunks if isinstance(chunks, LexicalIndex) else LexicalIndex.of(chunks)
    pruned = prune_from is not None
    weighed = keep(weighed_terms(queries, index, scopes, statistics, bounds=pruned))
    places = scopes.docs if scopes is not None else None
    work = weighed.agg(F.sum("df").alias("rows"), F.max("top_k").alias("most"),
                       F.count(F.lit(1)).alias("words")).first()
    if pruned and (work["rows"] or 0) >= prune_from:
        scored = _pruned(weighed, index, places)
        best = rank_per_query(scored, work["most"], F.col("top_k")).drop("top_k")
        return best.join(index.lengths.select("chunk_id", "doc_id"), "chunk_id").select(
            "query_id", "chunk_id", "doc_id", "score", "rank")
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism,
                -(-(work["rows"] or 0) // TASK_ROWS))
    slots, weights = _side_by_side(weighed)
    if work["words"] <= WORDS_SENT:
        slots, weights = F.broadcast(slots), F.broadcast(weights)
    all_scoped = scopes is not None and scopes.all_scoped

    def scores(of: LexicalIndex, least: DataFrame) -> DataFrame:
        parts = [] if all_scoped else [
            _together(weighed, of, tasks).withColumn("scope_id", F.lit(FREE))]
        if scopes is not None:
            parts.append(_placed(weighed, of, places))
        return reduce(DataFrame.union, [_added_up(p, weights, slots, least) for p in parts])

    least = _least(slots)
    if (work["rows"] or 0) >= LOOK_FROM:
        # the k-th best of any chunks is a score that the k best of all reach
        first = rank_per_query(scores(_one_in(index, LOOK), least), work["most"], F.col("top_k"))
        least = _least(slots, keep(first.groupBy("query_id", "top_k").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where("n = top_k")))
    scored = scores(index, F.broadcast(keep(least)) if work["words"] <= WORDS_SENT else least)
    return rank_per_query(scored, work["most"], F.col("top_k")).select(
        "query_id", "chunk_id", "doc_id", "score", "rank")


FREE = ""               # scope of the questions without one


def _side_by_side(weighed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope_id, block, slot, query_id, top_k): questions of a scope in blocks of SLOTS, and
    (scope_id, block, term, mean_length, w0, w1, ...): a word's weight in each of a block's
    questions, 0 where it is not asked."""
    placed = weighed.withColumn("scope_id", F.coalesce("scope_id", F.lit(FREE)))
    asked = placed.groupBy("scope_id", "query_id").agg(F.max("top_k").alias("top_k"))
    parts = 1 + asked.count() // 10_000
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    place = F.row_number().over(W.partitionBy("scope_id", "part").orderBy("query_id")) - 1
    slots = keep(asked.withColumn("part", part).withColumn("place", place).select(
        "scope_id", "query_id", "top_k", (F.col("place") % SLOTS).alias("slot"),
        (F.floor(F.col("place") / SLOTS) * parts + F.col("part")).alias("block")))
    weight = _weight(F.col("qtf"), F.col("df"), F.col("n_chunks"))
    weights = placed.withColumn("weight", weight).join(
        slots.drop("top_k"), ["scope_id", "query_id"]).groupBy(
        "scope_id", "block", "term", "mean_length").agg(*[
            F.max(F.when(F.col("slot") == i, F.col("weight")).otherwise(0.0)).alias(f"w{i}")
            for i in range(SLOTS)])
    return slots, keep(weights)


def _asked(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the words that are asked for; these are few, and sent to the rows if so."""
    few = terms.select("term").distinct()
    return rows.join(F.broadcast(few) if terms.count() <= WORDS_SENT else few, "term", "left_semi")


def _together(terms: DataFrame, index: LexicalIndex, tasks: int) -> DataFrame:
    """Postings of the asked words with all those of a chunk in one task."""
    if index.counted is not None:
        return _exploded(index.counted.repartition(tasks, "chunk_id"))
    return _asked(terms, index.postings).repartition(tasks, "chunk_id")


def _placed(terms: DataFrame, index: LexicalIndex, scope_docs: DataFrame) -> DataFrame:
    """Postings of the asked words, once for each scope that may see them. Chunks, not
    postings, meet the scopes, and then lie by document."""
    seen = scope_docs.groupBy("doc_id").agg(F.collect_set("scope_id").alias("scopes"))
    if index.counted is not None:
        held = index.counted.join(seen, "doc_id").select(
            "chunk_id", "doc_id", "dl", "scopes", F.explode("entries").alias("e")).select(
            "e.term", "chunk_id", "doc_id", "e.tf", "dl", "scopes")
        held = _asked(terms, held)
    else:
        held = _asked(terms, index.postings).join(seen, "doc_id")
    return held.select("term", "chunk_id", "doc_id", "tf", "dl", F.explode("scopes").alias("scope_id"))


def _one_in(index: LexicalIndex, n: int) -> LexicalIndex:
    """Every n-th chunk, by a hash of its id."""
    chosen = F.pmod(F.xxhash64("chunk_id", F.lit("first look")), F.lit(n)) == 0
    return replace(index, postings=index.postings.where(chosen), lengths=index.lengths.where(chosen),
                   counted=None if index.counted is None else index.counted.where(chosen))


def _least(slots: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(scope_id, block, l0, l1, ...): scores that a block's hits have to exceed, 0 if not known."""
    if known is None:
        floor = F.lit(0.0)
    else:
        slots = slots.join(known.select("query_id", "least"), "query_id", "left")
        floor = F.greatest(F.coalesce(F.col("least") - SLACK, F.lit(0.0)), F.lit(0.0))
    return slots.groupBy("scope_id", "block").agg(*[
        F.coalesce(F.max(F.when(F.col("slot") == i, floor)), F.lit(0.0)).alias(f"l{i}")
        for i in range(SLOTS)])


def _added_up(rows: DataFrame, weights: DataFrame, slots: DataFrame, least: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_id, top_k, score) of postings whose chunks lie together. A row
    adds to the scores of a whole block of questions; 0 means that no word is shared. Only
    scores above `least` go on."""
    part = _damped(F.col("tf"), F.col("dl"), F.col("mean_length"))
    sums = rows.join(weights, ["scope_id", "term"]).withColumn("part", part).groupBy(
        "scope_id", "block", "doc_id", "chunk_id").agg(*[
            F.sum(F.coalesce(F.col("part") * F.col(f"w{i}"), F.lit(0.0))).alias(f"s{i}")
            for i in range(SLOTS)])
    enough = [F.col(f"s{i}") > F.col(f"l{i}") for i in range(SLOTS)]
    each = sums.join(least, ["scope_id", "block"]).where(reduce(Column.__or__, enough)).select(
        "scope_id", "block", "doc_id", "chunk_id", F.posexplode(
            F.array(*[F.when(e, F.col(f"s{i}")) for i, e in enumerate(enough)])).alias("slot", "sum"))
    return each.where("sum is not null").join(slots, ["scope_id", "block", "slot"]).select(
        "query_id", "doc_id", "chunk_id", "top_k", F.round("sum", SCORE_DIGITS).alias("score"))


def sharing_chunks(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunks): how many chunks share a word with each question, if any does.

    A word stands for the set of its questions, as bits of blocks of 63. A chunk's sets are
    united and the bits counted, so the pairs themselves are never made.
    """
    terms = keep(query_terms(queries).select("query_id", "term").distinct())
    parts = 1 + terms.count() // 10_000
    place = F.row_number().over(W.partitionBy("part").orderBy("query_id")) - 1
    bits = keep(terms.select("query_id").distinct().withColumn(
        "part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("place", place).select(
        "query_id", (F.col("place") % 63).alias("bit"),
        (F.floor(F.col("place") / 63) * parts + F.col("part")).alias("block")))
    sets = keep(terms.join(bits, "query_id").groupBy("term", "block").agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("asked")))
    sent = F.broadcast(sets) if parts <= 1 + WORDS_SENT // 10_000 else sets
    united = postings.select("term", "chunk_id").join(sent, "term").groupBy("chunk_id", "block").agg(
        F.bit_or("asked").alias("asked"))
    counts = united.groupBy("block").agg(*[
        F.sum(F.shiftright("asked", i).bitwiseAND(F.lit(1))).alias(f"n{i}") for i in range(63)])
    return counts.select("block", F.posexplode(F.array(*[f"n{i}" for i in range(63)])).alias(
        "bit", "chunks")).where("chunks > 0").join(bits, ["block", "bit"]).select("query_id", "chunks")


def _summed(shares: DataFrame) -> DataFrame:
    """(query_id, chunk_id, top_k, score). The shares of one chunk lie together in a task, so
    most sums are done before the shuffle."""
    return shares.groupBy("query_id", "chunk_id").agg(
        F.max("top_k").alias("top_k"), F.round(F.sum("share"), SCORE_DIGITS).alias("score"))


def _pruned(weighed: DataFrame, index: LexicalIndex, places: DataFrame | None) -> DataFrame:
    """The same for all chunks that may be among the best of a question."""
    essential = keep(essential_terms(weighed, index, places))
    found = keep(candidates(essential, index, places))
    spared = weighed.join(essential.select("query_id", "term"), ["query_id", "term"], "left_anti")
    # the other words' shares: from their postings, or from the chunks' own rows if that is less
    unread = spared.agg(F.sum("df")).first()[0] or 0
    if index.counted is not None and found.count() * ROW_WORDS < unread:
        return full_scores(found, weighed, index)
    rest = _looked_up(spared, index, None).join(
        found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    columns = ["query_id", "chunk_id", "top_k", "share"]
    return _summed(found.select(*columns).union(rest.select(*columns)))


def full_scores(found: DataFrame, weighed: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, chunk_id, top_k, score) of the given (query_id, chunk_id)."""
    rows = index.rows_of(found.select("chunk_id").distinct())
    met = rows.join(found.select("query_id", "chunk_id"), "chunk_id").join(
        weighed.drop("scope_id"), ["query_id", "term"])
    return _summed(met.withColumn("share", _share()))


def weighed_terms(queries: DataFrame, index: LexicalIndex, scopes: Scopes | None,
                  statistics: DataFrame | None, bounds: bool = True) -> DataFrame:
    """(query_id, scope_id, top_k, term, qtf, df, n_chunks, mean_length, bound): the words of
    every question that stand in chunks it may see; `bound`, on demand, is the most a chunk can
    get for it."""
    terms = keep(query_terms(queries).join(queries.select("query_id", "top_k"), "query_id"))
    known = statistics
    if statistics is not None and bounds:
        known = statistics.join(_asked(terms, index.postings).groupBy("term").agg(*_bounds()), "term")
    parts = []
    if not (scopes is not None and scopes.all_scoped):
        free = terms.where(F.col("scope_id").isNull())
        parts.append(free.join(known if known is not None else store_statistics(
            _asked(terms, index.postings), index.lengths), "term"))
    if scopes is not None:
        scoped = terms.where(F.col("scope_id").isNotNull())
        if known is not None:
            parts.append(scoped.join(known, "term"))
        else:
            asked = scoped.select("scope_id", "term").distinct()
            held = _placed(terms, index, scopes.docs)
            parts.append(scoped.join(scope_statistics(held, index.lengths, scopes.docs, asked),
                                     ["scope_id", "term"]))
    columns = ["query_id", "scope_id", "top_k", "term", "qtf", "df", "n_chunks", "mean_length"]
    if bounds:
        columns.append(_share("max_tf", "min_dl").alias("bound"))
    weighed = [p.select(*columns) for p in parts]
    return weighed[0] if len(weighed) == 1 else weighed[0].union(weighed[1])


def _looked_up(weighed: DataFrame, index: LexicalIndex, places: DataFrame | None) -> DataFrame:
    """(query_id, top_k, chunk_id, doc_id, share, ...) of the given words' postings that a
    question may see. With `least` and `others` (the bounds of its other words together) what
    cannot reach `least` is left out, whole blocks at once where there are blocks."""
    pruned = "least" in weighed.columns
    if index.blocks is None:
        rows = index.postings.join(weighed, "term")
    else:
        rows = index.blocks.join(weighed, "term")
        if pruned:
            rows = rows.where(_share("max_tf", "min_dl") + F.col("others") >= F.col("least") - SLACK)
        rows = rows.select(*weighed.columns, F.explode("entries").alias("e")).select(
            *weighed.columns, "e.*")
    rows = rows.withColumn("share", _share())
    if pruned:
        rows = rows.where(F.col("share") + F.col("others") >= F.col("least") - SLACK)
    if places is None:
        return rows
    inside = places.select("scope_id", "doc_id")
    free = rows.where(F.col("scope_id").isNull())
    return rows.join(inside, ["scope_id", "doc_id"], "left_semi").select(*rows.columns).union(
        free.select(*rows.columns))


def essential_terms(weighed: DataFrame, index: LexicalIndex, places: DataFrame | None
                    ) -> DataFrame:
    """The words that have to be looked up, with `least` (a score that a question's best k
    reach; null if fewer chunks are known), `others` and `rest`, the bounds of the words of the
    question that need not be."""
    down = W.partitionBy("query_id").orderBy(F.desc("bound"), "term").rowsBetween(
        W.unboundedPreceding, -1)
    up = W.partitionBy("query_id").orderBy("bound", F.desc("term")).rowsBetween(
        W.unboundedPreceding, 0)
    every = W.partitionBy("query_id")
    seeds = weighed.withColumn("before", F.coalesce(F.sum("df").over(down), F.lit(0))).where(
        F.col("before") < SEED_ROWS).drop("before")
    most = weighed.agg(F.max("top_k")).first()[0] or 1
    partial = _summed(_looked_up(seeds, index, places))
    first = keep(rank_per_query(partial, most, F.col("top_k")).select("query_id", "chunk_id"))
    least = (full_scores(first, weighed, index).groupBy("query_id", "top_k")
             .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
             .where("n = top_k").select("query_id", "least"))
    ranked = weighed.join(least, "query_id", "left").withColumns({
        "up_to": F.sum("bound").over(up), "total": F.sum("bound").over(every)})
    needed = F.col("least").isNull() | (F.col("up_to") >= F.col("least") * SPARED - SLACK)
    return ranked.withColumn("needed", needed).withColumn(
        "rest", F.sum(F.when(~F.col("needed"), F.col("bound")).otherwise(0.0)).over(every)).where(
        "needed").select(*weighed.columns, F.coalesce("least", F.lit(0.0)).alias("least"),
                         (F.col("total") - F.col("bound")).alias("others"), "rest")


def candidates(essential: DataFrame, index: LexicalIndex, places: DataFrame | None = None
               ) -> DataFrame:
    """(query_id, chunk_id, top_k, share): all chunks that may be among the best of a question,
    with what they get for its essential words."""
    return (_looked_up(essential, index, places).groupBy("query_id", "chunk_id").agg(
        F.max("top_k").alias("top_k"), F.max("least").alias("least"), F.max("rest").alias("rest"),
        F.sum("share").alias("share"))
        .where(F.col("share") + F.col("rest") >= F.col("least") - SLACK).drop("least", "rest"))

"""Chat sessions: history, appending, trimming, expiry, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.operators.skew import lookup_join
from corpusq.operators.topk import newest_per_key

BLOCK_SECONDS = 3600


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def expired(last_access: Column, now: Column, ttl: int = fv.MEMORY_TTL_SECONDS) -> Column:
    """Strictly older than ttl seconds; exactly ttl is still alive."""
    return _micros(last_access) < _micros(now) - ttl * 1_000_000


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


def ordered_messages(messages: DataFrame) -> DataFrame:
    """Sessions in turn, messages by time, human before ai on equal time."""
    return messages.orderBy("session_id", "created_at", "id")


def trim(messages: DataFrame, max_messages: int = fv.MEMORY_MAX_MESSAGES) -> DataFrame:
    """Newest messages of each session."""
    return newest_per_key(messages, ["session_id"], max_messages)


def surplus(messages: DataFrame, max_messages: int = fv.MEMORY_MAX_MESSAGES) -> DataFrame:
    """The messages a trim deletes: those before the oldest one that is kept.

    The kept ones are few per session, so the bound is found without sorting a session.
    """
    bound = trim(messages.select("session_id", "created_at", "id"), max_messages).groupBy(
        "session_id").agg(F.min(F.struct("created_at", "id")).alias("_oldest_kept"))
    found = lookup_join(messages, bound, ["session_id"], spread="id", how="inner")
    return (found.where(F.struct("created_at", "id") < F.col("_oldest_kept"))
            .drop("_oldest_kept"))


def session_history(sessions: DataFrame, messages: DataFrame, now: Column,
                    ttl: int = fv.MEMORY_TTL_SECONDS,
                    max_messages: int | None = None) -> DataFrame:
    """(session_id, user_id, history) of all sessions; expired ones have an empty list.

    Every stored message is returned; appending keeps few per session, which bounds each
    list. `max_messages` reads only the newest ones of sessions stored without that bound.
    """
    if max_messages is not None:
        messages = trim(messages, max_messages)
    turns = F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content")))
    lists = messages.groupBy("session_id").agg(
        F.transform(turns, lambda t: F.struct(
            t["role"].alias("role"), t["content"].alias("content"))).alias("_turns"))
    alive = ~expired(F.col("last_access"), now, ttl)
    nothing = F.array().cast("array<struct<role:string,content:string>>")
    return sessions.join(lists, "session_id", "left").select(
        "session_id", "user_id",
        F.coalesce(F.when(alive, F.col("_turns")), nothing).alias("history"))


def refresh_access(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Sessions with last_access moved forward to the newest read (session_id, at); reading a
    history extends its session as appending does. Unknown sessions are not created."""
    newest = asked.groupBy("session_id").agg(F.max("at").alias("_at"))
    return sessions.join(newest, "session_id", "left").withColumn(
        "last_access", F.coalesce(F.greatest("last_access", "_at"), "last_access", "_at")
    ).select(*sessions.columns)


def expire_sessions(sessions: DataFrame, messages: DataFrame, now: Column,
                    ttl: int = fv.MEMORY_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Sessions still alive, and the messages of those."""
    gone = sessions.where(expired(F.col("last_access"), now, ttl)).select("session_id")
    kept = sessions.where(~expired(F.col("last_access"), now, ttl))
    return kept, lookup_join(messages, gone, ["session_id"], spread="id", how="left_anti")


def exchange_messages(exchanges: DataFrame) -> DataFrame:
    """(exchange_id, session_id, question, answer, at) -> two messages each; the human one
    has the smaller id."""
    turns = F.array(
        F.struct((F.col("exchange_id") * 2).alias("id"), F.lit("human").alias("role"),
                 F.col("question").alias("content")),
        F.struct((F.col("exchange_id") * 2 + 1).alias("id"), F.lit("ai").alias("role"),
                 F.col("answer").alias("content")))
    return (exchanges.select("session_id", F.col("at").alias("created_at"),
                             F.explode(turns).alias("m"))
            .select("m.id", "session_id", "m.role", "m.content", "created_at"))


def append_exchanges(sessions: DataFrame, messages: DataFrame, exchanges: DataFrame,
                     max_messages: int = fv.MEMORY_MAX_MESSAGES
                     ) -> tuple[DataFrame, DataFrame]:
    """Add exchanges, create missing sessions, refresh last access, trim what was touched.

    exchange_id must grow past the stored message ids; user_id is optional.
    """
    new = exchange_messages(exchanges)
    touched = exchanges.groupBy("session_id").agg(
        F.min("at").alias("_first"), F.max("at").alias("_last"),
        *([F.min("user_id").alias("_user")] if "user_id" in exchanges.columns
          else [F.lit(None).cast("string").alias("_user")]))
    ids = touched.select("session_id")
    untouched = lookup_join(messages, ids, ["session_id"], spread="id", how="left_anti")
    in_use = lookup_join(messages, ids, ["session_id"], spread="id", how="left_semi")
    kept = trim(in_use.select(*new.columns).unionByName(new), max_messages)
    upserted = (sessions.join(touched, "session_id", "full").select(
        "session_id",
        F.coalesce("user_id", "_user").alias("user_id"),
        F.coalesce("created_at", "_first").alias("created_at"),
        F.coalesce(F.greatest("last_access", "_last"), "last_access", "_last")
        .alias("last_access")))
    return upserted, untouched.select(*new.columns).unionByName(kept)


# --- replay of a log ---------------------------------------------------------------

def _block(ts: Column, seconds: int) -> Column:
    return F.floor(_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def session_islands(log: DataFrame, ttl: int = fv.MEMORY_TTL_SECONDS,
                    block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Log (session_id, ts, id, ...) + `island`: a gap above ttl starts the next one.

    A session is cut into time blocks, so a very busy one is many tasks' work; only one
    summary row per block is lined up per session to carry the count across blocks.
    """
    cut = log.withColumn("_block", _block(F.col("ts"), block_seconds))
    inside = W.partitionBy("session_id", "_block").orderBy("ts", "id")
    gap = _micros(F.col("ts")) - _micros(F.lag("ts").over(inside)) > ttl * 1_000_000
    marked = cut.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0)))
    counted = marked.withColumn("_inner", F.sum("_gap").over(
        inside.rowsBetween(W.unboundedPreceding, 0)))
    blocks = counted.groupBy("session_id", "_block").agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.max("_inner").alias("_gaps"))
    line = W.partitionBy("session_id").orderBy("_block")
    broken = _micros(F.col("_from")) - _micros(F.lag("_to").over(line)) > ttl * 1_000_000
    carried = (blocks.withColumn("_broken", F.coalesce(broken.cast("int"), F.lit(0)))
               .withColumn("_before", F.coalesce(F.lag("_gaps").over(line), F.lit(0)))
               .select("session_id", "_block", F.sum(F.col("_broken") + F.col("_before")).over(
                   line.rowsBetween(W.unboundedPreceding, 0)).alias("_offset")))
    return (counted.join(carried, ["session_id", "_block"])
            .withColumn("island", (F.col("_inner") + F.col("_offset")).cast("bigint"))
            .drop("_block", "_gap", "_inner", "_offset"))


def history_replay(log: DataFrame, content: list[str],
                   max_messages: int = fv.MEMORY_MAX_MESSAGES,
                   ttl: int = fv.MEMORY_TTL_SECONDS,
                   block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Log + `history`: the messages visible when each entry came in, oldest first.

    `content` names the columns a history entry keeps. Blocks as in session_islands; at
    most max_messages entries are handed from one block to the next.
    """
    islands = session_islands(log, ttl, block_seconds).withColumn(
        "_block", _block(F.col("ts"), block_seconds))
    keys = ["session_id", "island"]
    entry = F.struct("ts", "id", *content)
    inside = W.partitionBy(*keys, "_block").orderBy("ts", "id")
    recent = islands.withColumn("_here", F.collect_list(entry).over(
        inside.rowsBetween(-max_messages, -1)))
    tails = newest_per_key(islands, [*keys, "_block"], max_messages, ("ts", "id")).groupBy(
        *keys, "_block").agg(F.array_sort(F.collect_list(entry)).alias("_tail"))
    line = W.partitionBy(*keys).orderBy("_block").rowsBetween(-max_messages, -1)
    carried = tails.select(*keys, "_block", _last(
        F.flatten(F.collect_list("_tail").over(line)), max_messages).alias("_carried"))
    joined = recent.join(carried, [*keys, "_block"])
    history = _last(F.concat("_carried", "_here"), max_messages)
    return joined.withColumn("history", history).drop("_block", "_here", "_carried")


def _last(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))


def final_memory(log: DataFrame, content: list[str],
                 max_messages: int = fv.MEMORY_MAX_MESSAGES,
                 ttl: int = fv.MEMORY_TTL_SECONDS) -> DataFrame:
    """(session_id, memory) after the whole log: the newest entries of the last island.

    The newest max_messages decide it: a gap among them is the only one that matters.
    """
    newest = newest_per_key(log, ["session_id"], max_messages, ("ts", "id"))
    w = W.partitionBy("session_id").orderBy("ts", "id")
    gap = _micros(F.col("ts")) - _micros(F.lag("ts").over(w)) > ttl * 1_000_000
    numbered = newest.withColumn("_island", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(
        w.rowsBetween(W.unboundedPreceding, 0)))
    numbered = numbered.withColumn("_final", F.max("_island").over(W.partitionBy("session_id")))
    return (numbered.where(F.col("_island") == F.col("_final")).groupBy("session_id")
            .agg(F.array_sort(F.collect_list(F.struct("ts", "id", *content))).alias("memory")))

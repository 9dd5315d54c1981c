"""History, trimming, expiry, replay."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusq.operators import chat

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.fixture(scope="module")
def empty(spark):
    return (spark.createDataFrame([], "session_id string, user_id string, created_at timestamp, last_access timestamp"),
            spark.createDataFrame([], "id long, session_id string, role string, content string, created_at timestamp"))


def exchanges(spark, *rows):
    return spark.createDataFrame([(i, s, f"Q{n}", f"A{n}", at(t)) for i, (s, n, t) in enumerate(rows)],
                                 "exchange_id long, session_id string, question string, answer string, at timestamp")


def test_trim_keeps_newest(spark, empty, rows):
    x = exchanges(spark, ("s1", 1, 1), ("s1", 2, 2), ("s1", 3, 3), ("s2", 2, 2))
    sessions, messages = chat.append_exchanges(*empty, x, 4)
    got = [r.content for r in chat.ordered_messages(messages).where("session_id = 's1'").collect()]
    assert got == ["Q2", "A2", "Q3", "A3"]
    assert [r.content for r in chat.ordered_messages(messages).where("session_id = 's2'").collect()] == ["Q2", "A2"]
    odd = chat.append_exchanges(*empty, x, 3)[1]
    assert [r.content for r in chat.ordered_messages(odd).where("session_id = 's1'").collect()] == ["A2", "Q3", "A3"]
    assert sessions.where("session_id = 's1'").first().last_access == at(3).replace(tzinfo=None)


def test_untouched_sessions_stay(spark, empty, rows):
    sessions, messages = chat.append_exchanges(*empty, exchanges(spark, ("s1", 1, 1), ("s1", 2, 2)), 10)
    later = exchanges(spark, ("s2", 9, 9)).withColumn("exchange_id", F.col("exchange_id") + 100)
    sessions, messages = chat.append_exchanges(sessions, messages, later, 2)
    assert rows(chat.message_counts(messages)) == [("s1", 4), ("s2", 2)]


def test_ttl_boundary(spark, rows):
    sessions = spark.createDataFrame([("old", "u", at(0), at(0)), ("edge", "u", at(0), at(1)), ("new", "u", at(0), at(5))],
                                     "session_id string, user_id string, created_at timestamp, last_access timestamp")
    messages = spark.createDataFrame([(1, s, "human", "hi", at(0)) for s in ("old", "edge", "new")],
                                     "id long, session_id string, role string, content string, created_at timestamp")
    now = F.lit(at(11))
    got = {r.session_id: len(r.history) for r in chat.session_history(sessions, messages, now, ttl=10).collect()}
    assert got == {"old": 0, "edge": 1, "new": 1}
    kept, left = chat.expire_sessions(sessions, messages, now, ttl=10)
    assert rows(kept, "session_id") == [("edge",), ("new",)] and rows(left, "session_id") == [("edge",), ("new",)]


def test_history_is_ordered_on_equal_times(spark):
    sessions = spark.createDataFrame([("s", "u", at(0), at(5)), ("silent", "u", at(0), at(5))],
                                     "session_id string, user_id string, created_at timestamp, last_access timestamp")
    messages = spark.createDataFrame([(3, "s", "human", "b", at(1)), (2, "s", "ai", "a2", at(0)), (1, "s", "human", "a1", at(0))],
                                     "id long, session_id string, role string, content string, created_at timestamp")
    got = {r.session_id: [(m.role, m.content) for m in r.history]
           for r in chat.session_history(sessions, messages, F.lit(at(6))).collect()}
    assert got == {"s": [("human", "a1"), ("ai", "a2"), ("human", "b")], "silent": []}


def test_history_is_whole(spark):
    sessions = spark.createDataFrame([("s", "u", at(0), at(5))],
                                     "session_id string, user_id string, created_at timestamp, last_access timestamp")
    messages = spark.createDataFrame([(i, "s", "human", str(i), at(i)) for i in range(30)],
                                     "id long, session_id string, role string, content string, created_at timestamp")
    read = lambda **k: [m.content for m in chat.session_history(sessions, messages, F.lit(at(6)), **k).first().history]
    assert read() == [str(i) for i in range(30)]
    assert read(max_messages=4) == ["26", "27", "28", "29"]
    asked = spark.createDataFrame([("s", at(9)), ("s", at(7)), ("new", at(8))], "session_id string, at timestamp")
    assert chat.refresh_access(sessions, asked).where(F.col("last_access") == F.lit(at(9))).count() == 1


def test_surplus_is_the_complement(spark):
    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else f"s{rng.randrange(5)}", "human", "x", at(rng.randrange(40))) for i in range(300)]
    m = spark.createDataFrame(data, "id long, session_id string, role string, content string, created_at timestamp")
    kept, gone = chat.trim(m, 7), chat.surplus(m, 7)
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(kept) | ids(gone) == set(range(300)) and not ids(kept) & ids(gone)
    assert kept.where("session_id = 'hot'").count() == 7


def replay(log, n, ttl):
    out, final = {}, {}
    for s in {r[0] for r in log}:
        seen, last, island = [], None, 0
        for _, t, i in sorted((r for r in log if r[0] == s), key=lambda r: (r[1], r[2])):
            if last is not None and t - last > ttl:
                seen, island = [], island + 1
            out[i] = (island, seen[-n:])
            seen, last = [*seen, i], t
        final[s] = seen[-n:]
    return out, final


@pytest.mark.parametrize("block", [1, 7, 60, 100000])
def test_replay(spark, block):
    rng = random.Random(block)
    log = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}", rng.randrange(400), i) for i in range(400)]
    df = spark.createDataFrame([(s, at(t), i, f"m{i}") for s, t, i in log],
                               "session_id string, ts timestamp, id long, content string")
    want, final = replay(log, 5, 10)
    got = {r.id: (r.island, [m.id for m in r.history])
           for r in chat.history_replay(df, ["content"], 5, 10, block).collect()}
    assert got == want
    islands = {r.id: r.island for r in chat.session_islands(df, 10, block).collect()}
    assert islands == {i: w[0] for i, w in want.items()}
    assert {r.session_id: [m.id for m in r.memory]
            for r in chat.final_memory(df, ["content"], 5, 10).collect()} == final

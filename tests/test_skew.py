"""Hot keys: the chunked ways must give what the plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from debatelens import scale
from debatelens.operators import distributions, stats, turns
from debatelens.operators.cluster import seeded_sample
from debatelens.scale import join_lookup, positions, split_hot

LEVELS = ["none", "light", "strong"]


@pytest.fixture(scope="module")
def skewed(spark):
    """900 messages, two thirds of them in one conversation, many on the same time."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        conv = "hot" if i % 3 else rng.choice(["a", "b", None, "c"])
        time = None if rng.random() < 0.05 else f"2024-01-01T00:00:{rng.randrange(60):02d}"
        speaker = rng.choice(["Host", "Bot 1", "Bot 2"])
        rows.append((i, conv, time, speaker, f"m{i}", rng.choice(LEVELS), round(rng.gauss(0, 1), 1), i // 4))
    return spark.createDataFrame(
        rows,
        "id long, conversation_id string, timestamp string, speaker string, message string, escalation string, "
        "value double, message_id long",
    ).repartition(6)


def both(function, frame, columns):
    plain = sorted(map(repr, function(frame, None).select(columns).collect()))
    hot = sorted(map(repr, function(frame, 50).select(columns).collect()))
    assert plain == hot and plain


def test_hot_keys_are_found(skewed):
    normal, hot, rows = split_hot(skewed, "conversation_id", 100)
    assert rows == hot.count() == 600
    assert normal.count() + hot.count() == 900
    _, hot, _ = split_hot(skewed, "conversation_id", 10)
    assert hot.count() == 900  # the null conversation is a key too


def test_a_sample_finds_large_keys(spark, monkeypatch):
    monkeypatch.setattr(scale, "SAMPLED_ROWS_PER_KEY", 200)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    found = scale.hot_keys(df, "k", 2_000).collect()
    assert [k for k, _ in found] == ["hot"] and 8_000 < found[0][1] < 12_000
    assert scale.hot_keys(df, "k", 1_000_000).collect() == []


def test_many_hot_keys_become_a_join(skewed):
    for limit in (10, 100):
        listed = split_hot(skewed, "conversation_id", limit)
        joined = split_hot(skewed, "conversation_id", limit, listed=0)
        assert listed[2] == joined[2]
        for a, b in zip(listed[:2], joined[:2], strict=True):
            assert a.columns == b.columns
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(context, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(context, "master", "spark://somewhere:7077")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scale.checkpoint_root(spark)


def test_scratch_paths_are_fresh_and_in_one_folder(spark):
    a, b = scale.scratch_path(spark, "x"), scale.scratch_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_turn_index(skewed):
    both(lambda d, n: turns.turn_index(d, max_rows=n), skewed, ["id", "turn"])


def test_turns_run_from_zero(skewed):
    numbered = turns.turn_index(skewed, max_rows=50)
    table = numbered.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.countDistinct("turn").alias("d"), F.min("turn"), F.max("turn")
    )
    for row in table.collect():
        assert row["n"] == row["d"] and row[3] == 0 and row[4] == row["n"] - 1


def test_turn_from_id(skewed):
    both(lambda d, n: turns.turn_from_id(d, max_rows=n), skewed, ["id", "turn"])


def test_host_strategy(skewed):
    both(lambda d, n: turns.host_strategy(d, max_rows=n), skewed, ["id", "strategy"])


@pytest.mark.parametrize("ask", [False, True])
def test_reply_context(skewed, ask):
    both(lambda d, n: turns.reply_context(d, ask=ask, max_rows=n), skewed, ["id", "context"])


def test_last_statement(skewed):
    both(lambda d, n: turns.last_statement(d, max_rows=n), skewed, ["id", "statement"])


def test_reply_context_by_hand(spark):
    rows = [(1, "c", "t1", "Host", "hi"), (2, "c", "t2", "Bot 1", "yo"), (3, "c", "t3", "Con-Bot", "no")]
    df = spark.createDataFrame(rows, "id long, conversation_id string, timestamp string, speaker string, message string")
    got = {r["id"]: r["context"] for r in turns.reply_context(df, ask=True).collect()}
    assert got[2] == "Host: hi\nHost: 'hi'\nBot 1, how do you respond?"
    assert got[3] == "Host: hi\nBot 1: yo\nHost: 'yo'\nCon-Bot, how do you respond critically?"


def test_box_summary(skewed):
    limit = {None: 10_000, 50: 5}
    both(
        lambda d, n: distributions.box_summary(d, ["escalation"], "value", limit[n]),
        skewed,
        ["escalation", "count", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers"],
    )


def test_mann_whitney(skewed):
    limit = {None: 10_000, 50: 5}
    both(lambda d, n: stats.mann_whitney(d, ["value"], max_rows=limit[n]), skewed, ["metric", "u", "z", "p"])


def test_rank_test_is_symmetric_and_known(spark):
    rows = [("none", 1.0), ("none", 2.0), ("none", 3.0), ("strong", 2.0), ("strong", 4.0)]
    df = spark.createDataFrame(rows, "escalation string, value double")
    one = stats.mann_whitney(df, ["value"]).first()
    other = stats.mann_whitney(df, ["value"], first="strong", second="none").first()
    assert one["u"] == 1.5 and one["u"] + other["u"] == 6
    assert one["p"] == pytest.approx(other["p"]) and 0 < one["p"] <= 1
    short = stats.mann_whitney(df.where("escalation = 'none'"), ["value"]).first()
    assert short["note"] == "not enough data" and short["u"] is None and short["p"] is None


def test_lookup_is_broadcast_only_when_small(spark, skewed):
    small = spark.range(10).withColumnRenamed("id", "message_id")
    broadcast = join_lookup(skewed, small, "message_id")
    assert broadcast._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
    shuffled = join_lookup(skewed, small, "message_id", max_bytes=5)
    assert sorted(shuffled.collect(), key=repr) == sorted(broadcast.collect(), key=repr)


def test_sample_is_exact(spark):
    df = spark.range(5000)
    got = [r[0] for r in seeded_sample(df, 100, 42).collect()]
    hashed = df.select("id", F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))).alias("h"))
    assert got == [r[0] for r in hashed.orderBy("h", "id").limit(100).collect()]
    assert seeded_sample(df, 9000, 42).count() == 5000


def test_positions_follow_any_order(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(20)], "k int, v int")
    got = positions(df, "k", [F.desc("v")], "p", max_rows=3).collect()
    assert all(r["p"] == (19 - r["v"]) // 2 for r in got)

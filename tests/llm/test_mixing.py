"""Poisson mixing against a plain computation, and its shares."""

import hashlib
import math

import pytest

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, rate_steps int"


def draw(rate, key):
    u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
    n, p = 0, math.exp(-rate)
    f = p
    while f <= u:
        n += 1
        p *= rate / n
        f += p
    return n


def test_query_equals_plain_draws(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(r.text.encode()) + 1
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    rate = {s: sum(size.values()) * weight[s] / sum(weight.values()) / size[s] for s in size}
    want = {r.doc_id: draw(rate[r.source], f"{mixing.SEED}:{r.doc_id}") for r in rows}
    got = entry.queries()["op3_poisson_mix"](spark, DATA).collect()
    assert sorted((r.doc_id, r.copy) for r in got) == sorted((i, c) for i, n in want.items() for c in range(1, n + 1))
    texts = {r.doc_id: r.text for r in rows}
    assert all(texts[r.doc_id] == r.text and want[r.doc_id] == r.n_copies for r in got)


def test_shares_follow_given_weights(spark):
    rows = [(i, "x" * 99, "big" if i % 3 else "small", None, 1) for i in range(30000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0}, total=2.0)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert n["big"] == pytest.approx(15000, rel=0.03) and n["small"] == pytest.approx(45000, rel=0.03)
    assert mixed.columns == [*docs.columns, "copy_", "n_copies", "shuffle_key"]
    keys = [r.shuffle_key for r in mixed.limit(20000).collect()]
    assert len(set(keys)) == len(keys)
    assert mixing.poisson_mix(docs, {"small": 1.0}).select("source").distinct().collect() == [("small",)]


def test_nulls_repeats_and_many_repeats(spark):
    rows = [(None, None, None, None, 1), (None, "a", None, None, 1), (1, "", "s", None, 1), (1, "", "s", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.poisson_mix(docs, total=20.0, numbered=False)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert set(got) == {(None, None), (None, "a"), (1, "")} and got[1, ""] % 2 == 0
    n = mixing.poisson_mix(docs, total=1000.0).count()
    assert 3000 < n < 5000


def test_many_sources_are_joined_spread_by_key(spark):
    rows = [(i, "x" * (i % 7), None if i % 50 == 0 else f"s{i % 40}", None, 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    small, large = (mixing.poisson_mix(docs, total=3.0, most_broadcast=b) for b in (1 << 20, 1))
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
    assert large.columns == small.columns
    plan = mixing.poisson_mix(docs, total=3.0, most_broadcast=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan


def test_one_byte_source_beside_a_very_large_one(spark):
    from pyspark.sql import functions as F

    big = spark.range(20).select((-1 - F.col("id")).alias("doc_id"), F.expr("repeat('x', 999999)").alias("text"), F.lit("big").alias("source"))
    tiny = spark.createDataFrame([(7, None, None), (8, "", "rare")], "doc_id long, text string, source string")
    got = mixing.poisson_mix(big.union(tiny)).where("doc_id > 0").groupBy("doc_id", "n_copies").count().collect()
    weight = 20000000.0**mixing.TEMPERATURE + 2
    rate = 20000002 / weight
    want = {i: draw(rate, f"{mixing.SEED}:{i}") for i in (7, 8)}
    assert rate > 100 and {r.doc_id: r.n_copies for r in got} == want == {r.doc_id: r["count"] for r in got}


def test_rates_beyond_the_exponential(spark):
    from pyspark.sql import functions as F

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("tiny").alias("source"))
    docs = docs.unionByName(spark.range(1000, 1002).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 1999999)").alias("text"), F.lit("big").alias("source")))
    mixed = mixing.poisson_mix(docs, {"tiny": 1.0, "big": 4.0}, numbered=True).where("doc_id < 1000")
    got = mixed.groupBy("doc_id", "n_copies").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("copies"), F.max("copy").alias("last")).collect()
    rate = 4000200 / 5 / 200
    parts = math.ceil(rate / mixing.MOST_RATE)
    assert len(got) == 200 and all(r.n_copies == r.n == r.copies == r["last"] for r in got)
    for r in got:
        keys = [f"{mixing.SEED}:{r.doc_id}"] + [f"part:{k}:{mixing.SEED}:{r.doc_id}" for k in range(1, parts)]
        assert r.n_copies == sum(draw(rate / parts, k) for k in keys)
    mean = sum(r.n for r in got) / 200
    assert mean == pytest.approx(rate, rel=0.01)
    assert sum((r.n - rate) ** 2 for r in got) / 200 == pytest.approx(rate, rel=0.4)


def test_copies_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)
    docs = spark.createDataFrame([(i, "x", "a", None, 1) for i in range(50)], SCHEMA)
    rows = mixing.poisson_mix(docs, total=10.0).collect()
    want = {i: draw(10.0, f"{mixing.SEED}:{i}") for i in range(50)}
    assert sorted((r.doc_id, r["copy_"]) for r in rows) == [(i, c) for i, n in want.items() for c in range(1, n + 1)]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.poisson_mix(none).count() == 0
    assert mixing.poisson_mix(none, {"a": 1.0}).count() == 0

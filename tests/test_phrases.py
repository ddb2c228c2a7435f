"""Phrases of a table against the same phrases as a list."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import DATA
from debatelens import values as V
from debatelens.functions.escalation import has_phrase
from debatelens.operators.phrases import with_phrases
from debatelens.sources import fixtures


def table(spark, phrases):
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def lists(df, phrases):
    """The phrases of each text by the expression of one phrase each."""
    held = [F.when(has_phrase(phrases=[p]), p) for p in sorted(set(phrases))]
    return df.withColumn("phrases", F.when(F.col("message").isNotNull(), F.array_compact(F.array(*held))))


def same(got, want):
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
def test_table_agrees_with_the_list_form(spark, msgs, max_bytes):
    df = msgs.select("id", "message")
    phrases = [r.phrase for r in fixtures.phrase_table(spark, DATA).orderBy(F.md5("phrase")).limit(60).collect()]
    phrases += fixtures.PHRASES + V.ESCALATION_PHRASES
    got = with_phrases(df, table(spark, phrases), max_bytes=max_bytes)
    want = lists(df, phrases)
    same(got, want)
    assert want.where("size(phrases) > 0").count() > 50
    flags = got.select("id", (F.size("phrases") > 0).alias("f")).join(df.select("id", has_phrase(phrases=phrases).alias("g")), "id")
    assert flags.where("f <> g").count() == 0


def test_punctuation_inside_and_around_phrases(spark):
    rng = random.Random(2)
    parts = ["a", "bb", "é", "x_1", " ", "  ", "!", "--", "'", ".", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(400)] + [None, "A bb!"]
    phrases = list({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(80)})
    phrases = [p for p in phrases if any(c.isalnum() for c in p)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, message string")
    same(with_phrases(df, table(spark, [*phrases, "", None, phrases[0]])), lists(df, phrases))


def test_no_phrases_and_phrases_without_words(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "id int, message string")
    assert [tuple(r) for r in with_phrases(df, table(spark, [])).orderBy("id").collect()] == [(1, "some text", []), (2, None, None)]
    with pytest.raises(PySparkException, match="without a word"):
        with_phrases(df, table(spark, ["!!!"])).collect()

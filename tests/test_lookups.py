"""Draws: right candidates, fallbacks, the same for small and large lookup tables."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from debatelens.operators import lookups
from debatelens.plans.catalog import conversations
from debatelens.sources import fixtures


@pytest.fixture(scope="module")
def rows(msgs):
    return conversations(msgs).cache()


def test_large_tables_draw_the_same(spark, rows, monkeypatch):
    def draws():
        prompts = lookups.assign_prompt(rows, fixtures.prompts(spark, DATA), fixtures.default_prompts(spark, DATA), "s")
        topics = lookups.assign_topic(rows, fixtures.questions(spark, DATA), "s")
        return [
            sorted(map(repr, prompts.select("conversation_id", "prompt").collect())),
            sorted(map(repr, topics.select("conversation_id", "question").collect())),
        ]

    small = draws()
    monkeypatch.setattr(lookups, "MAX_BROADCAST_BYTES", 1)
    assert draws() == small


def test_large_tables_meet_no_single_task_or_hot_key(spark, rows, monkeypatch):
    monkeypatch.setattr(lookups, "MAX_BROADCAST_BYTES", 1)
    drawn = lookups.assign_topic(rows, fixtures.questions(spark, DATA), "s")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan
    assert not re.search(r"SortMergeJoin \[category#\d+\], ", plan)


def test_prompts_belong_to_topic_and_mode(spark):
    convs = spark.createDataFrame(
        [(str(i), c, m) for i in range(60) for c, m in [("Politics", "neutral"), ("Chess", "neutral"), ("Chess", "odd")]],
        "conversation_id string, category string, host_mode string",
    ).withColumn("conversation_id", F.concat("conversation_id", "category", "host_mode"))
    prompts = spark.createDataFrame(
        [("Politics", "neutral", f"p{i}") for i in range(3)], "category string, host_mode string, prompt string"
    )
    defaults = spark.createDataFrame([("neutral", "d1"), ("neutral", "d2")], "host_mode string, prompt string")
    drawn = lookups.assign_prompt(convs, prompts, defaults, "seed")
    found = {
        (r["category"], r["host_mode"]): set(r["p"])
        for r in drawn.groupBy("category", "host_mode").agg(F.collect_set("prompt").alias("p")).collect()
    }
    assert found[("Politics", "neutral")] == {"p0", "p1", "p2"}
    assert found[("Chess", "neutral")] == {"d1", "d2"}
    assert found[("Chess", "odd")] == set()
    assert drawn.count() == convs.count()


def test_claims_fall_back_to_the_fixed_sentence(spark):
    convs = spark.createDataFrame([("1", "Economy"), ("2", "Chess"), ("3", None)], "conversation_id string, category string")
    claims = spark.createDataFrame([("economy", "c")], "topic string, claim string")
    got = {r["conversation_id"]: r["claim"] for r in lookups.assign_claim(convs, claims, "s").collect()}
    assert got == {"1": "c", "2": lookups.NO_CLAIM, "3": lookups.NO_CLAIM}


def test_unknown_topics_draw_from_all(spark):
    convs = spark.createDataFrame(
        [(str(i), c) for i in range(80) for c in ("A", None)], "n string, category string"
    ).withColumn("conversation_id", F.concat("n", F.coalesce("category", F.lit("-"))))
    questions = spark.createDataFrame([("A", "a1"), ("B", "b1"), ("B", "b2")], "category string, question string")
    drawn = lookups.assign_topic(convs, questions, "s").groupBy("category").agg(F.collect_set("question").alias("q"))
    assert {r["category"]: set(r["q"]) for r in drawn.collect()} == {"A": {"a1"}, None: {"a1", "b1", "b2"}}


def test_reactions_take_mode_then_any(spark):
    rows = spark.createDataFrame(
        [(1, "fact_check", " EXTREME", "Economy", "x"), (2, "fact_check", "neutral", "Economy", "y"),
         (3, "redirect", "neutral", None, None)],
        "id long, strategy string, host_mode string, category string, statement string",
    )
    templates = spark.createDataFrame(
        [("fact_check", "extreme", "no: {statement}"), ("fact_check", None, "hm"), ("redirect", None, "to {category}")],
        "strategy string, host_mode string, template string",
    )
    got = {r["id"]: r["reaction"] for r in lookups.render_host_reaction(rows, templates, "s").collect()}
    assert got == {1: "no: x", 2: "hm", 3: "to the broader topic"}

"""The weighted rule at and around each cut-off, and the phrase and toxicity flags."""

import pytest
from pyspark.sql import functions as F

from debatelens.functions import escalation as E
from debatelens.functions.reasons import parse_reasons, reason_family, reasons_text
from debatelens.operators.enrich import apply_rule

COLUMNS = (
    "vader_compound double, textblob_polarity double, transformer_label string, transformer_score double, "
    "distilbert_label string, distilbert_score double, toxicity_is_toxic boolean"
)
CALM = (0.0, 0.0, "POSITIVE", 0.99, "POSITIVE", 0.99, False)
CASES = [
    (CALM, 0, "none", []),
    ((-0.5, *CALM[1:]), 0, "none", []),
    ((-0.500001, *CALM[1:]), 1, "none", ["vader_negative"]),
    ((-0.8, *CALM[1:]), 1, "none", ["vader_negative"]),
    ((-0.800001, *CALM[1:]), 2, "light", ["vader_strong_negative"]),
    ((0.0, -0.2, *CALM[2:]), 0, "none", []),
    ((0.0, -0.21, *CALM[2:]), 1, "none", ["textblob_negative"]),
    ((0.0, -0.5, *CALM[2:]), 1, "none", ["textblob_negative"]),
    ((0.0, -0.51, *CALM[2:]), 3, "light", ["textblob_negative", "textblob_strong_negative"]),
    ((0.0, 0.0, "NEGATIVE", 0.85, *CALM[4:]), 0, "none", []),
    ((0.0, 0.0, "NEGATIVE", 0.86, *CALM[4:]), 2, "light", ["transformer_negative"]),
    ((0.0, 0.0, "NEGATIVE", 0.95, *CALM[4:]), 2, "light", ["transformer_negative"]),
    ((0.0, 0.0, "NEGATIVE", 0.96, *CALM[4:]), 5, "strong", ["transformer_negative", "transformer_strong_negative"]),
    ((0.0, 0.0, "negative", 0.96, *CALM[4:]), 0, "none", []),
    ((*CALM[:4], "NEGATIVE", 0.85, False), 0, "none", []),
    ((*CALM[:4], "NEGATIVE", 0.95, False), 1, "none", ["distilbert_negative"]),
    ((*CALM[:4], "NEGATIVE", 0.99, False), 1, "none", []),
    ((*CALM[:4], "NEGATIVE", 0.991, False), 1, "none", ["distilbert_strong_negative"]),
    ((*CALM[:6], True), 3, "light", ["toxicity"]),
    ((-0.9, -0.6, "NEGATIVE", 0.97, "NEGATIVE", 0.995, True), 14, "strong", None),
    ((None, None, None, None, None, None, None), 0, "none", []),
]


def test_rule_at_every_cut_off(spark):
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], f"i int, {COLUMNS}")
    got = {r["i"]: r for r in apply_rule(rows).collect()}
    for i, (_, score, level, reasons) in enumerate(CASES):
        assert got[i]["escalation_score"] == score, CASES[i]
        assert got[i]["escalation"] == level
        if reasons is not None:
            assert got[i]["escalation_reason"] == reasons


@pytest.mark.parametrize(
    "text, flagged",
    [
        ("You IDIOT!", True),
        ("idiotic talk", False),
        ("just shut up now", True),
        ("you don't understand", True),
        ("shutup", False),
        ("éfool", False),
        ("what's wrong with you?", True),
        ("a fine day", False),
    ],
)
def test_phrases(spark, text, flagged):
    row = spark.createDataFrame([(text,)], "message string").select(E.has_phrase()).first()
    assert row[0] is flagged


def test_toxicity_cut_offs_and_case(spark):
    rows = [("TOXIC", 0.8), ("TOXIC", 0.81), ("toxic", 0.95), (None, 0.95), ("TOXIC", 0.9), ("TOXIC", 0.91)]
    df = spark.createDataFrame([("ok", *r) for r in rows], "message string, toxicity_label string, toxicity_score double")
    got = df.select(E.is_toxic(), E.is_toxic(toxic_label="toxic"), E.phrase_or_toxic()).collect()
    assert [r[0] for r in got] == [False, True, False, False, True, True]
    assert [r[1] for r in got] == [False, False, True, False, False, False]
    assert [r[2] for r in got] == [False, False, False, False, False, True]


def test_reason_texts(spark):
    texts = ["['a', 'b']", "[]", "None", None, "free text", '["it\'s"]', "['a',]", "'single'", " ['x'] "]
    expected = [["a", "b"], [], None, None, ["free text"], ["it's"], ["a"], ["single"], ["x"]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, escalation_reason string")
    got = {r["i"]: r["p"] for r in df.select("i", parse_reasons().alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    back = spark.createDataFrame([(["a", "b"],), ([],)], "r array<string>").select(reasons_text("r"))
    assert [r[0] for r in back.collect()] == ["['a', 'b']", "[]"]


def test_families(spark):
    names = ["vader_negative", "DistilBERT_x", "transformer_negative", "textblob_negative", "toxicity"]
    df = spark.createDataFrame([(n,) for n in names], "reason string")
    got = [r[0] for r in df.select(reason_family(F.col("reason"))).collect()]
    assert got == ["VADER", "DistilBERT", "Transformer", "TextBlob", "Other"]

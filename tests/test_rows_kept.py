"""Rows that were easily lost: no speaker, blank texts, unusual labels, bad batches."""

from pyspark.sql import functions as F

from conftest import DATA
from debatelens.functions.escalation import has_phrase
from debatelens.functions.normal import is_blank, lower_name, signed_score, title_name
from debatelens.operators import enrich, normalize
from debatelens.operators.models import predict_rows, score_with_models
from debatelens.plans import reports
from debatelens.sources import fixtures


def test_all_blanks_are_cut(spark):
    df = spark.createDataFrame([("\tPolitics\n", "  Extreme\r", " positive\t", 0.5)], "c string, m string, l string, s double")
    row = df.select(title_name("c"), lower_name("m"), signed_score("l", "s"), is_blank(F.lit("\n\t  "))).first()
    assert tuple(row) == ("Politics", "extreme", 0.5, True)


def test_no_phrases_flag_nothing(spark):
    df = spark.createDataFrame([("",), ("hello there.",), ("an idiot",)], "message string")
    assert [r[0] for r in df.select(has_phrase(phrases=[])).collect()] == [False] * 3
    assert [r[0] for r in df.select(has_phrase(phrases=["", "idiot"])).collect()] == [False, False, True]


def test_rows_without_a_speaker_are_stored_and_scored(spark):
    rows = [(1, "Host", "a"), (2, None, "b"), (3, "Bot 1", None)]
    df = spark.createDataFrame(rows, "id long, speaker string, message string")
    df = df.withColumns({c: F.lit("x") for c in ("conversation_id", "timestamp", "category", "host_mode", "api")})
    scorer = fixtures.scorer(spark, DATA)
    done = enrich.ingest_conversations(df, scorer, "category", "host_mode", "api")
    got = {r["id"]: (r["message"], r["vader_compound"], r["transformer_label"] is None) for r in done.collect()}
    assert got == {1: ("a", None, True), 2: ("b", 0.0, False), 3: (None, None, False)}
    # an executed adaptive plan is printed twice, as run and as planned
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    later = enrich.backfill_unscored(df, scorer, include_host=False)
    assert {r["id"] for r in later.where("vader_compound IS NOT NULL").collect()} == {2}


def test_every_label_is_counted(spark, msgs):
    table = reports.label_by_level(msgs, "transformer_label").collect()
    known = normalize.main_bots(msgs).where("transformer_label is not null and escalation is not null")
    assert sum(r["n"] for r in table) == known.count()
    assert len(table) == len({(r["escalation"], r["label"]) for r in table})
    assert {"NEUTRAL", "POSITIVE"} <= {r["label"] for r in table}


def test_nulls_and_bad_texts_don_t_split_a_batch():
    calls = []

    def predict(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError
        return [("X", 1.0)] * len(texts)

    assert predict_rows(predict, ["a", None, "b"], "?") == [("X", 1.0), ("?", 0.0), ("X", 1.0)]
    assert calls == [2]
    calls.clear()
    got = predict_rows(predict, ["a"] * 700 + ["bad"] + ["a"] * 300, "?")
    assert got.count(("X", 1.0)) == 1000 and got[700] == ("?", 0.0) and len(calls) < 25


def test_one_python_pass_for_all_predictors(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, message string")
    loaders = {k: (lambda kind=k: fixtures.hash_predictor(kind)) for k in ("transformer", "distilbert", "toxicity")}
    scored = score_with_models(df, loaders, as_is={"toxicity"})
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r["transformer_label"] for r in scored.where("id = 2").collect()] == ["UNKNOWN"]

"""Properties of report tables, filters and sources that hold on any data."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from debatelens import values as V
from debatelens.functions import normal as N
from debatelens.operators import distributions, enrich, models, normalize, terms
from debatelens.operators.crosstab import counts, shares
from debatelens.plans import reports
from debatelens.scale import scratch_path
from debatelens.sources import fixtures, messages as M
from debatelens.sources.transcripts import messages_from_transcripts
from debatelens.streaming.ingest import scored_stream


def test_shares_sum_up(msgs):
    for row in reports.pct_by_mode(msgs).collect():
        assert sum(row[v] for v in V.LEVELS) == pytest.approx(100)
    for row in reports.level_share_by_turn(msgs).collect():
        assert sum(row[v] for v in V.LEVELS) == pytest.approx(1)


def test_rates_stay_below_1000_and_grid_is_whole(msgs):
    rows = reports.rate1000_by_mode_topic(msgs).collect()
    assert {(r["host_mode"], r["category"]) for r in rows} == {(m, t) for m in V.MODES for t in V.TOPICS}
    assert all(0 <= sum(r[v] for v in V.LEVELS) <= 1000.0001 for r in rows)


def test_empty_rows_are_zero_in_counts_and_null_in_shares(spark):
    df = spark.createDataFrame([("neutral", "none")], "host_mode string, escalation string")
    axes = {"host_mode": ["neutral", "extreme"]}
    table = {r["host_mode"]: r for r in counts(df, ["host_mode"], axes=axes).collect()}
    assert table["extreme"]["messages"] == 0 and table["neutral"]["none"] == 1
    table = {r["host_mode"]: r for r in shares(df, ["host_mode"], axes=axes).collect()}
    assert table["extreme"]["none"] is None and table["neutral"]["none"] == 1


def test_box_order(msgs):
    for r in reports.box_scores(msgs).collect():
        assert r["whisker_low"] <= r["q1"] <= r["median"] <= r["q3"] <= r["whisker_high"]


def test_box_finds_outliers(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    row = distributions.box_summary(df, ["g"], "v").first()
    assert (row["q1"], row["median"], row["q3"], row["whisker_high"], row["outliers"]) == (2, 3, 4, 4, 1)


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,), (None,)], "v double")
    rows = distributions.histogram(df, ["v"], 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 0, 1, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in distributions.histogram(flat, ["v"], 4).collect()) == 2


def test_density_integrates_to_one(msgs):
    rows = distributions.density(msgs, ["vader_compound"]).orderBy("point").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert sum(r["density"] for r in rows) * step == pytest.approx(1, abs=0.01)


def test_role_report_counts_procon_rows_twice(msgs):
    service = normalize.in_catalogue(normalize.only_api(normalize.normalise_names(msgs)))
    both = service.where(F.col("speaker") == "Pro-Bot").count()
    alone = normalize.procon_bots(msgs).where(F.col("speaker") == "Pro-Bot").count()
    assert both > 0 and alone >= both


def test_null_mode_is_in_neither_family(spark):
    df = spark.createDataFrame([("neutral",), (" PRO-CON-extreme",), (None,)], "host_mode string")
    assert normalize.only_procon(df).count() == 1
    assert normalize.without_procon(df).count() == 1


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456",), ("2024-01-02T03:04:05",), ("x",), (None,)], "timestamp string")
    rows = df.select(N.event_time(), N.event_time(strict=True)).collect()
    assert [r[0] is not None for r in rows] == [True, True, False, False]
    assert [r[1] is not None for r in rows] == [False, True, False, False]


def test_times_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    transcripts = spark.read.parquet(f"{DATA}/conversations.parquet")
    here = messages_from_transcripts(transcripts).select("id", "timestamp", N.event_time().alias("t"))
    expected = sorted(map(repr, here.collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        there = messages_from_transcripts(transcripts).select("id", "timestamp", N.event_time().alias("t"))
        assert sorted(map(repr, there.collect())) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_service_errors_can_be_dropped(spark):
    df = spark.createDataFrame([(normalize.SERVICE_ERROR,), ("fine",), (None,)], "message string")
    assert normalize.without_service_errors(df).count() == 2


def test_signed_scores(spark):
    rows = [("POSITIVE", 0.9), (" negative ", 0.9), ("UNKNOWN", 0.4), (None, 0.3), ("POSITIVE", None)]
    df = spark.createDataFrame(rows, "l string, s double").select(N.signed_score("l", "s"))
    assert [r[0] for r in df.collect()] == [0.9, -0.9, 0.0, 0.0, None]


def test_lengths_count_characters(spark):
    df = spark.createDataFrame([("a😀é",)], "message string")
    assert df.select(N.message_length()).first()[0] == 3


def test_words_keep_accents(spark):
    df = spark.createDataFrame([("Ça va: ÉTÉ_1, don't!",)], "message string")
    assert df.select(terms.words()).first()[0] == ["ça", "va", "été_1", "don", "t"]
    assert df.select(terms.cloud_words()).first()[0] == ["ça", "va", "été_1", "don't"]


def test_top_words_tie_by_word(spark):
    df = spark.createDataFrame([(None, "b a b the c"), ("none", "z")], "escalation string, message string")
    rows = terms.top_words(df, ["escalation"], ["the"], 2).collect()
    assert {(r["escalation"], r["word"], r["n"], r["rank"]) for r in rows} == {
        (None, "b", 2, 1), (None, "a", 1, 2), ("none", "z", 1, 1)
    }
    as_table = terms.top_words(df, ["escalation"], spark.createDataFrame([("the",)], "w string"), 2)
    assert sorted(map(repr, as_table.select(rows[0].__fields__).collect())) == sorted(map(repr, rows))


def test_top_words_cut_before_the_shuffle(msgs):
    plan = terms.top_words(msgs, ["escalation"], ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("partial_count") == 1


def test_predictor_failures_stay_local():
    def predict(texts):
        if "bad" in texts:
            raise ValueError
        return [("positive", 0.5) for _ in texts]

    assert models.predict_rows(predict, ["a", "bad", None], "UNKNOWN") == [
        ("positive", 0.5), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0)
    ]


def test_ids_are_repeatable_uuids(spark):
    df = spark.createDataFrame([("7",), ("8",)], "conversation_id string")
    ids = df.select(enrich.conversation_uuid("conversation_id", "run")).collect()
    assert ids == df.select(enrich.conversation_uuid("conversation_id", "run")).collect()
    assert len({r[0] for r in ids}) == 2 and all(len(r[0]) == 36 for r in ids)


def test_append_read_and_missing_columns(spark, msgs):
    path = scratch_path(spark, "append-test")
    rows = msgs.select([f.name for f in M.MESSAGE_SCHEMA])
    M.append_messages(rows, path)
    M.append_messages(rows.drop("vader_pos"), path)
    stored = M.read_messages(spark, path)
    assert stored.count() == 2 * rows.count()
    assert set(stored.columns) == {f.name for f in M.MESSAGE_SCHEMA}
    one_mode = stored.where(F.col("host_mode") == "extreme")
    assert "PartitionFilters: [isnotnull" in one_mode._jdf.queryExecution().executedPlan().toString()


def test_backfill_keeps_scored_rows(spark, msgs):
    stored = msgs.select([f.name for f in M.MESSAGE_SCHEMA])
    scorer = fixtures.scorer(spark, DATA)
    done = enrich.backfill_unscored(stored, scorer)
    assert done.count() == stored.count() and done.columns == stored.columns
    assert done.where(enrich.unscored(done)).count() == 0
    scored = stored.where(~enrich.unscored(stored))
    assert done.join(scored, stored.columns[:3], "left_semi").exceptAll(scored).count() == 0
    kept = enrich.backfill_unscored(stored, scorer, include_host=False)
    assert kept.where((F.col("speaker") == V.HOST) & F.col("vader_compound").isNotNull()).count() == 0


def test_stream_scores_like_the_batch(spark, msgs):
    columns = ["id", "conversation_id", "speaker", "message", "timestamp", "category", "host_mode", "api"]
    source, sink, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    arriving = msgs.select(columns).where(F.col("host_mode").isNotNull())
    arriving.write.parquet(source)
    scorer = fixtures.scorer(spark, DATA)
    stream = spark.readStream.schema(arriving.schema).parquet(source)
    query = scored_stream(stream, scorer, sink, state).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = enrich.ingest_conversations(arriving, scorer, "category", "host_mode", "api")
    kept = ["id", "escalation", "escalation_reason", "vader_compound", "transformer_label"]
    stored = spark.read.parquet(sink).select(kept)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, batch.select(kept).collect()))


def test_filters_reach_the_scan(spark, msgs):
    path = scratch_path(spark, "scan-test")
    msgs.select([f.name for f in M.MESSAGE_SCHEMA]).write.parquet(path)
    stored = M.read_messages(spark, path)

    def scans(report):
        plan = report._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.split("\n") if "FileScan" in line]

    (main,) = scans(reports.rate1000_by_mode_topic(stored))
    assert "EqualTo(api,openai)" in main and "In(speaker, [Bot 1,Bot 2])" in main
    assert "message:" not in main and "vader" not in main
    (modes,) = scans(reports.count_by_mode_level(stored))
    assert "IsNotNull(host_mode)" in modes and "IsNotNull(escalation)" in modes
    (days,) = scans(reports.escalation_by_day(stored))
    assert "struct<timestamp:string,escalation:string>" in days

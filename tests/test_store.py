"""Stored tables that grow and are scored in place, and streams into them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from debatelens import values as V
from debatelens.operators import enrich
from debatelens.scale import scratch_path
from debatelens.sources import fixtures, messages as M, store
from debatelens.streaming.ingest import batch_writer, scored_stream


@pytest.fixture(scope="module")
def rows(msgs):
    return msgs.select([f.name for f in M.MESSAGE_SCHEMA])


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_two_appends_have_all_numbers(spark, rows):
    path = scratch_path(spark, "ids")
    store.append_numbered(rows.repartition(7), path)
    n = rows.count()
    first = {r.id: r.message for r in M.read_messages(spark, path).collect()}
    assert sorted(first) == list(range(1, n + 1))
    store.append_numbered(rows.limit(0), path)
    store.append_numbered(rows.drop("id", "api").repartition(3), path, ["timestamp", "message"])
    both = M.read_messages(spark, path)
    assert sorted(r.id for r in both.collect()) == list(range(1, 2 * n + 1))
    assert {r.id: r.message for r in both.where(F.col("id") <= n).collect()} == first
    later = [r.timestamp for r in both.where(F.col("id") > n).orderBy("id").collect()]
    assert later == sorted(later, key=lambda t: (t is not None, t))


def test_numbers_do_not_depend_on_a_second_run(spark, rows):
    numbered = store.numbered(rows.repartition(5), 11)
    once = {(r.id, r.message) for r in numbered.collect()}
    assert {(r.id, r.message) for r in numbered.repartition(2).collect()} == once
    assert min(once)[0] == 11 and len(once) == rows.count()


def prepared(spark, rows):
    """A stored table in which one partition has unscored rows."""
    path = scratch_path(spark, "backfill")
    done = enrich.backfill_unscored(rows, fixtures.scorer(spark, DATA))
    open_ones = (F.col("host_mode") == "extreme") & (F.col("id") % 2 == 0)
    again = done.select(*[F.when(open_ones, None).otherwise(F.col(c)).alias(c) if c in enrich.BACKFILLED else F.col(c) for c in done.columns])
    M.append_messages(again, path)
    return path, enrich.backfill_unscored(again, fixtures.scorer(spark, DATA))


def scored(spark, path):
    return sorted(map(repr, M.read_messages(spark, path).select([f.name for f in M.MESSAGE_SCHEMA]).collect()))


def test_backfill_writes_partitions_with_unscored_rows_only(spark, rows):
    path, done = prepared(spark, rows)
    before = files(path)
    assert store.backfill_table(spark, path, fixtures.scorer(spark, DATA)) == ["extreme"]
    after = files(path)
    clean = {f: t for f, t in before.items() if "host_mode=extreme" not in str(f)}
    assert clean and {f: after.get(f) for f in clean} == clean
    assert not any(f in after for f in before if "host_mode=extreme" in str(f))
    table = M.read_messages(spark, path)
    assert table.where(enrich.unscored(table)).count() == 0
    assert scored(spark, path) == sorted(map(repr, done.select([f.name for f in M.MESSAGE_SCHEMA]).collect()))
    assert store.backfill_table(spark, path, fixtures.scorer(spark, DATA)) == []
    assert files(path) == after


@pytest.mark.parametrize("ended", ["preparing", "before", "moved aside", "after"])
def test_backfill_that_ended_early_is_finished_by_the_next(spark, rows, ended):
    path, done = prepared(spark, rows)
    want = sorted(map(repr, done.select([f.name for f in M.MESSAGE_SCHEMA]).collect()))
    folder = Path(path.removeprefix("file:"))
    new = enrich.backfill_unscored(M.read_messages(spark, path).where("host_mode = 'extreme'"), fixtures.scorer(spark, DATA))
    new.select([f.name for f in M.MESSAGE_SCHEMA]).write.partitionBy("host_mode").parquet(f"{path}/_backfill")
    own, kept = folder / "_backfill/host_mode=extreme", folder / "_backfill/_replaced"
    if ended == "preparing":
        (folder / "_backfill/_SUCCESS").unlink()
    if ended in ("moved aside", "after"):
        kept.mkdir()
        (folder / "host_mode=extreme").rename(kept / "host_mode=extreme")
    if ended == "after":
        own.rename(folder / "host_mode=extreme")
    store.backfill_table(spark, path, fixtures.scorer(spark, DATA))
    assert scored(spark, path) == want and not (folder / "_backfill").exists()


def test_backfill_without_host_rows(spark, rows):
    path = scratch_path(spark, "backfill-bots")
    M.append_messages(rows, path)
    store.backfill_table(spark, path, fixtures.scorer(spark, DATA), include_host=False)
    table = M.read_messages(spark, path)
    assert table.count() == rows.count()
    open_rows = table.where(enrich.unscored(table))
    assert open_rows.count() > 0 and open_rows.where(~F.col("speaker").eqNullSafe(V.HOST)).count() == 0


ARRIVING = ["id", "conversation_id", "speaker", "message", "timestamp", "category", "host_mode", "api"]


def test_stream_with_a_lexicon_too_large_to_broadcast(spark, msgs):
    source, sink, state = (scratch_path(spark, n) for n in ("large-in", "large-out", "large-state"))
    arriving = msgs.select(ARRIVING).where(F.col("host_mode").isNotNull())
    halves = arriving.randomSplit([0.5, 0.5], seed=3)
    scorer = fixtures.scorer(spark, DATA)
    scorer = enrich.Scorer(scorer.valence, scorer.polarity, scorer.models, valence_rules=scorer.valence_rules, max_bytes=1)
    for half in halves:
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema(arriving.schema).parquet(source)
        query = scored_stream(stream, scorer, sink, state).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    stored = spark.read.parquet(sink)
    assert stored.select("batch").distinct().count() == 2
    batch = enrich.ingest_conversations(arriving, fixtures.scorer(spark, DATA), "category", "host_mode", "api")
    kept = ["id", "escalation", "escalation_reason", "vader_compound", "textblob_polarity", "transformer_label"]
    assert sorted(map(repr, stored.select(kept).collect())) == sorted(map(repr, batch.select(kept).collect()))


def test_a_batch_written_twice_counts_once(spark, msgs):
    sink = scratch_path(spark, "twice")
    arriving = msgs.select(ARRIVING).where(F.col("host_mode").isNotNull())
    write = batch_writer(fixtures.scorer(spark, DATA), sink)
    for number in (0, 1, 1):
        write(arriving.where(F.col("id") % 2 == number), number)
    stored = M.read_messages(spark, sink)
    assert sorted(r.id for r in stored.select("id").collect()) == sorted(r.id for r in arriving.select("id").collect())


def test_columns_in_another_case_are_present(spark):
    df = spark.createDataFrame([(1, "openai", 0.5)], "id long, API string, Vader_Compound double")
    full = M.ensure_columns(df)
    assert len(full.columns) == len(M.MESSAGE_SCHEMA) and full.select("api", "vader_compound").first() == ("openai", 0.5)

"""The pipeline stage by stage, each against a plain computation on its own input."""

import hashlib

import pytest
import test_mixing
import test_native
import test_packing
import test_simhash
import test_substring

import corpus_pipeline
from conftest import DATA
from debatelens.llm import mixing, packing, quality
from debatelens.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], DATA), "step"))
    return found


def test_all_but_the_last_return_the_columns_of_documents(steps):
    for df in steps[1:-1]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in steps[0].schema]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "substring dedup", "mixing sources to target weights", "best-fit packing",
    ]


def test_quality_stage(steps):
    verdict = {r.doc_id: r for r in quality.quality_scores(steps[0]).collect()}
    for r in steps[0].collect():
        n, *_, repeats = test_native.base(r.text)
        assert verdict[r.doc_id].base_failed == (n < 10 or 100 * repeats > 20 * n)
    want = [r for r in steps[0].collect() if verdict[r.doc_id].kept]
    assert sorted(steps[1].collect()) == sorted(want) and 0 < len(want) < len(verdict)


def test_simhash_stage(steps):
    before = steps[1].collect()
    groups = test_simhash.brute([(r.doc_id, r.text) for r in before])
    assert sorted(steps[2].collect()) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id)


def test_substring_stage(steps):
    before = steps[2].collect()
    want = test_substring.brute([(r.doc_id, r.text) for r in before], 50)
    got = {r.doc_id: r for r in steps[3].collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if gone < n or not gone}
    for r in before:
        n, gone, digest = want[r.doc_id]
        if r.doc_id in got and gone:
            assert hashlib.sha256(got[r.doc_id].text.encode()).hexdigest() == digest
            assert got[r.doc_id].n_chars == len(got[r.doc_id].text)
        elif r.doc_id in got:
            assert got[r.doc_id] == r


def test_mixing_stage(steps):
    before = steps[3].collect()
    size = {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(r.text.encode()) + 1
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    rate = {s: sum(size.values()) * weight[s] / sum(weight.values()) / size[s] for s in size}
    want = [r for r in before for _ in range(test_mixing.draw(rate[r.source], f"{mixing.SEED}:{r.doc_id}"))]
    assert sorted(steps[4].collect()) == sorted(want)


def test_packing_stage(steps):
    copies = {}
    for r in steps[4].collect():
        copies.setdefault((r.doc_id, r.text), []).append(r)
    words = sum(len(r.text.encode().split()) for r in steps[4].collect())
    rows = steps[5].collect()
    assert sum(r.n_words for r in rows) == words
    assert all(r.n_words == sum(r.lengths) <= r.capacity and r.capacity in packing.CAPACITIES for r in rows)
    packed = {}
    for r in rows:
        for doc, start, text in zip(r.doc_ids, r.starts, r.texts, strict=True):
            packed.setdefault((doc, start), []).append(text)
    for (doc, text), same in copies.items():
        if len(text.encode().split()) <= max(packing.CAPACITIES):
            assert packed[doc, 0] == [text] * len(same)


def test_run_gives_the_last_stage(spark, steps):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == steps[-1].columns
    assert sum(r.n_words for r in rows.collect()) == sum(r.n_words for r in steps[-1].collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    text = " ".join(f"word{i % 97}x{i}" for i in range(120))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int, copy int"
    rows = [(None, None, None, None, None, None, None, None), (1, text, "en", None, 5, "a", 1, 1), (1, text, "en", None, 5, "a", 1, 1)]
    rows += [(2, text + " tail of its own", None, "s", None, "b", 2, 2), (None, text, "en", "s", 1, "c", 3, 3), (3, "", "en", "s", 0, "d", 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA), "step")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert {r.doc_id for r in docs.collect()} <= {1, 2, None}
    corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()

"""Benchmark windows in documents against a search at every word."""

import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        own = words(text)
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + m]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(own) - m + 1):
                if (key := tuple(own[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[key]
        names = sorted({str(f) for f in found if f is not None})
        out.append((doc_id, len(own), len(hit), names))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()
    want = [
        (i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
        for i, n, hit, names in brute(docs, items)
    ]
    assert any(x[2] for x in want) and not all(x[2] for x in want)
    rows = entry.queries()["op12_decontamination"](spark, DATA).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def made(seed):
    """Texts of few words, so that windows repeat and overlap, and items of any length."""
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choices("aa b C dd é".split(), k=n))

    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(60)]
    items = [(str(i), text(rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 40]))) for i in range(30)]
    items += [("copy", docs[5][1] + " tail"), ("7", "two texts of one item"), (None, "B, c! Dd")]
    docs += [(None, None), (None, "b c dd b"), (None, "b c dd b"), (61, ""), (61, ", ; !"), (62, docs[5][1] * 3)]
    return docs, items


@pytest.mark.parametrize("window", [1, 4, 5, 10])
@pytest.mark.parametrize("options", [{}, {"shard": 1}, {"shard": 100, "block": 300}])
def test_any_shard_and_block_gives_the_same(spark, window, options):
    docs, items = made(window)
    found = decontamination.benchmark_matches(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=window, **options
    )
    assert result(found) == brute(docs, items, window)


def test_longest_matches_and_where_they_are(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "before " + " ".join(f"w{i}" for i in range(5, 25)) + " between " + " ".join(f"W{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"w{i}" for i in range(9)))], DOCS)
    found = decontamination.benchmark_matches(docs, spark.createDataFrame([("q", item)], ITEMS))
    rows = {r.doc_id: [tuple(m) for m in r.matches] for r in found.collect()}
    assert rows == {1: [("q", 1, 5, 20), ("q", 22, 0, 12)], 2: []}


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_affected_rows_go(spark, block):
    docs, items = made(9)
    names = "doc_id long, text string, n_words string, Matches int, text_copy int"
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], names)
    left = decontamination.decontaminate(table, spark.createDataFrame(items, ITEMS), block=block)
    assert left.columns == table.columns
    clean = [(d, t) for (d, t) in docs if not brute([(d, t)], items)[0][2]]
    assert 0 < len(clean) < len(docs)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    docs, items = made(2)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    none = decontamination.benchmark_matches(docs, items.where("false")).collect()
    assert len(none) == docs.count() and not any(r.n_hit or r["items"] or r.matches for r in none)
    assert decontamination.benchmark_matches(docs.where("false"), items).count() == 0
    assert decontamination.decontaminate(docs, items.where("false")).count() == docs.count()


def test_suffix_array_orders_suffixes_and_finds_ranges():
    rng = random.Random(4)
    numbers = [*rng.choices(range(4), k=300), 0]
    array = decontamination.SuffixArray(np.array(numbers), 7, 3)
    ordered = [numbers[i : i + 8] for i in array.order]
    inner = [x for x in ordered if len(x) == 8]
    assert inner == sorted(inner)
    tests = rng.choices(range(1, 5), k=200)
    starts, lengths = np.repeat(np.arange(190), 7), np.tile(np.arange(1, 8), 190)
    low, high = array.ranges(np.array(tests), starts, lengths)
    for a, n, i, j in zip(starts, lengths, low, high, strict=True):
        window = tests[a : a + n]
        want = [k for k in range(len(numbers)) if numbers[k : k + n] == window]
        assert sorted(array.order[i:j].tolist()) == want

"""Spelling variants against all words with one place edited."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(rows, every):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return total


def near(words):
    """word -> near words, by one place left out."""
    by_key = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_key[w[:i], w[i + 1 :]].add(w)
    found = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            found[w] |= by_key[w[:i], w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                found[w].add(shorter)
                found[shorter].add(w)
    return found


def brute(words, factor=2):
    links, form = near(set(words)), {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(links[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items()}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    words = {w: n for w, n in runs(docs, 97).items() if len(w) >= 5 and n >= 3}
    want = brute(words)
    assert sum(x[1] for x in want.values()) > 100 and any(x[2] for x in want.values())
    assert result(entry.queries()["op11_spelling_variants"](spark, DATA)) == want


def few_letters(seed, n, letters="abcé", longest=8):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize("options", [{}, {"homes": 40}, {"homes": 3, "steps": 1}, {"homes": 1, "steps": 30}])
def test_any_size_of_subtries_gives_the_same(spark, options):
    words = few_letters(1, 600) | {"日本語学校": 4, "日本語学": 9, "x" * 300: 2, "x" * 301: 5}
    assert result(spelling.variant_groups(table(spark, words), **options)) == brute(words)


def test_subtrie_walk_finds_each_pair_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("aabbcdz{", k=6)) for _ in range(400)})
    longer = sorted({"".join(rng.choices("aabbcdz{", k=7)) for _ in range(300)})
    import numpy as np

    order = rng.sample(range(26), 26)
    states = np.array([spelling._EQUAL] * len(words) + [spelling._LONGER] * len(longer))
    for leaf in (1, 4, 1000):
        got = [
            frozenset((words[i], (words + longer)[j]))
            for i, j in spelling.subtrie_links(words, words + longer, states, 0, order, leaf)
        ]
        links = near({*words, *longer})
        want = {frozenset((a, b)) for a in words for b in links[a] if len(b) == 6 or b in longer}
        assert len(got) == len(set(got)) and set(got) == want


def test_ties_take_the_smallest_word_and_chains_reach_their_end(spark):
    words = {"abcde": 1, "abcdx": 8, "abcdf": 8, "abcdxy": 16, "abcdxyz": 64, "abcdxyzz": 127, "lonely": 3}
    got = result(spelling.variant_groups(table(spark, words)))
    assert got == brute(words)
    assert got["abcde"][2] == "abcdf" and got["abcdx"][4] == "abcdxyz" and got["lonely"] == (3, 0, None, None, "lonely")


def test_nulls_repeats_empty_words_and_clashing_columns(spark):
    rows = [("again", 2, 1), ("again", 3, 1), (None, 9, 1), ("", 4, 1), ("a", 1, 1), ("agains", 50, 1)]
    words = spark.createDataFrame(rows, "word string, n long, path int")
    got = result(spelling.variant_groups(words))
    assert got["again"] == (5, 1, "agains", 50, "agains")
    assert got[""][1] == 0 and None not in got and len(got) == 4
    empty = spelling.variant_groups(words.where("false"))
    assert empty.columns == ["word", "n", "n_near", "form", "form_n", "root"] and empty.count() == 0


def test_runs_of_letters(spark):
    rows = [(1, "Éa×B÷c d_e 12ÄÖx日y"), (None, "Éa×B÷c"), (2, None), (3, ""), (4, "ab " * 50_000), (4, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.counted_runs(docs, drop_every=None).collect()}
    assert got == runs(rows, None)
    assert {r.word: r.n for r in spelling.counted_runs(docs, drop_every=2).collect() if r.word} == {
        w: n for w, n in runs(rows, 2).items() if w
    }
    with pytest.raises(ValueError):
        spelling.variant_groups(spelling.counted_runs(docs), factor=1)

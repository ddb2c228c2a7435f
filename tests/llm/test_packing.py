"""Packing against a slow best fit, and what must hold of any packing."""

import random

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import packing


def slow_fill(lengths, order, sizes, cost, least):
    """Best fit by looking at every open bin."""
    bins = []
    for i in order:
        fitting = [b for b in bins if b[0] >= lengths[i]]
        if fitting:
            b = min(fitting, key=lambda b: (b[0], b[2]))
        else:
            up = min(c for c in sizes if c >= lengths[i])
            c = min((d for d in sizes if d >= max(up, least)), key=lambda d: (cost(d) / d, -d))
            b = [c, [], len(bins)]
            bins.append(b)
        b[0] -= lengths[i]
        b[1].append(i)
    out = []
    for _, pieces, _ in bins:
        used = sum(lengths[i] for i in pieces)
        out.append((min((c for c in sizes if c >= used), key=lambda c: (cost(c), c)), pieces))
    return out


def test_pack_equals_slow_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted(rng.sample(range(5, 60), 3))
        lengths = [rng.randrange(sizes[-1] + 1) for _ in range(rng.randrange(80))]
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))

        def cost(c, a=rng.random(), b=rng.random() * 20):
            return c + a * c * c / 30 + b

        tried = [slow_fill(lengths, order, sizes, cost, least) for least in sizes]
        best = min(tried, key=lambda bins: sum(cost(c) for c, _ in bins))
        got = packing.pack(lengths, sizes, cost)
        assert sum(cost(c) for c, _ in got) == sum(cost(c) for c, _ in best)
        assert sorted(i for _, pieces in got for i in pieces) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in pieces) <= c for c, pieces in got)


def check(rows, texts, capacities):
    """Every word of every text is packed once, no sequence is too long or larger than needed."""
    at = {}
    for r in rows:
        assert r.n_words == sum(r.lengths) <= r.capacity
        assert all(c >= r.capacity or c < r.n_words for c in capacities)
        for doc, start, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            at.setdefault(doc, []).append((start, n))
    for doc, text in texts.items():
        total = len((text or "").encode().split())
        end = 0
        for start, n in sorted(at.pop(doc)):
            assert start == end
            end += n
        assert end == total
    assert not at
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_query_packs_every_word_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = entry.queries()["op1_best_fit_packing"](spark, DATA).collect()
    check(rows, {r.doc_id: r.text for r in docs}, packing.CAPACITIES)
    full = sum(r.n_words for r in rows) / sum(r.capacity for r in rows)
    assert full > 0.9


def test_texts_pieces_blocks_nulls_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, 0, "x"), (2, None, 0, "x"), (3, " a\n b ", 0, "x"), (3, " a\n b ", 0, "x"), (None, "c", 0, "x"), (4, "", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, capacity int, texts string").coalesce(1)
    for pieces in (100, 2, 1):
        got = packing.pack_documents(docs, capacities=(8, 16), block_pieces=pieces).collect()
        found = sorted((str(d), s, n, t) for r in got for d, s, n, t in zip(r.doc_ids, r.starts, r.lengths, r.texts, strict=True))
        words = long.split()
        want = [("1", s, len(words[s : s + 16]), " ".join(words[s : s + 16])) for s in range(0, 50, 16)]
        want += [("2", 0, 0, ""), ("3", 0, 2, " a\n b "), ("3", 0, 2, " a\n b "), ("4", 0, 0, ""), ("None", 0, 1, "c")]
        assert found == sorted(want)
        assert all(r.n_words == sum(r.lengths) <= r.capacity for r in got)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing.pack([]) == []

"""Shards: what the law and the groups demand."""

import math
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import sharding


def check(rows, texts, shards, near):
    """Sizes, sums of bytes, groups and slots of (doc_id, size, text_crc32, shard, slot)."""
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    load = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    assert max(load) - min(load) <= near * sum(load) / shards
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def plain_shards(rows, shards, lots, part_of):
    """doc_id -> shard, one thing after the other, for (doc_id, text)."""
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)

    def measures(text, n):
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]", text) if w]
        return n * (len(text.encode()) + 1), n * len(words), n

    total = [sum(m) for m in zip(*(measures(t, len(ids)) for t, ids in groups.items()), strict=True)]
    room = max(1, total[0] / shards)
    large, lot_sums, things = {}, {}, []
    for text, ids in groups.items():
        data, own = text.encode(), measures(text, len(ids))
        value = xxhash.xxh64_intdigest(data, 42)
        if any(m > t / lots for m, t in zip(own, total, strict=True)):
            parts = max(1, math.ceil(sharding.PARTS * own[0] / room)) if own[0] > room else 1
            signed = value - (1 << 64) if value >> 63 else value
            large[text] = (signed, zlib.crc32(data), len(data) + 1, own, parts)
        else:
            lot = (value - (1 << 64) if value >> 63 else value) % lots
            lot_sums[lot] = tuple(a + b for a, b in zip(lot_sums.get(lot, (0, 0, 0)), own, strict=True))
    for text, (*key, own, parts) in sorted(large.items(), key=lambda x: x[1][:3]):
        things += [((text, k), [m / parts for m in own]) for k in range(parts)]
    things += [((lot, None), list(own)) for lot, own in sorted(lot_sums.items())]
    share = [[v / t * shards if t else 0.0 for v, t in zip(own, total, strict=True)] for _, own in things]
    left = [[1 + sharding.SLACK, 1.0, 1.0] for _ in range(shards)]
    at = {}
    for i in sorted(range(len(things)), key=lambda i: (-((share[i][0] + share[i][1]) + share[i][2]), i)):
        fitting = [s for s in range(shards) if left[s][0] >= share[i][0]]
        if fitting:
            best = max(fitting, key=lambda s: (sum(a * b for a, b in zip(left[s], share[i], strict=True)), -s))
        else:
            best = max(range(shards), key=lambda s: (left[s][0], -s))
        at[things[i][0]] = best
        left[best] = [a - b for a, b in zip(left[best], share[i], strict=True)]
    out = {}
    for text, ids in groups.items():
        for i in ids:
            if text in large:
                out[i, text] = at[text, part_of(i, large[text][4]) if large[text][4] > 1 else 0]
            else:
                value = xxhash.xxh64_intdigest(text.encode(), 42)
                out[i, text] = at[(value - (1 << 64) if value >> 63 else value) % lots, None]
    return out


def test_query_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = plain_shards([tuple(r) for r in docs], 8, sharding.LOTS, None)
    got = {r.doc_id: r.shard for r in entry.queries()["op5_vector_sharding"](spark, DATA).collect()}
    assert got == {i: s for (i, _), s in want.items()}


def test_lots_and_parted_groups_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 50, int(k)))) for i, k in enumerate(rng.integers(0, 30, 700))]
    rows += [(1000 + i, "a group of copies") for i in range(400)] + [(2000, None), (2001, "ä ö ü " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    part = {
        (r.doc_id, n): r[f"p{n}"]
        for r in docs.select("doc_id", *[sharding._part(F.lit(n)).alias(f"p{n}") for n in range(1, 40)]).collect()
        for n in range(1, 40)
    }
    want = plain_shards(rows, 5, 60, lambda i, n: part[i, n])
    sizes = sharding.document_sizes(docs)
    got = sharding.looked_up(sizes, *sharding.shard_plan(sizes, 5, 60), 60).collect()
    texts = dict(rows)
    assert {(r.doc_id, texts[r.doc_id] or ""): r.shard for r in got} == want


def test_query_keeps_the_law(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = entry.queries()["op5_vector_sharding"](spark, DATA).collect()
    # 200 documents can't be nearer than a document
    largest = max(r.size for r in rows) * 8 / sum(r.size for r in rows)
    check(rows, [(r.doc_id, r.text) for r in docs], 8, 2 * largest)
    shard = {}
    of = {r.doc_id: r.shard for r in rows}
    for r in docs:
        assert shard.setdefault(r.text, of[r.doc_id]) == of[r.doc_id]
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_many_documents_hot_group_nulls_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot copy") for i in range(0, 6000)] + [(i, "w " * int(n)) for i, n in enumerate(rng.integers(1, 60, 9000), 6000)]
    rows += [(20000, None), (20001, ""), (20002, None), (5, "hot copy"), (20003, "same"), (20003, "same")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, shard string")
    got = sharding.shard_table(docs, 4).collect()
    check(got, rows, 4, 0.01)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot copy")}) == 1
    assert len({r.shard for r in got if r.size == 1}) == 1
    huge = spark.createDataFrame([(i, "hot copy") for i in range(4000)] + [(4000, None)], "doc_id long, text string")
    load = [r["count"] for r in sharding.shard_table(huge, 4).groupBy("shard").count().collect()]
    assert len(load) == 4 and max(load) < 1.2 * min(load)


def test_placing_is_greedy_by_dot_product():
    vectors = np.array([[8, 1, 1], [1, 8, 1], [1, 1, 8], [2, 2, 2], [2, 2, 2]], float)
    at = sharding.place(vectors, 2, 0.3)
    total = vectors.sum(axis=0)
    load = np.stack([vectors[at == s].sum(axis=0) for s in range(2)])
    assert (load[:, 0] <= total[0] / 2 * 1.3).all() and len(set(at)) == 2
    assert sharding.place(np.zeros((0, 3)), 3).tolist() == []


def test_written_shards_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 70}", "x", 3) for i in range(200)] + [(None, None, None, None)], "doc_id long, text string, shard string, parts int")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard_"])
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_table(none).count() == 0

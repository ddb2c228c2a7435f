"""SimHash groups against a comparison of all pairs."""

import random

import xxhash

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import simhash
from debatelens.llm.common import stored

SCHEMA = "doc_id long, text string, component_id string, fp string"


def brute(rows):
    """id -> (fingerprint, component) for (id, text) with distinct ids."""

    def fp(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            lowered = lowered.replace(c, " ")
        words = [w for w in lowered.split(" ") if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fp(t) for i, t in rows}
    group = {i: i for i in prints}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: (f"{prints[i]:016x}", top(i)) for i in ids}


def results(df):
    return {r.doc_id: (r.fp, r.component_id) for r in df.collect()}


def grouped(docs, **options):
    from pyspark.sql import functions as F

    return simhash.simhash_groups(docs, **options).withColumn("fp", F.lpad(F.lower(F.hex("fp")), 16, "0"))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = entry.queries()["op9_simhash"](spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want
    assert len(rows) == len(want) and {r.doc_id for r in rows if r.kept} == {c for _, c in want.values()}


def fingerprint_groups(values, bucket, monkeypatch, spark):
    df = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "fp long")
    links = simhash.fingerprint_links(df, 2, bucket)
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for r in links.collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        a, b = sorted((top(a), top(b)))
        group[b] = a
    return {v: top(v) for v in values}


def test_links_connect_exactly_what_is_near(spark, monkeypatch):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    dense = rng.getrandbits(64)
    values |= {dense ^ (a | b << 3) for a in range(8) for b in range(8)}
    want = {v: v for v in values}

    def top(v):
        while want[v] != v:
            v = want[v]
        return v

    ordered = sorted(values)
    for n, a in enumerate(ordered):
        for b in ordered[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                want[y] = x
    want = {v: top(v) for v in values}
    assert fingerprint_groups(values, 128, monkeypatch, spark) == want
    assert fingerprint_groups(values, 3, monkeypatch, spark) == want


def test_nulls_ties_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \t\n", "x", "y"), (4, long, "x", "y"), (5, long, "x", "y")]
    rows += [(6, "One two three", None, None), (7, "one two\nthree", "x", "y"), (8, "alone", "x", "y"), (8, "alone", "x", "y")]
    docs = spark.createDataFrame([*rows, (None, "alone", "x", "y")], SCHEMA)
    got = results(grouped(docs.select("doc_id", "text")))
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, None: 8}
    assert got[1][0] == "0" * 16
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 8]


def test_empty_table_and_only_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d", "x", "y")] * 2, SCHEMA)
    assert [r.component_id for r in simhash.simhash_groups(nameless).collect()] == [None, None]
    assert simhash.keep_one(nameless).count() == 1


def test_stored_rows_come_back(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    assert sorted(map(tuple, stored(df, "t").collect())) == [(1, None), (2, "a")]

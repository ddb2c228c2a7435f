"""Vector links against all cosines."""

import numpy as np
import pytest

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import embeddings

SCHEMA = "vec_id long, label int, embedding array<double>, n_links string, v int"


def brute(rows, threshold=0.98):
    """id -> (links, component) for (id, label, vector) with distinct ids."""
    n = dict.fromkeys((i for i, _, _ in rows), 0)
    group = {i: i for i in n}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    usable = [
        (i, label, np.array(v, float))
        for i, label, v in rows
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    for k, (i, label, x) in enumerate(usable):
        for j, other, y in usable[:k]:
            if label == other and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: (n[i], top(i)) for i in n}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got = entry.queries()["op4_embedding_dedup"](spark, DATA).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_tiles_nulls_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(i % 2), (centres[i % 6] * 10.0**(i % 5 * 60 - 120) + 0).tolist()) for i in range(40)]
    rows = [(i, label, (np.array(v) * (1 + 0.1 * rng.normal(size=8))).tolist()) for i, label, v in rows]
    rows += [(50, 1, None), (51, 1, []), (52, 1, [0.0] * 8), (53, 1, [float("nan")] + [1.0] * 7), (54, None, [1.0] * 8)]
    rows += [(55, 1, [None] + [1.0] * 7), (56, 1, [float("inf")] + [1.0] * 7), (57, 1, [1.0] * 8), (58, 1, [1.0] * 9)]
    want = brute(rows)
    vectors = spark.createDataFrame([(*r, "x", 1) for r in [*rows, rows[3]]] + [(None, 1, [1.0] * 8, "x", 1)], SCHEMA)
    for tile in (1024, 5):
        got = embeddings.embedding_groups(vectors, tile=tile).collect()
        assert len(got) == len(rows) + 2
        assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
        assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.2])
def test_bounds_lose_no_pair(spread):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 64)) * 10.0 ** rng.integers(-3, 3, size=(40, 1))
    b = a[rng.integers(0, 40, 60)] * (1 + spread * rng.normal(size=(60, 64)))
    cos = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    i, j = embeddings.tile_links(a, b, 0.98)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, y in zip(*(cos >= 0.98).nonzero())}


def test_empty_table(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0

"""Rank test, bootstrap band, collocations and densities against plain computations."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from debatelens.operators import bootstrap, distributions, stats, terms


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 7), (3, 4), (5, 5), (8, 3)])
def test_rank_sum_chances_count_all_orders(n1, n2):
    found = Counter(
        sum(chosen) - n1 * (n1 + 1) // 2 for chosen in combinations(range(1, n1 + n2 + 1), n1)
    )
    whole = math.comb(n1 + n2, n1)
    want = [found[u] / whole for u in range(n1 * n2 + 1)]
    assert stats.rank_sum_chances(n1, n2) == pytest.approx(want, abs=1e-12)


def test_large_other_side_stays_a_distribution():
    chances = stats.rank_sum_chances(8, 2000)
    assert chances.sum() == pytest.approx(1.0) and chances.min() > -1e-15
    assert chances[:5] == pytest.approx(chances[::-1][:5], abs=1e-15)


def test_exact_p_for_few_values_without_ties(spark):
    few, many = [1.5, 9.0, 11.0], [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0]
    rows = [("none", v, "a") for v in few] + [("strong", v, "a") for v in many]
    rows += [("none", v, "tied") for v in few] + [("strong", v, "tied") for v in [*many, 9.0]]
    rows += [("none", 1.0, "one side")]
    df = spark.createDataFrame(rows, "escalation string, v double, g string")
    got = {r.g: r for r in stats.mann_whitney(df, ["v"], by=["g"]).collect()}
    u = sum(a > b for a in few for b in many)
    larger = max(u, 24 - u)
    orders = [sum(c) - 6 for c in combinations(range(1, 12), 3)]
    assert got["a"].u == u and got["a"].p == pytest.approx(min(1, 2 * sum(x >= larger for x in orders) / len(orders)))
    assert got["tied"].p == pytest.approx(math.erfc(got["tied"].z / math.sqrt(2)))
    assert got["one side"].p is None and got["one side"].note == "not enough data"


def test_bootstrap_band_is_the_same_however_rows_lie(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), float(rng.randint(0, 2)) if rng.random() > 0.1 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, y double")
    one = {r.g: tuple(r) for r in bootstrap.bootstrap_band(df, ["g"], "y").collect()}
    two = {r.g: tuple(r) for r in bootstrap.bootstrap_band(df.repartition(9), ["g"], "y").collect()}
    assert one == two
    for g, n, mean, low, high in one.values():
        values = [y for _, k, y in rows if k == g and y is not None]
        assert n == len(values) and mean == pytest.approx(np.mean(values))
        half = 1.96 * np.std(values, ddof=1) / math.sqrt(n)
        assert (low, high) == (pytest.approx(mean - half, abs=half / 3), pytest.approx(mean + half, abs=half / 3))


def test_bootstrap_draws_are_poisson(spark):
    df = spark.range(3000).select(F.explode(bootstrap.poisson_weights("id", 10, "x")).alias("d")).select("d.*")
    counts = Counter({r.w: r["count"] for r in df.groupBy("w").count().collect()})
    for w in range(1, 5):
        assert counts[w] / 30000 == pytest.approx(math.exp(-1) / math.factorial(w), abs=0.01)
    assert {r.replicate for r in df.select("replicate").distinct().collect()} == set(range(10))


def cloud(texts, stop, threshold=30.0):
    """Terms of a word cloud, in plain Python."""
    tokens = [t.lower().split() for t in texts]
    single = Counter(w for ws in tokens for w in ws if w not in stop)
    pairs = Counter(f"{a} {b}" for ws in tokens for a, b in zip(ws, ws[1:]) if a not in stop and b not in stop)

    def folded(counts):
        form = {w: w[:-1] if w.endswith("s") and not w.endswith("ss") and w[:-1] in counts else w for w in counts}
        out = Counter()
        for w, n in counts.items():
            out[form[w]] += n
        return out, form

    counts, form = folded(single)
    pairs, _ = folded(pairs)
    total, result = sum(counts.values()), Counter(counts)

    def fit(k, n, x):
        return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (n - k)

    for pair, c12 in pairs.items():
        a, b = (form[w] for w in pair.split())
        c1, c2 = counts[a], counts[b]
        if total <= c1 or total <= c2:
            continue
        p, p1, p2 = c2 / total, c12 / c1, (c2 - c12) / (total - c1)
        score = fit(c12, c1, p) + fit(c2 - c12, total - c1, p) - fit(c12, c1, p1) - fit(c2 - c12, total - c1, p2)
        if -2 * score > threshold:
            result[a] -= c12
            result[b] -= c12
            result[pair] = c12
    return {w: n for w, n in result.items() if n > 0}


@pytest.mark.parametrize("as_table", [False, True])
def test_collocations(spark, as_table):
    rng = random.Random(4)
    words = ["tax", "cut", "cuts", "green", "deal", "the", "of", "class", "debate", "debates", "talk", "xs"]
    texts = {g: [" ".join(rng.choices(words, k=6)) + (" green deal tax cuts" if rng.random() < 0.5 else "") for _ in range(120)] for g in ("a", "b")}
    texts["b"] = ["alone alone"] * 3
    df = spark.createDataFrame([(g, t) for g, ts in texts.items() for t in ts] + [(None, None)], "g string, message string")
    stop = ["the", "of"]
    listed = spark.createDataFrame([(w,) for w in stop], "w string") if as_table else stop
    got = terms.collocations(df, ["g"], listed).collect()
    for g in texts:
        assert {r.term: r.n for r in got if r.g == g} == cloud(texts[g], stop)
    assert any(r.term == "green deal" for r in got)
    whole = terms.collocations(df, [], listed).collect()
    assert {r.term: r.n for r in whole} == cloud([t for ts in texts.values() for t in ts], stop)


def test_density_for_any_number_of_points(spark):
    values = [0.0, 0.0, 1.0, 2.5, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bw = len(values) ** -0.2 * np.std(values, ddof=1)
    for points in (3, 40, 41, 200):
        rows = distributions.density(df, ["v"], points).orderBy("point").collect()
        assert [r.point for r in rows] == list(range(points))
        for r in rows:
            want = np.exp(-((r.x - np.array(values)) / bw) ** 2 / 2).sum() / (len(values) * bw * math.sqrt(2 * math.pi))
            assert r.density == pytest.approx(want)


def test_quartiles_in_chunks_need_no_join_on_the_key(spark):
    rng = random.Random(6)
    rows = [(g, rng.gauss(0, 3)) for g, n in (("hot", 900), ("b", 40), ("c", 1), ("d", 200)) for _ in range(n)]
    rows += [("hot", 0.25)] * 300
    df = spark.createDataFrame(rows, "g string, v double")
    plain = distributions.box_summary(df, ["g"], "v")
    chunks = distributions.box_summary(df, ["g"], "v", max_rows=10)
    round_all = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert round_all(chunks) == round_all(plain)
    plan = distributions.box_summary(df, ["g"], "v", max_rows=10)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert moves and all("_chunk" in line or "count" in line for line in moves)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan

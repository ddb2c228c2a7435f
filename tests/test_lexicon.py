"""Lexicon scores against published example sentences, and the two lookup ways."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from debatelens.operators.lexicon import ValenceRules, with_lexicons, with_polarity, with_valence
from debatelens.sources import fixtures

WORDS = {
    "smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "horrible": -2.5,
    "love": 3.2, "bad": -2.5,
}

# compound, neg, neu, pos as published with the method
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316, 0.0, 0.254, 0.746),
    ("VADER is smart, handsome, and funny!", 0.8439, 0.0, 0.248, 0.752),
    ("VADER is very smart, handsome, and funny.", 0.8545, 0.0, 0.299, 0.701),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227, 0.0, 0.246, 0.754),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342, 0.0, 0.233, 0.767),
    ("VADER is not smart, handsome, nor funny.", -0.7424, 0.646, 0.354, 0.0),
    ("The book was good.", 0.4404, 0.0, 0.508, 0.492),
    ("The book was kind of good.", 0.3832, 0.0, 0.657, 0.343),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, valence double")


def scores(spark, lexicon, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, message string")
    rows = with_valence(df, lexicon, **options).orderBy("id").collect()
    return [(r["vader_compound"], r["vader_neg"], r["vader_neu"], r["vader_pos"]) for r in rows]


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
def test_published_sentences(spark, lexicon, max_bytes):
    got = scores(spark, lexicon, [p[0] for p in PUBLISHED], max_bytes=max_bytes)
    for sentence, result in zip(PUBLISHED, got):
        assert result == pytest.approx(sentence[1:], abs=1e-9), sentence[0]


def test_rules_one_by_one(spark, lexicon):
    texts = [
        "good", "not good", "never so good", "least good", "at least good", "bad but good",
        "", None, "zzz", "love?? love", "GOOD", "the GOOD", "isn't good",
    ]
    got = [g[0] for g in scores(spark, lexicon, texts)]

    def compound(total):
        return round(total / (total * total + 15) ** 0.5, 4)

    expected = [
        compound(1.9), compound(1.9 * -0.74), compound((1.9 + 0.293) * 1.5), compound(1.9 * -0.74),
        compound(1.9), compound(-2.5 * 0.5 + 1.9 * 1.5), 0.0, None, 0.0, compound(3.2 + 3.2 + 0.36),
        compound(1.9), compound(1.9 + 0.733), compound(1.9 * -0.74),
    ]
    assert got == expected


def test_idioms(spark, lexicon):
    got = scores(spark, lexicon, ["he said it was a yeah right good", "we all liked it good bad ass"])
    assert got[0][0] == round(-2 / (4 + 15) ** 0.5, 4)
    assert got[1][0] == round((1.9 + 1.5) / ((1.9 + 1.5) ** 2 + 15) ** 0.5, 4)


def test_broadcast_and_shuffled_lexicon_agree(spark, msgs):
    source = msgs.select("id", "message")
    valence, polarity = fixtures.valence_lexicon(spark, DATA), fixtures.polarity_lexicon(spark, DATA)
    assert valence.count() > 10
    sent = with_valence(source, valence, rules=fixtures.RULES)
    joined = with_valence(source, valence, rules=fixtures.RULES, max_bytes=5)
    assert sorted(sent.collect()) == sorted(joined.collect())
    sent = with_polarity(source, polarity)
    joined = with_polarity(source, polarity, max_bytes=5)
    assert sorted(sent.collect()) == sorted(joined.collect())


def test_repeated_and_null_words_and_ids_in_both_ways(spark):
    lexicon = spark.createDataFrame([("good", 1.0), ("good", 1.9), ("bad", -2.5), (None, 3.0)], "word string, valence double")
    mood = lexicon.selectExpr("word", "valence / 4 AS polarity", "0.5D AS subjectivity")
    rows = [(1, "good"), (1, "bad and GOOD ones"), (None, "good"), (None, "so bad!"), (2, None), (2, "good"), (3, "")]
    df = spark.createDataFrame(rows, "id long, message string")
    for score, words in ((with_valence, lexicon), (with_polarity, mood)):
        small, joined = score(df, words), score(df, words, max_bytes=1)
        assert small.columns == joined.columns
        assert sorted(map(repr, small.collect())) == sorted(map(repr, joined.collect()))
    assert [r["vader_compound"] for r in with_valence(df, lexicon).where("message = 'good'").collect()] == [0.4404] * 3


def test_rows_move_once_for_both_lexicons(spark, msgs):
    scored = with_lexicons(
        msgs.select("id", "message"), fixtures.valence_lexicon(spark, DATA), fixtures.polarity_lexicon(spark, DATA), rules=fixtures.RULES
    )
    plan = scored._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning(_text" in line]
    # the rows, and the different texts in each branch, of which the second is the first one again
    assert len(moves) == 3


def plain_valence(text, lexicon, rules):
    """Scores of one text, word by word, by the published method."""
    import re
    import string

    def bare(token):
        for mark in (*".!?,;:'\"-", "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?"):
            for one in (token.removeprefix(mark), token.removesuffix(mark)):
                if one != token and len(one) > 1 and not set(one) & set(string.punctuation):
                    return one
        return token

    tokens = [bare(t) for t in text.split() if len(t) > 1]
    low = [t.lower() for t in tokens]
    caps = [t.isupper() for t in tokens]
    mixed = any(caps) and not all(caps)
    boosts = {w: rules.booster for w in rules.boosters_up} | {w: -rules.booster for w in rules.boosters_down}
    values = []
    for i, w in enumerate(low):
        if w in boosts or w not in lexicon or (w == "kind" and low[i + 1 : i + 2] == ["of"]):
            values.append(0.0)
            continue
        v = lexicon[w]
        if mixed and caps[i]:
            v += rules.capitals if v > 0 else -rules.capitals
        for d in (1, 2, 3):
            if i < d or low[i - d] in lexicon:
                continue
            b = low[i - d]
            if b in boosts:
                s = boosts[b] if v >= 0 else -boosts[b]
                if mixed and caps[i - d]:
                    s += rules.capitals if v > 0 else -rules.capitals
                v += s * rules.distance_damping[d - 1]
            so = [x in ("so", "this") for x in low[i - d + 1 : i]]
            if d > 1 and b == "never" and any(so):
                v *= 1.5 if d == 2 else 1.25
            elif b in rules.negators or "n't" in b:
                v *= rules.negation
            if d == 3:
                runs = [low[i : i + 3], low[i : i + 2], low[i - 1 : i + 1], low[i - 2 : i + 1], low[i - 2 : i],
                        low[i - 3 : i], low[i - 3 : i - 1]]
                known = [rules.idioms[" ".join(r)] for r in runs if " ".join(r) in rules.idioms]
                v = known[0] if known else v
                pairs = {" ".join(low[i - 3 : i - 1]), " ".join(low[i - 2 : i])}
                v -= rules.booster if pairs & set(rules.boosters_down) else 0.0
        if low[i - 1 : i] == ["least"] and "least" not in lexicon and (i < 2 or low[i - 2] not in ("at", "very")):
            v *= rules.negation
        values.append(v)
    if rules.contrast in low:
        at = low.index(rules.contrast)
        values = [v * (rules.before_but if i < at else rules.after_but if i > at else 1.0) for i, v in enumerate(values)]
    asked = text.count("?")
    e = min(text.count("!"), 4) * rules.exclamation + (0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0.0)
    total = reduce(float.__add__, values, 0.0)
    total += e if total > 0 else -e if total < 0 else 0.0
    pos, neg = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0)
    pos, neg = pos + (e if pos > neg else 0), neg + (e if pos < neg else 0)
    whole = pos + neg + sum(v == 0 for v in values)
    shares = [x / whole if whole else 0.0 for x in (neg, sum(v == 0 for v in values), pos)]
    return [total / (total * total + 15) ** 0.5, *shares]


def test_default_rules_against_a_plain_computation(spark):
    rules, rng = ValenceRules(), random.Random(5)
    lexicon = {"good": 1.9, "bad": -2.5, "love": 3.2, "kind": 2.4, "ass": -2.1, "right": 0.4, "death": -2.9, "so": 0.3, "least": 0.1}
    parts = [*lexicon, *rules.idioms, "kind of", "sort of", "just enough", "never", "never so", "isn't", "very", "VERY", "GOOD",
             "at least", "least", "but", "this", "of", "the", "table", "Chair", "good!", "bad?", "really", "BAD", "'love'", "x"]
    for words in (lexicon, {w: v for w, v in lexicon.items() if w not in ("so", "least")}):
        texts = [" ".join(rng.choices(parts, k=rng.randint(0, 14))) + rng.choice(["", "!", "??", "????", "!!!!!"]) for _ in range(400)]
        table = spark.createDataFrame(list(words.items()), "word string, valence double")
        for text, got in zip(texts, scores(spark, table, texts, rules=rules), strict=True):
            assert got == pytest.approx(plain_valence(text, words, rules), abs=6e-4), text


def test_polarity_is_the_same_in_any_order(spark):
    lexicon = spark.createDataFrame([(f"w{i}", i / 7, 0.1 * i) for i in range(40)], "word string, polarity double, subjectivity double")
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(random.Random(i).sample(words, 40))) for i in range(20)]
    rows = with_polarity(spark.createDataFrame(texts, "id long, message string"), lexicon).collect()
    assert len({(r["textblob_polarity"], r["textblob_subjectivity"]) for r in rows}) == 1


def test_words_of_a_text_are_found_once(spark, lexicon):
    df = spark.createDataFrame([(1, "never so good")], "id long, message string")
    said = df.withColumn("message", F.regexp_replace("message", "zz", "y"))
    plan = with_valence(said, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    # nowhere else than in the list that is exploded, above all in no filter that visits it word by word
    assert plan.count("regexp_replace(lambda") == 1
    assert not [line for line in plan.split("\n") if "Filter" in line and "split(" in line]
    # the text itself once for the rows and once for the different texts
    assert plan.count("regexp_replace(message") == 2


def test_long_texts_of_many_phrases_against_a_plain_computation(spark):
    rules, rng = ValenceRules(idioms=ValenceRules().idioms | {"the good old bad": 2.5}), random.Random(8)
    lexicon = {"good": 1.9, "bad": -2.5, "ass": -2.1, "right": 0.4, "death": -2.9, "bus": -0.2, "kiss": 1.8}
    parts = [*lexicon, *rules.idioms, "kind of", "sort of", "just enough", "never so", "very", "GOOD", "the", "table", "good!"]
    texts = [" ".join(rng.choices(parts, k=n)) for n in (40, 400, 3000)]
    table = spark.createDataFrame(list(lexicon.items()), "word string, valence double")
    df = spark.createDataFrame([*enumerate(texts), (3, None), (4, "")], "id long, message string")
    got = [list(r)[2:] for r in with_valence(df, table, rules=rules).orderBy("id").collect()]
    for text, row in zip(texts, got):
        assert row == pytest.approx(plain_valence(text, lexicon, rules), abs=6e-4)
    assert got[3] == [None] * 4 and got[4] == [0.0] * 4

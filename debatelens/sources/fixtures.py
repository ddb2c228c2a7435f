"""Lookup inputs for the registered queries, derived from the given tables.

A user of the library brings lexicons, prompts, claims, questions and predictors.
The registered queries take them from the ``benchmark`` passages, with values from
a hash of the word or passage number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import values as V
from ..operators.enrich import Scorer
from ..operators.lexicon import ValenceRules
from ..operators.models import Predictor
from ..operators.terms import words

#: Frequent words of the four languages of the texts.
STOP_WORDS = ["the", "of", "and", "in", "to", "der", "die", "und", "la", "le", "de", "el", "que"]

#: Valence word lists that occur in the texts.
RULES = ValenceRules(
    negators=["of", "nicht", "qui", "no", "not"],
    boosters_up=["and", "der", "le", "los"],
    boosters_down=["in", "die", "de", "en"],
    idioms={},
    contrast="with",
)

PHRASES = ["the thing", "thing", "of the", "die", "in the", "la"]


def hash_number(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 4), 16, 10).cast("long")


def benchmark_words(spark: SparkSession, sf_dir: str, **numbers: int) -> DataFrame:
    """Distinct words of the passages, each with the hash numbers at the named places."""
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    listed = passages.select(F.explode(words("text")).alias("word"))
    # as aggregates, so that conditions on them are not evaluated on message words too
    return listed.groupBy("word").agg(
        *[F.max(hash_number(F.col("word"), start)).alias(name) for name, start in numbers.items()]
    )


def valence_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the passages' words: messages must hold words that no lexicon knows."""
    known = benchmark_words(spark, sf_dir, keep=1, value=5).where("keep % 3 <> 0")
    return known.select("word", ((F.col("value") % 79 - 39) / 10.0).alias("valence"))


#: Word runs that the published rules know, put into texts by the query on the default rules.
PUT_IN = ["the bomb", "bad ass", "yeah right", "kiss of death", "kind of", "sort of", "just enough", "never so",
          "isn't", "very", "at least", "least", "but", "hardly", "REALLY"]


def with_phrases_put_in(df: DataFrame, text: str = "message") -> DataFrame:
    """Texts in which every word whose hash asks for it is followed by one of ``PUT_IN``."""
    blank, number = F.lit(" "), lambda w: hash_number(w, 1)
    put = F.transform(
        F.split(text, " "),
        lambda w: F.when(number(w) % 5 == 0, F.concat(w, blank, _listed(PUT_IN, number(w)))).otherwise(w),
    )
    return df.withColumn(text, F.array_join(put, " "))


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to three words of the passages, as far as their hash asks for it."""
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    listed = F.split(F.lower(F.col("text")), " ")
    places = F.sequence(F.lit(1), F.size(listed))
    runs = F.flatten(F.transform(places, lambda i: F.transform(
        F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.array_join(F.slice(listed, i, n), " "))))
    each = passages.select(F.explode(runs).alias("phrase")).distinct()
    return each.where((hash_number(F.col("phrase"), 1) % 3 == 0) & F.col("phrase").rlike(r"[\p{L}\p{N}_]"))


def polarity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the passages' words, for the same reason."""
    known = benchmark_words(spark, sf_dir, keep=9, value=13, other=17).where("keep % 2 = 0")
    return known.select(
        "word",
        ((F.col("value") % 201 - 100) / 100.0).alias("polarity"),
        ((F.col("other") % 101) / 100.0).alias("subjectivity"),
    )


def _digits(text: str, start: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[start : start + 4], 16)


def hash_predictor(kind: str, fail_every: int = 0) -> Predictor:
    """A stand-in classifier: label and score from the hash of the text.

    ``fail_every`` makes it raise on that part of the texts.
    """
    labels, low, steps, start = {
        "transformer": (["Negative", "Positive"], 5000, 5001, 0),
        "distilbert": (["Negative", "Positive"], 8000, 2001, 8),
        "toxicity": (["TOXIC", "CLEAN", "CLEAN", "CLEAN"], 0, 10001, 16),
    }[kind]

    def one(text: str) -> tuple[str, float]:
        if fail_every and _digits(text, 24) % fail_every == 0:
            raise ValueError("no prediction")
        label = labels[_digits(text, start) % len(labels)]
        return label, (low + _digits(text, start + 4) % steps) / 10000.0

    return lambda texts: [one(t) for t in texts]


def scorer(spark: SparkSession, sf_dir: str, models: bool = True) -> Scorer:
    kinds = ["transformer", "distilbert", "toxicity"] if models else []
    return Scorer(
        valence=valence_lexicon(spark, sf_dir),
        polarity=polarity_lexicon(spark, sf_dir),
        models={k: (lambda kind=k: hash_predictor(kind)) for k in kinds},
        valence_rules=RULES,
    )


def _listed(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by topic and mode, for six of the eight topics."""
    item = F.col("item_id")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        _listed(V.TOPICS[:6], item).alias("category"),
        _listed(V.MODES, F.floor(item / 2)).alias("host_mode"),
        F.concat(F.col("item_id").cast("string"), F.lit(" "), F.col("text")).alias("prompt"),
    )


def default_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        _listed(V.MODES, F.floor(item / 4)).alias("host_mode"),
        F.concat(F.lit("any "), F.col("item_id").cast("string"), F.lit(" "), F.col("text")).alias("prompt"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.lower(_listed(V.TOPICS[3:], item)).alias("topic"),
        F.concat(F.lit("claim "), F.col("item_id").cast("string"), F.lit(": "), F.col("text")).alias("claim"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        _listed(V.TOPICS[:7], item).alias("category"),
        F.concat(F.lit("question "), F.col("item_id").cast("string"), F.lit(": "), F.col("text")).alias("question"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaction templates by strategy, some for one mode only."""
    item = F.col("item_id")
    strategy = _listed(V.STRATEGIES, item)
    mode = F.when(item % 3 == 0, F.lit(None).cast("string")).otherwise(_listed(V.MODES, item))
    text = F.concat(
        F.col("item_id").cast("string"), F.lit(" on {category}: '{statement}', says "), strategy, F.lit(", "), F.col("text")
    )
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        strategy.alias("strategy"), mode.alias("host_mode"), text.alias("template")
    )

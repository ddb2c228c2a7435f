"""Word counts of message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.ml.feature import StopWordsRemover

from ..scale import join_lookup

# --- Fixed values: word patterns; the class of word characters is spelled out because
# --- \w of the JVM leaves out accented letters ---
WORD = r"[\p{L}\p{N}_]+"
CLOUD_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def words(text: Column | str = "message", pattern: str = WORD) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def without_stop_words(df: DataFrame, stop_words: list[str] | DataFrame, column: str = "word") -> DataFrame:
    """Drop stop words, given as a list or as a one-column table."""
    if isinstance(stop_words, DataFrame):
        listed = stop_words.select(F.col(stop_words.columns[0]).alias(column)).distinct()
        return join_lookup(df, listed, column, "left_anti")
    return df.where(~F.col(column).isin(stop_words)) if stop_words else df


def top_per_group(table: DataFrame, by: list[str], n: int, key: str = "word") -> DataFrame:
    """The ``n`` most frequent keys of each group, ties by key.

    Spark keeps ``n`` rows per group and task before the shuffle, so a group of any
    size reaches the final task as a short list.
    """
    order = W.partitionBy(*by).orderBy(F.desc("n"), F.asc(key)) if by else None
    if order is None:
        return table.orderBy(F.desc("n"), F.asc(key)).limit(n)
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def word_counts(df: DataFrame, by: list[str], tokens: Column | None = None) -> DataFrame:
    """Count of each word per group; words combine in the task that read the text."""
    listed = words() if tokens is None else tokens
    exploded = df.where(F.col("message").isNotNull()).select(*by, F.explode(listed).alias("word"))
    return exploded.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def top_words(
    msgs: DataFrame, by: list[str], stop_words: list[str] | DataFrame, n: int = 20
) -> DataFrame:
    """Most frequent words of each group, stop words left out; a null group counts."""
    return top_per_group(without_stop_words(word_counts(msgs, by), stop_words), by, n)


def negative_words(msgs: DataFrame, lexicon: DataFrame, by: list[str] | None = None, n: int = 20) -> DataFrame:
    """Most frequent words of negative valence, over all messages or per group.

    Counted before the lookup, so the join sees each word of a group once. One word
    alone has a compound of the sign of its valence.
    """
    by = by or []
    negative = lexicon.where(F.col("valence") < 0).select("word")
    table = join_lookup(word_counts(msgs, by), negative, "word", "left_semi")
    return top_per_group(table, by, n)


def cloud_words(text: Column | str = "message") -> Column:
    """Words as a word cloud counts them: two characters or more, no bare numbers,
    a possessive ending cut."""
    cut = F.transform(words(text, CLOUD_WORD), lambda w: F.regexp_replace(w, "'s$", ""))
    return F.filter(cut, lambda w: ~w.rlike(r"^\p{N}+$"))


def term_frequencies(
    df: DataFrame, by: list[str], stop_words: list[str] | DataFrame, n: int = 200
) -> DataFrame:
    """Word counts per group for a word cloud."""
    table = word_counts(df, by, cloud_words())
    return top_per_group(without_stop_words(table, stop_words), by, n)


def pair_counts(df: DataFrame, by: list[str], stop_words: list[str] | DataFrame) -> DataFrame:
    """(by, a, b, n): neighbouring words of a message, neither of them a stop word.

    Stop words of a list are left out of each text, those of a table after counting.
    """
    listed = stop_words if isinstance(stop_words, list) else []
    tokens = F.col("_words")
    linked = F.transform(
        tokens, lambda a, i: F.struct(a.alias("a"), F.get(tokens, i + 1).alias("b"))
    )
    pairs = F.filter(
        linked,
        lambda p: p["b"].isNotNull() & ~p["a"].isin(listed) & ~p["b"].isin(listed),
    )
    exploded = (
        df.where(F.col("message").isNotNull())
        .select(*by, cloud_words().alias("_words"))
        .select(*by, F.explode(pairs).alias("pair"))
        .select(*by, "pair.a", "pair.b")
    )
    table = exploded.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(stop_words, DataFrame):
        for word in ("a", "b"):
            table = without_stop_words(table, stop_words, word)
    return table


def bigram_frequencies(
    df: DataFrame, by: list[str], stop_words: list[str] | DataFrame, n: int = 200
) -> DataFrame:
    """Counts of neighbouring word pairs of a message, neither of them a stop word."""
    table = pair_counts(df, by, stop_words).select(*by, F.concat_ws(" ", "a", "b").alias("bigram"), "n")
    return top_per_group(table, by, n, "bigram")


def _with_singular(table: DataFrame, by: list[str], word: str) -> DataFrame:
    """Add ``form``: the word without its last s if the group has that word too, else itself."""
    cut = F.expr(f"substring({word}, 1, char_length({word}) - 1)")
    plural = F.col(word).endswith("s") & ~F.col(word).endswith("ss")
    known = table.select(*[F.col(k).alias(f"_{k}") for k in by], F.col(word).alias("_singular")).distinct()
    same = F.col("_singular") == F.when(plural, cut)
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = table.join(known, same, "left").withColumn("form", F.coalesce("_singular", F.col(word)))
    return joined.select(*table.columns, "form")


def collocation_score(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Likelihood ratio of a pair of words against their chance meeting, from its count, the
    counts of both words and of all words; 0 where one word is all there is."""
    least = 1e-10

    def fit(hits: Column, trials: Column, chance: Column) -> Column:
        one = F.log(F.greatest(chance, F.lit(least))) * hits
        return one + F.log(F.greatest(1 - chance, F.lit(least))) * (trials - hits)

    c12, c1, c2, n = (c.cast("double") for c in (pair, first, second, total))
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / F.nullif(n - c1, F.lit(0.0))
    score = fit(c12, c1, p) + fit(c2 - c12, n - c1, p) - fit(c12, c1, p1) - fit(c2 - c12, n - c1, p2)
    return F.when((n <= c1) | (n <= c2), 0.0).otherwise(-2 * score)


def collocations(
    df: DataFrame,
    by: list[str],
    stop_words: list[str] | DataFrame,
    threshold: float = 30.0,
    n: int = 200,
) -> DataFrame:
    """Words and word pairs of a word cloud, per group the ``n`` most frequent.

    A pair counts as one term when its likelihood ratio is above ``threshold``; its words then
    lose its count, and a word with none left is no term. A plural in s counts as its singular
    where the group has both, for words and for pairs.
    """
    words_ = _with_singular(without_stop_words(word_counts(df, by, cloud_words()), stop_words), by, "word")
    single = words_.groupBy(*by, F.col("form").alias("term")).agg(F.sum("n").alias("n"))
    spelt = words_.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("word").alias("_word"), F.col("form").alias("_form"))
    pairs = pair_counts(df, by, stop_words).withColumn("bigram", F.concat_ws(" ", "a", "b"))
    pairs = _with_singular(pairs, by, "bigram").groupBy(*by, F.col("form").alias("bigram")).agg(F.sum("n").alias("n"))
    for place, name in enumerate(("first", "second")):
        # the word of the pair as it is counted, with its count
        counted = spelt.join(single.select(*[F.col(k).alias(f"_{k}s") for k in by], F.col("term"), F.col("n").alias(f"{name}_n")),
                             (F.col("_form") == F.col("term")) & _same(by, "_{}", "_{}s"))
        counted = counted.select(*[F.col(f"_{k}") for k in by], "_word", F.col("_form").alias(name), f"{name}_n")
        word = F.get(F.split("bigram", " "), F.lit(place))
        pairs = pairs.join(counted, (F.col("_word") == word) & _same(by, "{}", "_{}")).drop("_word", *[f"_{k}" for k in by])
    totals = single.groupBy(*by).agg(F.sum("n").alias("_total"))
    if by:
        scored = pairs.join(totals.select(*[F.col(k).alias(f"_{k}") for k in by], "_total"), _same(by, "{}", "_{}"))
    else:
        scored = pairs.withColumn("_total", totals.scalar())
    score = collocation_score(F.col("n"), F.col("first_n"), F.col("second_n"), F.col("_total"))
    kept = scored.where(score > threshold).select(*by, "bigram", "n", "first", "second")
    lost = kept.select(*by, F.explode(F.array("first", "second")).alias("term"), (-F.col("n")).alias("n"))
    left = single.select(*by, "term", "n").unionByName(lost).groupBy(*by, "term").agg(F.sum("n").alias("n")).where("n > 0")
    terms = left.unionByName(kept.select(*by, F.col("bigram").alias("term"), "n"))
    return top_per_group(terms, by, n, "term")


def _same(by: list[str], left: str, right: str) -> Column:
    same = F.lit(True)
    for key in by:
        same = same & F.col(left.format(key)).eqNullSafe(F.col(right.format(key)))
    return same

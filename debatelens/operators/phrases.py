"""Phrases from a table, found in texts by runs of words.

A phrase is reduced to the part from its first to its last word. In a text only the words
that begin some phrase are looked at, and from each of them only the runs as long as one of
those phrases; a run then meets the phrases by a join. Tables of any size take this way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import MAX_BROADCAST_BYTES
from .terms import WORD
from .texts import join_words, per_text

_OTHER = r"[^\p{L}\p{N}_]+"
#: From the first word to the last one, with all that stands between them.
_CORE = rf"(?s){WORD}(?:.*{WORD})?"


def _parts(text: Column | str) -> Column:
    """Words and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}|{_OTHER}"), F.lit(0))


def _listed(phrases: DataFrame) -> DataFrame:
    """Different phrases with their core, its first word and its number of parts."""
    named = phrases.select(F.col(phrases.columns[0]).alias("phrase")).where("phrase <> ''").distinct()
    core = F.regexp_extract("phrase", _CORE, 0)
    wordless = F.raise_error(F.concat(F.lit("a phrase without a word: "), F.col("phrase"))).cast("string")
    named = named.withColumn("core", F.when(core == "", wordless).otherwise(core))
    place = F.instr("phrase", F.col("core"))
    return named.select(
        "phrase",
        "core",
        F.regexp_extract("core", WORD, 0).alias("first"),
        F.size(_parts("core")).alias("n"),
        F.substring("phrase", F.lit(1), place - 1).alias("lead"),
        F.substring("phrase", place + F.char_length("core"), F.char_length("phrase")).alias("trail"),
    )


def _stands(side: Column, rest: Column, found: Column, last: Column) -> Column:
    """Whether what is next to a run begins (or ends) like the rest of the phrase, and no
    word follows right behind it."""
    return (rest == "") | F.coalesce(found & ((side != rest) | last), F.lit(False))


def _found_phrases(phrases: DataFrame, max_bytes: int) -> Callable[[DataFrame], DataFrame]:
    def find(texts: DataFrame) -> DataFrame:
        listed = _listed(phrases)
        first = listed.groupBy(F.col("first").alias("word")).agg(F.collect_set("n").alias("sizes"))
        read = texts.select("_text", _parts(F.lower("_said")).alias("parts"))
        placed = read.select("_text", "parts", F.posexplode("parts").alias("at", "word"))
        begun = join_words(placed, first, "inner", max_bytes)
        runs = begun.select("_text", "parts", "at", F.explode("sizes").alias("n"))
        runs = runs.where(F.col("at") + F.col("n") <= F.size("parts"))
        core = F.array_join(F.slice("parts", F.col("at") + 1, F.col("n")), "")
        before, after = F.get("parts", F.col("at") - 1), F.get("parts", F.col("at") + F.col("n"))
        edges = {
            "before": before,
            "after": after,
            "starts": F.col("at") == 1,
            "ends": F.col("at") + F.col("n") == F.size("parts") - 1,
        }
        runs = runs.select("_text", core.alias("word"), *[c.alias(n) for n, c in edges.items()])
        cores = listed.groupBy(F.col("core").alias("word")).agg(F.collect_list(F.struct("phrase", "lead", "trail")).alias("forms"))
        met = join_words(runs, cores, "inner", max_bytes)
        fitting = F.filter(
            "forms",
            lambda f: _stands(F.col("before"), f["lead"], F.endswith(F.col("before"), f["lead"]), F.col("starts"))
            & _stands(F.col("after"), f["trail"], F.startswith(F.col("after"), f["trail"]), F.col("ends")),
        )
        each = met.select("_text", F.explode(fitting).alias("form"))
        return each.groupBy("_text").agg(F.sort_array(F.collect_set("form.phrase")).alias("_phrases"))

    return find


def with_phrases(
    df: DataFrame,
    phrases: DataFrame,
    text: str = "message",
    out: str = "phrases",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the phrases of a one-column table that the lower-cased text holds as whole words.

    The list is sorted, empty without a match and null for a null text. It agrees with
    ``functions.escalation.has_phrase`` on the same phrases. Empty and null phrases match
    nothing; a phrase without a letter, digit or underscore is an error.
    """
    found = per_text(df, text, [_found_phrases(phrases, max_bytes)])
    listed = F.coalesce("_phrases", F.array().cast("array<string>"))
    kept = [c for c in df.columns if c != out]
    return found.select(*kept, F.when(F.col(text).isNotNull(), listed).alias(out))

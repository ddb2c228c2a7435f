"""Lookups for the words of texts: each different text once, its words joined with a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..scale import MAX_BROADCAST_BYTES, fits_bytes

#: Least number of copies of each entry of a table that is too large to broadcast.
_SALTS = 32


def join_words(tokens: DataFrame, entries: DataFrame, how: str, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join words of texts (``_text``, ``word``, ...) with entries of different words.

    A larger table than ``max_bytes`` is shuffled, salted by text, so that a word of most
    texts goes to many tasks.
    """
    if fits_bytes(entries, max_bytes):
        return tokens.join(F.broadcast(entries), "word", how)
    salts = max(_SALTS, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("_text"), F.lit(salts))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    salted = tokens.withColumn("_salt", salt).join(entries.withColumn("_salt", copies), ["word", "_salt"], how)
    return salted.drop("_salt")


def per_text(
    df: DataFrame, text: str, found: list[Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """``df`` with what is found for its texts.

    Each function takes the different texts (``_text``, ``_said``) and returns rows by
    ``_text``. Rows and texts are laid out by the text's digest once, for all of them.
    """
    keyed = df.withColumn("_text", F.md5(text))
    # a null text's key meets no row; without it, the text would be read twice to leave it out
    texts = df.select(F.coalesce(F.md5(text), F.lit("")).alias("_text"), F.col(text).alias("_said"))
    texts = texts.dropDuplicates(["_text"])
    for find in found:
        keyed = keyed.join(find(texts), "_text", "left")
    return keyed

"""Reports over the reasons of an escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import values as V
from ..functions.reasons import parse_reasons, reason_family


def reason_rows(df: DataFrame, text: str = "escalation_reason") -> DataFrame:
    """One line per message and reason; the reason keeps its message's columns."""
    parsed = df.withColumn("_reasons", parse_reasons(text))
    return parsed.withColumn("reason", F.explode("_reasons")).drop("_reasons")


def reason_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Messages per group and reason, as ``n``.

    Equal texts are counted before they are parsed: messages are many, their reason
    texts are few.
    """
    texts = df.groupBy(*by, "escalation_reason").agg(F.count(F.lit(1)).alias("n"))
    return reason_rows(texts).groupBy(*by, "reason").agg(F.sum("n").alias("n"))


def reason_frequency(df: DataFrame) -> DataFrame:
    return reason_counts(df, [])


def reason_family_frequency(df: DataFrame) -> DataFrame:
    """Reasons per model family, every family present."""
    found = reason_counts(df, []).select(reason_family("reason").alias("family"), "n")
    empty = df.sparkSession.createDataFrame([(f, 0) for f in V.REASON_FAMILIES], "family string, n bigint")
    return found.unionByName(empty).groupBy("family").agg(F.sum("n").alias("n"))


def reason_by_level(df: DataFrame, levels: list[str] = V.LEVELS) -> DataFrame:
    """Reasons counted per level, most frequent reason first."""
    return (
        reason_counts(df, ["escalation"])
        .groupBy("reason")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(F.when(F.col("escalation") == v, F.col("n")).otherwise(0)).alias(v) for v in levels],
        )
        .orderBy(F.desc("n"), F.asc("reason"))
    )


def reason_share_by_level(df: DataFrame) -> DataFrame:
    """Share of each reason among all reasons of its level."""
    table = reason_counts(df.where(F.col("escalation").isNotNull()), ["escalation"])
    whole = F.sum("n").over(W.partitionBy("escalation"))
    return table.select("escalation", "reason", "n", (F.col("n") / whole).alias("share"))

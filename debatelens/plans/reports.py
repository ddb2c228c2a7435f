"""The report tables, each a function of the message table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import values as V
from ..functions.normal import event_time, labels_agree, level_ordinal, message_length
from ..operators.bootstrap import bootstrap_band
from ..operators.crosstab import counts, long_shares, rate1000, shares, to_long
from ..operators.distributions import box_summary, metrics_long
from ..operators.normalize import (
    host_mode_bots,
    in_catalogue,
    main_bots,
    normalise_names,
    only_api,
    only_modes,
    procon_bots,
    resolve_speaker,
)
from ..operators.turns import level_trend, sentiment_trend, turn_index

TOPIC_AXIS = {"category": V.TOPICS}
MODE_AXIS = {"host_mode": V.MODES}


def _numbered(bots: DataFrame, *columns: str) -> DataFrame:
    """Turn numbers over the columns a report needs, so that only they are moved."""
    needed = ["id", "conversation_id", "timestamp", *columns]
    return turn_index(bots.select(needed))


# --- dashboard: every row ---


def conversation_summary(msgs: DataFrame) -> DataFrame:
    """Messages and mean sentiment per conversation; a missing id is a group too."""
    return msgs.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.avg("sentiment_score").alias("avg_sentiment")
    )


def escalation_counts(msgs: DataFrame) -> DataFrame:
    table = msgs.where(F.col("escalation").isNotNull()).groupBy("escalation")
    return table.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "escalation")


def escalation_by_day(msgs: DataFrame, strict: bool = False) -> DataFrame:
    """Levels per day; rows without a readable time or a level are left out."""
    dated = msgs.select(F.to_date(event_time("timestamp", strict)).alias("day"), "escalation")
    known = dated.where(F.col("day").isNotNull() & F.col("escalation").isNotNull())
    return counts(known, ["day"]).drop("messages")


def box_scores(msgs: DataFrame) -> DataFrame:
    metrics = ["textblob_polarity", "vader_compound", "transformer_score"]
    return box_summary(metrics_long(msgs, metrics), ["metric"], "value")


# --- host-mode reports ---


def count_by_mode_level(msgs: DataFrame) -> DataFrame:
    bots = host_mode_bots(msgs)
    return bots.groupBy("host_mode", "escalation_level").agg(F.count(F.lit(1)).alias("count"))


def avg_length_by_level(msgs: DataFrame) -> DataFrame:
    bots = host_mode_bots(msgs)
    return bots.groupBy("escalation_level").agg(F.avg(message_length()).alias("message_length"))


def box_length_by_level(msgs: DataFrame) -> DataFrame:
    lengths = host_mode_bots(msgs).select("escalation_level", message_length().alias("length"))
    return box_summary(lengths, ["escalation_level"], "length")


def pct_by_mode(msgs: DataFrame) -> DataFrame:
    return shares(host_mode_bots(msgs), ["host_mode"], "escalation_level", scale=100.0)


def pct_by_mode_long(msgs: DataFrame) -> DataFrame:
    return to_long(pct_by_mode(msgs), ["host_mode"], V.LEVELS, "escalation_level", "percentage")


def pct_by_mode_table(msgs: DataFrame) -> DataFrame:
    """All modes in report order, two decimals; a mode without rows stays null."""
    table = shares(
        host_mode_bots(msgs), ["host_mode"], "escalation_level", scale=100.0, axes=MODE_AXIS
    )
    place = F.array_position(F.array(*[F.lit(m) for m in V.MODES]), F.col("host_mode"))
    return table.select(
        place.cast("int").alias("place"), "host_mode", *[F.round(v, 2).alias(v) for v in V.LEVELS]
    ).orderBy("place")


# --- main reports ---


def messages_per_topic(msgs: DataFrame) -> DataFrame:
    return counts(main_bots(msgs), ["category"], values=[], axes=TOPIC_AXIS)


def rate1000_by_topic(msgs: DataFrame) -> DataFrame:
    return rate1000(main_bots(msgs), ["category"], TOPIC_AXIS)


def rate1000_by_mode(msgs: DataFrame) -> DataFrame:
    return rate1000(main_bots(msgs), ["host_mode"], MODE_AXIS)


def rate1000_by_mode_topic(msgs: DataFrame) -> DataFrame:
    """Rates by mode and topic, all modes in one aggregation."""
    return rate1000(main_bots(msgs), ["host_mode", "category"], MODE_AXIS | TOPIC_AXIS)


def _by_mode(table: DataFrame, modes: list[str], values: list[str]) -> DataFrame:
    """Topic rows with one column per mode and value (a grid has few rows)."""
    cells = [
        F.max(F.when(F.col("host_mode") == m, F.col(v))).alias(f"{m}_{v}" if len(values) > 1 else m)
        for m in modes
        for v in values
    ]
    return table.groupBy("category").agg(*cells)


def strong_heatmap(msgs: DataFrame) -> DataFrame:
    return _by_mode(rate1000_by_mode_topic(msgs), V.MODES, ["strong"])


def rate1000_topic_mode_level(msgs: DataFrame) -> DataFrame:
    return _by_mode(rate1000_by_mode_topic(msgs), V.MODES, V.LEVELS)


def label_by_level(msgs: DataFrame, label: str) -> DataFrame:
    """(escalation, label, n): messages of each classifier label per level.

    Every label that occurs is counted; the usual labels have a row for every level.
    """
    known = main_bots(msgs).where(F.col(label).isNotNull() & F.col("escalation").isin(V.LEVELS))
    found = known.select("escalation", F.col(label).alias("label"), F.lit(1).cast("long").alias("n"))
    usual = [(level, name, 0) for level in V.LEVELS for name in V.MODEL_LABELS]
    zeros = msgs.sparkSession.createDataFrame(usual, "escalation string, label string, n long")
    return found.unionByName(zeros).groupBy("escalation", "label").agg(F.sum("n").alias("n"))


def agreement_by_level(msgs: DataFrame) -> DataFrame:
    agree = F.when(labels_agree("transformer_label", "distilbert_label"), "Equal").otherwise("Different")
    bots = main_bots(msgs).withColumn("agreement", agree)
    table = counts(bots, ["escalation"], "agreement", ["Equal", "Different"], {"escalation": V.LEVELS})
    return table.drop("messages")


def level_by_bot(msgs: DataFrame) -> DataFrame:
    return counts(main_bots(msgs).where(F.col("escalation").isNotNull()), ["speaker"]).drop("messages")


def box_sentiment_by_level(msgs: DataFrame) -> DataFrame:
    long = metrics_long(main_bots(msgs), ["textblob_polarity", "vader_compound"], ["escalation"])
    return box_summary(long.where(F.col("escalation").isin(V.LEVELS)), ["metric", "escalation"], "value")


def main_sentiment_trend(msgs: DataFrame) -> DataFrame:
    scores = ["textblob_polarity", "vader_compound", "transformer_score", "distilbert_score"]
    return sentiment_trend(_numbered(main_bots(msgs), "speaker", *scores), scores)


def label_share(msgs: DataFrame, label: str) -> DataFrame:
    return long_shares(_numbered(main_bots(msgs), "speaker", label), ["turn", "speaker"], label)


def level_share_by_turn(msgs: DataFrame) -> DataFrame:
    return shares(_numbered(main_bots(msgs), "escalation"), ["turn"])


def level_trend_ci(msgs: DataFrame) -> DataFrame:
    return level_trend(_numbered(main_bots(msgs), "speaker", "escalation")).select(
        "turn", "speaker", "n", "mean_level", "ci_low", "ci_high"
    )


def level_trend_bootstrap(msgs: DataFrame) -> DataFrame:
    """Mean level per turn and speaker with the bootstrap band of the trend chart."""
    turns = _numbered(main_bots(msgs), "speaker", "escalation").withColumn("level", level_ordinal())
    return bootstrap_band(turns, ["turn", "speaker"], "level").withColumnRenamed("mean", "mean_level")


# --- pro/con reports ---


def procon_level_by_bot(msgs: DataFrame) -> DataFrame:
    return counts(procon_bots(msgs).where(F.col("escalation").isNotNull()), ["speaker"]).drop("messages")


def procon_rate1000(msgs: DataFrame) -> DataFrame:
    axes = {"host_mode": V.PROCON_MODES} | TOPIC_AXIS
    return rate1000(procon_bots(msgs), ["host_mode", "category"], axes)


def procon_strong_heatmap(msgs: DataFrame) -> DataFrame:
    return _by_mode(procon_rate1000(msgs), V.PROCON_MODES, ["strong"])


def box_procon(msgs: DataFrame) -> DataFrame:
    long = metrics_long(procon_bots(msgs), ["vader_compound", "textblob_polarity"], ["speaker"])
    return box_summary(long, ["metric", "speaker"], "value")


def procon_sentiment_trend(msgs: DataFrame) -> DataFrame:
    scores = ["vader_compound", "textblob_polarity", "transformer_score"]
    return sentiment_trend(_numbered(procon_bots(msgs), "speaker", *scores), scores)


def procon_label_share(msgs: DataFrame) -> DataFrame:
    """Label shares of both classifiers, numbered once and counted together."""
    models = ["transformer_label", "distilbert_label"]
    turns = _numbered(procon_bots(msgs), "speaker", *models)
    long = turns.select("turn", "speaker", *models).unpivot(
        ["turn", "speaker"], models, "model", "label"
    )
    return long_shares(long, ["model", "turn", "speaker"], "label")


def procon_level_share(msgs: DataFrame) -> DataFrame:
    return shares(_numbered(procon_bots(msgs), "escalation"), ["turn"])


def procon_level_band(msgs: DataFrame) -> DataFrame:
    return level_trend(_numbered(procon_bots(msgs), "speaker", "escalation")).select(
        "turn", "speaker", "n", "mean_level", "std_level", "band_low", "band_high"
    )


def role_level_pct(msgs: DataFrame) -> DataFrame:
    """Level percentages per speaker role.

    Both row sets are put together as they are: pro/con rows of the service count twice.
    """
    service = in_catalogue(only_api(normalise_names(resolve_speaker(msgs))))
    both = service.select("speaker", "escalation").unionAll(
        procon_bots(msgs).select("speaker", "escalation")
    )
    return shares(both, ["speaker"], scale=100.0)

"""Turn numbers and what depends on the order of a conversation's messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import values as V
from ..functions.normal import level_ordinal
from ..scale import earlier_values, positions, split_hot

CONVERSATION = "conversation_id"


def message_order() -> list[Column]:
    """Time text, then id, which makes the order total; rows without a time come last."""
    return [F.col("timestamp").asc_nulls_last(), F.col("id")]


def turn_index(df: DataFrame, out: str = "turn", max_rows: int | None = None) -> DataFrame:
    """Number the kept messages of each conversation from 0, in time order."""
    return positions(df, CONVERSATION, message_order(), out, max_rows)


def turn_from_id(
    df: DataFrame, column: str = "message_id", out: str = "turn", max_rows: int | None = None
) -> DataFrame:
    """Turn as dense rank of a message number inside its conversation, from 1."""
    normal, hot, _ = split_hot(df, CONVERSATION, max_rows)
    rank = F.dense_rank().over(W.partitionBy(CONVERSATION).orderBy(column)).cast("long")
    done = normal.withColumn(out, rank)
    if hot is None:
        return done
    numbers = hot.select(CONVERSATION, column).distinct()
    ranked = positions(numbers, CONVERSATION, [F.col(column)], "_rank", max_rows)
    joined = hot.alias("m").join(
        ranked.alias("r"),
        F.col(f"m.{CONVERSATION}").eqNullSafe(F.col(f"r.{CONVERSATION}"))
        & F.col(f"m.{column}").eqNullSafe(F.col(f"r.{column}")),
    )
    return done.unionByName(joined.select("m.*", (F.col("r._rank") + 1).alias(out)))


def modal_level(df: DataFrame, level: str = "escalation_level") -> DataFrame:
    """Most frequent level of each conversation and turn, the smallest name on ties."""
    return df.groupBy(CONVERSATION, "turn").agg(F.mode(level, deterministic=True).alias(level))


def level_series(df: DataFrame, level: str = "escalation_level") -> DataFrame:
    """Ordinal of the modal level per conversation and turn."""
    return modal_level(df, level).withColumn("escalation_numeric", level_ordinal(level))


def host_strategy(msgs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Host messages with the strategy of their place in the round robin.

    A strategy is drawn by the number of earlier host messages; the opener counts
    but follows no strategy itself.
    """
    host = msgs.where(F.col("speaker") == V.HOST)
    placed = positions(host, CONVERSATION, message_order(), "host_turns", max_rows)
    names = F.array(*[F.lit(s) for s in V.STRATEGIES])
    step = (F.col("host_turns") % len(V.STRATEGIES) + 1).cast("int")
    return placed.withColumn("strategy", F.when(F.col("host_turns") > 0, F.element_at(names, step)))


# --- Fixed values: the question that closes a reply prompt ---
REPLY_QUESTIONS = {
    "Bot 1": "Bot 1, how do you respond?",
    "Bot 2": "Bot 2, how do you respond?",
    "Pro-Bot": "Pro-Bot, how do you respond positively?",
    "Con-Bot": "Con-Bot, how do you respond critically?",
}


def reply_context(
    msgs: DataFrame, size: int = 5, ask: bool = False, max_rows: int | None = None
) -> DataFrame:
    """Each bot reply with the ``size`` messages before it, as ``speaker: message`` lines.

    ``ask`` closes the context as the prompt did: the last message again under the
    host's name, whoever wrote it, and the question to the bot.
    """
    text = F.coalesce("message", F.lit("None"))
    line = F.struct(F.concat("speaker", F.lit(": "), text).alias("line"), text.alias("message"))
    seen = earlier_values(msgs, CONVERSATION, message_order(), line, size, "_seen", max_rows)
    context = F.array_join(F.col("_seen.line"), "\n")
    if ask:
        last = F.coalesce(F.try_element_at("_seen", F.lit(-1)).getField("message"), F.lit("None"))
        question = F.coalesce(
            *[F.when(F.col("speaker") == s, F.lit(q)) for s, q in REPLY_QUESTIONS.items()]
        )
        context = F.concat(context, F.lit("\nHost: '"), last, F.lit("'\n"), question)
    replies = seen.where(F.col("speaker").isin(list(REPLY_QUESTIONS)))
    return replies.withColumn("context", context).drop("_seen")


def last_statement(msgs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Add ``statement``: the message before each one, which a host reacts to."""
    order, value = message_order(), F.coalesce("message", F.lit(""))
    seen = earlier_values(msgs, CONVERSATION, order, value, 1, "_seen", max_rows)
    return seen.withColumn("statement", F.try_element_at("_seen", F.lit(1))).drop("_seen")


def sentiment_trend(turns: DataFrame, scores: list[str]) -> DataFrame:
    """Mean of each score per turn and speaker, in one pass."""
    return turns.groupBy("turn", "speaker").agg(*[F.avg(s).alias(s) for s in scores])


def level_trend(turns: DataFrame, z: float = 1.96) -> DataFrame:
    """Mean ordinal level per turn and speaker, its spread and its normal interval."""
    number = level_ordinal("escalation")
    table = turns.groupBy("turn", "speaker").agg(
        F.count(number).alias("n"),
        F.avg(number).alias("mean_level"),
        F.stddev_samp(number).alias("std_level"),
    )
    half = z * F.col("std_level") / F.sqrt(F.nullif(F.col("n"), F.lit(0)))
    mean, std = F.col("mean_level"), F.col("std_level")
    return table.where(F.col("n") > 0).select(
        "turn", "speaker", "n", "mean_level", "std_level",
        (mean - half).alias("ci_low"), (mean + half).alias("ci_high"),
        (mean - std).alias("band_low"), (mean + std).alias("band_high"),
    )

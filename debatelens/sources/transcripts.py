"""Message table built from plain chat transcripts.

Transcripts have four columns: conversation number, turn, role and text. The
message table needs speakers, topics, modes, times and model signals as well;
they are derived from the conversation number and the turn with bit
arithmetic, so the same transcript always gives the same messages, row by row,
without a shuffle, and a report that needs no text does not read it.

The spread of the derived values covers what reports have to cope with: host
rows without signals, unscored rows, rows without a speaker, names in mixed case
and with tabs, blank texts, topics outside the catalogue, unusual labels, null modes,
times with and without a fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import values as V
from ..functions.escalation import escalation_level, escalation_reasons, escalation_score
from ..functions.escalation import is_toxic
from ..functions.reasons import reasons_text
from .messages import MESSAGE_SCHEMA

#: Topic spellings found in the message table, two of them outside the catalogue.
TOPIC_SPELLINGS = [
    "Politics", "\tsocial issues\n", "Religion", "ECONOMY", "Technology",
    "climate change", "Human Rights", "Education", "Gender Equality", "Immigration",
]
MODE_SPELLINGS = ["neutral", "Provocative\t", "extreme", "pro-con-neutral", "Pro-Con-Provocative", "pro-con-extreme"]
TRANSFORMER_LABELS = ["NEGATIVE", "POSITIVE", "NEGATIVE", "NEUTRAL", "NEGATIVE", "POSITIVE", "NEGATIVE", "UNKNOWN"]
DISTILBERT_LABELS = ["NEGATIVE", "POSITIVE", "NEGATIVE", "NEGATIVE"]
TOXICITY_LABELS = ["CLEAN", "TOXIC", "CLEAN", "CLEAN"]


#: A message with nothing in it.
BLANK_TEXT = " \n\t "

#: Scrambled number of a message.
MIXED = "(conv_id & 65535) * 40503 + turn * 25717"


def draw(factor: int, bits: int) -> Column:
    """Number of ``bits`` bits that depends on the message and ``factor`` only."""
    return F.expr(f"((_mixed * {factor}) >> 9) & {2**bits - 1}")


def pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number + 1).cast("int"))


def _speaker(procon: Column) -> Column:
    """Rounds of host, first bot, second bot, as stored debates have them."""
    place = F.col("turn") % 3
    first = F.when(procon, V.PROCON_BOTS[0]).otherwise(V.BOTS[0])
    second = F.when(procon, V.PROCON_BOTS[1]).otherwise(V.BOTS[1])
    return F.when(place == 0, V.HOST).when(place == 1, first).otherwise(second)


def _timestamp() -> Column:
    # without a zone, so that the texts do not depend on the session's
    moment = F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(conv_id % 2000), 0, int(turn * 37))"
    )
    whole = F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))
    fraction = F.lpad((draw(7919, 16) * 13).cast("string"), 6, "0")
    return (
        F.when(draw(911, 6) == 0, F.lit(None).cast("string"))
        .when(draw(877, 2) == 0, whole)
        .otherwise(F.concat(whole, F.lit("."), fraction))
    )


def messages_from_transcripts(transcripts: DataFrame) -> DataFrame:
    conv = F.col("conv_id")
    procon = conv % 7 >= 4
    mode = F.when(procon, pick(MODE_SPELLINGS[3:], conv % 3)).otherwise(pick(MODE_SPELLINGS[:3], conv % 3))
    base = transcripts.withColumn("_mixed", F.expr(MIXED)).select(
        (conv * 1000 + F.col("turn")).alias("id"),
        conv.cast("string").alias("conversation_id"),
        F.when(draw(3947, 8) != 0, _speaker(procon)).alias("speaker"),
        F.when(draw(2129, 7) == 0, F.lit(BLANK_TEXT)).otherwise(F.col("text")).alias("message"),
        _timestamp().alias("timestamp"),
        pick(TOPIC_SPELLINGS, conv % 10).alias("category"),
        F.when(conv % 41 != 40, mode).alias("host_mode"),
        F.when(conv % 11 == 10, "deepseek").when(conv % 13 == 12, "ollama").otherwise("openai").alias("api"),
        # host rows have no signals, and some rows are left unscored
        ((F.col("turn") % 3 != 0) & (draw(331, 4) != 0)).alias("_scored"),
        "_mixed",
    )
    signals = {
        "textblob_polarity": (draw(1613, 11) - 1024) / 1025.0,
        "textblob_subjectivity": draw(677, 10) / 1023.0,
        "vader_compound": (draw(2711, 14) - 8192) / 8193.0,
        "vader_neg": draw(73, 7) / 509.0,
        "vader_neu": (509 - draw(73, 7) - draw(79, 7)) / 509.0,
        "vader_pos": draw(79, 7) / 509.0,
        "transformer_label": pick(TRANSFORMER_LABELS, draw(4799, 3)),
        "transformer_score": (draw(8311, 13) + 8192) / 16387.0,
        "distilbert_label": pick(DISTILBERT_LABELS, draw(5903, 2)),
        "distilbert_score": (draw(8999, 11) + 8192) / 10243.0,
        "toxicity_label": pick(TOXICITY_LABELS, draw(5987, 2)),
        "toxicity_score": draw(9749, 10) / 1023.0,
    }
    judged = (
        base.withColumns(signals)
        .withColumn("toxicity_is_toxic", is_toxic())
        .withColumn("_points", escalation_score())
        .withColumn("escalation", escalation_level("_points"))
        .withColumn("escalation_reason", reasons_text(escalation_reasons()))
        .withColumn("sentiment_score", F.col("vader_compound"))
    )
    kept = {
        name: F.when(F.col("_scored"), F.col(name))
        for name in [*signals, "toxicity_is_toxic", "escalation", "escalation_reason", "sentiment_score"]
    }
    kept["escalation_reason"] = F.when(F.col("speaker") == V.HOST, "None").otherwise(kept["escalation_reason"])
    stored = judged.withColumns(kept)
    return stored.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE_SCHEMA], "toxicity_label")


def read_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

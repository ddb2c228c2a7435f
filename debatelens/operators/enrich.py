"""Scoring of messages: lexicons, classifiers and the escalation rule together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions.escalation import (
    DEFAULT_RULE,
    EscalationRule,
    escalation_level,
    escalation_reasons,
    escalation_score,
    is_toxic,
)
from ..functions.normal import is_blank
from ..functions.reasons import reasons_text
from ..scale import MAX_BROADCAST_BYTES
from ..sources.messages import MESSAGE_SCHEMA, SIGNALS, ensure_columns
from .lexicon import DEFAULT_VALENCE_RULES, ValenceRules, with_lexicons
from .models import Predictor, score_with_models


@dataclass(frozen=True)
class Scorer:
    """What the scoring needs: two lexicons, predictors by column prefix, the rule.

    A prefix without a predictor keeps the label and score columns of the input.
    """

    valence: DataFrame
    polarity: DataFrame
    models: dict[str, Callable[[], Predictor]] = field(default_factory=dict)
    rule: EscalationRule = DEFAULT_RULE
    valence_rules: ValenceRules = DEFAULT_VALENCE_RULES
    toxic_label: str = V.TOXIC
    max_bytes: int = MAX_BROADCAST_BYTES


def apply_rule(df: DataFrame, rule: EscalationRule = DEFAULT_RULE) -> DataFrame:
    """Add score, level and reasons from the signal columns, as one projection."""
    scored = df.withColumn("escalation_score", escalation_score(rule))
    return scored.withColumns(
        {
            "escalation": escalation_level("escalation_score", rule),
            "escalation_reason": escalation_reasons(rule),
        }
    )


def enrich(df: DataFrame, scorer: Scorer, text: str = "message") -> DataFrame:
    """Score every row; the result has all signal columns, reasons as an array.

    The rows are laid out by their text once, for both lexicons.
    """
    signals = with_lexicons(df, scorer.valence, scorer.polarity, text, scorer.valence_rules, scorer.max_bytes)
    fallbacks = {p: None if p == "toxicity" else V.UNKNOWN for p in scorer.models}
    signals = score_with_models(signals, scorer.models, text, fallbacks, as_is={"toxicity"})
    if "toxicity_label" in signals.columns:
        signals = signals.withColumn("toxicity_is_toxic", is_toxic(toxic_label=scorer.toxic_label))
    judged = apply_rule(ensure_columns(signals, MESSAGE_SCHEMA), scorer.rule)
    return judged.withColumn("sentiment_score", F.col("vader_compound"))


def analyze_texts(df: DataFrame, scorer: Scorer, text: str = "message") -> DataFrame:
    """Score typed texts; blank ones are left out, reasons come as one line."""
    typed = enrich(df.where(~is_blank(text)), scorer, text)
    return typed.withColumn("escalation_reason", F.array_join("escalation_reason", ", "))


def conversation_uuid(key: Column | str, run: str) -> Column:
    """UUID of a conversation, from its key and the name of the run.

    Derived, not drawn: a task run again gives its rows the same id.
    """
    digest = F.md5(F.concat(F.lit(f"{run}|"), F.col(key).cast("string") if isinstance(key, str) else key))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def ingest_conversations(
    df: DataFrame,
    scorer: Scorer,
    category: Column | str,
    host_mode: Column | str,
    api: Column | str,
    conversation_id: Column | str = "conversation_id",
) -> DataFrame:
    """Rows to store for finished conversations: bots scored, host rows without signals.

    A row without a speaker is no host row and is scored. One pass: host rows go through
    the scoring without a text, and their signals are blanked afterwards.
    """
    described = df.withColumns(
        {
            "conversation_id": F.col(conversation_id) if isinstance(conversation_id, str) else conversation_id,
            "category": F.col(category) if isinstance(category, str) else category,
            "host_mode": F.col(host_mode) if isinstance(host_mode, str) else host_mode,
            "api": F.col(api) if isinstance(api, str) else api,
        }
    )
    is_host = F.col("speaker").eqNullSafe(F.lit(V.HOST))
    rows = enrich(described.withColumn("_scored_text", F.when(~is_host, F.col("message"))), scorer, "_scored_text")
    rows = rows.withColumn("escalation_reason", reasons_text("escalation_reason"))
    return rows.select(
        *[F.when(~is_host, F.col(f.name)).alias(f.name) if f.name in SIGNALS else F.col(f.name) for f in MESSAGE_SCHEMA]
    )


#: Columns the backfill writes; the other signals keep what is stored.
BACKFILLED = [
    "textblob_polarity",
    "textblob_subjectivity",
    "vader_compound",
    "vader_neg",
    "vader_neu",
    "vader_pos",
    "transformer_label",
    "transformer_score",
    "escalation",
]


def unscored(msgs: DataFrame) -> Column:
    return (
        F.col("textblob_polarity").isNull()
        | F.col("vader_compound").isNull()
        | F.col("transformer_label").isNull()
    )


def backfill_unscored(msgs: DataFrame, scorer: Scorer, include_host: bool = True) -> DataFrame:
    """The table with unscored rows scored; scored rows pass through unread.

    Host rows have no signals and are scored too unless ``include_host`` is off. The
    two parts are disjoint by predicate, so no join by id is needed.
    """
    columns = msgs.columns
    stored = ensure_columns(msgs, MESSAGE_SCHEMA)
    todo = unscored(stored)
    if not include_host:
        todo = todo & ~F.col("speaker").eqNullSafe(F.lit(V.HOST))
    todo = F.coalesce(todo, F.lit(False))
    kept = [c for c in stored.columns if c not in BACKFILLED]
    old = stored.where(todo).select(*[F.col(c).alias(f"_old_{c}") for c in kept], "*")
    scored = enrich(old, scorer).select(*[F.col(f"_old_{c}").alias(c) for c in kept], *BACKFILLED)
    return stored.where(~todo).unionByName(scored).select(
        *columns, *[c for c in stored.columns if c not in columns]
    )

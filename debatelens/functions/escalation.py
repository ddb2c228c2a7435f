"""The weighted escalation rule and the phrase flag, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .. import values as V


@dataclass(frozen=True)
class EscalationRule:
    """Cut-offs (strict) and weights. Defaults are the fixed values of the data model."""

    vader_negative: float = -0.5
    vader_strong: float = -0.8
    vader_negative_weight: int = 1
    vader_strong_weight: int = 2
    textblob_negative: float = -0.2
    textblob_strong: float = -0.5
    textblob_negative_weight: int = 1
    textblob_strong_weight: int = 2
    transformer_negative: float = 0.85
    transformer_strong: float = 0.95
    transformer_negative_weight: int = 2
    transformer_strong_weight: int = 3
    distilbert_negative: float = 0.85
    distilbert_middle: float = 0.95
    distilbert_strong: float = 0.99
    distilbert_weight: int = 1
    toxicity_weight: int = 3
    light_from: int = 2
    strong_from: int = 5


DEFAULT_RULE = EscalationRule()


def _branches(rule: EscalationRule) -> list[list[tuple[Column, int, str | None]]]:
    """(condition, weight, reason) in rule order; of one list only the first hit counts."""
    vader, blob = F.col("vader_compound"), F.col("textblob_polarity")
    tr, tr_neg = F.col("transformer_score"), F.col("transformer_label") == V.NEGATIVE
    db, db_neg = F.col("distilbert_score"), F.col("distilbert_label") == V.NEGATIVE
    r = rule
    return [
        [
            (vader < r.vader_strong, r.vader_strong_weight, "vader_strong_negative"),
            (vader < r.vader_negative, r.vader_negative_weight, "vader_negative"),
        ],
        [(blob < r.textblob_negative, r.textblob_negative_weight, "textblob_negative")],
        [(blob < r.textblob_strong, r.textblob_strong_weight, "textblob_strong_negative")],
        [
            (tr_neg & (tr > r.transformer_negative), r.transformer_negative_weight, "transformer_negative"),
        ],
        [
            (tr_neg & (tr > r.transformer_strong), r.transformer_strong_weight, "transformer_strong_negative"),
        ],
        [
            (db_neg & (db > r.distilbert_strong), r.distilbert_weight, "distilbert_strong_negative"),
            # the middle band counts but names no reason
            (db_neg & (db > r.distilbert_middle), r.distilbert_weight, None),
            (db_neg & (db > r.distilbert_negative), r.distilbert_weight, "distilbert_negative"),
        ],
        [(F.col("toxicity_is_toxic"), r.toxicity_weight, "toxicity")],
    ]


def _first_hit(branch: list[tuple], value: Callable[[int, str | None], Column], default: Column) -> Column:
    expr = None
    for condition, weight, reason in branch:
        result = value(weight, reason)
        expr = F.when(condition, result) if expr is None else expr.when(condition, result)
    return expr.otherwise(default)


def escalation_score(rule: EscalationRule = DEFAULT_RULE) -> Column:
    """Sum of the weights whose condition holds; a missing signal adds nothing."""
    terms = [_first_hit(b, lambda weight, _: F.lit(weight), F.lit(0)) for b in _branches(rule)]
    return sum(terms[1:], terms[0])


def escalation_level(score: Column | str, rule: EscalationRule = DEFAULT_RULE) -> Column:
    col = F.col(score) if isinstance(score, str) else score
    none, light, strong = V.LEVELS
    return F.when(col >= rule.strong_from, strong).when(col >= rule.light_from, light).otherwise(none)


def escalation_reasons(rule: EscalationRule = DEFAULT_RULE) -> Column:
    """Names of the conditions that hold, in rule order."""
    nothing = F.lit(None).cast("string")
    named = [_first_hit(b, lambda _, reason: F.lit(reason), nothing) for b in _branches(rule)]
    return F.array_compact(F.array(*named))


def is_toxic(
    label: Column | str = "toxicity_label",
    score: Column | str = "toxicity_score",
    above: float = 0.8,
    toxic_label: str = V.TOXIC,
) -> Column:
    """Toxic label with a score above the cut-off; a missing value is not toxic."""
    label_col = F.col(label) if isinstance(label, str) else label
    score_col = F.col(score) if isinstance(score, str) else score
    return F.coalesce((label_col == toxic_label) & (score_col > above), F.lit(False))


def has_phrase(text: Column | str = "message", phrases: list[str] | None = None) -> Column:
    """Whether the lower-cased text holds any of the phrases as whole words; with no
    phrases nothing does."""
    listed = [p for p in (V.ESCALATION_PHRASES if phrases is None else phrases) if p]
    if not listed:
        return F.lit(False)
    choice = "|".join(re.escape(p) for p in listed)
    # spelled-out word class: \w and \b of the JVM know ASCII letters only
    word = r"[\p{L}\p{N}_]"
    return F.lower(text).rlike(f"(?<!{word})(?:{choice})(?!{word})")


def phrase_or_toxic(
    text: Column | str = "message",
    label: Column | str = "toxicity_label",
    score: Column | str = "toxicity_score",
    above: float = 0.9,
    phrases: list[str] | None = None,
) -> Column:
    return has_phrase(text, phrases) | is_toxic(label, score, above)

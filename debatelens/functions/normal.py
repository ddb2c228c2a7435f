"""Column expressions for names, labels, lengths and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import values as V


def stripped(c: Column | str) -> Column:
    """Text without any blanks, tabs or line breaks at its ends."""
    return F.btrim(c, F.lit(V.BLANKS))


def title_name(c: Column | str) -> Column:
    """Trimmed, title-cased topic name."""
    return F.initcap(stripped(c))


def lower_name(c: Column | str) -> Column:
    return F.lower(stripped(c))


def is_blank(c: Column | str = "message") -> Column:
    """Whether a text has nothing but blanks; null for null."""
    return stripped(c) == ""


def is_procon(mode: Column | str = "host_mode") -> Column:
    """Pro/con mode; null for a null mode, so both the filter and its negation drop it."""
    return lower_name(mode).startswith(V.PROCON_PREFIX)


def message_length(c: Column | str = "message") -> Column:
    return F.char_length(c)


def model_input(c: Column | str = "message") -> Column:
    return F.substring(c, 1, V.MODEL_INPUT_CHARS)


def preview(c: Column | str = "message") -> Column:
    return F.substring(c, 1, V.PREVIEW_CHARS)


def signed_score(label: Column | str, score: Column | str) -> Column:
    """Score with the sign of its label; 0 for any other label, null for a null score."""
    name = lower_name(label)
    value = F.col(score) if isinstance(score, str) else score
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(name == V.POSITIVE.lower(), value)
        .when(name == V.NEGATIVE.lower(), -value)
        .otherwise(F.lit(0.0))
    )


def level_ordinal(level: Column | str = "escalation") -> Column:
    """0, 1, 2 for the three levels, null for anything else."""
    col = F.col(level) if isinstance(level, str) else level
    expr = None
    for name, number in V.LEVEL_ORDINALS.items():
        expr = F.when(col == name, number) if expr is None else expr.when(col == name, number)
    return expr


def labels_agree(a: Column | str, b: Column | str) -> Column:
    """Same label in any case; a missing label agrees with nothing."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def event_time(text: Column | str = "timestamp", strict: bool = False) -> Column:
    """Time of an ISO text, without a zone as it was written; null where it cannot be read.

    ``strict`` takes whole seconds only, so texts with a fraction become null.
    """
    col = F.col(text) if isinstance(text, str) else text
    read = col.try_cast("timestamp_ntz")
    if not strict:
        return read
    return F.when(col.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), read)

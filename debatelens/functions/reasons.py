"""Reason lists: text to array and back, and the model family of a reason."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import values as V
from .normal import stripped

_QUOTED = r"""(?:'[^']*'|"[^"]*")"""
_LIST = rf"^\[\s*(?:{_QUOTED}\s*(?:,\s*{_QUOTED}\s*)*,?\s*)?\]$"


def parse_reasons(text: Column | str = "escalation_reason") -> Column:
    """Array of a stored list literal.

    ``None`` and null give null; a text that is not a list gives a list of that text.
    """
    col = F.col(text) if isinstance(text, str) else text
    body = stripped(col)
    items = F.transform(
        F.regexp_extract_all(body, F.lit(_QUOTED), F.lit(0)),
        lambda item: F.substring(item, F.lit(2), F.length(item) - 2),
    )
    return (
        F.when(body == "None", F.lit(None).cast("array<string>"))
        .when(body.rlike(_LIST) | body.rlike(f"^{_QUOTED}$"), items)
        .when(col.isNotNull(), F.array(col))
    )


def reasons_text(reasons: Column | str) -> Column:
    """Stored form of a reason array: a list literal with single quotes."""
    col = F.col(reasons) if isinstance(reasons, str) else reasons
    quoted = F.transform(col, lambda r: F.concat(F.lit("'"), r, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def reason_family(reason: Column | str) -> Column:
    """First family whose name the reason contains, in any case."""
    name = F.lower(reason)
    *named, other = V.REASON_FAMILIES
    expr = None
    for family in named:
        hit = name.contains(family.lower())
        expr = F.when(hit, family) if expr is None else expr.when(hit, family)
    return expr.otherwise(other)

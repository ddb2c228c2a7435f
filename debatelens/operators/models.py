"""Classifier scores through a caller-supplied predictor; no model is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions.normal import model_input

#: Texts → (label, score) pairs, in order.
Predictor = Callable[[list[str]], list[tuple[str, float]]]


def predict_rows(predict: Predictor, texts: list[str | None], fallback: str | None) -> list[tuple]:
    """Predict the texts of a batch together; nulls get ``fallback``/0.0.

    A batch that fails is halved until the bad texts are alone; they get the fallback too.
    """

    def together(part: list[str]) -> list[tuple]:
        if not part:
            return []
        try:
            scored = [(label, float(score)) for label, score in predict(part)]
            if len(scored) == len(part):
                return scored
        except Exception:  # a bad text must not end the job
            pass
        if len(part) == 1:
            return [(fallback, 0.0)]
        half = len(part) // 2
        return together(part[:half]) + together(part[half:])

    scored = iter(together([t for t in texts if t is not None]))
    return [(fallback, 0.0) if t is None else next(scored) for t in texts]


def models_column(
    text: Column | str, loaders: dict[str, Callable[[], Predictor]], fallbacks: dict[str, str | None]
) -> Column:
    """Struct of ``<name>_label`` and ``<name>_score`` of every predictor.

    The (cut) text travels to Python once, in Arrow batches; each predictor is loaded once
    per Python worker run.
    """
    names = list(loaders)
    fields = [f"{n}_{part}" for n in names for part in ("label", "score")]

    @F.pandas_udf(", ".join(f"`{f}` {'string' if f.endswith('_label') else 'double'}" for f in fields))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictors = [loaders[n]() for n in names]
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch]
            columns: dict[str, list] = {}
            for name, predict in zip(names, predictors, strict=True):
                rows = predict_rows(predict, texts, fallbacks[name])
                columns[f"{name}_label"] = [label for label, _ in rows]
                columns[f"{name}_score"] = [value for _, value in rows]
            yield pd.DataFrame(columns, columns=fields)

    return score(model_input(text))


def score_with_models(
    df: DataFrame,
    loaders: dict[str, Callable[[], Predictor]],
    text: str = "message",
    fallbacks: dict[str, str | None] | None = None,
    as_is: set[str] | None = None,
) -> DataFrame:
    """Add ``<prefix>_label`` and ``<prefix>_score`` of each predictor, in one Python pass,
    replacing columns of that name. Labels become upper case unless listed ``as_is``."""
    if not loaders:
        return df
    fallbacks = {n: V.UNKNOWN for n in loaders} | (fallbacks or {})
    scored = df.withColumn("_models", models_column(text, loaders, fallbacks))
    added = {}
    for name in loaders:
        label = F.col(f"_models.{name}_label")
        added[f"{name}_label"] = label if name in (as_is or set()) else F.upper(label)
        added[f"{name}_score"] = F.col(f"_models.{name}_score")
    kept = [c for c in df.columns if c not in added]
    return scored.select(*kept, *[c.alias(n) for n, c in added.items()])


def score_with_model(
    df: DataFrame,
    prefix: str,
    load: Callable[[], Predictor],
    text: str = "message",
    fallback: str | None = V.UNKNOWN,
    upper: bool = True,
) -> DataFrame:
    """One predictor; see ``score_with_models``."""
    return score_with_models(df, {prefix: load}, text, {prefix: fallback}, set() if upper else {prefix})

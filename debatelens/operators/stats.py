"""The rank test between two levels."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..scale import MAX_ROWS_PER_KEY, cumulative_counts
from .distributions import metrics_long


#: Up to this many values on one side, none of them tied, the test counts rank sums.
EXACT_UP_TO = 8
#: Products of the two sizes beyond which the tail is taken from the normal curve after all.
EXACT_CELLS = 1 << 22


@lru_cache(maxsize=256)
def rank_sum_chances(n1: int, n2: int) -> np.ndarray:
    """Chance of each value 0 to n1 * n2 of the statistic when all orders are alike.

    One array: its generating function is a product of n1 factors (1 - q^(n2+i)) / (1 - q^i),
    each of which is a shifted difference and a running sum of step i.
    """
    few, many = sorted((n1, n2))
    ways = np.zeros(few * many + 1)
    ways[0] = 1.0
    for i in range(1, few + 1):
        shift = many + i
        if shift < len(ways):
            ways[shift:] -= ways[:-shift].copy()
        for first in range(i):
            ways[first::i] = np.cumsum(ways[first::i])
        # of these many orders this factor knows; keeps the numbers small
        ways *= i / (many + i)
    return ways


def _exact_p(n1: int, n2: int, u: float) -> float:
    larger = max(u, n1 * n2 - u)
    return min(1.0, 2.0 * float(rank_sum_chances(n1, n2)[round(larger) :].sum()))


@F.pandas_udf(T.DoubleType())
def _two_sided_p(z: pd.Series, n1: pd.Series, n2: pd.Series, u: pd.Series, exact: pd.Series) -> pd.Series:
    def one(z: float, n1: int, n2: int, u: float, exact: bool) -> float | None:
        if exact:
            return _exact_p(int(n1), int(n2), u)
        return None if z is None or z != z else min(1.0, math.erfc(z / math.sqrt(2.0)))

    return pd.Series([one(*row) for row in zip(z, n1, n2, u, exact, strict=True)], dtype="float64")


def mann_whitney(
    df: DataFrame,
    metrics: list[str],
    level: str = "escalation",
    first: str = "none",
    second: str = "strong",
    max_rows: int = MAX_ROWS_PER_KEY,
    by: list[str] | None = None,
) -> DataFrame:
    """Two-sided rank test of each metric between two levels, per group of ``by`` if given.

    Equal values share their average rank, so ranks follow from counts per distinct value.
    With at most ``EXACT_UP_TO`` values on one side and no ties, p comes from the exact
    distribution of the rank sum, else from the normal curve, corrected for ties. A metric
    without values on one side has no statistic; with all values equal it has no p.
    """
    by = by or []
    compared = metrics_long(df.where(F.col(level).isin(first, second)), metrics, [*by, level])
    counted, _ = cumulative_counts(
        compared,
        [*by, "metric"],
        "value",
        {"a": F.count_if(F.col(level) == first), "b": F.count_if(F.col(level) == second)},
        max_rows,
    )
    both = (F.col("a") + F.col("b")).cast("double")
    rank = F.col("a_before") + F.col("b_before") + (both + 1) / 2
    sums = counted.groupBy(*by, "metric").agg(
        F.sum("a").alias("n1"),
        F.sum("b").alias("n2"),
        F.sum(F.col("a") * rank).alias("r1"),
        F.sum(both * both * both - both).alias("ties"),
    )
    found = metrics_grid(df, metrics).join(sums, "metric", "left") if not by else sums
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    pairs = n1.cast("double") * n2
    n = (n1 + n2).cast("double")
    u1 = F.col("r1") - n1.cast("double") * (n1 + 1) / 2
    larger = F.greatest(u1, pairs - u1)
    spread = F.sqrt(pairs / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    enough = (n1 > 0) & (n2 > 0)
    exact = enough & (F.col("ties") == 0) & (F.least(n1, n2) <= EXACT_UP_TO) & (pairs <= EXACT_CELLS)
    table = found.select(
        *by,
        "metric",
        n1.alias("n1"),
        n2.alias("n2"),
        F.when(enough, u1).alias("u"),
        F.when(enough, (larger - pairs / 2 - 0.5) / F.nullif(spread, F.lit(0.0))).alias("z"),
        F.when(enough, F.lit("tested")).otherwise("not enough data").alias("note"),
        F.coalesce(exact, F.lit(False)).alias("_exact"),
    )
    # a row per metric and group
    return table.withColumn("p", _two_sided_p("z", "n1", "n2", "u", "_exact")).drop("_exact")


def metrics_grid(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")

"""Counts, rates and shares of a label over report rows.

Every table is one aggregation with a fixed set of counters, so a hot topic or
mode is combined on the map side. Rows that must appear even when empty are added
as zero-weight rows before the aggregation, which needs no join.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import values as V


def grid(df: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """All combinations of the axis values, as a table of that many rows."""
    schema = ", ".join(f"{name} string" for name in axes)
    return df.sparkSession.createDataFrame(list(product(*axes.values())), schema)


def _with_empty_rows(df: DataFrame, columns: list[str], axes: dict[str, list[str]]) -> DataFrame:
    listed = df.select(*columns, F.lit(1).alias("_weight"))
    for axis, values in axes.items():
        listed = listed.where(F.col(axis).isin(values))
    extra = [c for c in columns if c not in axes]
    empty = grid(df, axes).select(
        *axes, *[F.lit(None).cast("string").alias(c) for c in extra], F.lit(0).alias("_weight")
    )
    return listed.unionByName(empty)


def counts(
    df: DataFrame,
    rows: list[str],
    label: str = "escalation",
    values: list[str] = V.LEVELS,
    axes: dict[str, list[str]] | None = None,
    total: str = "messages",
) -> DataFrame:
    """One row per group: all its messages, and those with each label value.

    ``axes`` lists the values of row columns that must all appear, and no others.
    """
    if axes:
        source, weight = _with_empty_rows(df, [*rows, label], axes), F.sum("_weight")
    else:
        source, weight = df, F.count(F.lit(1))
    return source.groupBy(*rows).agg(
        weight.alias(total), *[F.count_if(F.col(label) == v).alias(v) for v in values]
    )


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole × scale, null for an empty whole."""
    return part / F.nullif(whole, F.lit(0)) * scale


def rate1000(
    df: DataFrame,
    rows: list[str],
    axes: dict[str, list[str]] | None = None,
    values: list[str] = V.LEVELS,
) -> DataFrame:
    """Messages of each level per 1000 messages of the row; 0 for an empty row."""
    table = counts(df, rows, values=values, axes=axes)
    rate = [
        F.coalesce(ratio(F.col(v), F.col("messages"), 1000.0), F.lit(0.0)).alias(v) for v in values
    ]
    return table.select(*rows, *rate)


def shares(
    df: DataFrame,
    rows: list[str],
    label: str = "escalation",
    values: list[str] = V.LEVELS,
    scale: float = 1.0,
    axes: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Share of each listed value among the row's messages that have one of them."""
    known = df.where(F.col(label).isNotNull())
    table = counts(known, rows, label, values, axes)
    whole = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return table.select(*rows, *[ratio(F.col(v), whole, scale).alias(v) for v in values])


def long_shares(df: DataFrame, rows: list[str], label: str, scale: float = 1.0) -> DataFrame:
    """Share of every label value found in a row's messages, one line per value."""
    table = df.where(F.col(label).isNotNull()).groupBy(*rows, label).agg(F.count(F.lit(1)).alias("n"))
    return table.select(
        *rows, label, ratio(F.col("n"), F.sum("n").over(W.partitionBy(*rows)), scale).alias("share")
    )


def to_long(table: DataFrame, rows: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide table to one line per row and value column."""
    return table.unpivot(rows, values, name, value)

"""Bands around a mean by a Poisson bootstrap.

In a replicate every row counts as often as a Poisson draw of mean one says. The draws come
from the seeded hash of the row's id, so they are the same wherever the row lies, and all
replicates are added up in one aggregation.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, functions as F

#: Draws that one digest gives, eight hex digits each.
_DRAWS = 4
#: Chances of at most 0, 1, 2 ... copies; the last is one to the precision of a draw.
_STEPS = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(13)]


def poisson_weights(id_col: str, replicates: int, seed: str) -> Column:
    """(replicate, w) with a weight above zero, as an array."""

    def drawn(block: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"), F.lit("|"), block.cast("string")))
        shares = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / float(1 << 32) for i in range(_DRAWS)]
        return F.array(*[F.struct((block * _DRAWS + i).alias("replicate"), u.alias("u")) for i, u in enumerate(shares)])

    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // _DRAWS))
    draws = F.filter(F.flatten(F.transform(blocks, drawn)), lambda d: (d["replicate"] < replicates) & (d["u"] >= _STEPS[0]))

    def copies(u: Column) -> Column:
        return sum((F.when(u >= step, 1).otherwise(0) for step in _STEPS[1:]), F.lit(1))

    return F.transform(draws, lambda d: F.struct(d["replicate"].alias("replicate"), copies(d["u"]).alias("w")))


def bootstrap_band(
    df: DataFrame,
    by: list[str],
    value: str,
    id_col: str = "id",
    replicates: int = 200,
    width: float = 0.95,
    seed: str = "band",
) -> DataFrame:
    """Per group: the rows with a value (``n``), their mean, and the ends of the band that
    holds the middle ``width`` of the replicates' means, with linear interpolation.

    A replicate in which a group has no row gives it no mean. Rows with a null id are drawn
    alike; groups without a value are left out. The plain mean is replicate -1 of the same
    aggregation.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_y"), id_col)
    plain = F.array(F.struct(F.lit(-1).alias("replicate"), F.lit(1).alias("w")))
    keyed = known.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    every = keyed.select(*by, "_y", F.explode(F.concat(plain, poisson_weights(id_col, replicates, seed))).alias("d"))
    sums = every.groupBy(*by, "d.replicate").agg(F.sum("d.w").alias("w"), F.sum(F.col("d.w") * F.col("_y")).alias("y"))
    means = sums.withColumn("mean", F.col("y") / F.col("w"))
    drawn, given = F.col("replicate") >= 0, F.col("replicate") == -1
    tail = (1 - width) / 2
    # no more than one value per replicate and group
    ends = F.percentile(F.when(drawn, F.col("mean")), F.array(F.lit(tail), F.lit(1 - tail)))
    banded = means.groupBy(*by).agg(
        F.max(F.when(given, F.col("w"))).alias("n"), F.max(F.when(given, F.col("mean"))).alias("mean"), ends.alias("_ends")
    )
    return banded.select(*by, "n", "mean", F.get("_ends", F.lit(0)).alias("ci_low"), F.get("_ends", F.lit(1)).alias("ci_high"))

"""Distribution summaries: box plots, histograms, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..scale import MAX_ROWS_PER_KEY, checkpoint_root, fits, ranked_chunks

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def metrics_long(df: DataFrame, metrics: list[str], keep: list[str] | None = None) -> DataFrame:
    """One line per row and metric, nulls left out."""
    keep = keep or []
    typed = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(keep, metrics, "metric", "value").where(F.col("value").isNotNull())


def _quartiles(total: Column, number: Column) -> dict[str, Column]:
    """Values at the lower and upper rank of each quartile, as aggregates over ranked rows."""
    found = {}
    for name, q in QUARTILES.items():
        place = (total - 1) * F.lit(q)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            found[f"{name}_{end}"] = F.max(F.when(inside, number))
    return found


def _between(name: str) -> Column:
    low, high, place = F.col(f"{name}_lo"), F.col(f"{name}_hi"), (F.col("count") - 1) * F.lit(QUARTILES[name])
    return (low + (high - low) * (place - F.floor(place))).alias(name)


def box_summary(
    df: DataFrame, by: list[str], value: str, max_rows: int = MAX_ROWS_PER_KEY
) -> DataFrame:
    """Exact quartiles, whiskers at 1.5 IQR and outlier count of each group.

    Works on distinct values with counts: a quartile is found by its rank. Few distinct
    values take one window per group; many are cut into range chunks, and no group is ever
    put into one place.
    """
    known = df.where(F.col(value).isNotNull())
    for key in by:
        known = known.where(F.col(key).isNotNull())
    checkpoint_root(df.sparkSession)
    # counted and then read again
    distinct = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    if fits(distinct, max_rows):
        group = W.partitionBy(*by)
        below = F.sum("n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        ranked = distinct.withColumn("n_before", F.coalesce(below, F.lit(0)))
        ranked = ranked.withColumn("count", F.sum("n").over(group))
        number = F.col(value).cast("double")
        ends = _quartiles(F.col("count"), number)
        sized = ranked.select("*", *[e.over(group).alias(n) for n, e in ends.items()])
    else:
        sized = _ranked_in_chunks(distinct, by, value)
    placed = sized.select(
        *by, F.col(value).cast("double").alias("_value"), "n", "count", *[_between(name) for name in QUARTILES]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_value") >= F.col("q1") - reach) & (F.col("_value") <= F.col("q3") + reach)
    return placed.groupBy(*by, "count", *QUARTILES).agg(
        F.min(F.when(inside, F.col("_value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def _ranked_in_chunks(distinct: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with the count of their group and the values at its quartile ranks.

    A group that lies in one chunk is finished there. Only the first and the last group of a
    chunk can reach over its edge; for those the chunks' totals (two per chunk at most) give
    the rank at which each chunk begins, and so the one chunk that holds a quartile. That is
    the only one whose values are looked at for it.
    """
    spark = distinct.sparkSession
    chunked = ranked_chunks(distinct, [*by, value], distinct.count())
    key = F.struct(*by)
    edges = chunked.groupBy("_chunk").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    over: dict[tuple, list[int]] = {}
    for chunk, first, last in sorted(edges.collect()):
        for group in {tuple(first), tuple(last)}:
            over.setdefault(group, []).append(chunk)
    wide = [(*group, chunk) for group, chunks in over.items() if len(chunks) > 1 for chunk in chunks]
    names = T.StructType([*[f for f in distinct.schema if f.name in by], T.StructField("_chunk", T.IntegerType())])
    names = T.StructType([names[b] for b in [*by, "_chunk"]])
    # two rows per chunk at most
    listed = F.broadcast(spark.createDataFrame(wide, names))
    totals: dict[tuple, dict[int, int]] = {}
    for row in chunked.join(listed, [*by, "_chunk"]).groupBy(*by, "_chunk").agg(F.sum("n")).collect():
        totals.setdefault(tuple(row)[:-2], {})[row["_chunk"]] = row[-1]
    offsets = []
    for group, sizes in totals.items():
        before = 0
        for chunk in sorted(sizes):
            offsets.append((*group, chunk, before, sum(sizes.values())))
            before += sizes[chunk]
    fields = [*names, T.StructField("_offset", T.LongType()), T.StructField("_whole", T.LongType())]
    starts = F.broadcast(spark.createDataFrame(offsets, T.StructType(fields)))

    here = W.partitionBy("_chunk", *by)
    below = F.sum("n").over(here.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    local = chunked.withColumns({"_below": F.coalesce(below, F.lit(0)), "_here": F.sum("n").over(here)})
    ranked = local.join(starts, [*by, "_chunk"], "left").withColumns(
        {
            "n_before": F.col("_below") + F.coalesce("_offset", F.lit(0)),
            "count": F.coalesce("_whole", "_here"),
        }
    )
    ends = _quartiles(F.col("count"), F.col(value).cast("double"))
    sized = ranked.select("*", *[e.over(here).alias(n) for n, e in ends.items()])
    # of a wide group each chunk knows the quartiles that lie in it; a few rows bring them together
    reached = ranked.where(F.col("_whole").isNotNull()).groupBy(*by, "_chunk", "count").agg(
        *[e.alias(n) for n, e in ends.items()]
    )
    known: dict[tuple, list] = {}
    for row in reached.collect():
        values = known.setdefault(tuple(row[b] for b in by), [None] * len(ends))
        for i, name in enumerate(ends):
            values[i] = row[name] if row[name] is not None else values[i]
    fields = [*names.fields[:-1], *[T.StructField(f"_{n}", T.DoubleType()) for n in ends]]
    wide_ends = F.broadcast(spark.createDataFrame([(*g, *v) for g, v in known.items()], T.StructType(fields)))
    joined = sized.join(wide_ends, by, "left")
    return joined.select(*by, value, "n", "count", *[F.coalesce(f"_{n}", n).alias(n) for n in ends])


def _ranges(values: DataFrame) -> DataFrame:
    return values.groupBy("metric").agg(
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count("value").alias("total"),
        F.stddev_samp("value").alias("sd"),
    )


def histogram(df: DataFrame, metrics: list[str], bins: int = 30) -> DataFrame:
    """Counts in equal bins between minimum and maximum, the last bin closed."""
    values = metrics_long(df, metrics)
    flat = F.col("lo") == F.col("hi")
    ranges = _ranges(values).select(
        "metric",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    place = F.floor(bins * (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    # ranges has one row per metric name
    filled = values.join(F.broadcast(ranges), "metric").select(
        "metric", "lo", "hi", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), F.lit(1).alias("w")
    )
    empty = ranges.select(
        "metric", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).alias("w")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        filled.unionByName(empty)
        .groupBy("metric", "lo", "hi", "bin")
        .agg(F.sum("w").alias("n"))
        .select(
            "metric",
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_low"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
            "n",
        )
    )


#: Grid points that one aggregation adds up; more of them take longer to compile than to compute.
_POINTS_AT_ONCE = 20


def density(df: DataFrame, metrics: list[str], points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth n^(-1/5) · sd.

    Equal values are counted first. The grid is cut into blocks of points; a distinct value
    goes to each block once, and each task hands on one row per metric and block.
    """
    values = metrics_long(df, metrics)
    ranges = _ranges(values).select(
        "metric",
        "total",
        (F.pow(F.col("total"), F.lit(-0.2)) * F.col("sd")).alias("bw"),
        "lo",
        "hi",
    ).where(F.col("bw") > 0)
    start, end = F.col("lo") - cut * F.col("bw"), F.col("hi") + cut * F.col("bw")
    step = (end - start) / (points - 1)
    distinct = values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    size = min(points, _POINTS_AT_ONCE)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((points - 1) // size)))
    # ranges has one row per metric name
    placed = distinct.join(F.broadcast(ranges), "metric").select(
        "metric", "total", "bw", "n", "value", start.alias("start"), step.alias("step"), blocks.alias("block")
    )
    place = F.col("block") * size

    def mass(point: int) -> Column:
        z = (F.col("start") + (place + point) * F.col("step") - F.col("value")) / F.col("bw")
        return F.sum(F.col("n") * F.exp(-z * z / 2))

    keys = ["metric", "total", "bw", "start", "step", "block"]
    summed = placed.groupBy(*keys).agg(*[mass(i).alias(f"_{i}") for i in range(size)])
    masses = F.array(*[f"_{i}" for i in range(size)])
    scale = F.col("total") * F.col("bw") * F.sqrt(2 * F.pi())
    spread = summed.select(*keys, F.posexplode(masses).alias("within", "mass"))
    spread = spread.withColumn("point", (place + F.col("within")).cast("int")).where(F.col("point") < points)
    return spread.select(
        "metric", "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"), (F.col("mass") / scale).alias("density")
    )

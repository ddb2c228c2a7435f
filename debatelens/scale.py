"""Helpers that keep plans safe when one key holds a large part of the rows.

Three tools, used all over the library:

* ``join_lookup`` broadcasts a lookup side only after counting it, and leaves it
  to a shuffled join (with AQE skew handling) beyond the limit;
* ``ranked_chunks`` cuts a total order into materialised chunks of similar size,
  however the keys are spread, so no window ever has to hold one whole key;
* ``positions`` numbers the rows of each key, with a plain window for keys of
  normal size and with chunks for the hot ones.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Largest lookup side (in bytes of its values) that may be broadcast.
MAX_BROADCAST_BYTES = 64 << 20
#: A key with more rows than this is never put into one window frame.
MAX_ROWS_PER_KEY = 2_000_000
#: Rows that the sample behind the hot-key list holds of a key at the limit.
SAMPLED_ROWS_PER_KEY = 2_000
#: Rows aimed at for one chunk of a hot key.
ROWS_PER_CHUNK = 2_000_000
#: Hot keys that are filtered by a list in the plan; more of them are joined as a table.
MAX_LISTED_KEYS = 10_000


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables, as the session names it.

    Only a local session without one (a test) gets a temporary folder; on a cluster its
    files would lie on one machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="debatelens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table written by one run.

    All of a session's paths lie in one folder, which is removed when the session ends.
    """
    context = spark.sparkContext
    folder = f"{checkpoint_root(spark).rstrip('/')}/scratch-{context.applicationId}"
    if folder not in _scratch:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _scratch.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_scratch: set[str] = set()


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def fits_bytes(df: DataFrame, max_bytes: int) -> bool:
    """True when the values of ``df`` take at most ``max_bytes``; measured in one pass.

    Texts count with their bytes, any other value with 16.
    """
    of = [
        F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(16)
        for f in df.schema
    ]
    size = df.agg(F.sum(sum(of[1:], of[0]).cast("long") + 16)).first()[0]
    return (size or 0) <= max_bytes


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: str | list[str] | Column,
    how: str = "inner",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join a lookup table, broadcast only when its measured size allows it."""
    side = F.broadcast(lookup) if fits_bytes(lookup, max_bytes) else lookup
    return df.join(side, on, how)


def ranked_chunks(df: DataFrame, order: Sequence[str | Column], rows: int) -> DataFrame:
    """Cut ``df`` along a total order into chunks: adds ``_chunk``, rising with the order.

    Range partitioning splits hot keys because the order reaches beyond the key.
    Chunk numbers come from partition numbers, so they are checkpointed: a lost
    executor must not draw other range bounds on a second run.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    return (
        df.repartitionByRange(max(least, rows // ROWS_PER_CHUNK + 1), *order)
        .withColumn("_chunk", F.spark_partition_id())
        .checkpoint()
    )


def chunk_offsets(
    chunked: DataFrame, keys: Sequence[str], measures: dict[str, Column]
) -> DataFrame:
    """Per key and chunk, the total of each measure over all earlier chunks of the key."""
    totals = chunked.groupBy(*keys, "_chunk").agg(
        *[expr.alias(name) for name, expr in measures.items()]
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in measures],
    )


def hot_keys(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """(key, n) of the keys with more than about ``max_rows`` rows.

    Found in a sample, which a key of that size cannot escape; it only decides how
    the rows of a key are ordered, never which rows there are. With a small limit all
    rows are counted.
    """
    rate = min(1.0, SAMPLED_ROWS_PER_KEY / max_rows)
    seen = df.select(key) if rate == 1 else df.select(key).sample(rate, seed=1)
    least = max_rows if rate == 1 else max_rows * rate / 2
    counted = seen.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return counted.select(key, F.round(F.col("n") / rate).cast("long").alias("n"))


def split_hot(
    df: DataFrame, key: str, max_rows: int | None = None, listed: int = MAX_LISTED_KEYS
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of normal keys, rows of hot keys (None when there are none), hot row count.

    A few hot keys become a filter, more of them a table that is joined; the rows are
    the same either way.
    """
    checkpoint_root(df.sparkSession)
    hot = hot_keys(df, key, MAX_ROWS_PER_KEY if max_rows is None else max_rows)
    found = hot.take(listed + 1)
    if not found:
        return df, None, 0
    if len(found) > listed:
        hot = hot.checkpoint()
        same = F.col(f"d.{key}").eqNullSafe(F.col(f"h.{key}"))
        rows, keys = df.alias("d"), hot.alias("h")
        total = hot.agg(F.sum("n")).first()[0]
        return rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi"), total
    values = [k for k, _ in found if k is not None]
    is_hot = F.coalesce(F.col(key).isin(values), F.lit(False)) if values else F.lit(False)
    if len(values) < len(found):
        is_hot = is_hot | F.col(key).isNull()
    return df.where(~is_hot), df.where(is_hot), sum(n for _, n in found)


def positions(
    df: DataFrame,
    key: str,
    order: Sequence[str | Column],
    out: str,
    max_rows: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 0 along ``order`` (which must be total)."""
    normal, hot, hot_rows = split_hot(df, key, max_rows)
    numbered = normal.withColumn(
        out, F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long") - 1
    )
    if hot is None:
        return numbered
    chunked = ranked_chunks(hot, [F.col(key), *order], hot_rows)
    offsets = chunk_offsets(chunked, [key], {"_before": F.count(F.lit(1))})
    local = F.row_number().over(W.partitionBy("_chunk", key).orderBy(*order)).cast("long") - 1
    spread = (
        chunked.withColumn("_local", local)
        .alias("r")
        # one row per hot key and chunk: bounded by the hot-key limit times the chunks
        .join(
            F.broadcast(offsets).alias("o"),
            (F.col("r._chunk") == F.col("o._chunk"))
            & F.col(f"r.{key}").eqNullSafe(F.col(f"o.{key}")),
        )
        .select("r.*", (F.col("r._local") + F.col("o._before")).alias(out))
        .drop("_chunk", "_local")
    )
    return numbered.unionByName(spread)


def earlier_values(
    df: DataFrame,
    key: str,
    order: Sequence[str | Column],
    value: Column,
    size: int,
    out: str,
    max_rows: int | None = None,
) -> DataFrame:
    """Add the values of up to ``size`` earlier rows of the key, oldest first.

    A hot key is cut into runs of consecutive positions; the last ``size`` rows of
    a run also go to the next run, as context only, so a run needs nothing else.
    """
    frame = (-size, -1)
    normal, hot, _ = split_hot(df, key, max_rows)
    plain = W.partitionBy(key).orderBy(*order).rowsBetween(*frame)
    done = normal.withColumn(out, F.collect_list(value).over(plain))
    if hot is None:
        return done
    run_length = max(MAX_ROWS_PER_KEY if max_rows is None else max_rows, size)
    run = F.floor(F.col("_at") / run_length)
    tail = F.col("_at") % run_length >= run_length - size
    spread = (
        positions(hot, key, order, "_at", max_rows)
        .withColumn("_home", run)
        .withColumn("_run", F.explode(F.when(tail, F.array(run, run + 1)).otherwise(F.array(run))))
    )
    by_run = W.partitionBy(key, "_run").orderBy("_at").rowsBetween(*frame)
    context = (
        spread.withColumn(out, F.collect_list(value).over(by_run))
        .where(F.col("_run") == F.col("_home"))
        .drop("_at", "_home", "_run")
    )
    return done.unionByName(context)


def cumulative_counts(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measures: dict[str, Column],
    max_rows: int = MAX_ROWS_PER_KEY,
) -> tuple[DataFrame, bool]:
    """Per group and distinct value: each measure, and its total over smaller values.

    Rows collapse to distinct values first, which are checkpointed because they are
    counted and then read again. If they are few, one window per group is enough
    (the flag returned is true); otherwise they are cut into range chunks whose
    totals are carried forward.
    """
    checkpoint_root(df.sparkSession)
    distinct = df.groupBy(*by, value).agg(*[e.alias(m) for m, e in measures.items()]).checkpoint()
    before = {m: f"{m}_before" for m in measures}
    if fits(distinct, max_rows):
        below = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(m).over(below), F.lit(0)).alias(b) for m, b in before.items()]
        return distinct.select("*", *sums), True
    chunked = ranked_chunks(distinct, [*by, value], distinct.count())
    offsets = chunk_offsets(chunked, by, {b: F.sum(m) for m, b in before.items()})
    below = W.partitionBy("_chunk", *by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = chunked.select(
        "*",
        *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"_{b}") for m, b in before.items()],
    )
    # both sides are partitioned by group and chunk, whatever the number of groups
    spread = local.join(offsets, [*by, "_chunk"]).select(
        *by,
        value,
        *measures,
        *[(F.col(f"_{b}") + F.col(b)).alias(b) for b in before.values()],
    )
    return spread, False

"""Changes to a stored message table: rows with new ids, and partitions scored in place.

The table is Parquet, laid out by ``host_mode``. One writer changes it at a time. Both
changes prepare everything beside the table first and may be run again after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import values as V
from ..operators.enrich import Scorer, backfill_unscored, unscored
from ..scale import scratch_path
from .messages import MESSAGE_SCHEMA, append_messages, read_messages

#: Folder of prepared partitions; readers pass over names that begin with an underscore.
_PREPARED = "_backfill"
#: Bits of ``monotonically_increasing_id`` below the number of the partition.
_PLACE_BITS = 33


def _store(spark: SparkSession, path: str):
    """File system and path object of a folder, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _store(spark, path)
    return files.exists(place)


def numbered(msgs: DataFrame, first: int, order: list[str | Column] | None = None) -> DataFrame:
    """``msgs`` with ids from ``first`` on, without gaps, in ``order`` if one is given.

    The rows are written with the number of their partition and their place in it, which
    fixes both; an id then is the place behind the rows of all earlier partitions. Only one
    count per partition is put in order, and no row depends on how a task ran.
    """
    spark = msgs.sparkSession
    rows = msgs.drop("id")
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch_path(spark, "numbered")
    rows.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    part = F.shiftright("_place", _PLACE_BITS)
    fixed = spark.read.parquet(path).withColumn("_part", part)
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per written partition
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_place") - F.shiftleft("_part", _PLACE_BITS)
    return fixed.join(starts, "_part").select(
        (F.lit(first) + F.col("_before") + place).cast("long").alias("id"), *rows.columns
    )


def append_numbered(msgs: DataFrame, path: str, order: list[str | Column] | None = None) -> None:
    """Append messages with ids that go on from the largest stored one, the first being 1.

    An ``id`` column of ``msgs`` is ignored. Missing columns are stored as nulls.
    """
    spark = msgs.sparkSession
    last = read_messages(spark, path).agg(F.max("id")).first()[0] if exists(spark, path) else None
    append_messages(numbered(msgs, (last or 0) + 1, order), path)


def _swap(spark: SparkSession, path: str) -> None:
    """Put every prepared partition in the place of the old one; goes on where a run ended.

    The old partition is moved aside before the new one moves in, so at any time one of both
    is there as a whole.
    """
    prepared = f"{path}/{_PREPARED}"
    files, place = _store(spark, prepared)
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        target, aside = (_store(spark, p)[1] for p in (f"{path}/{name}", f"{prepared}/_replaced/{name}"))
        if files.exists(target):
            files.mkdirs(aside.getParent())
            if not files.rename(target, aside):
                raise OSError(f"could not move {target} aside")
        if not files.rename(status.getPath(), target):
            raise OSError(f"could not move {name} into the table")
    files.delete(place, True)


def backfill_table(spark: SparkSession, path: str, scorer: Scorer, include_host: bool = True) -> list[str | None]:
    """Score the unscored messages of a stored table, in place; returns the host modes rewritten.

    Only partitions with unscored rows are read for their texts and written anew; files of
    the others stay as they are. They are prepared as a whole, then swapped one by one. A run
    that ended before all were prepared leaves the table as it was; one that ended during the
    swap is finished by the next run. A run without unscored rows changes nothing. With
    ``include_host`` off, host rows stay unscored and do not make a partition a candidate.
    """
    prepared = f"{path}/{_PREPARED}"
    files, place = _store(spark, prepared)
    if exists(spark, f"{prepared}/_SUCCESS"):
        _swap(spark, path)
    files.delete(place, True)

    stored = read_messages(spark, path)
    todo = F.coalesce(unscored(stored), F.lit(False))
    if not include_host:
        todo = todo & ~F.col("speaker").eqNullSafe(F.lit(V.HOST))
    # one row per partition of the table
    modes = [r[0] for r in stored.where(todo).select("host_mode").distinct().collect()]
    if not modes:
        return []
    named = [m for m in modes if m is not None]
    chosen = F.col("host_mode").isin(named) if named else F.lit(False)
    if None in modes:
        chosen = chosen | F.col("host_mode").isNull()
    rows = stored.where(chosen).select([f.name for f in MESSAGE_SCHEMA])
    backfill_unscored(rows, scorer, include_host).write.partitionBy("host_mode").parquet(prepared)
    _swap(spark, path)
    return sorted(modes, key=lambda m: (m is None, m))

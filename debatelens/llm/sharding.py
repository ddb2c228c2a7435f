"""Sharding by vector bin packing: bytes, tokens and rows are balanced together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from debatelens.llm.common import own_names, stored, words_of

SHARDS = 8
#: Small groups are gathered by hash into this many lots; a group larger than one lot's
#: share stands alone, so at most 4 * LOTS + SHARDS * PARTS things are placed.
LOTS = 4096
#: A shard may exceed its share of the bytes by this part.
SLACK = 0.0005
#: A group larger than a shard is cut into this many parts per shard's share.
PARTS = 64
#: Slots are numbered in this many chunks per shard.
CHUNKS = 1024

MEASURES = ["bytes", "tokens", "rows"]


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, text_hash): what placing needs of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.size(words_of(F.col(text_col))).cast("long").alias("tokens"),
        F.xxhash64(text).alias("text_hash"),
    )


def place(vectors: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """The shard of each row of ``vectors`` (bytes, tokens, rows).

    Largest first, each goes where the dot product of its share with the shards' residual
    capacity is highest, among the shards whose bytes hold it; if none does, where most
    bytes are left.
    """
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, vectors.shape[1]))
    left[:, 0] += slack
    shard_of = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -share.sum(axis=1))):
        fits = left[:, 0] >= share[i, 0]
        score = np.where(fits, left @ share[i], -np.inf) if fits.any() else left[:, 0]
        shard_of[i] = at = int(score.argmax())
        left[at] -= share[i]
    return shard_of


def _part(parts: Column) -> Column:
    """Which part of a cut group a document belongs to."""
    return F.pmod(F.xxhash64("doc_id", F.lit("part")), parts).cast("int")


def shard_plan(sizes: DataFrame, shards: int = SHARDS, lots: int = LOTS) -> tuple[DataFrame, DataFrame]:
    """Two tables of bounded size: large groups (text_hash, text_crc32, size, parts), and
    the shard of each thing placed (lot, text_hash, part; a lot has null text_hash).

    Groups are equal texts; none is parted unless it is larger than a whole shard.
    """
    spark = sizes.sparkSession
    same = ["text_hash", "text_crc32", "size"]
    groups = stored(
        sizes.groupBy(*same).agg(
            (F.count("*") * F.col("size")).alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
        ),
        "groups",
    )
    totals = groups.agg(*[F.sum(m).alias(m) for m in MEASURES]).first()
    large = F.lit(False)
    for m in MEASURES:
        large = large | (F.col(m) > F.lit((totals[m] or 0) / lots))
    # at most 3 * lots groups can exceed a lot's share of something
    big = sorted(tuple(r) for r in groups.where(large).select(*same, *MEASURES).collect())
    small = groups.where(~large).groupBy(F.pmod("text_hash", F.lit(lots)).cast("int").alias("lot"))
    # in a fixed order, so that things of one size are always placed alike
    rest = sorted(tuple(r) for r in small.agg(*[F.sum(m) for m in MEASURES]).collect())
    room = max(1, (totals["bytes"] or 0) / shards)
    keys, vectors, listed = [], [], []
    for *key, size, tokens, rows in big:
        parts = max(1, int(-(-PARTS * size // room))) if size > room else 1
        listed.append((*key, parts))
        for part in range(parts):
            keys.append((None, key[0], key[1], key[2], part))
            vectors.append((size / parts, tokens / parts, rows / parts))
    for lot, size, tokens, rows in rest:
        keys.append((lot, None, None, None, 0))
        vectors.append((size, tokens, rows))
    at = place(np.array(vectors, float).reshape(-1, 3), shards)
    schema = "lot int, text_hash long, text_crc32 long, size long, part int, shard int"
    placed = spark.createDataFrame([(*k, int(s)) for k, s in zip(keys, at, strict=True)], schema)
    return spark.createDataFrame(listed, "text_hash long, text_crc32 long, size long, parts int"), placed


def looked_up(rows: DataFrame, large: DataFrame, placed: DataFrame, lots: int = LOTS) -> DataFrame:
    """Adds ``shard`` to rows with doc_id, size and the two hashes, by lookups in the
    plan's two tables, which are bounded by the number of lots and parts."""
    same = ["text_hash", "text_crc32", "size"]
    names = rows.columns
    rows = rows.join(F.broadcast(large), same, "left")
    lot = F.when(F.col("parts").isNull(), F.pmod("text_hash", F.lit(lots)).cast("int"))
    rows = rows.withColumns({"lot": lot, "part": F.when(F.col("parts").isNull(), 0).otherwise(_part(F.col("parts")))})
    alone = placed.where("lot is null").drop("lot").withColumnRenamed("shard", "own_shard")
    rows = rows.join(F.broadcast(alone), [*same, "part"], "left")
    rows = rows.join(F.broadcast(placed.where("lot is not null").select("lot", "shard")), "lot", "left")
    return rows.select(*names, F.coalesce("own_shard", "shard").alias("shard"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, without a gap from 0 in each shard.

    Rows are numbered in chunks, and each chunk starts where the earlier ones of its
    shard end; the starts are one row per shard and chunk.
    """
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(CHUNKS)).cast("int"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "chunk").orderBy("doc_id", "text_hash", "size")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    return rows.join(F.broadcast(starts), ["shard", "chunk"]).withColumn("slot", F.col("start") + F.col("place")).drop("chunk", "place", "start")


def shard_table(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, text_hash, shard, slot), one row per row of ``docs``.

    Documents with equal texts share a shard (unless together they are larger than one,
    then they are cut by id), and the shards' bytes are nearly equal. A null text counts
    as an empty one. Repeated rows and null ids get a slot each, other columns are
    ignored, an empty table gives no rows.
    """
    sizes = stored(document_sizes(docs, id_col, text_col), "sizes")
    return numbered(stored(looked_up(sizes, *shard_plan(sizes, shards)), "placed"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder per shard, without a shuffle of the texts."""
    (shard,) = own_names(docs, ["shard"])
    large, placed = shard_plan(stored(document_sizes(docs, id_col, text_col), "sizes"), shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.crc32(text).alias("text_crc32"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
    )
    rows = looked_up(keyed, large, placed).select("row.*", F.col("shard").alias(shard))
    rows.write.partitionBy(shard).parquet(path)

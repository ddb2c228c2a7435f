"""Near-duplicates by SimHash: pigeonring candidates, then the full Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from debatelens.llm.common import as_bytes, key_runs, own_names, stored
from debatelens.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints of a bucket that are compared in one task; larger buckets go by masks.
BUCKET = 128
#: Bits that a key gives to one segment; with two differing bits the widest has 13.
_WIDTH = 13


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(flat, seed)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(flat[i:j], seed) for i, j in cuts], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"]
            )

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _bounds(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the 2 * max_bits + 1 segments on the ring."""
    n = 2 * max_bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bucket_keys(fp: Column, max_bits: int) -> Column:
    """Keys of the chains that two fingerprints at most ``max_bits`` apart can share.

    With 2t + 1 segments on a ring and t differing bits, some chain of consecutive
    segments has at most l * t / (2t + 1) differences in its first l segments, for
    every l. So its first two segments are equal, and the next two have one difference
    at most: one of them is equal too. A key is a chain's start with three segments.
    """
    segments = _bounds(max_bits)
    n = len(segments)

    def value(i: int) -> Column:
        shift, width = segments[i % n]
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for i in range(n):
        for third in (2, 3):
            key = F.lit(2 * i + third - 2).cast("long")
            for j in (i, i + 1, i + third):
                key = F.shiftleft(key, _WIDTH).bitwiseOR(value(j))
            keys.append(key)
    return F.array(*keys)


def _start(key: int) -> int:
    """Start of the chain that a bucket key names."""
    return (key >> 3 * _WIDTH) // 2


def _near(a: np.ndarray, b: np.ndarray, start: int, max_bits: int) -> np.ndarray:
    """Which pairs keep the chain's budgets and then pass the full check."""
    segments = _bounds(max_bits)
    n = len(segments)
    differing = a[:, None] ^ b[None, :]
    passed = np.ones(differing.shape, bool)
    seen = np.zeros(differing.shape, np.uint8)
    for length in range(1, n):
        shift, width = segments[(start + length - 1) % n]
        mask = np.uint64(((1 << width) - 1) << shift)
        seen += np.bitwise_count(differing & mask)
        passed &= seen <= length * max_bits // n
    rows, cols = passed.nonzero()
    full = np.bitwise_count(differing[rows, cols]) <= max_bits
    passed[rows[~full], cols[~full]] = False
    return passed


def _forest(fps: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bucket's fingerprints."""
    values = fps.view(np.uint64)
    left = np.arange(len(fps))
    edges = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = _near(values[front[:256]], values[left], start, max_bits)
            found = hit.any(axis=0)
            by = front[:256][hit.argmax(axis=0)[found]]
            edges += zip(fps[by].tolist(), fps[left[found]].tolist(), strict=True)
            front, left = np.concatenate((front[256:], left[found])), left[~found]
    return edges


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``max_bits`` bits apart.

    ``fps`` has distinct values in ``fp``. Not every pair is returned: of each bucket
    a spanning forest is, so that groups of copies give no pair explosion. Buckets of
    more than ``bucket`` values are left to an exact way without comparisons: two
    values are at most 2r bits apart if and only if flipping at most r bits in each
    gives a common value, so each of those joins the smallest that shares it.
    """
    if max_bits < 2 or max_bits % 2:
        raise ValueError("max_bits must be 2 or a larger even number")
    keyed = fps.select("fp", F.explode(_bucket_keys(F.col("fp"), max_bits)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = stored(keyed.join(sizes, "key"), "buckets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in key_runs(batches, "key"):
            start = _start(int(group["key"].iloc[0]))
            edges = _forest(group["fp"].to_numpy(), start, max_bits)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    few = keyed.where(F.col("n") <= bucket).select("key", "fp")
    # a count of its own: the rows are few, but each takes long
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = few.repartition(tasks, "key").sortWithinPartitions("key", "fp").mapInPandas(run, "a long, b long")

    flips = [0]
    for r in range(1, max_bits // 2 + 1):
        flips += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    many = keyed.where(F.col("n") > bucket).select("fp").distinct()
    masked = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in signed])).alias("mask"))
    least = masked.groupBy("mask").agg(F.min("fp").alias("b"))
    wide = masked.join(least, "mask").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(wide).distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, kept), one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach, ``kept`` marks one document
    of each component: the smallest id, of repeated ids the smallest text hash, of
    repeated rows every copy (a reader that wants one takes one, see ``keep_one``).
    A null or empty text has fingerprint 0 and is linked like any other. A null id
    is never the smallest unless a component has no other: then ``component_id`` is
    null. An empty table gives no rows; other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    values = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "values")
    # read several times by the first round
    links = stored(fingerprint_links(values.select("fp"), max_bits), "pairs")
    of = connected_components(links)
    group = F.coalesce("component", "fp")
    labelled = values.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", group.alias("component"))
    # the members of a group are combined before each shuffle, then read their group's first
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    by_value = labelled.join(least, "component").select("fp", "least")
    return prints.join(by_value, "fp").select(
        "doc_id",
        "text_hash",
        "fp",
        F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does.

    Columns and texts are unchanged. Of repeated rows one stays.
    """
    key, number, stay_id, stay_hash = own_names(docs, ["text_hash", "row_number", "stay_id", "stay_hash"])
    stay = simhash_groups(docs, id_col, text_col, **options).where("kept")
    stay = stay.select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash)).distinct()
    rows = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(stay_id)) & (F.col(key) == F.col(stay_hash))
    once = F.row_number().over(W.partitionBy(key, id_col).orderBy(key))
    return (
        rows.join(stay, same, "left_semi").withColumn(number, once).where(F.col(number) == 1).drop(key, number)
    )

"""Near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from debatelens.llm.common import stored
from debatelens.llm.components import connected_components

THRESHOLD = 0.98
#: Vectors of one tile, on average; a task holds two tiles.
TILE = 1024
#: Rows of a tile product, and pairs that are recomputed, at once.
BLOCK, PAIRS = 256, 1 << 15


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of at most 127, scale, length of the error, length of the rounded
    vector) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    rounded = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(unit - rounded, axis=1), np.linalg.norm(rounded, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the pairs with cosine of at least ``threshold``.

    For unit vectors x = x' + e and y = y' + f with rounded x', y' the product is
    x'y' + ey' + xf, so it is at most x'y' + |e||y'| + |f|. Only pairs that this allows
    are computed in double precision.
    """
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    whole_a, scale_a, error_a, _ = quantised(a / norm_a[:, None])
    whole_b, scale_b, error_b, length_b = quantised(b / norm_b[:, None])
    # products of int8 and their sums are whole numbers below 2^24 for up to 1040
    # dimensions, which single precision holds exactly; beyond, double precision does
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    right = whole_b.astype(kind).T
    rows, cols = [], []
    for at in range(0, len(a), BLOCK):
        part = slice(at, at + BLOCK)
        product = (whole_a[part].astype(kind) @ right).astype(np.float64) * scale_a[part, None] * scale_b
        product += error_a[part, None] * length_b + error_b
        i, j = (product >= threshold - 1e-9).nonzero()
        rows.append(i + at)
        cols.append(j)
    rows, cols = np.concatenate(rows or [[]]).astype(np.int64), np.concatenate(cols or [[]]).astype(np.int64)
    sure = np.zeros(len(rows), bool)
    for at in range(0, len(rows), PAIRS):
        i, j = rows[at : at + PAIRS], cols[at : at + PAIRS]
        sure[at : at + PAIRS] = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j]) >= threshold
    return rows[sure], cols[sure]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` reaches by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def linked_vectors(
    vectors: DataFrame, id_col: str, label_col: str, vector_col: str, threshold: float, tile: int
) -> DataFrame:
    """(vec_id, n_links, root): per tile pair and vector with links in it, how many, and
    the smallest id that it reaches there."""
    v = F.col("v")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.transform(vector_col, lambda x: x.cast("double")).alias("v"),
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = rows.where(usable).distinct().withColumn("dim", F.size("v"))
    counts = rows.groupBy("label", "dim").agg(F.count("*").alias("n"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    rows = rows.join(counts, ["label", "dim"]).withColumn("tiles", tiles)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), "tiles").cast("int"))
    # a vector meets every tile of its label once
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        ids = group["vec_id"].to_numpy()
        all_v = np.stack(group["v"].to_numpy())
        # a power of two changes no cosine and keeps squares of huge or tiny numbers in range
        all_v = np.ldexp(all_v, -np.frexp(np.abs(all_v).max(axis=1))[1][:, None])
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        a = (group["tile"].to_numpy() == low).nonzero()[0]
        b = (group["tile"].to_numpy() == high).nonzero()[0]
        i, j = tile_links(all_v[a], all_v[b], threshold) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        i, j = a[i], b[j]
        real = (ids[i] < ids[j]) if low == high else (ids[i] != ids[j])
        i, j = i[real], j[real]
        n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        some = n > 0
        roots = _roots(len(ids), i, j)
        return pd.DataFrame({"vec_id": ids[some], "n_links": n[some], "root": ids[roots[some]]})

    pairs = rows.select("label", "dim", "low", "high", "tile", "vec_id", "v")
    return pairs.groupBy("label", "dim", "low", "high").applyInPandas(run, "vec_id long, n_links long, root long")


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors with one label (not null) and one length are compared, all with all, in tiles
    of bounded size; a link is a cosine of at least ``threshold``. Tile pairs return the
    links' number per vector and the smallest id reached, never the pairs. Vectors that
    are null, empty, zero or hold a null or non-finite number link with nothing, nor do
    those without an id (they keep a null component and stay). Repeated rows are one
    vector and get the same result each; rows of one id with unlike vectors are not
    linked with each other. Other columns are ignored, an empty table gives no rows.
    """
    links = stored(linked_vectors(vectors, id_col, label_col, vector_col, threshold, tile), "links")
    counts = links.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    of = connected_components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    rows = rows.join(counts, "vec_id", "left").join(of.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )

"""Connected components of links, with joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from debatelens.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(back)


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest node among ``a`` and what ``a`` is linked to."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").withColumn("m", F.least("a", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest one."""
    near = _with_least(_both_ways(edges)).where("b > a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _with_least(down.where("a > b"))
    moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    own = near.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns ``a`` and ``b``, long).

    The component is its smallest node. Two kinds of star rounds take turns until
    nothing moves; a node's neighbours are combined before each shuffle, and every
    round is written to the shared folder. Links from a node to itself and links
    with a null are dropped. No links give no rows.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = stored(_small_star(clean), "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    # a star per component: every node but the smallest has one edge, to the smallest
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )

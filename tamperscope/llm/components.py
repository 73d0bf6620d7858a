"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.session import materialize


def _signature(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def _pull(edges: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour of their first end. The minimum is a
    partial aggregate and the join can be split, so a hub is no hot task."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; both longs): the root is
    the smallest node that can be reached, the node itself included.

    Null ends and self links are ignored; repeated and reversed links count
    once; an empty table gives an empty result. Each round is written to the
    shared folder, so a lost executor re-reads one round.
    """
    edges = materialize(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_pull(both).where("b > a")
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        small = _pull(large)
        edges = materialize(
            small.select("a", F.col("m").alias("b"))
            .union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))

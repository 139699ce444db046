"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node of its component.

    Alternates the two published star operations, each a map-side combined ``min`` by node and a join with it. A node that is
    its neighbourhood's least keeps its links, so the hub of a large component isn't looked up: the minima of the others are
    stored and joined to the links by plain exchanges, whose skew Spark can split. Each round is written to the shared folder, so lineage stays short. It ends when a round changes
    nothing; the number of rounds grows with the logarithm of the number of nodes. Null ends and loops drop out;
    an empty graph gives an empty result.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = _sign(edges)
    for _ in range(rounds):
        if not sign[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        less = written(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").withColumnRenamed("u", "v"), "minima")
        large = edges.join(less, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "links")
        before, sign = sign, _sign(edges)
        if before == sign:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return nodes.union(roots.select("node", F.col("node").alias("root")))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

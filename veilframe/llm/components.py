"""Connected components over a distributed table of links, by contraction to neighbours of high degree.

In a round each node points at the node of greatest degree among itself and its neighbours (ties by a hash of the round),
follows that pointer once more, and is merged into the node it reaches; links between merged nodes are what the next round
works on. A node that points at itself has as many neighbours, all pointing elsewhere, as any of them has, so at most half
of the nodes are such roots, whatever the links: stars take one round, and chains of n nodes about log n, in any order of
ids. At the end the rounds' pointers are composed backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, materialize, scratch


def _contract(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(pointers (node, to) of links' nodes, links (a, b) that are left, both directions and distinct)."""
    degree = materialize(links.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    heavy = heavy_keys(degree, "node", "degree")
    rank = lambda node: F.struct(F.col("degree").alias("d"), F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("node"))
    seen = join_heavy(links, degree.withColumnRenamed("node", "b"), "b", "a", heavy).select(F.col("a").alias("node"), rank("b").alias("r"))
    best = seen.unionByName(degree.select("node", rank("node").alias("r"))).groupBy("node").agg(F.max("r").alias("r"))
    first = materialize(best.select("node", F.col("r.node").alias("to")), "pointers")
    beyond = first.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
    pointers = materialize(join_heavy(first, beyond, "to", "node", heavy).select("node", F.col("beyond").alias("to")), "pointers")
    left = links
    for end, other in (("a", "b"), ("b", "a")):
        left = join_heavy(left, pointers.select(F.col("node").alias(end), F.col("to").alias("_to")), end, other, heavy).withColumn(end, F.col("_to")).drop("_to")
    return pointers, materialize(left.filter("a <> b").select("a", "b").distinct(), "links")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b: any type with an order): the least node reachable.

    Rounds go on until no link is left; each is written to the shared folder, and nothing but counts reaches the driver. The
    result is written too, and the rounds are deleted.
    Nodes with a large share of the links are salted. Null ends and loops link nothing. An empty table gives no row.
    """
    with scratch(links.sparkSession) as keep:
        return keep(_settled(links.filter("a is not null and b is not null and a <> b").select("a", "b")), "components")


def _settled(links: DataFrame) -> DataFrame:
    left = materialize(links.union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        pointers, left = _contract(left, len(rounds))
        rounds.append(pointers)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # (node, root) of the last round, then of each round before it
    whole = rounds.pop().select("node", F.col("to").alias("root"))
    while rounds:
        pointers = rounds.pop()
        after = whole.select(F.col("node").alias("to"), "root")
        whole = pointers.join(after, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        whole = materialize(whole, "roots")
    least = materialize(whole.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")), "components")
    return join_heavy(whole, least.select("root", "component"), "root", "node", heavy_keys(least, "root", "n")).select("node", "component")

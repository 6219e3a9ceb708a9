"""Connected components of a graph of links, by alternating large and small stars.

The large star ties every larger neighbour of a node to the smallest of its
neighbourhood, the small star every smaller one. Nodes only ever move to smaller ones,
and after a logarithmic number of rounds each component is one star around its smallest
node. Minima are pre-aggregated before they are shuffled, and each round is written to
the checkpoint folder, so a round that is lost is no reason to start over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.stored import stored

ROUNDS = 60


def _smallest(arcs: DataFrame) -> DataFrame:
    """arcs with m: the smallest of a node and its neighbours in `arcs`."""
    least = arcs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return arcs.join(least, "u")


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(turned))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge in `edges` (u, v), longs.

    component is the smallest node of it. Edges of a node to itself, repeated edges and
    either direction are allowed; an empty graph has no rows.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).distinct())
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        large = _smallest(_both_ways(now)).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter(F.col("u") != F.col("v")).distinct()
        small = _smallest(down)
        own = small.select("u", F.col("m").alias("v"))
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(own.unionByName(moved).filter(F.col("u") != F.col("v")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not settled after {ROUNDS} rounds")
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

"""Connected components over an edge table that may be larger than any one machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import stored

#: Nodes that one task keeps in memory while it contracts its edges; beyond them it emits what it has and goes on.
CONTRACT_NODES = 300_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = up.setdefault(x, x)
        while up[top] != top:
            top = up[top]
        while x != top:
            up[x], x = top, up[x]
        return top

    def join(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x < y:
            self.up[y] = x
        elif y < x:
            self.up[x] = y

    def stars(self) -> list[tuple]:
        return [(x, top) for x in list(self.up) if (top := self.root(x)) != x]


def _contract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > CONTRACT_NODES:
            yield pd.DataFrame(forest.stars(), columns=["a", "b"])
            forest = Forest()
    if forest.up:
        yield pd.DataFrame(forest.stars(), columns=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; component is the smallest node that it reaches.

    edges: columns a and b of one orderable type. Loops, repeated edges and edges with a null end add nothing. Each task first
    contracts its own edges to stars, then large-star and small-star steps alternate until only stars are left. A hub's edges
    meet as partial minima; the joins back to them are plain equi-joins that adaptive execution splits when they are skewed.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.select("a", "b").filter("a != b")
    now = stored(edges.mapInPandas(_contract, f"a {kind}, b {kind}"), "edges")
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        now = stored(_small_star(_large_star(now)), "stars")
        twice = now.groupBy("a").count().filter("count > 1").select("a")
        chained = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")
        if twice.union(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

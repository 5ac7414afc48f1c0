"""Connected components of a table of links, by alternating stars.

Every partition first replaces its own links by a spanning forest (union-find over that partition alone). Then
large-star and small-star steps (Kiveris et al., 2014) point every node at ever smaller neighbours until each component
is one star around its smallest node. Each step is an aggregation with partial sums followed by a join of two written
tables, which Spark can split where a hub has very many links; nothing is gathered on the driver but a count and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch

ROUNDS = 60


class Forest:
    """Union-find; the root of a set is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            x, up[x] = up.get(x, x), top
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


def links_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    yield links_batch(forest.links())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each node of ``links(u long, v long)``; label is the smallest node of its component.

    Nodes without a link are absent. Loops and repeated links do no harm. No links: no rows.
    """
    edges = scratch.save(links.where("u <> v").mapInArrow(_contract, "u long, v long"))
    seen = None
    for _ in range(ROUNDS):
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == seen:
            break
        seen = (state.n, state.x)
        # large star: the neighbours above a node point at the smallest of node and neighbours
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: the neighbours below a node, and the node, point at the smallest of them
        least2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.union(least2.toDF("u", "v")).distinct())
        scratch.drop(edges, least, large, least2)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())

"""Connected components of a table of links, by union-find within partitions and star contraction between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.llm import common


def local_forest(links: DataFrame) -> DataFrame:
    """The same components with at most one link for each node and partition: every node with the smallest of its local group."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(find(x), x) for x in parent]
        for at in range(0, len(pairs), 50_000):
            u, v = zip(*pairs[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long").filter("u < v")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of links(u long, v long): label is the smallest node that it can reach.

    A round replaces each node's links by links to the smallest node near it: first of the larger neighbours (large
    star), then of the smaller (small star). When nothing changes, each node is linked to its label alone. A node's
    smallest neighbour is an aggregate with partial sums; it is joined back from a table, so that a node with very
    many links can be split over tasks. An empty table gives an empty result."""
    edges = common.materialise(local_forest(links).distinct(), "forest")
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v")
        large = common.materialise(local_forest(large).distinct(), "large")
        least = common.materialise(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, "v").select("m", "u", "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").filter("u < v").distinct()
        edges = common.materialise(small, "small")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).union(edges.select("u", "u").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

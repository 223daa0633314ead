"""Connected components of a graph given by its edges, by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.llm.common import stored


def forest(pairs) -> dict:
    """node -> smallest node of its tree, for every node of some pairs that is not the smallest."""
    parent: dict = {}

    def find(x):
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars, which shortens the paths that rounds have to follow."""

    def run(batches):
        stars = forest((a, b) for batch in batches for a, b in zip(*(c.to_pylist() for c in batch.columns)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(stars), pa.int64()), pa.array(list(stars.values()), pa.int64())], ["u", "v"]
        )

    return edges.select("a", "b").mapInArrow(run, "u bigint, v bigint")


#: So many edges (16 bytes each) are contracted by one task at once; more take rounds.
LOCAL_EDGES = 500_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); ``root`` is the smallest node reachable.

    Every task first contracts the edges it reads; if few are left, one task ends the work. Else
    each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour; the number of rounds grows with the logarithm of the largest component. Minima are
    combined before the shuffle and every round is written to the shared folder.
    """
    now = stored(_contracted(edges.filter("a <> b")).distinct())
    if now.count() <= local_edges:
        last = now.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1)
        return _with_roots(stored(_contracted(last)))
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        )
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == sign:
            break
        sign = tuple(size)
    return _with_roots(now)


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    tops = roots.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return roots.unionByName(tops)

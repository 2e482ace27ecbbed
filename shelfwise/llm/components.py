"""Connected components by alternating large and small stars, without neighbour lists.

A star step needs a node's least neighbour only, which is a hash aggregate with partial sums; the
neighbours are then moved by a join, which the planner can split on a hub. Each round is written to the
shared folder, so lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.stage import stage

#: rows of links that a task joins up by itself before the rounds; only lessens the rounds
FOREST_ROWS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of links replaced by stars over the same components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    root: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (up := root.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            root[p] = x
        return x

    def out() -> pa.RecordBatch:
        pairs = [(top(x), x) for x in list(root)]
        pairs = [(a, b) for a, b in pairs if a != b]
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], schema=schema
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FOREST_ROWS:
            yield out()
            root.clear()
    if root:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of the links ``a``, ``b`` (longs, not null).

    Nodes without a link to another node are not in the result; an empty table gives an empty one.
    """
    edges = stage(links.where("a <> b").mapInArrow(_forest, "a long, b long"), "links")
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # small star: a node's smaller neighbours, and itself, move to the least of them
        least_a = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(least_a, "b")
            .select(F.explode(F.array(F.struct("m", F.col("a").alias("x")), F.struct("m", F.col("b").alias("x")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = stage(small.mapInArrow(_forest, "a long, b long").distinct(), "links")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")
        ).head()
        # done when every node hangs on one root and nothing has moved
        if now == last:
            break
        last = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )

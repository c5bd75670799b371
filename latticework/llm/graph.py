"""Connected components over DataFrames: alternating large and small stars, whose rounds grow with the logarithm of a component.

Before the first round every partition reduces its edges to stars of their own (union-find), which join the same nodes with
fewer edges than nodes, however many edges a dense group has. What is left of a small graph, up to LOCAL edges, is finished the
same way in one task; the components are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60
#: At most so many edges (16 bytes each) meet in one task.
LOCAL = 200_000
#: Edges that a partition reduces at a time.
_HELD = 1_000_000


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition -> fewer edges (node, smallest node it reaches) that join the same nodes."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, y) for x in up if (y := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > _HELD:
            yield out()
            up.clear()
    yield out()


def _with_roots(edges: DataFrame) -> DataFrame:
    """node, component of edges(u, v) from nodes to the smallest node of their component."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """node, component (its smallest node) of every node of edges(a, b), both long; repeats are fine, loops are left out."""
    now = stored(edges.where("a <> b").select("a", "b").mapInArrow(stars, "u long, v long").distinct(), "edges")
    if now.limit(local + 1).count() <= local:
        return _with_roots(now.coalesce(1).mapInArrow(stars, "u long, v long"))
    mark = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    before = mark(now)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return _with_roots(now)


def joined(parts: DataFrame, links: DataFrame, local: int = LOCAL) -> DataFrame:
    """parts(node, component) after further links(a, b): only the components that a link touches meet in a new graph."""
    if links.isEmpty():
        return parts
    label = lambda df, c: df.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    both = stored(label(label(links.select("a", "b"), "a"), "b"), "labelled")
    new = both.select(F.col("a").alias("node")).union(both.select("b")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    above = components(both.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), local).select(F.col("node").alias("component"), F.col("component").alias("above"))
    return stored(parts.union(new).join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "components")

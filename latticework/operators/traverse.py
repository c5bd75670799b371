"""Breadth-first traversals of many starts at once: one join a step, visited pairs left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .skeleton import Skeleton

MAX_HOPS = 12
# Which relation a path climbs first.
CLIMB = {"feeds": 0, "hasPart": 1, "isLocationOf": 2}
#: Rows of what nodes reach that are broadcast, and next nodes of a seed that is gathered for it.
MAX_SENT = 2_000_000
FEW = 1_000


def frontier(seeds: DataFrame, steps: DataFrame, most: int | None, ends: list[DataFrame] | None = None) -> DataFrame:
    """(start, node, h) reached from seeds(start, node) by steps(node, next) in at most so many steps, with the least h.

    ends: for most only, the nodes(node) from which what is sought can be reached in at most 0, 1, .. steps; nodes with fewer steps
    left than they need are left out.
    """
    newest = stored(seeds.select("start", "node").distinct().withColumn("h", F.lit(0)), "frontier")
    reached, seen = [newest], newest
    step = steps.select("node", "next").distinct()
    while most is None or len(reached) <= most:
        left = None if ends is None else most - len(reached)
        ways = step if left is None or left >= len(ends) else step.join(ends[left].select(F.col("node").alias("next")), "next", "left_semi")
        found = newest.join(ways, "node").select("start", F.col("next").alias("node")).distinct()
        newest = stored(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("h", F.lit(len(reached))), "frontier")
        if newest.isEmpty():
            break
        reached.append(newest)
        seen = stored(seen.union(newest), "visited") if len(reached) % 4 == 0 else seen.union(newest)
    return seen


def closure(seeds: DataFrame, steps: DataFrame, most: int | None) -> DataFrame:
    """frontier, for seeds(start, node) whose neighbourhoods overlap much: walked step by step only among nodes that steps lead to
    and from, once for each of them. Nodes that steps lead to but not from are added at the end, and a seed that no step leads to
    takes what its next nodes reach, a step further; so what is found before is not dealt out anew for each step."""
    seeds = stored(seeds.select("start", "node").distinct(), "seeds")
    step = stored(steps.select("node", "next").distinct(), "steps")
    leading, led = step.select("node").distinct(), step.select(F.col("next").alias("node")).distinct()
    pairs = stored(seeds.join(led, "node", "left_anti").join(step, "node").select("start", F.col("next").alias("mid")), "mids")
    inner = seeds.join(led, "node", "left_semi")
    own = inner.select("node").union(pairs.select("mid")).distinct().select(F.col("node").alias("start"), "node")
    through = step.join(leading.withColumnRenamed("node", "next"), "next", "left_semi")
    ended = step.join(leading.withColumnRenamed("node", "next"), "next", "left_anti")
    core = frontier(own.join(leading, "node", "left_semi"), through, most)
    below = core if most is None else core.where(F.col("h") < most)
    last = below.join(ended, "node").groupBy("start", F.col("next").alias("node")).agg((F.min("h") + 1).alias("h"))
    alone = own.join(leading, "node", "left_anti").select("start", "node", F.lit(0).alias("h"))
    reached = stored(core.select("start", "node", "h").union(last).union(alone), "reached").withColumnRenamed("start", "mid")
    first = seeds.join(led, "node", "left_anti").select("start", "node", F.lit(0).alias("h"))
    near = reached if most is None else reached.where(F.col("h") < most)
    if near.limit(MAX_SENT + 1).count() <= MAX_SENT:
        near = F.broadcast(near)
        # starts with few next nodes are gathered before they are joined, so what is joined is not dealt out
        if (pairs.groupBy("start").count().agg(F.max("count")).first()[0] or 0) <= FEW:
            pairs = pairs.repartition("start")
    further = pairs.join(near, "mid").groupBy("start", "node").agg((F.min("h") + 1).alias("h"))
    same = inner.withColumnRenamed("node", "mid").join(reached, "mid").groupBy("start", "node").agg(F.min("h").alias("h"))
    out = first.union(further).union(same) if most is None or most > 0 else seeds.withColumn("h", F.lit(0))
    if not seeds.groupBy("start").count().where("count > 1").isEmpty():  # a node may be reached from several seeds of a start
        out = out.groupBy("start", "node").agg(F.min("h").alias("h"))
    return stored(out.select("start", "node", "h"), "closure")


def _structural(skeleton: Skeleton, starts: DataFrame) -> DataFrame:
    return starts.select("start", "node").join(skeleton.nodes.select(F.col("node_id").alias("node")), "node", "left_semi").select("start", "node")


def up_cone(skeleton: Skeleton, starts: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(start, node, h): ancestors of starts(start, node), the nodes themselves included; nothing for nodes off the skeleton."""
    return closure(_structural(skeleton, starts), skeleton.edges.select(F.col("dst").alias("node"), F.col("src").alias("next")), most)


def cone_edges(skeleton: Skeleton, cone: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(start, src, rel, dst): edges into the nodes of a cone that lie below its last step; none twice, as no node of a cone is."""
    return cone.where(F.col("h") < most).join(skeleton.edges, F.col("node") == F.col("dst")).select("start", "src", "rel", "dst")


def subtree(skeleton: Skeleton, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, h): descendants of starts(start, node), the nodes themselves included."""
    return closure(_structural(skeleton, starts), skeleton.edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), most)


def primary_path(skeleton: Skeleton, starts: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(start, path): from each of starts(start, node), greedily to the parent by climbing order, relation and name that is not
    on the path yet, up to a root, a dead end or so many steps.

    Walked once for each node that is a parent; other nodes can be on no further path, so they take the path of their first parent,
    a step shorter. No path is longer than so many steps, so of a parent's own parents one more than that is all it can need. Nothing
    leads to a root, so paths end there by themselves.
    """
    place = F.coalesce(*[F.when(F.col("rel") == r, i) for r, i in CLIMB.items()], F.lit(9))
    ups = skeleton.edges.select(F.col("dst").alias("at"), F.col("src").alias("up"), F.struct(place.alias("place"), "rel").alias("by"))
    inner = stored(skeleton.edges.select(F.col("src").alias("node")).distinct(), "parents")
    if inner.limit(MAX_SENT + 1).count() <= MAX_SENT:
        inner = F.broadcast(inner)
    first = ups.groupBy(F.col("at").alias("node")).agg(F.min(F.struct("by", "up"))["up"].alias("mid"))
    seeds = _structural(skeleton, starts).distinct().join(inner.withColumn("inner", F.lit(True)), "node", "left").join(first, "node", "left")
    seeds = stored(seeds.select("start", "node", F.when(F.col("inner"), F.col("node")).otherwise(F.col("mid")).alias("mid"), F.coalesce("inner", F.lit(False)).alias("inner")), "seeds")
    own = ups.join(inner.withColumnRenamed("node", "at"), "at", "left_semi").groupBy("at", "up").agg(F.min("by").alias("by"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy("by", "up"))).where(F.col("nth") <= most + 1)
    own = own.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "up"))), lambda x: x["up"]).alias("ups"))
    own = stored(own, "ups")
    going = seeds.where("mid is not null").select(F.col("mid").alias("node")).distinct().select("node", F.array("node").alias("path"), F.col("node").alias("at"))
    done = []
    for _ in range(most):
        fresh = F.get(F.filter(F.coalesce("ups", F.array().cast("array<string>")), lambda x: ~F.array_contains("path", x)), F.lit(0))
        moved = stored(going.join(own, "at", "left").select("node", "path", fresh.alias("up")), "paths")
        done.append(moved.where("up is null").select("node", "path"))
        going = moved.where("up is not null").select("node", F.concat("path", F.array("up")).alias("path"), F.col("up").alias("at"))
        if going.isEmpty():
            break
    walked = going.select("node", "path")
    for part in done:
        walked = walked.union(part)
    out = seeds.join(walked.select(F.col("node").alias("mid"), "path"), "mid", "left")
    longer = F.concat(F.array("node"), F.slice(F.coalesce("path", F.array().cast("array<string>")), 1, most))
    return out.select("start", F.when(F.col("inner"), F.col("path")).otherwise(longer).alias("path"))


def reaches_root(skeleton: Skeleton, cone: DataFrame) -> DataFrame:
    """(start, root): the first root by name in each cone that has one."""
    return cone.join(skeleton.roots.withColumnRenamed("node_id", "node"), "node", "left_semi").groupBy("start").agg(F.min("node").alias("root"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, next) over all relations in both directions."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()


def within(sought: DataFrame, steps: DataFrame, most: int) -> list[DataFrame]:
    """For 0, 1, .. most - 1 steps(node, next), that lead both ways: the nodes(node) that reach one of sought(node) in so many."""
    out = [sought.select("node").distinct()]
    for _ in range(1, most):
        out.append(stored(out[-1].union(out[-1].join(steps, "node").select(F.col("next").alias("node"))).distinct(), "within"))
    return out


def khop(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, h) over all relations in both directions from starts(start)."""
    return frontier(starts.select("start", F.col("start").alias("node")), both_ways(edges), most)

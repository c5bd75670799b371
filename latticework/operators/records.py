"""A target's record: its nodes, edges and ordered leaves; summaries over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .view import Spine


def edges(own: Spine, kept: DataFrame, attached: DataFrame) -> DataFrame:
    """(target, src, rel, dst): ancestry edges, then for each of kept(target, leaf) its first host that is one of the record's nodes."""
    up = own.edges.select(F.col("start").alias("target"), "src", "rel", "dst")
    known = own.nodes.select(F.col("start").alias("target"), F.col("node").alias("parent")).union(kept.select("target", "leaf")).union(own.flags.select("start", "start"))
    hosts = kept.select("target", "leaf").join(attached, "leaf").join(known.distinct(), ["target", "parent"], "left_semi")
    points = hosts.groupBy("target", "leaf").agg(F.min_by("parent", "edge_ord").alias("src"))
    return up.union(points.select("target", "src", F.lit("hasPoint"), F.col("leaf")))


def cone_names(own: Spine) -> DataFrame:
    """(target, place, cone): the names of the nodes of a target's cone, gathered once for each place."""
    names = own.cones.groupBy("place").agg(F.collect_list("node").alias("cone"))
    return own.places.join(names, "place").select(F.col("start").alias("target"), "place", "cone")


def _points() -> Column:
    """Of cone and leaves of (leaf, hosts): (src, leaf), each leaf's first host that is in the cone. A host has no series, so it is
    neither a leaf nor a target."""
    first = lambda v: F.get(F.filter(F.coalesce(v["hosts"], F.array().cast("array<string>")), lambda h: F.array_contains(F.coalesce("cone", F.array().cast("array<string>")), h)), F.lit(0))
    return F.filter(F.transform("leaves", lambda v: F.struct(first(v).alias("src"), v["leaf"].alias("leaf"))), lambda v: v["src"].isNotNull())


def points(picked: DataFrame) -> DataFrame:
    """(target, src, leaf) of picked(target, cone, leaves of (leaf, hosts))."""
    return picked.select("target", F.explode(_points()).alias("x")).select("target", "x.src", "x.leaf")


def assemble(targets: DataFrame, own: Spine, picked: DataFrame, roots: DataFrame, before_cap: DataFrame) -> DataFrame:
    """One record for each target; picked(target, cone, leaves of (leaf, hosts)); roots(place, root); before_cap(target, n_pre_cap).
    Spines, ancestry edges and roots are gathered for each place."""
    by = lambda df, c: df.groupBy("place").agg(c)
    ways = by(own.ways, F.collect_list(F.struct("src", "rel", "dst")).alias("ways"))
    at = by(own.cones, F.collect_list("node").alias("spine")).join(ways, "place", "left").join(by(roots, F.array_sort(F.collect_set("root")).alias("roots_reached")), "place", "left")
    found = picked.select("target", F.transform("leaves", lambda v: v["leaf"]).alias("leaves"), _points().alias("points"))
    out = targets.select("target", "target_class").join(own.flags.select(F.col("start").alias("target"), "orphan"), "target", "left").join(before_cap, "target", "left")
    out = out.join(found, "target", "left").join(own.places.select(F.col("start").alias("target"), "place"), "target", "left")
    # targets without a place are dealt out by name
    out = out.withColumn("place", F.coalesce("place", F.concat(F.lit("-|"), "target"))).join(at, "place", "left")
    empty = F.array().cast("array<string>")
    leaves, spine = F.coalesce("leaves", empty), F.coalesce("spine", empty)
    pairs = F.array().cast("array<struct<src: string, rel: string, dst: string>>")
    points = F.transform(F.coalesce("points", F.array().cast("array<struct<src: string, leaf: string>>")), lambda v: F.struct(v["src"].alias("src"), F.lit("hasPoint").alias("rel"), v["leaf"].alias("dst")))
    return out.select(
        F.col("target").alias("target_uri"), "target_class", F.array_sort(F.array_distinct(F.concat(spine, F.array("target"), leaves))).alias("nodes"), F.array_sort(F.concat(F.coalesce("ways", pairs), points)).alias("edges"),
        F.size(leaves).alias("n_leaves"), leaves.alias("leaves"), F.size(spine).alias("spine_size"), "orphan", F.coalesce("roots_reached", empty).alias("roots_reached"), F.coalesce("n_pre_cap", F.lit(0)).alias("n_pre_cap"),
    )


def size_summary(sizes: DataFrame) -> DataFrame:
    """One row over sizes(n_leaves): n_targets, mean_leaves, median_leaves (the value at n div 2) and n_zero; none without targets."""
    counts = sizes.groupBy(F.col("n_leaves").cast("long").alias("n_leaves")).agg(F.count("*").alias("n"))
    total = counts.agg(F.array_sort(F.collect_list(F.struct("n_leaves", "n"))).alias("all"), F.sum("n").alias("n_targets"), F.sum(F.col("n_leaves") * F.col("n")).alias("s"), F.sum(F.when(F.col("n_leaves") == 0, F.col("n")).otherwise(0)).alias("n_zero"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("median"))
    walk = F.aggregate("all", start, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["median"] < 0) & (a["seen"] + x["n"] > F.expr("n_targets div 2")), x["n_leaves"]).otherwise(a["median"]).alias("median")))
    return total.where("n_targets > 0").select("n_targets", F.round(F.col("s") / F.col("n_targets"), 6).alias("mean_leaves"), walk["median"].alias("median_leaves"), "n_zero")


def quality_summary(sizes: DataFrame, most: int = 60) -> DataFrame:
    """One row over sizes(n_leaves, fallback_used, orphan): targets, least, upper median, mean and most leaves, cap hits, fallbacks,
    orphans; no row without targets. The median is the value at n div 2, found from the counts of each size."""
    flags = F.sum(F.col("fallback_used").cast("long")).alias("f"), F.sum(F.col("orphan").cast("long")).alias("o")
    counts = sizes.groupBy("n_leaves").agg(F.count("*").alias("n"), *flags)
    whole = F.array_sort(F.collect_list(F.struct("n_leaves", "n")))
    total = counts.agg(whole.alias("all"), F.sum("n").alias("n_targets"), F.sum("f").alias("fallback_used"), F.sum("o").alias("orphan"), F.sum(F.when(F.col("n_leaves") >= most, F.col("n")).otherwise(0)).alias("cap_hits"), F.sum(F.col("n_leaves") * F.col("n")).alias("s"))
    walk = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("median")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["median"] < 0) & (a["seen"] + x["n"] > F.expr("n_targets div 2")), x["n_leaves"].cast("long")).otherwise(a["median"]).alias("median")))
    out = total.where("n_targets > 0").withColumn("median_leaves", walk["median"])
    first, last = F.get("all", F.lit(0))["n_leaves"], F.element_at("all", -1)["n_leaves"]
    return out.select("n_targets", first.cast("long").alias("min_leaves"), "median_leaves", F.round(F.col("s") / F.col("n_targets"), 6).alias("mean_leaves"), last.cast("long").alias("max_leaves"), "cap_hits", "fallback_used", "orphan")

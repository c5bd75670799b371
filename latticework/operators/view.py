"""A target's surroundings: spine, anchors with aliases, and the text that a selector reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uri import short
from ..shared import stored
from .attach import cluster_histogram, counts_under, host_histogram, points_under
from .skeleton import Skeleton
from .traverse import cone_edges, subtree, up_cone

TOP = 12
PEERS = 5
#: Global hosts that are broadcast.
MAX_GLOBAL = 10_000


@dataclass(frozen=True)
class Spine:
    """flags(start, orphan, first_host); places(start, place): targets with the same hosts are at one place; for each place
    cones(place, node, h) and ways(place, src, rel, dst). nodes(start, node, h) and edges(start, src, rel, dst) repeat them for
    each target."""

    flags: DataFrame
    places: DataFrame
    cones: DataFrame
    ways: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.places.join(self.cones, "place").select("start", "node", "h")

    @property
    def edges(self) -> DataFrame:
        return self.places.join(self.ways, "place").select("start", "src", "rel", "dst")


def spine(targets: DataFrame, attached: DataFrame, skeleton: Skeleton) -> Spine:
    """Of targets(target): structural hosts and the union of their cones."""
    own = targets.select(F.col("target").alias("start")).distinct()
    hosts = own.join(attached, F.col("start") == F.col("leaf")).select("start", F.col("parent").alias("node"), "edge_ord")
    hosts = hosts.join(skeleton.nodes.select(F.col("node_id").alias("node")), "node", "left_semi")
    near = hosts.groupBy("start").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.min_by("node", "edge_ord").alias("first_host"))
    near = stored(near.select("start", F.to_json("nodes").alias("place"), "nodes", "first_host"), "places")
    at = near.groupBy("place").agg(F.first("nodes").alias("nodes")).select("place", F.size("nodes").alias("many"), F.explode("nodes").alias("start"))
    # one cone for each host, and one union of cones for each place, however many targets share it
    cones = up_cone(skeleton, at.select("start", F.col("start").alias("node")))
    nodes, edges = at.join(cones, "start"), at.join(cone_edges(skeleton, cones), "start")
    merged = nodes.where("many > 1").groupBy("place", "node").agg(F.min("h").alias("h"))
    nodes = stored(nodes.where("many = 1").select("place", "node", "h").union(merged), "spine")
    ways = edges.where("many = 1").select("place", "src", "rel", "dst").union(edges.where("many > 1").select("place", "src", "rel", "dst").distinct())
    flags = own.join(near.select("start", "first_host"), "start", "left").select("start", F.col("first_host").isNull().alias("orphan"), "first_host")
    return Spine(flags, near.select("start", "place"), nodes, ways)


def place_roots(skeleton: Skeleton, own: Spine) -> DataFrame:
    """(place, root)."""
    return own.cones.join(skeleton.roots.withColumnRenamed("node_id", "node"), "node", "left_semi").select("place", F.col("node").alias("root"))


def roots_reached(skeleton: Skeleton, own: Spine) -> DataFrame:
    """(start, root)."""
    return own.places.join(place_roots(skeleton, own), "place").select("start", "root")


def ancestry_order(skeleton: Skeleton, own: Spine) -> DataFrame:
    """(start, node, place) from the hosts up: by steps, class and name; ordered once for each set of hosts."""
    named = own.cones.join(skeleton.nodes.select(F.col("node_id").alias("node"), "brick_class"), "node")
    nth = F.row_number().over(Window.partitionBy("place").orderBy("h", "brick_class", "node")).alias("nth")
    return own.places.join(named.select("place", "node", nth), "place").select("start", "node", F.col("nth").alias("place"))


def global_hosts(skeleton: Skeleton, attached: DataFrame) -> DataFrame:
    """(node) with points: roots that are locations, their children, and all external and collection nodes."""
    tops = skeleton.nodes.join(skeleton.roots, "node_id", "left_semi").where("top_type = 'Location'").select("node_id")
    below = skeleton.edges.join(tops, F.col("src") == F.col("node_id"), "left_semi").select(F.col("dst").alias("node_id"))
    other = skeleton.nodes.where("top_type in ('External', 'Collection')").select("node_id")
    every = tops.union(below).union(other).distinct().withColumnRenamed("node_id", "node")
    return every.join(attached, F.col("node") == F.col("parent"), "left_semi")


def histogram_text(counts: DataFrame, key: list[str], name: str, most: int = TOP) -> DataFrame:
    """(key, text): the commonest classes as class×n, then how many more; ties by name."""
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), name)))
    items = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", F.concat(F.col(name), F.lit("×"), F.col("n").cast("string")).alias("t")))))
    out = ranked.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["t"]), ", ").alias("head"), F.count("*").alias("many"))
    more = F.when(F.col("many") > most, F.concat(F.lit(", +"), (F.col("many") - most).cast("string"), F.lit(" more"))).otherwise("")
    return out.select(*key, F.concat("head", more).alias("text"))


def cohort_counts(targets: DataFrame, places: DataFrame, starts: DataFrame, attached: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(target, node, n): how many other leaves of the target's class lie below each node of starts(view, node) for its view, which
    places(target, view) names. The nodes are to lie above the target's host, so each counts the target itself."""
    below = subtree(skeleton, starts.select(F.col("node").alias("start"), "node").distinct())
    counts = counts_under(attached, below).where("n > 1").select(F.col("start").alias("node"), F.col("leaf_class").alias("target_class"), (F.col("n") - 1).alias("n"))
    own = starts.join(stored(counts, "cohort_counts"), "node")
    return targets.select("target", "target_class").join(places, "target").join(own, ["view", "target_class"]).select("target", "node", "n")


def cohorts(targets: DataFrame, starts: DataFrame, attached: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(target, node, n, text): leaves of the target's class below each node of starts(target, node), itself left out.

    Counted once for each node and class; a target then takes itself out.
    """
    wanted = starts.join(targets.select("target", "target_class"), "target")
    below = subtree(skeleton, wanted.select(F.col("node").alias("start"), "node").distinct())
    leaves = stored(points_under(attached, below).withColumnRenamed("start", "node"), "cohorts")
    place = F.row_number().over(Window.partitionBy("node", "leaf_class").orderBy("edge_ord"))
    ranked = leaves.withColumn("place", place)
    groups = ranked.groupBy("node", "leaf_class").agg(F.count("*").alias("all"), F.array_sort(F.collect_list(F.when(F.col("place") <= PEERS + 1, F.struct("place", "leaf")))).alias("heads"))
    inside = leaves.select("node", F.col("leaf").alias("target"), F.lit(1).alias("inside"))
    out = wanted.join(groups, (wanted["node"] == groups["node"]) & (F.col("target_class") == F.col("leaf_class"))).drop(groups["node"]).join(inside, ["node", "target"], "left")
    n = F.col("all") - F.coalesce("inside", F.lit(0))
    text = _kin(n, F.filter(F.transform("heads", lambda x: x["leaf"]), lambda x: x != F.col("target")))
    return out.where(n > 0).select("target", "node", n.cast("long").alias("n"), text.alias("text"))


@dataclass(frozen=True)
class Views:
    """places(target, view); entries(view, ord, section, rel, node): what a view lists, in order; a node may be listed twice.
    listed(target, ord, section, rel, node) repeats the entries for each target.

    Targets with the same first host share a view, and those without a host share one. Sections: host (the first one), parent (of
    that host), up (other ancestors, at the first parent that leads to them), cluster (for targets without a host) and global (hosts
    that are not listed yet).
    """

    places: DataFrame
    entries: DataFrame

    @property
    def listed(self) -> DataFrame:
        return self.places.join(self.entries, "view").select("target", "ord", "section", "rel", "node")


def entries(targets: DataFrame, own: Spine, attached: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(target, ord, section, rel, node): what a target's view lists."""
    return views(own, attached, skeleton).listed


def views(own: Spine, attached: DataFrame, skeleton: Skeleton) -> Views:
    flags = own.flags.withColumnRenamed("start", "target")
    host = flags.where("not orphan").select("target", F.col("first_host").alias("host"))
    ups = skeleton.edges.select(F.col("dst").alias("host"), "rel", F.col("src").alias("parent"), F.row_number().over(Window.partitionBy("dst").orderBy("edge_ord")).alias("branch"))
    # views of one host are alike: listed once for each host
    hosts = host.select("host").distinct()
    parent = stored(hosts.join(ups, "host"), "parents")
    cone = up_cone(skeleton, parent.select(F.col("parent").alias("start"), F.col("parent").alias("node")).distinct())
    above = parent.join(cone, F.col("parent") == F.col("start")).where("h > 0").groupBy("host", "node").agg(F.min(F.struct("branch", "h")).alias("at"))
    shown = parent.groupBy("host", F.col("parent").alias("node")).agg(F.min("branch").alias("own"))
    above = above.join(shown, ["host", "node"], "left").where("node <> host and (own is null or own > at.branch)").join(skeleton.nodes.select(F.col("node_id").alias("node"), "brick_class"), "node")
    key = lambda a, b, h, c: F.struct(F.lit(a).alias("a") if isinstance(a, int) else a.alias("a"), F.lit(b).alias("b"), h.alias("h"), c.alias("c"))
    zero, none = F.lit(0), F.lit("")
    listed = hosts.select("host", key(0, 0, zero, none).alias("key"), F.lit("host").alias("section"), none.alias("rel"), F.col("host").alias("node"))
    listed = listed.union(parent.select("host", key(F.col("branch"), 0, zero, none), F.lit("parent"), "rel", "parent"))
    listed = stored(listed.union(above.select("host", key(F.col("at.branch"), 1, F.col("at.h"), F.col("brick_class")), F.lit("up"), none, "node")), "listed")
    wide = stored(global_hosts(skeleton, attached), "global_hosts")  # every view lists all of them; a building has few
    wide = F.broadcast(wide) if wide.limit(MAX_GLOBAL + 1).count() <= MAX_GLOBAL else wide
    rest = hosts.join(wide)
    last = F.lit(2**30)
    drivers = rest.join(listed.select("host", "node").distinct(), ["host", "node"], "left_anti").select("host", key(last, 0, zero, none), F.lit("global"), none, "node")
    on = lambda c: F.concat(F.lit("on:"), c)
    out = listed.union(drivers).select(on("host").alias("view"), "key", "section", "rel", "node")
    places = stored(flags.select("target", F.when(F.col("orphan"), "lone").otherwise(on("first_host")).alias("view")), "view_places")
    lone = places.where("view = 'lone'").select("view").limit(1)
    out = out.union(lone.select("view", key(0, 0, zero, none), F.lit("cluster"), none, F.lit("__cluster__")))
    out = out.union(lone.join(wide).select("view", key(last, 0, zero, none), F.lit("global"), none, "node"))
    nth = F.row_number().over(Window.partitionBy("view").orderBy("key", "node", "rel")).alias("ord")
    return Views(places, stored(out.select("view", nth, "section", "rel", "node"), "entries"))


def anchors(listed: DataFrame, key: str = "target") -> DataFrame:
    """(target, alias, node): A1, A2, .. by first appearance."""
    first = listed.repartition(key).groupBy(key, "node").agg(F.min("ord").alias("ord"))
    return first.select(key, F.concat(F.lit("A"), F.row_number().over(Window.partitionBy(key).orderBy("ord")).cast("string")).alias("alias"), "node")


def _wording() -> tuple[Column, Column]:
    """A line before and after what only its target knows."""
    # The wording of a view's lines.
    label = F.concat(F.lit("["), "alias", F.lit("] "), F.coalesce("brick_class", F.lit("")), F.lit("("), short(F.col("node")), F.lit(")"))
    part = lambda head, tail="": F.when(F.col("own").isNotNull(), F.concat(F.lit(head), "own", F.lit(tail))).otherwise("")
    head = (
        F.when(F.col("section") == "host", F.concat(F.lit("on target node "), label))
        .when(F.col("section") == "parent", F.concat(F.lit("  via "), "rel", F.lit(" <- "), label))
        .when(F.col("section") == "up", F.concat(F.lit("      ^up "), label, F.coalesce("root", F.lit(""))))
        .when(F.col("section") == "cluster", F.concat(F.lit("  ["), "alias", F.lit("] cluster (expand=cluster): ")))
        .otherwise(F.concat(F.lit("  "), label))
    )
    tail = F.when(F.col("section") == "host", part(": self={", "}")).when(F.col("section").isin("parent", "up"), part("  self={", "}")).when(F.col("section") == "cluster", "").otherwise(part(": "))
    return head, tail


def _kin(n: Column, others: Column) -> Column:
    """How many peers a target has, and the first of them."""
    more = F.when(n > PEERS, F.concat(F.lit(" (+"), (n - PEERS).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(n.cast("string"), F.lit(" "), "target_class", F.lit(" peers: "), F.array_join(F.transform(F.slice(others, 1, PEERS), lambda x: short(x)), ", "), more)


def lines(targets: DataFrame, listed: DataFrame, attached: DataFrame, skeleton: Skeleton, members: DataFrame) -> DataFrame:
    """(target, ord, text) of the view's entries."""
    own = histogram_text(host_histogram(attached), ["parent"], "leaf_class").select(F.col("parent").alias("node"), F.col("text").alias("own"))
    mates = histogram_text(cluster_histogram(members), ["leaf"], "peer_class").select(F.col("leaf").alias("target"), F.col("text").alias("mates"))
    kin = cohorts(targets, listed.where("section = 'parent'").select("target", "node").distinct(), attached, skeleton).select("target", "node", F.col("text").alias("kin"))
    named = skeleton.nodes.select(F.col("node_id").alias("node"), "brick_class")
    roots = skeleton.roots.select(F.col("node_id").alias("node"), F.lit(" (root)").alias("root"))
    x = listed.join(anchors(listed), ["target", "node"]).join(own, "node", "left").join(mates, "target", "left").join(kin, ["target", "node"], "left").join(named, "node", "left").join(roots, "node", "left")
    head, tail = _wording()
    part = F.when(F.col("section") == "parent", F.coalesce(F.concat(F.lit("  = "), "kin"), F.lit(""))).when(F.col("section") == "cluster", F.coalesce("mates", F.lit(""))).otherwise("")
    text = F.concat(head, part, tail)
    return x.select("target", "ord", "section", text.alias("text"))


# The headings of a view's sections.
HEADINGS = {
    "cluster": "YOU ARE HERE: KG-orphan (no structural parent). Recovered into an UNMODELED-equipment cluster; its cluster-mates:",
    "parent": "GROUPED-WITH  (each parent branch = a peer cohort + its upstream; pull a cohort with expand=subtree on its anchor):",
    "global": "GLOBAL DRIVERS  (building-wide; weather/utility/plant):",
    "pool": "BUILDING-WIDE POOL: request any brick_class building-wide (expand=building) for broad peer pooling.",
}


def _heading(section: str) -> Column:
    return F.lit(HEADINGS[section])


def contexts(targets: DataFrame, seen: Views, attached: DataFrame, skeleton: Skeleton, members: DataFrame) -> DataFrame:
    """rendered of lines, for targets with a class(target, target_class): lines are written once for each view. A target adds its
    peers below each parent, from heads kept for each node and class, and its cluster; each parent holds the target itself."""
    own = histogram_text(host_histogram(attached), ["parent"], "leaf_class").select(F.col("parent").alias("node"), F.col("text").alias("own"))
    mates = histogram_text(cluster_histogram(members), ["leaf"], "peer_class").select(F.col("leaf").alias("target"), F.col("text").alias("mates"))
    parents = seen.entries.where("section = 'parent'").select(F.col("node").alias("start"), "node").distinct()
    below = subtree(skeleton, parents)
    classes = F.broadcast(targets.select(F.col("target_class").alias("leaf_class")).distinct())
    leaves = points_under(attached.join(classes, "leaf_class", "left_semi").select("parent", "leaf", "leaf_class", "edge_ord"), below)
    first = leaves.withColumn("nth", F.row_number().over(Window.partitionBy("start", "leaf_class").orderBy("edge_ord"))).where(F.col("nth") <= PEERS + 1)
    heads = first.groupBy("start", "leaf_class").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "leaf"))), lambda x: x["leaf"]).alias("heads"))
    kin = counts_under(attached, below).where("n > 1").join(heads, ["start", "leaf_class"])
    kin = kin.groupBy(F.col("start").alias("node")).agg(F.collect_list(F.struct("leaf_class", (F.col("n") - 1).alias("n"), "heads")).alias("kin"))
    named = skeleton.nodes.select(F.col("node_id").alias("node"), "brick_class")
    roots = skeleton.roots.select(F.col("node_id").alias("node"), F.lit(" (root)").alias("root"))
    x = seen.entries.join(anchors(seen.entries, "view"), ["view", "node"]).join(own, "node", "left").join(named, "node", "left").join(roots, "node", "left")
    x = x.join(kin.select(F.lit("parent").alias("section"), "*"), ["section", "node"], "left")
    head, tail = _wording()
    gathered = x.groupBy("view").agg(F.array_sort(F.collect_list(F.struct("ord", "section", head.alias("head"), tail.alias("tail"), "kin"))).alias("written"))
    same = lambda w: F.get(F.filter(w["kin"], lambda k: k["leaf_class"] == F.col("target_class")), F.lit(0))
    peers = lambda k: F.coalesce(F.concat(F.lit("  = "), _kin(k["n"], F.filter(k["heads"], lambda v: v != F.col("target")))), F.lit(""))
    middle = lambda w: F.when(w["section"] == "parent", peers(same(w))).when(w["section"] == "cluster", F.coalesce("mates", F.lit(""))).otherwise("")
    out = targets.select("target", "target_class").join(mates, "target", "left").join(seen.places, "target").join(gathered, "view")
    line = lambda w: F.struct(w["ord"].alias("ord"), w["section"].alias("section"), F.concat(w["head"], middle(w), w["tail"]).alias("text"))
    return _composed(out.withColumn("all", F.transform("written", line)))


def rendered(targets: DataFrame, written: DataFrame) -> DataFrame:
    """(target, context): the whole text that a selector reads."""
    gathered = written.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("ord", "section", "text"))).alias("all"))
    return _composed(targets.select("target", "target_class").join(gathered, "target", "left"))


def _composed(x: DataFrame) -> DataFrame:
    """(target, context) of x(target, target_class, all lines in order)."""
    block = lambda *s: F.array_join(F.transform(F.filter("all", lambda x: x["section"].isin(*s)), lambda x: x["text"]), "\n")
    has = lambda s: F.exists("all", lambda e: e["section"] == s)
    head = F.concat(F.lit("TARGET: "), "target_class", F.lit("  (id="), short(F.col("target")), F.lit(")\n\n"))
    here = F.when(has("cluster"), F.concat(_heading("cluster"), F.lit("\n"), block("cluster"), F.lit("\n\n")))
    here = here.when(has("host"), F.concat(block("host"), F.lit("\n\n"), _heading("parent"), F.lit("\n"), block("parent", "up"), F.lit("\n\n"))).otherwise("")
    wide = F.when(has("global"), F.concat(_heading("global"), F.lit("\n"), block("global"), F.lit("\n\n"))).otherwise("")
    return x.select("target", F.concat(head, here, wide, _heading("pool")).alias("context"))

"""Points and the nodes that host them; points without a structural host, by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.uri import POINT_RELATIONS, dotted_prefix
from ..shared import stored
from .skeleton import Skeleton, first_wins

#: Members of a cluster in a block, pairs of blocks in a task, and tasks at most.
BLOCK = 1_000
PAIRS_A_TASK = 8
MAX_TASKS = 10_000


def attachments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, leaf, leaf_class, edge_ord): point relations with a series at exactly one end, which is the leaf; an end that is
    not among the nodes has none. The first edge counts."""
    series = nodes.where("has_ts").select(F.col("node_id").alias("id"))
    own = edges.where(F.col("rel").isin(*POINT_RELATIONS))
    own = own.join(series.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(series.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    one = own.where(F.col("a").isNotNull() != F.col("b").isNotNull())
    leaf = F.when(F.col("b"), F.col("dst")).otherwise(F.col("src"))
    parent = F.when(F.col("b"), F.col("src")).otherwise(F.col("dst"))
    pairs = first_wins(one.select(parent.alias("parent"), leaf.alias("leaf"), "edge_ord"), ["parent", "leaf"], "edge_ord")
    return pairs.join(nodes.select(F.col("node_id").alias("leaf"), F.col("brick_class").alias("leaf_class")), "leaf").select("parent", "leaf", "leaf_class", "edge_ord")


def host_histogram(attached: DataFrame) -> DataFrame:
    return attached.groupBy("parent", "leaf_class").agg(F.count("*").alias("n"))


def hosts_of_class(attached: DataFrame) -> DataFrame:
    return attached.select("leaf_class", "parent").distinct()


def orphan_leaves(nodes: DataFrame, attached: DataFrame) -> DataFrame:
    """Leaves without any host."""
    return nodes.where("has_ts").join(attached, F.col("node_id") == F.col("leaf"), "left_anti").select(F.col("node_id").alias("leaf"))


def clusters(nodes: DataFrame, attached: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(leaf, cluster_key, leaf_class) of leaves without a structural host: by the first host, else by the id's dotted prefix."""
    housed = attached.join(skeleton.nodes, F.col("parent") == F.col("node_id"), "left_semi").select("leaf")
    first = attached.groupBy("leaf").agg(F.min_by("parent", "edge_ord").alias("host"))
    lone = nodes.where("has_ts").select(F.col("node_id").alias("leaf"), F.col("brick_class").alias("leaf_class")).join(housed, "leaf", "left_anti").join(first, "leaf", "left")
    key = F.when(F.col("host").isNotNull(), F.concat(F.lit("node:"), "host")).otherwise(F.concat(F.lit("pfx:"), dotted_prefix(F.col("leaf"))))
    return lone.select("leaf", key.alias("cluster_key"), "leaf_class")


def cluster_peers(members: DataFrame) -> DataFrame:
    """(leaf, peer, peer_class): the other members of a leaf's cluster. As large as the answer is: a row for each such pair.

    Members are dealt to blocks of some BLOCK of a cluster, and each pair of blocks is joined on its own, whatever the cluster's size.
    """
    blocks = F.broadcast(stored(members.groupBy("cluster_key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cluster_key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "blocks"))
    dealt = members.join(blocks, "cluster_key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = stored(dealt.withColumn("block", F.pmod(F.xxhash64("leaf"), F.col("blocks").cast("long")).cast("int")), "dealt")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.select("cluster_key", "block", "blocks").distinct().agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    parts = min(max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS_A_TASK), MAX_TASKS)
    rows = dealt.select("cluster_key", "leaf", "block", every.alias("other")).repartition(parts, "cluster_key", "block", "other")
    peers = dealt.groupBy("cluster_key", F.col("block").alias("other"), "blocks").agg(F.collect_list(F.struct("leaf", "leaf_class")).alias("peers"))
    peers = peers.select("cluster_key", "other", "peers", every.alias("block")).repartition(parts, "cluster_key", "block", "other")
    out = rows.join(peers.hint("shuffle_hash"), ["cluster_key", "block", "other"]).select("leaf", F.explode("peers").alias("peer"))
    return out.select("leaf", F.col("peer.leaf").alias("peer"), F.col("peer.leaf_class").alias("peer_class")).where("leaf <> peer")


def cluster_histogram(members: DataFrame) -> DataFrame:
    """(leaf, peer_class, n): classes of a leaf's cluster, itself left out. Counted by cluster, not by pair."""
    counts = members.groupBy("cluster_key", "leaf_class").agg(F.count("*").alias("n"))
    own = members.select("leaf", "cluster_key", F.col("leaf_class").alias("own")).join(counts, "cluster_key")
    left = F.col("n") - F.when(F.col("own") == F.col("leaf_class"), 1).otherwise(0)
    return own.select("leaf", F.col("leaf_class").alias("peer_class"), left.cast("long").alias("n")).where("n > 0")


def _by_hosts(attached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """attached of leaves with one host, and of those with several."""
    several = attached.groupBy("leaf").agg(F.count("*").alias("hosts")).where("hosts > 1").select("leaf")
    return attached.join(several, "leaf", "left_anti"), attached.join(several, "leaf", "left_semi")


def points_under(attached: DataFrame, reached: DataFrame) -> DataFrame:
    """(start, leaf, leaf_class, edge_ord) of the leaves hosted by reached(start, node), without repeats; each leaf once. Only leaves
    with several hosts can be reached twice."""
    once, several = _by_hosts(attached)
    under = lambda part: reached.select("start", "node").join(part, F.col("node") == F.col("parent"))
    more = under(several).groupBy("start", "leaf").agg(F.first("leaf_class").alias("leaf_class"), F.min("edge_ord").alias("edge_ord"))
    return under(once).select("start", "leaf", "leaf_class", "edge_ord").union(more)


def counts_under(attached: DataFrame, reached: DataFrame) -> DataFrame:
    """(start, leaf_class, n) of points_under, from the counts of each host."""
    once, several = _by_hosts(attached)
    counted = reached.select("start", "node").join(host_histogram(once), F.col("node") == F.col("parent")).select("start", "leaf_class", "n")
    more = points_under(several, reached).groupBy("start", "leaf_class").agg(F.count("*").alias("n"))
    return counted.union(more).groupBy("start", "leaf_class").agg(F.sum("n").alias("n"))

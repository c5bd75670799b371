"""The structural skeleton: typed nodes without series, the relations among them, and its roots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.uri import STRUCTURAL_RELATIONS
from ..shared import stored
from .taxonomy import STRUCTURAL, read_types, top_types, write_types


@dataclass(frozen=True)
class Skeleton:
    """nodes(node_id, brick_class, top_type, node_ord), edges(edge_ord, src, rel, dst), roots(node_id)."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, that with the least order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*[c if c in keys else f"_x.{c}" for c in df.columns])


def build(nodes: DataFrame, edges: DataFrame, subclasses: DataFrame, known_at: str | None = None) -> Skeleton:
    """Of normalised nodes and edges. known_at: a table of resolved classes, read if it is there and written anew. Structural nodes are those of a structural type without a series; edges need both ends
    structural and count once; roots are the nodes that no edge leads to, isolated ones too."""
    known = read_types(nodes.sparkSession, known_at) if known_at else None
    types = stored(top_types(nodes, subclasses, known), "types")
    if known_at:
        write_types(types, known, known_at)
    typed = nodes.join(types, "brick_class").where(F.col("top_type").isin(*STRUCTURAL) & ~F.col("has_ts"))
    typed = stored(typed.select("node_id", "brick_class", "top_type", "node_ord"), "skeleton_nodes")
    ends = typed.select("node_id")
    own = edges.where(F.col("rel").isin(*STRUCTURAL_RELATIONS)).join(ends, F.col("src") == F.col("node_id"), "left_semi").join(ends, F.col("dst") == F.col("node_id"), "left_semi")
    own = stored(first_wins(own.select("edge_ord", "src", "rel", "dst"), ["src", "rel", "dst"], "edge_ord"), "skeleton_edges")
    return Skeleton(typed, own, ends.join(own, F.col("node_id") == F.col("dst"), "left_anti"))


def isolated(skeleton: Skeleton) -> DataFrame:
    ends = skeleton.edges.select(F.col("src").alias("node_id")).union(skeleton.edges.select("dst"))
    return skeleton.nodes.join(ends, "node_id", "left_anti").select("node_id")


def summary(skeleton: Skeleton) -> DataFrame:
    """(kind, name, n): nodes by type, edges by relation, roots, isolated nodes."""
    by = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [by(skeleton.nodes, "type", F.col("top_type")), by(skeleton.edges, "relation", F.col("rel")), by(skeleton.roots, "roots", F.lit("all")), by(isolated(skeleton), "isolated", F.lit("all"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def parents(skeleton: Skeleton, nodes: DataFrame) -> DataFrame:
    """(node_id, rel, parent) of nodes(node_id)."""
    return skeleton.edges.join(nodes.select(F.col("node_id").alias("dst")), "dst").select(F.col("dst").alias("node_id"), "rel", F.col("src").alias("parent"))


def children(skeleton: Skeleton, nodes: DataFrame) -> DataFrame:
    """(node_id, rel, child) of nodes(node_id)."""
    return skeleton.edges.join(nodes.select(F.col("node_id").alias("src")), "src").select(F.col("src").alias("node_id"), "rel", F.col("dst").alias("child"))

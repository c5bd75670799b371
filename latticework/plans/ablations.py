"""Baselines in place of a selector: covariates by hops, by class or at random, with a record for each target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import baselines, records
from .selection import Graph

#: What a run covers unless told otherwise.
STRATEGIES = ("1hop", "2hop", "3hop", "random", "same_ont")


def hops_of(strategy: str, k: int = 3) -> int | None:
    """The hops of a strategy: the number before "hop", k where none stands there; None for other strategies."""
    if not strategy.endswith("hop"):
        return None
    return int(strategy[:-3]) if strategy[:-3].isdigit() else k


class Ablations:
    """The strategies over one graph. Neighbourhoods are walked once, as far as any of the strategies needs."""

    def __init__(self, graph: Graph, strategies=STRATEGIES, k: int = 3, seed: int = 0):
        unknown = [s for s in strategies if hops_of(s, k) is None and s not in ("same_ont", "random")]
        if unknown:
            raise ValueError(f"unknown strategies: {', '.join(unknown)}")
        self.graph, self.k, self.seed, self.strategies = graph, k, seed, tuple(strategies)
        far = max([2 if "random" in strategies else 0, *(hops_of(s, k) or 0 for s in strategies)])
        self.reach = baselines.reach(graph.targets, graph.nodes, graph.edges, far) if far else None

    def chosen(self, strategy: str) -> DataFrame:
        """(target, leaf, ord): hops nearest first, same_ont by name, random as drawn, as many as there are within 2 hops."""
        g, most = self.graph, hops_of(strategy, self.k)
        by = lambda df, *order: df.select("target", "leaf", F.row_number().over(Window.partitionBy("target").orderBy(*order)).alias("ord"))
        if most is not None:
            near, leaves = self.reach
            return by(near.join(leaves.where(F.col("h") <= most), "kin").where("leaf <> target"), "h", "leaf")
        if strategy == "same_ont":
            return by(baselines.same_class(g.targets, g.nodes), "leaf")
        if strategy == "random":
            return baselines.random_matched(g.targets, g.nodes, self._within(2), self.seed)
        raise ValueError(f"unknown strategy: {strategy}")

    def _within(self, most: int) -> DataFrame:
        """(target, n): how many leaves within so many hops, without its pairs."""
        return baselines.hop_summary(*self.reach, most).select("target", F.col("n_leaves").alias("n"))

    def sizes(self, strategy: str) -> DataFrame:
        """(target, n_leaves) of every target; hops and same_ont are counted without their pairs, and random draws as many as there
        are within 2 hops, at most all others."""
        g, most = self.graph, hops_of(strategy, self.k)
        if strategy == "same_ont":
            own = baselines.same_class_sizes(g.targets, g.nodes)
        elif most is not None:
            own = self._within(most)
        elif strategy == "random":
            own = self._within(2)  # all of them other leaves with a series, so there are as many to draw
        else:
            own = self.chosen(strategy).groupBy("target").agg(F.count("*").alias("n"))
        return self.graph.targets.select("target").join(own, "target", "left").select("target", F.coalesce("n", F.lit(0)).cast("long").alias("n_leaves"))

    def records(self, strategy: str) -> DataFrame:
        """(target_uri, target_class, nodes, edges, n_leaves, leaves, llm_used, sampler): one row for each target."""
        listed = self.chosen(strategy).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
        out = self.graph.targets.join(listed, "target", "left").withColumn("leaves", F.coalesce("leaves", F.array().cast("array<string>")))
        return out.select(
            F.col("target").alias("target_uri"), "target_class", F.concat(F.array("target"), "leaves").alias("nodes"), F.array().cast("array<struct<src: string, rel: string, dst: string>>").alias("edges"),
            F.size("leaves").alias("n_leaves"), "leaves", F.lit(False).alias("llm_used"), F.lit(strategy).alias("sampler"),
        )

    def summary(self) -> DataFrame:
        """(sampler, n_targets, mean_leaves, median_leaves, n_zero): the median is the upper one; no row without targets."""
        out = None
        for s in self.strategies:
            row = records.size_summary(self.sizes(s)).select(F.lit(s).alias("sampler"), "*")
            out = row if out is None else out.union(row)
        return out

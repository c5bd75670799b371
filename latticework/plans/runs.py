"""Whole runs over a dataset's folder: skeleton, selection, baselines; each reads, computes, writes and returns its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pulls, records, skeleton
from ..sources import graphs
from .ablations import STRATEGIES, Ablations
from .selection import Graph, Selector, select


def load(spark: SparkSession, path: str, ontology: str | DataFrame, types: str | None = None) -> Graph:
    """The graph of a folder; ontology: a Turtle file or a table (class, superclass); types: a table of classes that are resolved
    already, which is read, if it is there, and written anew."""
    nodes, edges = graphs.read_graph(spark, path)
    return Graph(nodes, edges, graphs.read_subclasses(spark, ontology) if isinstance(ontology, str) else ontology, types)


def build_skeleton(spark: SparkSession, path: str, ontology: str | DataFrame, write: bool = True, types: str | None = None) -> tuple[Graph, DataFrame]:
    """The graph and the summary of its skeleton, which is written below path/skeleton."""
    graph = load(spark, path, ontology, types)
    if write:
        graphs.write_skeleton(graph.skeleton, f"{path}/skeleton")
    return graph, skeleton.summary(graph.skeleton)


def run_selection(graph: Graph, out: str | None, dataset: str, selector: Selector | None = None, verifier: Selector | None = None, limit: int = 0, max_leaves: int = pulls.MAX_LEAVES, sampler: str = "selector", form: str = "json") -> tuple[DataFrame, DataFrame]:
    """Records of a run, written below out with their envelope, and the run's summary."""
    found = select(graph, selector, verifier, limit, max_leaves)
    if out:
        graphs.write_records(found, out, dataset, sampler, form)
        found = graphs.read_records(graph.nodes.sparkSession, out, dataset, sampler, form, found.schema)
    return found, records.quality_summary(found.select("n_leaves", "fallback_used", "orphan"), max_leaves)


def run_ablations(graph: Graph, out: str | None, dataset: str, strategies: Sequence[str] = STRATEGIES, k: int = 3, seed: int = 0, form: str = "json") -> DataFrame:
    """The strategies' summary; their records are written below out, each with its envelope."""
    runs = Ablations(graph, strategies, k, seed)
    for s in strategies if out else ():
        graphs.write_records(runs.records(s), out, dataset, s, form)
    return runs.summary().withColumn("dataset", F.lit(dataset))

"""Covariate selection for all targets at once: spine, view, selector, pulls, audit, cap, record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import AUDITED, PICKED, parse
from ..operators import attach, lookup, pulls, records, skeleton, view
from ..shared import stored

#: contexts(target, context) -> answers(target, content, error). Runs once; its answers are written before anything reads them.
Selector = Callable[[DataFrame], DataFrame]


@dataclass
class Graph:
    """A building's normalised tables and what is derived from them. types: where resolved classes are kept between runs."""

    nodes: DataFrame
    edges: DataFrame
    subclasses: DataFrame
    types: str | None = None

    # each made when it is first read
    @cached_property
    def skeleton(self) -> skeleton.Skeleton:
        return skeleton.build(self.nodes, self.edges, self.subclasses, self.types)

    @cached_property
    def attached(self) -> DataFrame:
        return stored(attach.attachments(self.nodes, self.edges), "attached")

    @cached_property
    def members(self) -> DataFrame:
        return stored(attach.clusters(self.nodes, self.attached, self.skeleton), "clusters")

    @cached_property
    def targets(self) -> DataFrame:
        return stored(lookup.forecast_targets(self.nodes), "targets")


def replay(answers: DataFrame) -> Selector:
    """A selector that answers from a table (target, content), an error where there is none."""
    return lambda contexts: contexts.select("target").join(answers, "target", "left").select("target", "content", F.when(F.col("content").isNull(), "no answer").alias("error"))


def rule_pulls(targets: DataFrame, listed: DataFrame) -> DataFrame:
    """Pulls by rule: the target's own node, its class below the first parent, its cluster for targets without a host, and the
    outdoor temperature of the building."""
    first = listed.where("section = 'parent'").groupBy("target").agg(F.min("ord").alias("ord"))
    parent = listed.join(first, ["target", "ord"]).select("target", F.lit(1).alias("pull_ord"), F.col("node").alias("anchor"), F.lit("subtree").alias("expand"))
    parent = parent.join(targets.select("target", F.col("target_class").alias("point_class")), "target")
    none = F.lit(None).cast("string")
    host = listed.where("section = 'host'").select("target", F.lit(0), F.col("node"), F.lit("self"), none)
    lone = listed.where("section = 'cluster'").select("target", F.lit(0), F.col("node"), F.lit("cluster"), none)
    wide = targets.select("target", F.lit(2), F.lit(""), F.lit("building"), F.lit("Outside_Air_Temperature_Sensor"))
    return parent.union(host).union(lone).union(wide).withColumn("reason", F.lit("rule"))


def picked(answers: DataFrame, name: str = "pulls", schema: str = PICKED) -> DataFrame:
    """(target, pull_ord, anchor, expand, point_class, reason) of parsed answers; failed or unreadable ones ask for nothing."""
    return answers.select("target", F.posexplode(parse(F.col("content"), schema)[name]).alias("pull_ord", "x")).select("target", "pull_ord", "x.*")


def select(graph: Graph, selector: Selector | None = None, verifier: Selector | None = None, limit: int = 0, max_leaves: int = pulls.MAX_LEAVES) -> DataFrame:
    """Records of all targets (the first limit). selector None: pulls by rule. verifier: sees context and choice, adds and drops."""
    targets = graph.targets.orderBy("node_ord").limit(limit) if limit else graph.targets
    own = view.spine(targets, graph.attached, graph.skeleton)
    seen = view.views(own, graph.attached, graph.skeleton)
    listed = seen.listed
    contexts = answers = anchors = None
    if selector or verifier:
        contexts = view.contexts(targets, seen, graph.attached, graph.skeleton, graph.members)
        anchors = seen.places.join(view.anchors(seen.entries, "view"), "view").select("target", "alias", "node")
    if selector:
        answers = stored(selector(contexts).select("target", "content", "error"), "answers")
        asked = picked(answers.where("error is null"))
    else:
        asked = rule_pulls(targets, listed)
    asked = stored(asked, "asked")
    # pulls by rule name nodes, never aliases
    first = x = pulls.lists(asked, anchors if selector else None, graph.attached, graph.members, graph.skeleton)
    audit = None
    if verifier:
        summary = view.histogram_text(pulls.class_counts(x), ["target"], "leaf_class", 1 << 30)
        # Fixed value: the line before the choice that is audited.
        question = contexts.join(summary, "target", "left").select("target", F.concat("context", F.lit("\n\nCOVARIATES THE ENGINEER CHOSE (audit these):\n  "), F.coalesce("text", F.lit("(none)"))).alias("context"))
        audit = stored(verifier(question).select("target", "content", "error"), "audit")
        good = audit.where("error is null")
        drop = good.select("target", F.explode(parse(F.col("content"), AUDITED)["drop"]).alias("leaf_class")).distinct()
        added = pulls.candidates(stored(picked(good, "add", AUDITED), "added"), anchors, graph.attached, graph.members, graph.skeleton)
        added = stored(pulls.resolve(added), "added")
        said = good.select("target", parse(F.col("content"), AUDITED).alias("a")).select("target", F.coalesce("a.verdict", F.lit("")).alias("verdict"), F.array_sort(F.coalesce("a.drop", F.array().cast("array<string>"))).alias("dropped_classes"), F.coalesce("a.note", F.lit("")).alias("note"))
        more = added.groupBy("target").agg(F.count("*").alias("added"))
        audit = said.join(more, "target", "left").select("target", F.struct("verdict", F.coalesce("added", F.lit(0)).alias("added"), "dropped_classes", "note").alias("verifier"))
        x = pulls.audited_lists(x, drop, added)
    final = pulls.capped_lists(x, max_leaves, graph.attached, records.cone_names(own))
    before = pulls.totals(x).select("target", F.col("n_leaves").alias("n_pre_cap"))
    out = records.assemble(targets, own, final, view.place_roots(graph.skeleton, own), before)
    n_resolved = asked.join(pulls.pull_counts(first), ["target", "pull_ord"], "left").withColumn("n_resolved", F.coalesce("n_resolved", F.lit(0)))
    counted = n_resolved.groupBy("target").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pull_ord", "anchor", "expand", "point_class", "reason", "n_resolved"))), lambda x: F.struct(*[x[c].alias(c) for c in ("anchor", "expand", "point_class", "reason", "n_resolved")])).alias("pulls"))
    out = out.join(counted.withColumnRenamed("target", "target_uri"), "target_uri", "left")
    if answers is not None:
        said = answers.select(F.col("target").alias("target_uri"), F.col("error").alias("llm_error"), parse(F.col("content"))["summary"].alias("llm_summary"))
        out = out.join(said, "target_uri", "left").withColumn("fallback_used", F.col("llm_error").isNotNull())
    else:
        out = out.withColumns({"llm_error": F.lit(None).cast("string"), "llm_summary": F.lit(""), "fallback_used": F.lit(False)})
    out = out.withColumn("llm_used", F.lit(answers is not None) & ~F.col("fallback_used"))
    return out.join(audit.withColumnRenamed("target", "target_uri"), "target_uri", "left") if audit is not None else out

"""Work grows with what is asked, not with pairs of targets."""

import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_graph import SUB, make, rows

from latticework import catalogue, shared
from latticework.operators import attach, baselines, pulls, traverse, view
from latticework.plans import selection
from latticework.plans.ablations import Ablations


def hub(spark, many):
    """A hub with many leaves, a leaf two further steps away, and a leaf that a target feeds directly."""
    leaves = [(f"p{i:03d}", "Temperature_Sensor", True) for i in range(many)]
    nodes = [("h", "AHU", None), ("a", "AHU", None), ("far", "Sensor", True), ("own", "Sensor", True), *leaves]
    return make(spark, nodes, [("h", "hasPoint", p) for p, _, _ in leaves] + [("a", "feeds", "h"), ("a", "hasPoint", "far"), ("p000", "feeds", "own"), ("p001", "feeds", "p001")])


def test_neighbours_are_walked_once_for_targets_with_the_same_ones(spark):
    n, e, _ = hub(spark, 40)
    targets = n.where("node_id like 'p0%'").select(F.col("node_id").alias("target"), F.col("brick_class").alias("target_class"), "node_ord")
    near, leaves = baselines.reach(targets, n, e, 3)
    assert near.count() == 40 and leaves.count() < 3 * 42  # three sets of neighbours; pairs would be over 1,600
    ids = {f"p{i:03d}" for i in range(40)}
    want = sorted([(t, x, 2) for t in ids for x in ids - {t}] + [(t, "far", 3) for t in ids] + [("p000", "own", 1)] + [(t, "own", 3) for t in ids - {"p000"}])
    assert rows(baselines.hops(targets, n, e, 3), "target", "leaf", "h") == want
    for most in (1, 2, 3):
        by = {}
        for t, x, h in want:
            if h <= most:
                by.setdefault(t, []).append((x, h))
        expected = sorted((t, len(xs), min(xs)[0], max(xs)[0], sum(h for _, h in xs)) for t, xs in by.items())
        assert rows(baselines.hop_summary(near, leaves, most), "target", "n_leaves", "first_leaf", "last_leaf", "sum_h") == expected
    strategies = Ablations(SimpleNamespace(targets=targets, nodes=n, edges=e))
    assert rows(strategies.sizes("random"), "target", "n_leaves") == rows(strategies.chosen("random").groupBy("target").agg(F.count("*").alias("n_leaves")), "target", "n_leaves")


def test_graph_makes_what_is_read(spark, monkeypatch):
    n, e, _ = hub(spark, 3)
    g = selection.Graph(n, e, spark.createDataFrame(SUB, "class string, superclass string"))
    assert not {"skeleton", "attached", "members", "targets"} & set(vars(g))
    assert g.members.count() == 1 and "skeleton" in vars(g)
    monkeypatch.setattr(catalogue, "graph", None)
    monkeypatch.setattr(catalogue.fixture, "edges", None)
    assert catalogue.QUERIES["query_class"](spark, "/root/testdata/sf0.001").count() == 30


@pytest.mark.parametrize(("hot", "slots"), [(100_000, 8), (1, 8), (1, 0)])
def test_lists_count_and_cap_as_single_leaves_do(spark, monkeypatch, hot, slots):
    monkeypatch.setattr(pulls, "HOT", hot)
    monkeypatch.setattr(pulls, "MAX_SLOTS", slots)
    leaves = [(f"p{i:02d}", "AB"[i % 2], True) for i in range(30)]
    n, e, s = make(spark, [("b", "Building", None), ("z", "Zone", None), ("y", "Zone", None), *leaves, ("o.1", "A", True), ("o.2", "B", True)],
                   [("b", "hasPart", "z"), ("b", "hasPart", "y")] + [(x, "hasPoint", p) for i, (p, _, _) in enumerate(leaves) for x in ("z", "y", "b") if (x == "z") == (i < 12) or i % 7 == 0])
    attached = attach.attachments(n, e)
    members = attach.clusters(n, attached, s)
    of = [("z", "self", None), ("b", "subtree", "A"), ("", "building", "B"), ("b", "subtree", ""), ("z", "self", None), ("nowhere", "self", None)]
    asked = [(t, k, *p) for t in ("p00", "p05", "p29") for k, p in enumerate(of)] + [("o.1", 0, "__cluster__", "self", None), ("p01", 0, "b", "subtree", "A"), ("p01", 0, "z", "self", None)]
    asked = spark.createDataFrame(asked, "target string, pull_ord int, anchor string, expand string, point_class string")
    x = pulls.lists(asked, None, attached, members, s)
    assert x.leaves.count() == x.leaves.select("list", "leaf").distinct().count() < pulls.candidates(asked, None, attached, members, s).count()
    # leaf by leaf, without lists
    under = {r.parent: {} for r in attached.collect()}
    for r in attached.collect():
        under[r.parent][r.leaf] = (r.leaf_class, r.edge_ord)
    want = {}
    for t, k, a, mode, c in sorted(tuple(r) for r in asked.fillna("").collect()):
        hosts = {"self": [a], "subtree": ["b", "z", "y"], "building": ["b", "y", "z"]}[mode]
        given = {("o.2", "B", ("", 0))} if a == "__cluster__" else {(leaf, kind, (h if mode == "building" else "", o)) for h in hosts for leaf, (kind, o) in under.get(h, {}).items() if c in ("", kind)}
        for leaf, kind, key in given:
            if leaf != t:
                want[t, leaf] = min(want.get((t, leaf), ((99,), kind)), ((k, *key), kind))
    by = {}
    for (t, leaf), ((k, *key), kind) in want.items():
        by.setdefault(t, []).append((k, key, leaf, kind))
    assert rows(pulls.totals(x)) == sorted((t, len(v), min(r[2] for r in v), max(r[2] for r in v)) for t, v in by.items())
    assert rows(pulls.class_counts(x)) == sorted((t, c, sum(r[3] == c for r in v)) for t, v in by.items() for c in {r[3] for r in v})
    assert rows(pulls.pull_counts(x)) == sorted((t, k, sum(r[0] == k for r in v)) for t, v in by.items() for k in {r[0] for r in v})
    for most in (3, 14, 60):
        expected = sorted((t, [r[2] for r in sorted(v)][:most]) for t, v in by.items())
        assert rows(pulls.capped_lists(x, most), "target", "leaves") == expected
    drop = spark.createDataFrame([("p00", "A"), ("o.1", "B")], "target string, leaf_class string")
    add = spark.createDataFrame([("p00", "p02", "A", 2), ("p00", "p04", "A", 1), ("p29", "p03", "B", 1)], "target string, leaf string, leaf_class string, ord int")
    audited = pulls.audited(pulls.resolve(pulls.candidates(asked, None, attached, members, s)), drop, add)
    expected = rows(audited.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "leaf"))), lambda v: v["leaf"]).alias("leaves")))
    assert rows(pulls.capped_lists(pulls.audited_lists(x, drop, add)), "target", "leaves") == expected


def test_views_and_spines_are_made_once_for_shared_hosts(spark):
    many = [(f"p{i:02d}", "Temperature_Sensor", True) for i in range(20)]
    n, e, s = make(spark, [("b", "Building", None), ("z", "Zone", None), ("y", "Zone", None), *many],
                   [("b", "hasPart", "z"), ("b", "hasPart", "y"), *[("z", "hasPoint", p) for p, _, _ in many[:18]], ("z", "hasPoint", "p18"), ("y", "hasPoint", "p18")])
    attached = attach.attachments(n, e)
    targets = n.where("has_ts").select(F.col("node_id").alias("target"), F.col("brick_class").alias("target_class"), "node_ord")
    own = view.spine(targets, attached, s)
    assert own.cones.count() == 2 + 3 and own.nodes.count() == 18 * 2 + 3 and own.edges.count() == 18 + 2
    assert rows(own.nodes.where("start = 'p18'"), "node", "h") == [("b", 1), ("y", 0), ("z", 0)]
    seen = view.views(own, attached, s)
    assert seen.entries.count() == 3 + 3 and seen.listed.count() == 20 * 3  # hosts z and y are global drivers too
    assert rows(view.cohort_counts(targets, seen.places, seen.entries.where("section = 'parent'").select("view", "node"), attached, s)) == [(f"p{i:02d}", "b", 18) for i in range(19)]
    assert rows(attach.counts_under(attached, traverse.subtree(s, s.nodes.selectExpr("node_id as start", "node_id as node")))) == [("b", "Temperature_Sensor", 19), ("y", "Temperature_Sensor", 1), ("z", "Temperature_Sensor", 19)]
    members = attach.clusters(n, attached, s)
    texts = view.rendered(targets, view.lines(targets, seen.listed, attached, s, members))
    assert rows(view.contexts(targets, seen, attached, s, members)) == rows(texts)


def test_peers_of_a_large_cluster_are_joined_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(attach, "BLOCK", 4)
    monkeypatch.setattr(attach, "PAIRS_A_TASK", 1)
    members = spark.createDataFrame([(f"p{i:02d}", "a" if i < 30 else f"c{i // 2}", "AB"[i % 2]) for i in range(41)], "leaf string, cluster_key string, leaf_class string")
    out = attach.cluster_peers(members)
    assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 15  # a task for each cluster: at most 7
    all_ = members.collect()
    assert rows(out) == sorted((x.leaf, y.leaf, y.leaf_class) for x in all_ for y in all_ if x.leaf != y.leaf and x.cluster_key == y.cluster_key)
    assert attach.cluster_peers(members.limit(0)).count() == 0


def test_draws_of_a_target_are_one_list(spark, monkeypatch):
    drew = []
    monkeypatch.setattr(baselines, "stored", lambda df, name, plain=baselines.stored: drew.append(plain(df, name)) or drew[-1] if name == "drawn" else plain(df, name))
    n, e, _ = hub(spark, 40)
    targets = n.where("node_id like 'p0%'").select(F.col("node_id").alias("target"), F.col("brick_class").alias("target_class"), "node_ord")
    for want in (15, 99):
        sizes = targets.select("target", F.lit(want).cast("long").alias("n"))
        drew.clear()
        out = baselines.random_matched(targets, n, sizes, 3)
        assert drew[0].count() == 40  # a row for each target, not for each draw
        got = out.where("leaf <> target").groupBy("target").agg(F.count_distinct("leaf").alias("n"), F.max("ord").alias("last")).collect()
        assert len(got) == 40 and {(r.n, r["last"]) for r in got} == {(min(want, 41), min(want, 41))}


def test_shared_neighbourhoods_are_walked_once(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(traverse, "frontier", lambda *a, plain=traverse.frontier: walked.append(plain(*a)) or walked[-1])
    edges = [*((f"z{i:02d}", "c0") for i in range(30)), ("z00", "c2"), ("c0", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "end"), ("y", "end"), ("self", "self"), ("self", "end")]
    steps = spark.createDataFrame(edges, "node string, next string")
    seeds = [(x, x) for x in sorted({x for e in edges for x in e} | {"lone"})] + [("both", "z00"), ("both", "c3")]
    for sent, few, most in ((2_000_000, 1_000, None), (2_000_000, 0, 2), (0, 0, 3)):
        monkeypatch.setattr(traverse, "MAX_SENT", sent)
        monkeypatch.setattr(traverse, "FEW", few)
        want = {s: 0 for s in seeds}
        for h in range(1, 9 if most is None else most + 1):
            for start, b in [(start, b) for (start, a), at in want.items() if at == h - 1 for x, b in edges if x == a]:
                want.setdefault((start, b), h)
        assert rows(traverse.closure(spark.createDataFrame(seeds, "start string, node string"), steps, most), "start", "node", "h") == sorted((*k, h) for k, h in want.items())
        assert walked[-1].count() <= 5 * 5  # without the many nodes that nothing leads to


def test_paths_are_walked_once_for_each_parent(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(traverse, "stored", lambda df, name, plain=traverse.stored: walked.append(plain(df, name)) or walked[-1] if name == "paths" else plain(df, name))
    few = [f"c{i}" for i in range(7)]
    many = [f"z{i:02d}" for i in range(30)]
    hash_ = lambda *x: zlib.crc32(repr(x).encode())
    rels = ("feeds", "hasPart", "isLocationOf")
    edges = {(a, rels[hash_(a, b, k) % 3], b) for a in few for b in few for k in range(2) if hash_(a, b, k, "few") % 3 == 0}
    edges |= {(a, rels[hash_(a, b) % 3], b) for a in few for b in many[2:] if hash_(a, b, "many") % 3 == 0} | {("r", "isLocationOf", "c0"), ("r", "feeds", "z01"), ("s", "feeds", "s"), ("t", "hasPart", "s")}
    _, _, s = make(spark, [(x, "AHU", None) for x in [*few, *many, "r", "s", "t"]], sorted(edges))
    nodes = [*few, *many, "r", "s", "t"]
    roots = {x for x in nodes if not any(b == x for _, _, b in edges)}
    asked = [(x, x) for x in nodes] + [("both", "c3"), ("both", "z05"), ("twice", "z05"), ("twice", "z05"), ("gone", "nowhere")]

    def greedy(node, most):
        path = [node]
        while len(path) <= most and path[-1] not in roots:
            ways = [(rels.index(rel), rel, a) for a, rel, b in edges if b == path[-1] and a not in path]
            if not ways:
                break
            path.append(min(ways)[2])
        return path

    lengths = set()
    for most, sent in ((0, 9), (3, 0), (12, 2_000_000)):
        monkeypatch.setattr(traverse, "MAX_SENT", sent)
        walked.clear()
        want = sorted({(start, tuple(greedy(x, most))) for start, x in asked if x in nodes})
        assert sorted((r.start, tuple(r.path)) for r in traverse.primary_path(s, spark.createDataFrame(asked, "start string, node string"), most).collect()) == want
        assert all(df.count() <= 10 for df in walked)  # few, r, s and t, not many
        lengths |= {len(p) for _, p in want}
    assert max(lengths) > 5
    assert traverse.primary_path(s, spark.createDataFrame([], "start string, node string")).count() == 0


def test_one_step_deals_only_with_edges_between_targets_and_leaves(spark, monkeypatch):
    made = []
    monkeypatch.setattr(baselines, "stored", lambda df, name, plain=baselines.stored: made.append(plain(df, name)) or made[-1])
    n, e, _ = hub(spark, 40)
    own = lambda where: n.where(where).select(F.col("node_id").alias("target"), F.col("brick_class").alias("target_class"), "node_ord")
    targets = own("has_ts")
    assert rows(baselines.hops(targets, n, e, 1), "target", "leaf", "h") == [("own", "p000", 1), ("p000", "own", 1)]
    assert max(df.count() for df in made) <= 3  # the 43 edges lead both ways 83 times
    assert rows(baselines.hop_summary(*baselines.reach(targets, n, e, 1), 1)) == [("own", 1, "p000", "p000", 1), ("p000", 1, "own", "own", 1)]
    records = Ablations(SimpleNamespace(targets=targets, nodes=n, edges=e), ["1hop"]).records("1hop")
    assert rows(records.where("n_leaves > 0"), "target_uri", "n_leaves") == [("own", 1), ("p000", 1)] and records.count() == 42
    # a target need not be a leaf
    assert rows(baselines.hops(own("node_id in ('h', 'a', 'p000')"), n, e, 1), "target", "leaf", "h") == sorted([("a", "far", 1), ("p000", "own", 1), *(("h", f"p{i:03d}", 1) for i in range(40))])
    # what no edge reaches
    assert baselines.reach(targets, n, e.limit(0), 1)[1].count() == 0


def test_rows_are_dealt_out_once_to_be_numbered(spark):
    x = spark.range(500).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("nth")).repartition(5)
    for order in (["nth", "x"], [F.col("nth"), F.col("x") + 1]):
        out = shared.numbered(x, "place", *order)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
        want = sorted((r.nth, r.x) for r in x.collect())
        assert out.columns == ["place", "x", "nth"] and sorted((r.place, r.nth, r.x) for r in out.collect()) == [(i + 1, *k) for i, k in enumerate(want)]

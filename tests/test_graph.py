"""Edge cases on hand-written graphs."""

import pytest
from pyspark.sql import functions as F

from latticework.functions import answers, uri
from latticework.operators import attach, lookup, pulls, records, skeleton, timeseries, traverse, view
from latticework.plans import selection
from latticework.sources import graphs

SUB = [("Building", "Location"), ("AHU", "Equipment"), ("Zone", "Location"), ("Temperature_Sensor", "Sensor"), ("Sensor", "Point")]


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, c, t, False, k) for k, (i, c, t) in enumerate(nodes)], "node_id string, brick_class string, has_ts boolean, is_forecast_target boolean, node_ord long")
    e = spark.createDataFrame([(k, s, r, d) for k, (s, r, d) in enumerate(edges)], "edge_ord long, src string, rel string, dst string")
    n, e = graphs.normalize_nodes(n), graphs.normalize_edges(e)
    return n, e, skeleton.build(n, e, spark.createDataFrame(SUB, "class string, superclass string"))


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def starts(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "start string, node string")


def test_diamond_cycle_isolated_duplicate(spark):
    _, _, s = make(spark, [(x, "AHU", None) for x in "rabcxyzi"] + [("p", "Temperature_Sensor", True)],
                   [("r", "feeds", "a"), ("r", "feeds", "b"), ("a", "hasPart", "c"), ("b", "feeds", "c"), ("r", "feeds", "a"), ("x", "feeds", "y"), ("y", "feeds", "z"), ("z", "feeds", "x"), ("c", "hasPoint", "p"), ("c", "isPartOf", "r")])
    assert rows(s.roots) == [("i",), ("r",)]
    assert s.edges.count() == 7
    cone = traverse.up_cone(s, starts(spark, "c", "x", "p", "q"))
    assert rows(cone, "start", "node", "h") == [("c", "a", 1), ("c", "b", 1), ("c", "c", 0), ("c", "r", 2), ("x", "x", 0), ("x", "y", 2), ("x", "z", 1)]
    assert len(rows(traverse.cone_edges(s, cone).where("start = 'c'"))) == 4
    assert rows(traverse.subtree(s, starts(spark, "x")), "node") == [("x",), ("y",), ("z",)]
    assert rows(traverse.primary_path(s, starts(spark, "c", "x", "i")).select("start", F.array_join("path", ""))) == [("c", "cbr"), ("i", "i"), ("x", "xzy")]
    assert rows(skeleton.isolated(s)) == [("i",)]


def test_long_chain_stops(spark):
    names = [f"n{i:02d}" for i in range(16)]
    _, _, s = make(spark, [(x, "AHU", None) for x in names], [(a, "feeds", b) for a, b in zip(names, names[1:], strict=False)])
    cone = traverse.up_cone(s, starts(spark, "n15"))
    assert cone.count() == 13 and traverse.cone_edges(s, cone).count() == 12


def test_tie_path(spark):
    _, _, s = make(spark, [(x, "AHU", None) for x in "abc"], [("b", "feeds", "c"), ("a", "feeds", "c"), ("a", "hasPart", "c")])
    assert rows(traverse.primary_path(s, starts(spark, "c")).select(F.array_join("path", ""))) == [("ca",)]


def test_attachments(spark):
    n, e, s = make(spark, [("z", "Zone", None), ("l", "Temperature_Sensor", True), ("m", "Temperature_Sensor", True), ("d#x.y.o", "Sensor", True)],
                   [("l", "hasPoint", "z"), ("z", "global_hasPoint", "l"), ("l", "hasPoint", "m"), ("z", "hasPoint", "z"), ("ghost", "hasPoint", "m")])
    a = attach.attachments(n, e)
    assert rows(a, "parent", "leaf") == [("ghost", "m"), ("z", "l")]
    assert rows(attach.clusters(n, a, s), "leaf", "cluster_key") == [("d#x.y.o", "pfx:x.y"), ("m", "node:ghost")]
    assert rows(attach.orphan_leaves(n, a)) == [("d#x.y.o",)]


def test_duplicate_node_last_wins(spark):
    n = spark.createDataFrame([("a", "AHU", True, 0), ("a", None, None, 1)], "node_id string, brick_class string, has_timeseries boolean, node_ord long")
    assert rows(graphs.normalize_nodes(n), "node_id", "brick_class", "has_ts") == [("a", "", False)]


def test_pulls(spark):
    n, e, s = make(spark, [("b", "Building", None), ("z", "Zone", None), ("t", "Sensor", True), ("u", "Sensor", True), ("v", "Temperature_Sensor", True), ("o.1", "Sensor", True), ("o.2", "Sensor", True)],
                   [("b", "hasPart", "z"), ("z", "hasPoint", "t"), ("z", "hasPoint", "u"), ("b", "hasPoint", "v")])
    a = attach.attachments(n, e)
    members = attach.clusters(n, a, s)
    anchors = spark.createDataFrame([("t", "A1", "z"), ("o.1", "A1", "__cluster__")], "target string, alias string, node string")
    asked = spark.createDataFrame(
        [("t", 0, "A1", "self", ""), ("t", 1, "b", "subtree", None), ("t", 2, "", "building", None), ("t", 3, "", "building", "Sensor"), ("t", 4, "nowhere", "odd", None), ("o.1", 0, "A1", "self", None)],
        "target string, pull_ord int, anchor string, expand string, point_class string")
    kept = pulls.resolve(pulls.candidates(asked, anchors, a, members, s))
    assert rows(kept, "target", "leaf", "pull_ord", "ord") == [("o.1", "o.2", 0, 1), ("t", "u", 0, 1), ("t", "v", 1, 2)]
    assert rows(pulls.resolved_counts(asked, kept).where("target = 't'"), "pull_ord", "n_resolved") == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0)]


def test_cap(spark):
    kept = spark.createDataFrame([("t", f"l{i}", "c", i) for i in range(1, 62)], "target string, leaf string, leaf_class string, ord int")
    assert pulls.capped(kept).count() == 60


def test_audit_adds_survive_drops(spark):
    kept = spark.createDataFrame([("t", "a", "X", 1), ("t", "b", "Y", 2)], "target string, leaf string, leaf_class string, ord int")
    drop = spark.createDataFrame([("t", "X")], "target string, leaf_class string")
    add = spark.createDataFrame([("t", "c", "X", 1), ("t", "b", "Y", 2)], "target string, leaf string, leaf_class string, ord int")
    assert rows(pulls.audited(kept, drop, add), "leaf", "ord") == [("b", 1), ("c", 2)]


def test_answers(spark):
    texts = ['x ```json\n{"pulls": [{"anchor": "A1"}]}\n``` y', '{"pulls": [{"anchor": "A1"}]}', '{"pulls": []} tail', "none", "", None, '```json\n{"pulls": null}\n```']
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.size(answers.parse(F.col("t"))["pulls"]).alias("n"))
    assert [(r.i, r.n) for r in x.orderBy("i").collect()] == [(0, 1), (1, None), (2, 0), (3, None), (4, None), (5, None), (6, None)]


def test_uri(spark):
    x = spark.createDataFrame([("a/b#c.d.efghijklmnopqrstu",), ("a/b",), ("a#b#c",)], "u string")
    assert rows(x.select(uri.fragment(F.col("u")), uri.short(F.col("u")), uri.dotted_prefix(F.col("u")))) == [("b", "b", "b"), ("b#c", "b#c", "b#c"), ("c.d.efghijklmnopqrstu", "efghijklmnopqr", "c.d")]


def test_upper_median(spark):
    sizes = spark.createDataFrame([(n, False, n == 1) for n in (1, 2, 3, 4)], "n_leaves int, fallback_used boolean, orphan boolean")
    r = records.quality_summary(sizes, 4).first()
    assert (r.median_leaves, r.mean_leaves, r.min_leaves, r.max_leaves, r.cap_hits, r.orphan) == (3, 2.5, 1, 4, 1, 1)
    assert records.quality_summary(sizes.limit(0)).count() == 0


@pytest.mark.parametrize("n, flag", [(23, False), (24, True)])
def test_stuck(spark, n, flag):
    x = spark.createDataFrame([("s", i, 5.0 if i < n else float(i)) for i in range(40)], "sensor_id string, step long, value double")
    assert timeseries.outages(x).agg(F.max("stuck_flat")).first()[0] is flag


@pytest.mark.parametrize("n, flag", [(11, False), (12, True)])
def test_zero(spark, n, flag):
    x = spark.createDataFrame([("s", i, i % 2 * 1e-4 if i < n else float(i)) for i in range(40)], "sensor_id string, step long, value double")
    assert timeseries.outages(x).agg(F.max("drop_to_zero")).first()[0] is flag


@pytest.mark.parametrize("gap, filled", [(4, 4), (5, 0)])
def test_gaps(spark, gap, filled):
    inner = spark.createDataFrame([("s", i, None if 2 <= i < 2 + gap else float(i)) for i in range(12)], "sensor_id string, step long, value double")
    assert timeseries.interpolated(inner).where("value is not null").count() == 12 - gap + filled
    edge = spark.createDataFrame([("s", i, None if i < gap else float(i)) for i in range(12)], "sensor_id string, step long, value double")
    assert timeseries.edge_filled(edge).where("value is not null").count() == 12 - gap + 4


def test_turtle(spark, tmp_path):
    (tmp_path / "o.ttl").write_text('@prefix brick: <https://x/Brick#> .\nbrick:AHU a owl:Class ;\n  rdfs:label "A. B" ;\n  rdfs:subClassOf brick:Equipment, brick:HVAC .\nbrick:Zone rdfs:subClassOf [ a owl:R ] .\n')
    assert rows(graphs.read_subclasses(spark, f"file://{tmp_path}/o.ttl")) == [("AHU", "Equipment"), ("AHU", "HVAC")]


def test_selection_with_replay_and_audit(spark):
    nodes = [("b", "Building", None), ("z", "Zone", None), ("t", "Temperature_Sensor", True), ("u", "Temperature_Sensor", True), ("v", "Sensor", True)]
    n, e, _ = make(spark, nodes, [("b", "isLocationOf", "z"), ("z", "hasPoint", "t"), ("z", "hasPoint", "u"), ("b", "hasPoint", "v")])
    n = n.withColumn("is_forecast_target", F.col("node_id") == "t")
    g = selection.Graph(n, e, spark.createDataFrame(SUB, "class string, superclass string"))
    said = spark.createDataFrame([("t", '```json\n{"pulls": [{"anchor": "A1", "expand": "self"}], "summary": "s"}\n```')], "target string, content string")
    audit = spark.createDataFrame([("t", '```json\n{"verdict": "ok", "add": [{"anchor": "b", "expand": "self"}], "drop": ["Temperature_Sensor"], "note": ""}\n```')], "target string, content string")
    r = selection.select(g, selection.replay(said), selection.replay(audit)).first()
    assert (r.leaves, r.nodes, r.llm_summary, r.n_pre_cap, r.verifier.added, r.roots_reached) == (["v"], ["b", "t", "v", "z"], "s", 1, 1, ["b"])
    assert [(x.src, x.rel, x.dst) for x in r.edges] == [("b", "hasPoint", "v"), ("b", "isLocationOf", "z")]
    none = selection.select(g, selection.replay(said.limit(0))).first()
    assert none.fallback_used and none.leaves == [] and none.llm_error == "no answer"
    own = view.spine(g.targets, g.attached, g.skeleton)
    listed = view.entries(g.targets, own, g.attached, g.skeleton)
    text = view.rendered(g.targets, view.lines(g.targets, listed, g.attached, g.skeleton, g.members)).first().context
    assert "on target node [A1] Zone(z): self={Temperature_Sensor×2}" in text and "via isLocationOf <- [A2] Building(b)  = 1 Temperature_Sensor peers: u  self={Sensor×1}" in text


def test_neighbour_limit_and_targets(spark):
    n, e, _ = make(spark, [("a", "AHU", None), ("b", "AHU", None), ("c", "AHU", None)], [("a", "feeds", "b"), ("a", "feeds", "c"), ("a", "feeds", "b")])
    one = spark.createDataFrame([("a",)], "node_id string")
    assert rows(lookup.neighbours(n, e, one, ["feeds"], most=1), "neighbour") == [("b",)]
    assert rows(lookup.resolve(n, spark.createDataFrame([("a",), ("q",)], "name string")).select("name", F.coalesce("node_id", F.lit("-")))) == [("a", "a"), ("q", "-")]


def test_stream(spark, tmp_path):
    from latticework.streaming.regular import gridded

    src = str(tmp_path / "in")
    spark.createDataFrame([("s", "2024-01-01 00:01:00", 1.0), ("s", "2024-01-01 00:02:00", 3.0), ("s", "2024-01-01 05:00:00", 9.0)], "sensor_id string, ts string, value double").selectExpr("sensor_id", "cast(ts as timestamp) ts", "value").coalesce(1).write.parquet(src)
    q = gridded(spark.readStream.schema("sensor_id string, ts timestamp, value double").parquet(src)).writeStream.format("memory").queryName("gridded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("gridded"), "sensor_id", "n", "value") == [("s", 2, 2.0)]


@pytest.mark.parametrize(("name", "there"), [("neighbors_typed", 1100), ("neighbors_inverse", 0)])
def test_neighbours_are_not_capped(spark, monkeypatch, name, there):
    from types import SimpleNamespace

    from latticework import catalogue

    n, e, _ = make(spark, [("hub", "AHU", None)] + [(f"n{i}", "AHU", None) for i in range(1100)], [("hub", "hasPart", f"n{i}") for i in range(1100)] + [(f"n{i}", "feeds", "n0") for i in range(1, 1100)])
    monkeypatch.setattr(catalogue, "graph", lambda spark, sf_dir: SimpleNamespace(nodes=n, edges=e))
    out = catalogue.QUERIES[name](spark, "")
    assert out.where("node_id = 'hub'").count() == there
    assert out.where("node_id = 'n0'").count() == 1100


def test_same_class_lists_leaves(spark):
    from latticework.operators import baselines

    given = [("a", "S", True), ("b", "S", True), ("c", "S", None), ("d", "T", True), ("e", "S", True), ("f", "T", True), ("g", "U", True)]
    n, _, _ = make(spark, given, [("a", "feeds", "b")])
    targets = [("a", "S"), ("e", "S"), ("d", "T"), ("g", "U")]
    df = spark.createDataFrame(targets, "target string, target_class string")
    want = sorted((t, i) for t, k in targets for i, c, series in given if c == k and series and i != t)
    assert rows(baselines.same_class(df, n), "target", "leaf") == want
    assert rows(baselines.same_class_sizes(df, n), "target", "n") == sorted((t, sum(x == t for x, _ in want)) for t, _ in targets)

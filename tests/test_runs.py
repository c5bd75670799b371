"""Runs over a folder, baselines, the model client, raw sources and stored tables."""

import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework import shared
from latticework.operators import baselines, evaluate, lookup, taxonomy, timeseries
from latticework.plans import model, runs, selection
from latticework.plans.ablations import Ablations, hops_of
from latticework.sources import graphs

SUB = [("Building", "Location"), ("AHU", "Equipment"), ("Temperature_Sensor", "Sensor"), ("Sensor", "Point")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("building")
    nodes = [("b#r", "Building", None, False), ("b#a", "AHU", None, False), *((f"b#s{i:02d}", "Temperature_Sensor", True, i < 6) for i in range(12)), ("b#odd", "Strange", None, False)]
    edges = [("b#r", "isLocationOf", "b#a"), *(("b#a" if i % 2 else "b#r", "hasPoint", f"b#s{i:02d}") for i in range(11))]
    spark.createDataFrame([(*n, k) for k, n in enumerate(nodes)], "node_id string, brick_class string, has_ts boolean, is_forecast_target boolean, node_ord long").write.parquet(f"{at}/kg_nodes.parquet")
    spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], "src string, rel string, dst string, edge_ord long").write.parquet(f"{at}/kg_edges.parquet")
    (at / "o.ttl").write_text("\n".join(f"brick:{a} rdfs:subClassOf brick:{b} ." for a, b in SUB) + "\n")
    return at


def test_whole_runs(spark, folder):
    graph, summary = runs.build_skeleton(spark, f"file://{folder}", f"file://{folder}/o.ttl", types=f"file://{folder}/types")
    assert {(r.kind, r.name): r.n for r in summary.collect()}[("type", "Equipment")] == 1
    assert graphs.read_skeleton(spark, f"file://{folder}/skeleton").nodes.count() == 2
    known = taxonomy.read_types(spark, f"file://{folder}/types")
    assert {r.brick_class: r.top_type for r in known.collect()} == {"Building": "Location", "AHU": "Equipment", "Temperature_Sensor": "Point"}
    classes = spark.createDataFrame([("AHU",), ("Strange",)], "brick_class string")
    again = taxonomy.top_types(classes, spark.createDataFrame([], "class string, superclass string"), known)  # what is kept needs no ontology
    assert {(r.brick_class, r.top_type, r.resolved) for r in again.collect()} == {("AHU", "Equipment", True), ("Strange", "Point", False)}
    assert taxonomy.read_types(spark, f"file://{folder}/none") is None
    found, whole = runs.run_selection(graph, f"file://{folder}/out", "b", limit=4)
    assert found.count() == 4 and whole.first().n_targets == 4
    envelope = next((folder / "out/b/selector/envelope").glob("*.json"))
    assert json.loads(envelope.read_text()) == {"dataset": "b", "sampler": "selector", "n_targets": 4}
    ask = lambda system, user: '```json\n{"pulls": [{"anchor": "A1", "expand": "self", "point_class": "", "reason": "r"}], "summary": "s"}\n```'
    chosen, _ = runs.run_selection(graph, None, "b", model.chat(ask, delays=(0,)), max_leaves=2)
    assert {(r.n_leaves, r.n_pre_cap, r.llm_used, r.llm_summary) for r in chosen.collect()} == {(2, 5, True, "s"), (2, 4, True, "s")}
    out = {r.sampler: r for r in runs.run_ablations(graph, f"file://{folder}/ablations", "b").collect()}
    assert {s: r.n_targets for s, r in out.items()} == dict.fromkeys(("1hop", "2hop", "3hop", "random", "same_ont"), 6)
    assert (out["1hop"].mean_leaves, out["1hop"].n_zero, out["same_ont"].median_leaves) == (0, 6, 11) and out["random"].mean_leaves == out["2hop"].mean_leaves
    rows = graphs.read_records(spark, f"file://{folder}/ablations", "b", "random", "json").collect()
    assert all(r.nodes == [r.target_uri, *r.leaves] and len(set(r.leaves)) == r.n_leaves and r.target_uri not in r.leaves for r in rows)


def test_strategies(spark, folder):
    assert [hops_of(s, 5) for s in ("1hop", "12hop", "khop", "random")] == [1, 12, 5, None]
    graph = runs.load(spark, f"file://{folder}", spark.createDataFrame(SUB, "class string, superclass string"))
    with pytest.raises(ValueError, match="nearest"):
        Ablations(graph, ["1hop", "nearest"])
    near = Ablations(graph, ["3hop"]).chosen("3hop").collect()
    assert sorted(r.leaf for r in near if r.target == "b#s00") == [f"b#s{i:02d}" for i in range(1, 11)]


def test_random_is_uniform_and_whole(spark):
    nodes = spark.createDataFrame([(f"n{i}", "C", True) for i in range(10)], "node_id string, brick_class string, has_ts boolean")
    targets = spark.createDataFrame([(f"t{i}",) for i in range(400)] + [("n0",)], "target string")
    many = {}
    for n in (2, 8, 50):
        rows = baselines.random_matched(targets, nodes, targets.withColumn("n", F.lit(n))).collect()
        by = Counter(r.target for r in rows)
        assert all(by[t] == min(n, 9 if t == "n0" else 10) for t in by) and len(by) == 401
        assert len({(r.target, r.leaf) for r in rows}) == len(rows) and not any(r.target == r.leaf for r in rows)
        many[n] = Counter(r.leaf for r in rows)
    assert all(40 < many[2][f"n{i}"] < 125 for i in range(10)) and all(270 < many[8][f"n{i}"] < 370 for i in range(10))
    assert len({r.leaf for r in baselines.random_matched(targets.limit(1), nodes, targets.withColumn("n", F.lit(0))).collect()}) == 0


def test_retries():
    calls = []

    def ask(system, user):
        calls.append(user)
        raise RuntimeError(user)

    assert model.retried(ask, "", "read timeout", (0, 0, 0)) == (None, "RuntimeError: read timeout") and len(calls) == 3
    assert model.retried(ask, "", "no such model", (0, 0, 0)) == (None, "RuntimeError: no such model") and len(calls) == 4
    assert model.retried(lambda s, u: u.upper(), "", "x", (0,)) == ("X", None)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    out = shared.numbered(rows, "place", F.col("x")).collect()
    assert sorted((r.place, r.x) for r in out) == [(i + 1, i) for i in range(1000)]
    assert shared.numbered(rows.limit(0), "place", F.col("x")).count() == 0


def test_shared_folder_is_asked_for(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    kept = shared.stored(spark.range(3), "some")
    assert kept.count() == 3 and shared.shared_dir(spark).endswith(spark.sparkContext.applicationId)


def test_raw_sources(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix brick: <https://b#> .\n:r a brick:Building ; rdfs:label "The, house; x." .\n:a a brick:AHU ; brick:isPartOf :r ; brick:feeds :z, :y .\n:p a brick:Temperature_Sensor ; brick:isPointOf :a .\n:z a brick:Zone .\n:y a brick:Zone .\n')
    nodes, edges = graphs.read_building(spark, f"file://{tmp_path}/g.ttl", ["isPartOf", "feeds", "isPointOf"], spark.createDataFrame([(":p",)], "node_id string"))
    assert [(r.node_ord, r.node_id, r.brick_class, r.has_timeseries) for r in nodes.orderBy("node_ord").collect()] == [(1, ":a", "AHU", False), (2, ":p", "Temperature_Sensor", True), (3, ":r", "Building", False), (4, ":y", "Zone", False), (5, ":z", "Zone", False)]
    assert [(r.src, r.rel_canonical, r.dst) for r in edges.orderBy("edge_ord").collect()] == [(":r", "hasPart", ":a"), (":a", "feeds", ":z"), (":a", "feeds", ":y"), (":a", "hasPoint", ":p")]
    (tmp_path / "csv").mkdir()
    for name in ("one", "two"):
        (tmp_path / f"csv/{name}.csv").write_text("ts,value\n2024-01-01 00:00:00,1.5\n2024-01-02 00:00:00,\n")
    out = graphs.read_readings(spark, f"file://{tmp_path}/csv", start="2024-01-01", end="2024-01-02").collect()
    assert sorted((r.sensor_id, r.value) for r in out) == [("one", 1.5), ("two", 1.5)]
    (tmp_path / "meta.csv").write_text("Id,Units of x\none,kW\none,degC\ntwo,\n,kW\n")
    assert sorted(graphs.read_metadata(spark, f"file://{tmp_path}/meta.csv", "Id", unit="Units of x").collect()) == [("one", "degC" if "degC" < "kW" else "kW"), ("two", None)]
    with zipfile.ZipFile(tmp_path / "u.xlsx", "w") as box:
        box.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>sensor</t></si><si><r><t>deg</t></r><r><t>C</t></r></si></sst>')
        box.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>one</t></is></c><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert sorted((r.row, dict(r.cells)) for r in graphs.read_sheet(spark, f"file://{tmp_path}/u.xlsx").collect()) == [(1, {"A": "sensor", "C": "3.5"}), (2, {"A": "one", "B": "degC"})]


def test_control_points_and_inputs(spark):
    nodes = spark.createDataFrame([("a", "Zone_Setpoint", True, True, True, 0), ("b", "Air_Sensor", True, True, True, 1)], "node_id string, brick_class string, has_ts boolean, is_forecast_target boolean, is_usable boolean, node_ord long")
    assert [r.node_id for r in lookup.contexts(nodes, control_points=False).collect()] == ["b"] and lookup.contexts(nodes).count() == 2
    assert [r.target for r in lookup.forecast_targets(nodes).collect()] == ["b"] and lookup.forecast_targets(nodes, control_points=True).count() == 2
    grid = spark.createDataFrame([(s, k, float(k * k if s == "y" else k)) for s in ("y", "x") for k in range(10)], "sensor_id string, step long, value double")
    w = timeseries.windows(grid.where("sensor_id = 'y'"), 4, 3, 100)
    roles = spark.createDataFrame([("y", "x", "future-known"), ("y", "y", "past-known")], "target string, sensor_id string, availability string")
    read = timeseries.inputs(grid, w, roles).collect()
    assert Counter(r.sensor_id for r in read) == {"x": 7, "y": 4} and max(r.step for r in read if r.sensor_id == "y") == 3
    slope = 3.0  # of k^2 on k over 0..3
    out = evaluate.with_future(grid, w, "x").orderBy("lead").collect()
    assert [r.forecast for r in out] == pytest.approx([9 + slope, 9 + 2 * slope, 9 + 3 * slope])


def test_selector_errors_are_the_targets_own(spark):
    contexts = spark.createDataFrame([("t1", "1"), ("t2", "2"), ("t3", None)], "target string, context string")

    def ask(system, user):
        if user == "2":
            raise RuntimeError("bad")
        return user

    assert sorted(model.chat(ask, delays=(0,))(contexts).collect()) == [("t1", "1", None), ("t2", None, "RuntimeError: bad"), ("t3", "", None)]
    assert selection.replay(spark.createDataFrame([("t1", "x")], "target string, content string"))(contexts).where("error is null").count() == 1

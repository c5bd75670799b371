"""Reading and writing graphs, skeletons, records and ontologies."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uri import INVERSES, canonical
from ..shared import numbered


def _either(df: DataFrame, *names: str, default: Column) -> Column:
    """The first of the columns that exists, else the default."""
    return next((F.col(n) for n in names if n in df.columns), default)


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, brick_class ('' for null), node_type, has_ts, is_forecast_target, is_usable (True without the column),
    is_context_ts, node_ord; null flags are False; of rows with one id, that with the largest node_ord counts."""
    flag = lambda *n, default=False: F.coalesce(_either(nodes, *n, default=F.lit(default)).cast("boolean"), F.lit(False))
    text = lambda n: F.coalesce(_either(nodes, n, default=F.lit("")).cast("string"), F.lit(""))
    order = _either(nodes, "node_ord", default=F.monotonically_increasing_id())
    out = nodes.select(
        F.col("node_id").cast("string"), text("brick_class").alias("brick_class"), text("node_type").alias("node_type"), flag("has_timeseries", "has_ts").alias("has_ts"),
        flag("is_forecast_target").alias("is_forecast_target"), flag("is_usable", default=True).alias("is_usable"), flag("is_context_ts").alias("is_context_ts"), order.cast("long").alias("node_ord"),
    )
    rest = [c for c in out.columns if c != "node_id"]
    return out.groupBy("node_id").agg(F.max_by(F.struct(*rest), "node_ord").alias("x")).select("node_id", *[f"x.{c}" for c in rest])


def normalize_edges(edges: DataFrame, add_inverse: bool = False) -> DataFrame:
    """edge_ord, src, rel (rel_canonical where there is one), dst; add_inverse adds a reversed row under the inverse name."""
    out = edges.select(_either(edges, "edge_ord", default=F.monotonically_increasing_id()).cast("long").alias("edge_ord"), "src", _either(edges, "rel_canonical", "rel", default=F.lit("")).alias("rel"), "dst")
    if add_inverse:
        names = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in INVERSES.items()) for x in pair])
        out = out.union(out.where(names[F.col("rel")].isNotNull()).select("edge_ord", F.col("dst").alias("src"), names[F.col("rel")].alias("rel"), F.col("src").alias("dst")))
    return out


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Normalised kg_nodes.parquet and kg_edges.parquet of a folder."""
    return normalize_nodes(spark.read.parquet(f"{path}/kg_nodes.parquet")), normalize_edges(spark.read.parquet(f"{path}/kg_edges.parquet"))


_STATEMENT = re.compile(r"\.\s*(?=\n|$)")
_NAME = re.compile(r"(?:.*[#/:])?([A-Za-z0-9_.%-]+)>?$", re.S)


def _triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Subject, predicate and object of a Turtle text as written; literals are left out, nested blank nodes are one name."""
    text = re.sub(r"(?m)(^|\s)#.*$", "", re.sub(r'"""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*"', '""', text))
    for part in _STATEMENT.split(text):
        part = re.sub(r"\[[^\[\]]*\]", "_:b", part.strip())
        subject = part.split(None, 1)[0] if part.split() else ""
        if subject.lower() in ("@prefix", "@base", "prefix", "base", ""):
            continue
        for clause in part[len(subject) :].split(";"):
            words = clause.split(None, 1)
            for value in words[1].split(",") if len(words) == 2 else ():
                if value.strip() and not value.strip().startswith('"') and "_:" not in subject + value:
                    yield subject, words[0], value.strip()


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, subject, predicate, object) of Turtle files as written, prefixes kept. A task holds one file at a time.

    Statements are read whole ('.'-terminated), with ';' and ',' lists; enough for class hierarchies and building graphs, not all of
    Turtle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(_triples(text or ""))
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *columns], ["file", "nth", "subject", "predicate", "object"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInArrow(run, "file string, nth long, subject string, predicate string, object string")


def _local(c: str) -> Column:
    return F.regexp_extract(c, _NAME.pattern.replace("(?:.*", "(?s)(?:.*"), 1)


def read_subclasses(spark: SparkSession, path: str) -> DataFrame:
    """(class, superclass) of the rdfs:subClassOf triples of Turtle files, by local names; blank nodes are left out."""
    own = read_triples(spark, path).where(_local("predicate") == "subClassOf").select(_local("subject").alias("class"), _local("object").alias("superclass"))
    return own.where("class <> '' and superclass <> ''").distinct()


def read_building(spark: SparkSession, path: str, relations: list[str], series: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, as normalize_nodes and normalize_edges take them, of a building's Turtle graph: a node for each subject of
    rdf:type (its class the object's local name), an edge for each triple of the relations. series(node_id): nodes with readings."""
    triples = read_triples(spark, path)
    order = F.struct("file", "nth")
    typed = triples.where((F.col("predicate") == "a") | (_local("predicate") == "type")).groupBy(F.col("subject").alias("node_id")).agg(F.min_by(_local("object"), order).alias("brick_class"))
    held = F.lit(False) if series is None else F.col("has").isNotNull()
    if series is not None:
        typed = typed.join(series.select("node_id", F.lit(True).alias("has")).distinct(), "node_id", "left")
    nodes = numbered(typed.select("node_id", "brick_class", held.alias("has_timeseries"), held.alias("is_forecast_target")), "node_ord", F.col("node_id"))
    edges = triples.where(_local("predicate").isin(*relations)).select(F.col("subject").alias("src"), _local("predicate").alias("rel"), F.col("object").alias("dst"), "file", "nth")
    edges = numbered(edges.withColumn("rel_canonical", canonical(F.col("rel"))), "edge_ord", F.col("file"), F.col("nth"))
    # an inverse relation points the other way
    turned = F.col("rel") != F.col("rel_canonical")
    src, dst = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    return nodes, edges.select("edge_ord", src.alias("src"), "rel", "rel_canonical", dst.alias("dst"))


def write_skeleton(skeleton, path: str) -> None:
    """nodes, edges and roots as Parquet below path."""
    for name, df in (("nodes", skeleton.nodes), ("edges", skeleton.edges), ("roots", skeleton.roots)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_skeleton(spark: SparkSession, path: str):
    from ..operators.skeleton import Skeleton

    return Skeleton(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "roots")))


def write_records(records: DataFrame, path: str, dataset: str, sampler: str, form: str = "parquet") -> None:
    """Records below path/dataset/sampler/subgraphs, as Parquet or JSON lines, and beside them their envelope (dataset, sampler,
    n_targets) as JSON."""
    at = f"{path}/{dataset}/{sampler}"
    records.write.mode("overwrite").format(form).save(f"{at}/subgraphs")
    spark = records.sparkSession
    n = spark.read.schema(records.schema).format(form).load(f"{at}/subgraphs").count()
    spark.createDataFrame([(dataset, sampler, n)], "dataset string, sampler string, n_targets long").coalesce(1).write.mode("overwrite").json(f"{at}/envelope")


def read_records(spark: SparkSession, path: str, dataset: str, sampler: str, form: str = "parquet", schema=None) -> DataFrame:
    """Records that write_records has left."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(form).load(f"{path}/{dataset}/{sampler}/subgraphs")


def read_readings(spark: SparkSession, path: str, sensor: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """readings(sensor_id, ts, value) of CSV files with the columns ts and value, in a half-open range of time. sensor None: each
    file is a sensor's, named after the file."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.csv$", "") if sensor is None else F.lit(sensor)
    out = spark.read.schema("ts timestamp, value double").option("header", True).csv(path).select(name.alias("sensor_id"), "ts", "value")
    out = out.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else out
    return out.where(F.col("ts") < F.lit(end).cast("timestamp")) if end else out


def read_metadata(spark: SparkSession, path: str, sensor: str, **columns: str) -> DataFrame:
    """(sensor_id, ..) of a CSV table of sensors: sensor is the column of their ids, columns names others by what they are called
    here (unit="Units"); of rows with one id, the first by their values counts."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.where(F.col(f"`{sensor}`").isNotNull()).select(F.col(f"`{sensor}`").alias("sensor_id"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    return out.groupBy("sensor_id").agg(F.min(F.struct(*columns)).alias("x")).select("sensor_id", *[f"x.{n}" for n in columns]) if columns else out.distinct()


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, cells) of the first sheet of XLSX files: each row's texts by column letters, numbers as written."""

    def cells(data: bytes) -> Iterator[tuple[int, dict[str, str]]]:
        with zipfile.ZipFile(io.BytesIO(data)) as box:
            names = set(box.namelist())
            text = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
            shared = [text(e) for e in ElementTree.fromstring(box.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
            sheet = ElementTree.fromstring(box.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
            for row in (e for e in sheet.iter() if e.tag.endswith("}row")):
                own = {}
                for c in row:
                    value = next((v.text or "" for v in c if v.tag.endswith("}v")), None)
                    value = text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value else value
                    if value is not None:
                        own[c.get("r", "").rstrip("0123456789")] = value
                yield int(row.get("r", 0)), own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(cells(data))
                kind = pa.map_(pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int64()), pa.array([list(c.items()) for _, c in rows], kind)], ["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row long, cells map<string, string>")

"""Node and neighbour look-ups, and which nodes are forecast targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uri import CANONICAL, INVERSES, base_relation, fragment, is_global

# What a target's class must hold, and what it must not.
INCLUDE = (
    "Sensor", "Meter", "Temperature_Sensor", "Air_Temperature_Sensor", "Zone_Air_Temperature_Sensor", "Supply_Air_Temperature_Sensor", "Return_Air_Temperature_Sensor",
    "Water_Temperature_Sensor", "Flow_Sensor", "Flow_Rate_Sensor", "Pressure_Sensor", "Differential_Pressure_Sensor", "CO2_Sensor", "Humidity_Sensor", "Power_Sensor", "Electrical_Meter", "Energy_Meter",
)
CONTROL = ("Setpoint", "Command")
EXCLUDE = ("Setpoint", "Command", "Status", "Mode", "Alarm", "Fault", "Availability", "Enable", "Occupancy_Command")


def eligible(brick_class: Column) -> Column:
    """A class that may be forecast: holds an include substring and no exclude substring."""
    any_of = lambda words: "|".join(map(re.escape, words))
    return brick_class.rlike(any_of(INCLUDE)) & ~brick_class.rlike(any_of(EXCLUDE))


def is_control(brick_class: Column) -> Column:
    """A class that is set rather than measured."""
    return brick_class.rlike("|".join(CONTROL))


def contexts(nodes: DataFrame, control_points: bool = True) -> DataFrame:
    """(node_id, brick_class) of the nodes with a series that may serve as covariates; without control points if so told."""
    out = nodes.where("has_ts").select("node_id", "brick_class")
    return out if control_points else out.where(~is_control(F.col("brick_class")))


def forecast_targets(nodes: DataFrame, limit: int = 0, control_points: bool = False) -> DataFrame:
    """(target, target_class, node_ord); the first limit by node_ord, 0 for all. Control points are targets only if told so (and
    then need no eligible class)."""
    fits = eligible(F.col("brick_class")) if not control_points else eligible(F.col("brick_class")) | is_control(F.col("brick_class"))
    out = nodes.where(F.col("is_forecast_target") & F.col("is_usable") & F.col("has_ts") & fits)
    out = out.select(F.col("node_id").alias("target"), F.col("brick_class").alias("target_class"), "node_ord")
    return out.orderBy("node_ord").limit(limit) if limit else out


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node_id): a name that is an id, else the first id with that fragment, else null."""
    short = nodes.groupBy(fragment(F.col("node_id")).alias("name")).agg(F.min_by("node_id", "node_ord").alias("by_fragment"))
    out = names.select("name").join(nodes.select(F.col("node_id").alias("full")), F.col("name") == F.col("full"), "left").join(short, "name", "left")
    return out.select("name", F.coalesce("full", "by_fragment").alias("node_id"))


def metadata(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """brick_class, node_type and flags of ids(node_id); '?' and False for unknown ones."""
    text = lambda c: F.coalesce(c, F.lit("?")).alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return ids.select("node_id").join(nodes, "node_id", "left").select("node_id", text("brick_class"), text("node_type"), flag("has_ts"), flag("is_forecast_target"), flag("is_context_ts"))


def query_class(nodes: DataFrame, brick_class: str, has_ts: bool | None = None, most: int = 30) -> DataFrame:
    """The first nodes of a class by node_ord, at least one."""
    out = nodes.where(F.col("brick_class") == brick_class)
    out = out if has_ts is None else out.where(F.col("has_ts") == has_ts)
    return out.orderBy("node_ord").limit(max(most, 1))


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, relations: list[str], direction: str = "both", most: int | None = 30) -> DataFrame:
    """(node_id, rel, direction, neighbour, brick_class, has_ts) of starts(node_id), each (rel, neighbour) once, the first most by
    edge_ord, or all for None. A canonical relation goes out, in or both ways; an inverse one always follows its canonical edges backwards.
    Global relations count under their base name."""
    own = edges.select("edge_ord", "src", base_relation(F.col("rel")).alias("rel"), "dst")
    parts = []
    for r in relations:
        ways = [("in", INVERSES[r])] if r in INVERSES else [(w, r) for w in ("out", "in") if r in CANONICAL and direction in ("both", "outgoing" if w == "out" else "incoming")]
        for way, canonical in ways:
            here, there = ("src", "dst") if way == "out" else ("dst", "src")
            parts.append(own.where(F.col("rel") == canonical).select(F.col(here).alias("node_id"), F.lit(r).alias("rel"), F.lit(way).alias("direction"), F.col(there).alias("neighbour"), "edge_ord"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.join(starts.select("node_id"), "node_id", "left_semi").groupBy("node_id", "rel", "neighbour").agg(F.min(F.struct("edge_ord", "direction")).alias("x"))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("node_id").orderBy("x.edge_ord", "rel", "neighbour"))
        out = out.withColumn("nth", nth).where(F.col("nth") <= most)
    return _described(out.select("node_id", "rel", F.col("x.direction").alias("direction"), "neighbour"), nodes)


def global_neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, most: int = 50) -> DataFrame:
    """(node_id, rel, direction, neighbour, ..) over global relations only, under their own names."""
    own = edges.where(is_global(F.col("rel")))
    out = own.select(F.col("src").alias("node_id"), "rel", F.lit("out").alias("direction"), F.col("dst").alias("neighbour"), "edge_ord")
    out = out.union(own.select("dst", "rel", F.lit("in"), "src", "edge_ord")).join(starts.select("node_id"), "node_id", "left_semi")
    out = out.groupBy("node_id", "rel", "neighbour").agg(F.min(F.struct("edge_ord", "direction")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("x.edge_ord", "rel", "neighbour"))
    return _described(out.withColumn("nth", nth).where(F.col("nth") <= most).select("node_id", "rel", F.col("x.direction").alias("direction"), "neighbour"), nodes)


def _described(out: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("node_id").alias("neighbour"), "brick_class", "has_ts")
    out = out.join(known, "neighbour", "left")
    return out.select("node_id", "rel", "direction", "neighbour", F.coalesce("brick_class", F.lit("?")).alias("brick_class"), F.coalesce("has_ts", F.lit(False)).alias("has_ts"))

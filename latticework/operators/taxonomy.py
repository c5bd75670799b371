"""Classes and their top types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored

# Top types in order of precedence, structural types, classes whose type is given, the type of all others.
TOP_TYPES = ("Point", "Equipment", "Location", "Collection")
STRUCTURAL = ("Equipment", "Location", "Collection", "External")
OVERRIDES = {
    "Chilled_Water_Supply_Flow_Rate": "Point",
    "Hot_Water_Supply_Flow_Rate": "Point",
    "Outdoor_Air_Flow_Rate": "Point",
    "Outdoor_Air_Temperature_Sensor": "Point",
    "Outdoor_Air_Humidity_Sensor": "Point",
    "Hot_Water_Temperature_Sensor": "Point",
    "Electrical_Energy_Sensor": "Point",
    "Electrical_Generation_Meter": "Point",
    "Electrical_Storage_Meter": "Point",
    "Economizer_Setpoint": "Point",
    "Return_Air_Fan_Speed": "Point",
    "Supply_Air_Fan_Speed": "Point",
    "Occupant_Count": "Point",
    "Sensor_Ext": "Point",
    "Electrical_Circuit": "Equipment",
    "Outdoor_Air_Damper": "Equipment",
    "Solar_Inverter": "Equipment",
    "Wifi_AP": "Equipment",
    "Locationoratory": "Location",
    "Kitchen": "Location",
    "_Kitchen": "Location",
    "Room_Kitchen": "Location",
    "space_Kitchen": "Location",
    "space": "Location",
    "Open_": "Location",
    "Open_space": "Location",
    "Enclosed_space": "Location",
    "Shared_space": "Location",
    "Unknown_Ext": "External",
}
FALLBACK = "Point"


def ancestors(subclasses: DataFrame) -> DataFrame:
    """(class, ancestor) of the transitive closure, each class its own ancestor; cycles are fine."""
    reached = subclasses.select("class").union(subclasses.select("superclass")).distinct().select("class", F.col("class").alias("ancestor"))
    newest, step = reached, subclasses.select(F.col("class").alias("ancestor"), "superclass").distinct()
    while True:
        found = newest.join(F.broadcast(step) if step.limit(100_001).count() <= 100_000 else step, "ancestor").select("class", F.col("superclass").alias("ancestor")).distinct()
        newest = stored(found.join(reached, ["class", "ancestor"], "left_anti"), "ancestors")
        if newest.isEmpty():
            return reached
        reached = stored(reached.union(newest), "ancestors")


def top_types(classes: DataFrame, subclasses: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(brick_class, top_type, resolved) of classes(brick_class): override, else known (brick_class, top_type), else the first
    top type among the ancestors, else the fallback, which counts as unresolved. Null and empty classes are left out."""
    spark = classes.sparkSession
    rank = spark.createDataFrame([(t, i) for i, t in enumerate(TOP_TYPES)], "ancestor string, place int")
    given = spark.createDataFrame(list(OVERRIDES.items()), "brick_class string, given string")
    found = ancestors(subclasses).join(F.broadcast(rank), "ancestor").groupBy(F.col("class").alias("brick_class")).agg(F.min_by("ancestor", "place").alias("found"))
    own = spark.createDataFrame([(t, t) for t in TOP_TYPES], "brick_class string, self string")
    out = classes.select("brick_class").where("brick_class <> ''").distinct()
    out = out.join(F.broadcast(given), "brick_class", "left").join(found, "brick_class", "left").join(F.broadcast(own), "brick_class", "left")
    cached = F.lit(None).cast("string")
    if known is not None:
        out, cached = out.join(known.select("brick_class", F.col("top_type").alias("cached")), "brick_class", "left"), F.col("cached")
    best = F.coalesce("given", cached, "found", "self")
    return out.select("brick_class", F.coalesce(best, F.lit(FALLBACK)).alias("top_type"), best.isNotNull().alias("resolved"))


def read_types(spark: SparkSession, path: str) -> DataFrame | None:
    """Resolved classes (brick_class, top_type) that write_types has left; None where there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def write_types(types: DataFrame, known: DataFrame | None, path: str) -> None:
    """Adds the resolved classes of top_types to the known ones; those that fell back are not kept."""
    own = types.where("resolved").select("brick_class", "top_type")
    every = own if known is None else own.union(known.select("brick_class", "top_type").join(own, "brick_class", "left_anti"))
    stored(every, "known_types").write.mode("overwrite").parquet(path)

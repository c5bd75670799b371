"""A building graph derived from the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import numbered, stored

NODES = """
select concat('b/x#reg', r_regionkey) node_id, 'Building' brick_class, false has_timeseries, false is_forecast_target from region
union all select concat('b/x#nat', n_nationkey), 'Floor', false, false from nation
union all select concat('b/x#sup', s_suppkey), 'AHU', false, false from supplier
union all select concat('b/x#cus', c_custkey), 'HVAC_Zone', false, false from customer
union all select distinct concat('b/x#cir', replace(p_brand,'Brand#','')), 'Electrical_Circuit', false, false from part
union all select concat('b/x#wx', r_regionkey), 'Unknown_Ext', false, false from region
union all select concat('b/x#oat', r_regionkey), 'Outside_Air_Temperature_Sensor', true, false from region
union all select concat('b/x#ord', o_orderkey),
  case substr(o_orderpriority,1,1) when '1' then 'Zone_Air_Temperature_Sensor' when '2' then 'CO2_Sensor'
       when '3' then 'Zone_Air_Humidity_Sensor' when '4' then 'Occupancy_Status' else 'Zone_Air_Temperature_Setpoint' end,
  case when o_orderstatus='P' then null else true end, substr(o_orderpriority,1,1) in ('1','2','3') from orders
union all select distinct concat('b/x#site.dev', user_id % 10, '.u', user_id), 'Electrical_Power_Sensor', true, true from events"""

EDGES = """
select concat('b/x#reg', n_regionkey) src, 'isLocationOf' rel, 'isLocationOf' rel_canonical, concat('b/x#nat', n_nationkey) dst from nation
union all select concat('b/x#nat', s_nationkey), 'isPartOf', 'hasPart', concat('b/x#sup', s_suppkey) from supplier
union all select concat('b/x#nat', c_nationkey), 'isPartOf', 'hasPart', concat('b/x#cus', c_custkey) from customer
union all select distinct concat('b/x#sup', l_suppkey), 'feeds','feeds', concat('b/x#cus', o_custkey) from lineitem join orders on l_orderkey=o_orderkey where l_linenumber=1
union all select distinct concat('b/x#cir', replace(p_brand,'Brand#','')), 'feeds','feeds', concat('b/x#sup', l_suppkey) from lineitem join part on l_partkey=p_partkey where l_linenumber=2 and l_quantity>=49
union all select concat('b/x#sup', s_suppkey), 'feeds','feeds', concat('b/x#sup', (s_suppkey+1)%3) from supplier where s_suppkey<3
union all select concat('b/x#cus', o_custkey), 'hasPoint','hasPoint', concat('b/x#ord', o_orderkey) from orders
union all select concat('b/x#cus', o_custkey), 'isPointOf','hasPoint', concat('b/x#ord', o_orderkey) from orders where o_orderkey % 10 = 0
union all select concat('b/x#reg', r_regionkey), 'hasPoint','global_hasPoint', concat('b/x#oat', r_regionkey) from region
union all select concat('b/x#wx', r_regionkey), 'hasPoint','hasPoint', concat('b/x#oat', r_regionkey) from region
union all select distinct concat('b/x#ghost', user_id % 4), 'hasPoint','hasPoint', concat('b/x#site.dev', user_id % 10, '.u', user_id) from events where user_id % 5 = 0"""

SUBCLASSES = (
    ("Building", "Location"), ("Floor", "Location"), ("HVAC_Zone", "Zone"), ("Zone", "Location"), ("AHU", "HVAC_Equipment"), ("HVAC_Equipment", "Equipment"),
    ("Zone_Air_Temperature_Sensor", "Temperature_Sensor"), ("Outside_Air_Temperature_Sensor", "Temperature_Sensor"), ("Temperature_Sensor", "Sensor"), ("CO2_Sensor", "Sensor"),
    ("Zone_Air_Humidity_Sensor", "Sensor"), ("Electrical_Power_Sensor", "Sensor"), ("Sensor", "Point"), ("Occupancy_Status", "Status"), ("Status", "Point"),
    ("Zone_Air_Temperature_Setpoint", "Setpoint"), ("Setpoint", "Point"),
)

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_made: dict[tuple[str, str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, sql: str, name: str, *order: str) -> DataFrame:
    """A table of the graph with its rows' numbers; written to the shared folder once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        for table in _TABLES:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        _made[key] = stored(numbered(spark.sql(sql), name, *order), name)
    return _made[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, NODES, "node_ord", "node_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, EDGES, "edge_ord", "rel_canonical", "src", "dst", "rel")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, subclasses)."""
    return nodes(spark, sf_dir), edges(spark, sf_dir), spark.createDataFrame(SUBCLASSES, "class string, superclass string")

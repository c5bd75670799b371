"""Series on a regular grid: resampling, gaps, outages, splits and forecast windows. readings(sensor_id, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drawn
from .lookup import resolve

STEP_S = 900
GAP, EDGE = 4, 4
STUCK, ZERO, NEAR_ZERO = 24, 12, 1e-3
MISSING = 0.30
INVALID = 0.5


def grid(readings: DataFrame, step_s: int = STEP_S) -> DataFrame:
    """(sensor_id, step, value): the mean of each step from a series' first to its last; null where nothing was read. step counts
    from the epoch."""
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(step_s * 1_000_000)).cast("long")
    means = readings.groupBy("sensor_id", step.alias("step")).agg(F.avg("value").alias("value"))
    spans = means.groupBy("sensor_id").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    every = spans.select("sensor_id", F.explode(F.sequence("a", "b")).alias("step"))
    return every.join(means, ["sensor_id", "step"], "left")


def missing_ratio(gridded: DataFrame) -> DataFrame:
    return gridded.groupBy("sensor_id").agg(F.count("*").alias("n_steps"), F.count("value").alias("n_valid"), F.avg(F.col("value").isNull().cast("double")).alias("missing_ratio"))


def retained(gridded: DataFrame, most_missing: float = MISSING, least_valid: int = 0) -> DataFrame:
    """The series that miss no more than that share and have that many valid steps."""
    good = missing_ratio(gridded).where((F.col("missing_ratio") <= most_missing) & (F.col("n_valid") >= least_valid))
    return gridded.join(good.select("sensor_id"), "sensor_id", "left_semi")


def _by(sensor: str = "sensor_id"):
    return Window.partitionBy(sensor).orderBy("step")


def interpolated(gridded: DataFrame, most: int = GAP) -> DataFrame:
    """Gaps of at most so many steps between two values, filled on a straight line."""
    before, after = _by().rowsBetween(Window.unboundedPreceding, -1), _by().rowsBetween(1, Window.unboundedFollowing)
    valid = F.when(F.col("value").isNotNull(), F.struct("step", "value"))
    x = gridded.withColumns({"p": F.last(valid, True).over(before), "q": F.first(valid, True).over(after)})
    width = F.col("q.step") - F.col("p.step")
    line = F.col("p.value") + (F.col("q.value") - F.col("p.value")) * (F.col("step") - F.col("p.step")) / width
    return x.select("sensor_id", "step", F.coalesce("value", F.when(width - 1 <= most, line)).alias("value"))


def edge_filled(gridded: DataFrame, most: int = EDGE) -> DataFrame:
    """Up to so many steps before the first and after the last value of a series get that value."""
    whole = Window.partitionBy("sensor_id")
    valid = F.when(F.col("value").isNotNull(), F.struct("step", "value"))
    x = gridded.withColumns({"a": F.min(valid).over(whole), "b": F.max(valid).over(whole)})
    head = F.when((F.col("step") < F.col("a.step")) & (F.col("a.step") - F.col("step") <= most), F.col("a.value"))
    tail = F.when((F.col("step") > F.col("b.step")) & (F.col("step") - F.col("b.step") <= most), F.col("b.value"))
    return x.select("sensor_id", "step", F.coalesce("value", head, tail).alias("value"))


def _long_runs(x: DataFrame, broken: Column, inside: Column, least: int) -> DataFrame:
    """flag: in a run of at least so many rows; broken: a run starts here; inside: rows that count."""
    runs = x.withColumn("run", F.sum(F.coalesce(broken.cast("int"), F.lit(1))).over(_by()))
    many = F.count("*").over(Window.partitionBy("sensor_id", "run"))
    return runs.withColumn("flag", F.coalesce(inside, F.lit(False)) & (many >= least))


def outages(gridded: DataFrame, stuck: int = STUCK, zero: int = ZERO, near_zero: float = NEAR_ZERO) -> DataFrame:
    """(sensor_id, step, value, stuck_flat, drop_to_zero, outage_mask): runs of one value, runs of values near zero."""
    value, last = F.col("value"), F.lag("value").over(_by())
    flat = _long_runs(gridded, (value.isNull() | last.isNull() | (value != last)), value.isNotNull(), stuck).drop("run").withColumnRenamed("flag", "stuck_flat")
    low = F.coalesce(F.abs(value) <= near_zero, F.lit(False))
    flat = flat.withColumn("low", low)
    out = _long_runs(flat, F.col("low") != F.coalesce(F.lag("low").over(_by()), ~F.col("low")), F.col("low"), zero).drop("run", "low").withColumnRenamed("flag", "drop_to_zero")
    return out.withColumn("outage_mask", F.col("stuck_flat") | F.col("drop_to_zero"))


def horizon_validity(masked: DataFrame, horizon: int, most: float = INVALID) -> DataFrame:
    """(sensor_id, step, invalid_share, usable): of the horizon's steps from here on, the share that is null or masked."""
    ahead = _by().rowsBetween(0, horizon - 1)
    bad = (F.col("value").isNull() | F.col("outage_mask")).cast("double")
    x = masked.select("sensor_id", "step", F.sum(bad).over(ahead).alias("bad"), F.count("*").over(ahead).alias("n"))
    share = (F.col("bad") + (horizon - F.col("n"))) / horizon
    return x.select("sensor_id", "step", share.alias("invalid_share"), (share <= most).alias("usable"))


def calendar_split(ts: Column, start: str, train: int = 3, val: int = 1, test: int = 2) -> Column:
    """train, val or test by whole months since the start's month; null outside."""
    first = F.lit(start).cast("date")
    months = (F.year(ts) - F.year(first)) * 12 + F.month(ts) - F.month(first)
    return F.when(months < 0, None).when(months < train, "train").when(months < train + val, "val").when(months < train + val + test, "test")


def windows(gridded: DataFrame, lookback: int, horizon: int, stride: int) -> DataFrame:
    """(sensor_id, origin, first_step, last_step): whole windows of a series, every stride steps; origin is the first step to be
    forecast."""
    spans = gridded.groupBy("sensor_id").agg(F.min("step").alias("a"), F.max("step").alias("b")).where(F.col("b") - F.col("a") + 1 >= lookback + horizon)
    origin = F.explode(F.sequence(F.col("a") + lookback, F.col("b") - horizon + 1, F.lit(stride).cast("long")))
    return spans.select("sensor_id", origin.alias("origin")).select("sensor_id", "origin", (F.col("origin") - lookback).alias("first_step"), (F.col("origin") + horizon - 1).alias("last_step"))


def between(readings: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Readings from start on and before end; either may be open."""
    out = readings if start is None else readings.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return out if end is None else out.where(F.col("ts") < F.lit(end).cast("timestamp"))


def of_sites(df: DataFrame, sites: list[str] | None, column: str = "site") -> DataFrame:
    """The rows of some sites, or of all for None."""
    return df if sites is None else df.where(F.col(column).isin(*sites))


def on_nodes(sensors: DataFrame, nodes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(sensor_id, node_id, brick_class) of sensors(sensor_id): the node of overrides(sensor_id, node_id), else that with the
    sensor's name as its id or the first with it as its fragment; null, '' where there is none."""
    ids = sensors.select("sensor_id").distinct()
    found = resolve(nodes, ids.withColumnRenamed("sensor_id", "name")).withColumnRenamed("name", "sensor_id").withColumnRenamed("node_id", "own")
    given = found.withColumn("given", F.lit(None).cast("string")) if overrides is None else found.join(overrides.select("sensor_id", F.col("node_id").alias("given")), "sensor_id", "left")
    out = given.select("sensor_id", F.coalesce("given", "own").alias("node_id")).join(nodes.select("node_id", "brick_class"), "node_id", "left")
    return out.select("sensor_id", "node_id", F.coalesce("brick_class", F.lit("")).alias("brick_class"))


def inputs(gridded: DataFrame, windows: DataFrame, roles: DataFrame) -> DataFrame:
    """(target, origin, sensor_id, step, value): what a forecast of each window(sensor_id, origin, first_step, last_step) may read of
    the covariates roles(target, sensor_id, availability): the history, and of future-known ones the horizon as well."""
    asked = windows.withColumnRenamed("sensor_id", "target").join(roles, "target")
    last = F.when(F.col("availability") == "future-known", F.col("last_step")).otherwise(F.col("origin") - 1)
    steps = asked.select("target", "origin", "sensor_id", F.explode(F.sequence("first_step", last)).alias("step"))
    return steps.join(gridded, ["sensor_id", "step"]).select("target", "origin", "sensor_id", "step", "value")


def availability(brick_class: Column) -> Column:
    """future-known (weather, schedules, calendar) or past-known, by class."""
    return F.when(brick_class.rlike("Outside_Air|Outdoor_Air|Weather|Solar|Schedule|Calendar|Occupancy_Schedule"), "future-known").otherwise("past-known")


def noisy(gridded: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """value plus Gaussian noise of so many standard deviations of the series, hashed from sensor and step."""
    unit = lambda k: (drawn(F.lit(f"{seed}|{k}"), F.col("sensor_id"), F.col("step").cast("string")).cast("double") + 0.5) / F.lit(float(1 << 52))
    gauss = F.sqrt(-2 * F.log(unit(1))) * F.cos(F.lit(6.283185307179586) * unit(2))
    spread = F.coalesce(F.stddev_pop("value").over(Window.partitionBy("sensor_id")), F.lit(0.0))
    return gridded.select("sensor_id", "step", (F.col("value") + sigma * spread * gauss).alias("value"))

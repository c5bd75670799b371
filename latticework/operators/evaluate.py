"""Naive forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _asked(gridded: DataFrame, windows: DataFrame) -> DataFrame:
    """(sensor_id, origin, lead, actual) of every step to be forecast."""
    leads = windows.select("sensor_id", "origin", F.explode(F.sequence("origin", "last_step")).alias("step"))
    return leads.join(gridded, ["sensor_id", "step"]).select("sensor_id", "origin", (F.col("step") - F.col("origin") + 1).alias("lead"), "step", F.col("value").alias("actual"))


def persistence(gridded: DataFrame, windows: DataFrame) -> DataFrame:
    """(sensor_id, origin, lead, actual, forecast): the last value before the origin."""
    before = Window.partitionBy("sensor_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = gridded.select("sensor_id", F.col("step").alias("origin"), F.last("value", True).over(before).alias("forecast"))
    return _asked(gridded, windows).join(last, ["sensor_id", "origin"]).select("sensor_id", "origin", "lead", "actual", "forecast")


def seasonal(gridded: DataFrame, windows: DataFrame, season: int) -> DataFrame:
    """(sensor_id, origin, lead, actual, forecast): the value whole seasons earlier, from the last season before the origin."""
    asked = _asked(gridded, windows).withColumn("then", F.col("step") - F.expr(f"((lead - 1) div {season} + 1) * {season}"))
    past = gridded.select("sensor_id", F.col("step").alias("then"), F.col("value").alias("forecast"))
    return asked.join(past, ["sensor_id", "then"], "left").select("sensor_id", "origin", "lead", "actual", "forecast")


def with_future(gridded: DataFrame, windows: DataFrame, covariate: str) -> DataFrame:
    """(sensor_id, origin, lead, actual, forecast): the last value before the origin, moved by the covariate's change since then
    times the slope of the series on the covariate over the window's history. The covariate is future-known: its values in the
    horizon are read. Without it (as past-known) the change is unknown and the forecast is persistence; a covariate that never
    varies has slope 0."""
    x = gridded.where(F.col("sensor_id") == covariate).select("step", F.col("value").alias("x"))
    past = windows.select("sensor_id", "origin", F.explode(F.sequence("first_step", F.col("origin") - 1)).alias("step"))
    pairs = past.join(gridded, ["sensor_id", "step"]).join(x, "step").where(F.col("value").isNotNull() & F.col("x").isNotNull())
    slope = pairs.groupBy("sensor_id", "origin").agg(F.coalesce(F.covar_pop("value", "x") / F.when(F.var_pop("x") > 0, F.var_pop("x")), F.lit(0.0)).alias("slope"))
    before = Window.partitionBy("sensor_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = gridded.where(F.col("sensor_id") == covariate).select(F.col("step").alias("origin"), F.last("value", True).over(before).alias("x0"))
    own = persistence(gridded, windows).withColumn("step", F.col("origin") + F.col("lead") - 1)
    out = own.join(slope, ["sensor_id", "origin"], "left").join(last, "origin", "left").join(x, "step", "left")
    moved = F.col("forecast") + F.coalesce(F.col("slope") * (F.col("x") - F.col("x0")), F.lit(0.0))
    return out.select("sensor_id", "origin", "lead", "actual", moved.alias("forecast"))


def errors(forecasts: DataFrame, gridded: DataFrame) -> DataFrame:
    """(sensor_id, n, nmae, nmse): absolute errors over the series' standard deviation, squared ones over its variance; steps
    without a value or forecast are left out, and series that never vary."""
    spread = gridded.groupBy("sensor_id").agg(F.stddev_pop("value").alias("sd")).where("sd > 0")
    e = F.col("actual") - F.col("forecast")
    x = forecasts.where(e.isNotNull()).groupBy("sensor_id").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse")).join(spread, "sensor_id")
    return x.select("sensor_id", "n", (F.col("mae") / F.col("sd")).alias("nmae"), (F.col("mse") / (F.col("sd") * F.col("sd"))).alias("nmse"))


def errors_by(scored: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """(by, n_series, nmae, nmse): means over series, by a column of names(sensor_id, by)."""
    return scored.join(names, "sensor_id").groupBy(by).agg(F.count("*").alias("n_series"), F.avg("nmae").alias("nmae"), F.avg("nmse").alias("nmse"))


def gain(with_: DataFrame, without: DataFrame) -> DataFrame:
    """(sensor_id, nmae_gain, nmse_gain): the share of the error that an input takes away."""
    a, b = with_.alias("a"), without.alias("b")
    share = lambda c: (F.col(f"b.{c}") - F.col(f"a.{c}")) / F.when(F.col(f"b.{c}") != 0, F.col(f"b.{c}"))
    return a.join(b, "sensor_id").select("sensor_id", share("nmae").alias("nmae_gain"), share("nmse").alias("nmse_gain"))

"""Series from the star-schema tables: point form ``(series_id, pos, value)`` and array form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(rows: DataFrame, series: str, order: list[str], value: str | Column) -> DataFrame:
    """Numbers each series' rows from 0 in the given order."""
    value = F.col(value) if isinstance(value, str) else value
    pos = F.row_number().over(W.partitionBy(series).orderBy(*order)) - 1
    return rows.select(F.col(series).alias("series_id"), pos.cast("long").alias("pos"), value.cast("double").alias("value"))


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of event values per user."""
    return points(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def hourly_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums per event type; hours without events have value null."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    sums = events.groupBy("event_type", "hour").agg(F.sum("value").alias("value"))
    span = sums.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select("event_type", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return points(grid.join(sums, ["event_type", "hour"], "left"), "event_type", ["hour"], "value")


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form: ``series_id, label, values``."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), "label", values.alias("values"))


def to_arrays(pts: DataFrame) -> DataFrame:
    """``series_id, values``: a series is one row, so its points meet in one task."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return pts.groupBy("series_id").agg(F.transform(packed, lambda p: p["value"]).alias("values"))


def to_points(arrays: DataFrame) -> DataFrame:
    return arrays.select("series_id", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))

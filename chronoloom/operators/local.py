"""Evidence of the local scope: each chunk of a series is looked at as a series of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import spectral, stats, trend


def chunked(pts: DataFrame, k: int) -> DataFrame:
    """Points of the chunks, with ``series_id`` a pair of the series and the chunk, numbered from 0 within it."""
    n = F.count("*").over(stats.whole())
    placed = pts.withColumn("n", n).withColumn("chunk", stats.chunk_of(F.col("n"), k))
    size = F.floor(F.col("n") / k)
    start = F.when(size == 0, F.lit(0)).otherwise(F.col("chunk") * size)
    return placed.select(F.struct(F.col("series_id").alias("id"), "chunk").alias("series_id"), (F.col("pos") - start).cast("long").alias("pos"), "value")


def _by_chunk(found: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c != "series_id"]
    return found.select(F.col("series_id.id").alias("series_id"), F.col("series_id.chunk").alias("chunk"), *rest)


def trends(pts: DataFrame, k: int = 4) -> DataFrame:
    """Slope, direction, fits and best fit of each chunk."""
    return _by_chunk(trend.trend_fit(chunked(pts, k)).select("series_id", "slope", "direction", "r2", "best_fit"))


def periods(pts: DataFrame, k: int = 2) -> DataFrame:
    """Dominant period and frequency of each chunk."""
    found = spectral.dominant_period(chunked(pts, k)).select("series_id", "period", (1 / F.col("period")).alias("frequency"))
    return _by_chunk(found)


def outliers(pts: DataFrame, k: int = 4) -> DataFrame:
    """Points outside each chunk's own fences, their places in it, and its largest deviation in standard deviations."""
    parts = chunked(pts, k)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    own = parts.groupBy("series_id").agg(q.alias("q"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    width = F.col("q")[1] - F.col("q")[0]
    own = own.withColumns({"low": F.col("q")[0] - 1.5 * width, "high": F.col("q")[1] + 1.5 * width})
    out = parts.join(own.select("series_id", "low", "high"), "series_id").filter("value < low OR value > high")
    found = out.groupBy("series_id").agg(F.count("*").alias("outliers"), F.array_sort(F.collect_list("pos")).alias("positions"))
    deviation = F.when(F.col("std") > 0, F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("std")).otherwise(0.0)
    none = F.expr("CAST(array() AS array<bigint>)")
    rows = own.join(found, "series_id", "left")
    return _by_chunk(rows.select("series_id", F.coalesce("outliers", F.lit(0)).alias("outliers"), F.coalesce("positions", none).alias("positions"), deviation.alias("max_deviation")))


def variances(pts: DataFrame, k: int = 3) -> DataFrame:
    return _by_chunk(chunked(pts, k).groupBy("series_id").agg(F.var_pop("value").alias("variance")))


def amplitudes(pts: DataFrame, k: int = 2) -> DataFrame:
    """Mean, deviation, extremes, range and quartiles of each chunk."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    found = chunked(pts, k).groupBy("series_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"), q[0].alias("q25"), q[1].alias("q75"),
    )
    return _by_chunk(found)

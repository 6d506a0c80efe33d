"""Outlier rules over series in point form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.stats import whole, cleaned


def zscore_outliers(pts: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Points beyond ``threshold`` sample deviations, at their places in the raw series."""
    present = pts.filter("value IS NOT NULL AND NOT isnan(value)")
    mean, std = F.avg("value").over(whole()), F.stddev_samp("value").over(whole())
    z = F.when(std > 0, (F.col("value") - mean) / std)
    return present.select("series_id", "pos", z.alias("z")).filter(F.abs("z") > threshold)


def iqr_outliers(pts: DataFrame, k: float = 1.5) -> DataFrame:
    """Tukey fences per series, how many points lie strictly outside and where; status says why there are none."""
    present = pts.filter("value IS NOT NULL AND NOT isnan(value)")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    fences = present.groupBy("series_id").agg(q.alias("q"), F.count("*").alias("n"))
    iqr = F.col("q")[1] - F.col("q")[0]
    low, high = F.col("q")[0] - k * iqr, F.col("q")[1] + k * iqr
    status = F.when(F.col("n") < 4, "too short").when(iqr == 0, "no spread").otherwise("ok")
    f = fences.select("series_id", low.alias("low"), high.alias("high"), status.alias("status"))
    outside = present.join(f, "series_id").filter("status = 'ok' AND (value < low OR value > high)")
    found = outside.groupBy("series_id").agg(F.count("*").alias("outliers"), F.array_sort(F.collect_list("pos")).alias("positions"))
    told = lambda c, none: F.when(F.col("status") == "ok", F.coalesce(c, none)).alias(c)
    none = F.expr("CAST(array() AS array<bigint>)")
    return f.join(found, "series_id", "left").select("series_id", "low", "high", told("outliers", F.lit(0).cast("long")), "status", told("positions", none))


def anomaly_score(pts: DataFrame) -> DataFrame:
    """Largest |z| (population deviation) and number of points outside Tukey's fences."""
    n = cleaned(pts).groupBy("series_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    far = F.greatest(F.col("max") - F.col("mean"), F.col("mean") - F.col("min"))
    z = n.select("series_id", F.when(F.col("std") > 0, far / F.col("std")).otherwise(0.0).alias("max_deviation"))
    return z.join(iqr_outliers(pts).select("series_id", F.coalesce("outliers", F.lit(0)).alias("outlier_count")), "series_id")

"""Closed-form statistics and transforms of series in point form; NaN and null points are dropped first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import WindowSpec


def by_pos() -> WindowSpec:
    return W.partitionBy("series_id").orderBy("pos")


def whole() -> WindowSpec:
    return W.partitionBy("series_id")


def cleaned(pts: DataFrame) -> DataFrame:
    """Points with a value, numbered again from 0."""
    kept = pts.filter("value IS NOT NULL AND NOT isnan(value)")
    return kept.withColumn("pos", (F.row_number().over(by_pos()) - 1).cast("long"))


def basic_stats(pts: DataFrame) -> DataFrame:
    v = F.col("value")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    present = pts.filter("value IS NOT NULL AND NOT isnan(value)")
    return present.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.sum(v).alias("sum"), F.max(F.abs(v)).alias("abs_max"),
        q[0].alias("q1"), q[1].alias("q3"), (q[1] - q[0]).alias("iqr"), F.min_by(v, "pos").alias("first"), F.max_by(v, "pos").alias("last"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
    )


def percentile(pts: DataFrame, q: float) -> DataFrame:
    """The linear-interpolated percentile; ``q`` is checked on the driver."""
    if not 0 <= q <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    return pts.filter("value IS NOT NULL AND NOT isnan(value)").groupBy("series_id").agg(F.percentile("value", q / 100).alias("value"))


def value_at(pts: DataFrame, index: int) -> DataFrame:
    """The value at an index, negative from the end; null with a note outside the series."""
    clean = cleaned(pts)
    back = F.count("*").over(whole()) + index if index < 0 else F.lit(index)
    return (
        clean.withColumn("wanted", back).groupBy("series_id").agg(F.max(F.when(F.col("pos") == F.col("wanted"), F.col("value"))).alias("value"))
        .withColumn("note", F.when(F.col("value").isNull(), "index out of range").otherwise("ok"))
    )


_COMPARE = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def count_threshold(pts: DataFrame, op: str, threshold: float) -> DataFrame:
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op}")
    hit = getattr(F.col("value"), _COMPARE[op])(F.lit(float(threshold)))
    return pts.filter("value IS NOT NULL AND NOT isnan(value)").groupBy("series_id").agg(F.count_if(hit).alias("n"))


def argmax_argmin(pts: DataFrame) -> DataFrame:
    """First positions of the extremes of the raw series; a NaN, being unordered, takes both."""
    nan = F.isnan("value")
    first_nan = F.min(F.when(nan, F.col("pos")))
    low = F.min_by("pos", F.when(~nan, F.struct("value", "pos")))
    return pts.groupBy("series_id").agg(
        F.coalesce(first_nan, F.max_by("pos", F.struct("value", (-F.col("pos")).alias("p")))).alias("argmax"), F.coalesce(first_nan, low).alias("argmin")
    )


def local_extrema(pts: DataFrame) -> DataFrame:
    """Strict interior maxima and minima; plateaus and ends don't count."""
    a, b = F.lag("value").over(by_pos()), F.lead("value").over(by_pos())
    near = cleaned(pts).select("series_id", "value", a.alias("a"), b.alias("b"))
    return near.groupBy("series_id").agg(F.count_if(F.expr("value > a AND value > b")).alias("n_max"), F.count_if(F.expr("value < a AND value < b")).alias("n_min"))


def shift_scale(pts: DataFrame, offset: float, factor: float) -> DataFrame:
    return pts.select("series_id", "pos", (F.col("value") + offset).alias("shifted"), (F.col("value") * factor).alias("scaled"))


def lagged(pts: DataFrame, k: int, fill: float) -> DataFrame:
    """Delays (k > 0) or advances (k < 0) the series, filling the open end."""
    moved = F.lag("value", k, fill) if k >= 0 else F.lead("value", -k, fill)
    return pts.select("series_id", "pos", moved.over(by_pos()).alias("value"))


def moving_average(pts: DataFrame, w: int) -> DataFrame:
    """Means of all full windows of ``w`` points, numbered from 0."""
    if w <= 0:
        raise ValueError("a window has at least one point")
    mean = F.avg("value").over(by_pos().rowsBetween(1 - w, 0))
    return pts.select("series_id", (F.col("pos") - (w - 1)).alias("pos"), mean.alias("value")).filter("pos >= 0")


def difference(pts: DataFrame, order: int) -> DataFrame:
    """Differences of the given order (repeated first differences)."""
    out = pts.select("series_id", "pos", "value")
    for _ in range(order):
        out = out.withColumn("value", F.col("value") - F.lag("value").over(by_pos())).filter("value IS NOT NULL")
    return out.withColumn("pos", F.col("pos") - order)


def detrended(pts: DataFrame) -> DataFrame:
    """Residuals of each series' least-squares line."""
    vx, vy = F.col("pos").cast("double"), F.col("value")
    m = pts.withColumns({"mx": F.avg(vx).over(whole()), "my": F.avg(vy).over(whole()), "c": F.covar_pop(vx, vy).over(whole()), "v": F.var_pop(vx).over(whole())})
    line = F.col("my") + F.when(F.col("v") > 0, F.col("c") / F.col("v")).otherwise(0.0) * (F.col("pos") - F.col("mx"))
    return m.select("series_id", "pos", (F.col("value") - line).alias("value"))


def chunk_of(n: Column, k: int) -> Column:
    """The chunk of a position among k equal ones; the last takes what is over, all of a short series."""
    size = F.floor(n / k)
    return F.when(size == 0, F.lit(k - 1)).otherwise(F.least(F.floor(F.col("pos") / size), F.lit(k - 1))).cast("int")


def chunk_stats(pts: DataFrame, k: int) -> DataFrame:
    placed = pts.withColumn("n", F.count("*").over(whole())).withColumn("chunk", chunk_of(F.col("n"), k))
    return placed.groupBy("series_id", "chunk").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def zscores(pts: DataFrame) -> DataFrame:
    mean, std = F.avg("value").over(whole()), F.stddev_pop("value").over(whole())
    return pts.select("series_id", "pos", F.when(std > 0, (F.col("value") - mean) / std).otherwise(0.0).alias("value"))


def interpolated(pts: DataFrame) -> DataFrame:
    """Fills null, NaN and infinite points linearly between finite neighbours, the ends with the nearest."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    known = F.when(finite, F.struct("pos", "value"))
    before = F.last(known, ignorenulls=True).over(by_pos().rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(by_pos().rowsBetween(0, W.unboundedFollowing))
    p = pts.select("series_id", "pos", before.alias("a"), after.alias("b"))
    a, b, t = F.col("a.value"), F.col("b.value"), F.col("pos") - F.col("a.pos")
    gap = F.col("b.pos") - F.col("a.pos")
    between = F.when(F.col("a").isNull(), b).when(F.col("b").isNull() | (gap == 0), a).otherwise(a + (b - a) * t / gap)
    return p.select("series_id", "pos", between.alias("value"))


def subsampled(pts: DataFrame, m: int) -> DataFrame:
    """At most m points at positions round(i (n - 1) / (m - 1)), half to even, ends kept."""
    n = pts.groupBy("series_id").agg(F.count("*").alias("n"))
    wanted = n.select("series_id", "n", F.explode(F.expr(f"sequence(0, CAST(least(n, {m}) - 1 AS INT))")).alias("i"))
    at = F.when(F.col("n") <= m, F.col("i")).otherwise(F.bround(F.col("i") * (F.col("n") - 1) / F.lit(m - 1)))
    return wanted.select("series_id", F.col("i").cast("long").alias("i"), at.cast("long").alias("pos")).join(pts, ["series_id", "pos"])


def peak_flanks(pts: DataFrame) -> DataFrame:
    """Per strict peak the nearest troughs before and after (as-of both ways): ``series_id, pos, rise, fall``; peaks without both are left out."""
    a, b = F.lag("value").over(by_pos()), F.lead("value").over(by_pos())
    near = cleaned(pts).select("series_id", "pos", F.expr("value").alias("v"), a.alias("a"), b.alias("b"))
    trough = F.when(F.expr("v < a AND v < b"), F.col("pos"))
    before = F.last(trough, ignorenulls=True).over(by_pos().rowsBetween(W.unboundedPreceding, -1))
    after = F.first(trough, ignorenulls=True).over(by_pos().rowsBetween(1, W.unboundedFollowing))
    met = near.withColumns({"before": before, "after": after}).filter("v > a AND v > b AND before IS NOT NULL AND after IS NOT NULL")
    return met.select("series_id", "pos", (F.col("pos") - F.col("before")).alias("rise"), (F.col("after") - F.col("pos")).alias("fall"))


def rise_fall_ratio(pts: DataFrame) -> DataFrame:
    """Mean rise over mean fall of the peaks, with a hint; 1 where there are no peaks between troughs."""
    flanks = peak_flanks(pts).groupBy("series_id").agg((F.avg("rise") / F.avg("fall")).alias("ratio"), F.count("*").alias("peaks"))
    every = pts.select("series_id").distinct().join(flanks, "series_id", "left")
    return every.select("series_id", F.coalesce("ratio", F.lit(1.0)).alias("ratio"), F.coalesce("peaks", F.lit(0)).alias("peaks"))

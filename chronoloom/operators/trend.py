"""Trend fits, regression per chunk, best splits and long-range dependence of series in point form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.guards import intercept, r_squared, slope
from chronoloom.operators.stats import by_pos, chunk_of, cleaned, whole


def trend_direction(line: Column, std: Column) -> Column:
    """flat below a ten-thousandth of the deviation a step, else increasing or decreasing."""
    flat = F.abs(line) < F.when(std > 0, std * 1e-4).otherwise(1e-10)
    return F.when(line.isNull() | flat, "flat").when(line > 0, "increasing").otherwise("decreasing")


def trend_fit(pts: DataFrame) -> DataFrame:
    """Linear, exponential (where all values are above 0) and logarithmic fits; ties go to the earlier of these."""
    x, y = F.col("pos").cast("double"), F.col("value")
    fits = pts.groupBy("series_id").agg(
        slope(y, x).alias("slope"), intercept(y, x).alias("intercept"), r_squared(y, x).alias("r2"), F.stddev_pop(y).alias("std"),
        F.when(F.min(y) > 0, r_squared(F.ln(F.when(y > 0, y)), x)).alias("exp_r2"), r_squared(y, F.ln(x + 1)).alias("log_r2"),
    )
    exp = F.coalesce("exp_r2", F.lit(-1.0))
    best = F.when((F.col("r2") >= exp) & (F.col("r2") >= F.col("log_r2")), "linear").when(exp >= F.col("log_r2"), "exponential").otherwise("log")
    direction = trend_direction(F.col("slope"), F.col("std"))
    return fits.select("series_id", "slope", "intercept", "r2", "exp_r2", "log_r2", direction.alias("direction"), best.alias("best_fit"))


def linear_trend(pts: DataFrame) -> DataFrame:
    """Least squares over the points that aren't NaN, which keep their places; series with fewer than 2 have a status only."""
    present = F.when(~F.isnan("value"), F.col("value"))
    x = F.when(present.isNotNull(), F.col("pos").cast("double"))
    fit = pts.groupBy("series_id").agg(slope(present, x).alias("slope"), intercept(present, x).alias("intercept"), r_squared(present, x).alias("r_squared"), F.count(present).alias("n"))
    good = F.col("n") >= 2
    word = F.when(F.abs("slope") < 1e-10, "stationary").when(F.col("slope") > 0, "upward").otherwise("downward")
    return fit.select("series_id", *[F.when(good, F.col(c)).alias(c) for c in ("slope", "intercept", "r_squared")], F.when(good, word).alias("direction"), F.when(good, "ok").otherwise("too few values").alias("status"))


def ols_summary(pts: DataFrame) -> DataFrame:
    """A sentence with the slope of the finite points, numbered again; null for series without any."""
    finite = pts.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    numbered = finite.withColumn("pos", F.row_number().over(by_pos()) - 1)
    s = numbered.groupBy("series_id").agg(slope(F.col("value"), F.col("pos").cast("double")).alias("slope"), F.count("*").alias("n"), F.stddev_pop("value").alias("std"))
    word = F.when(F.col("slope") > 0, "upward").when(F.col("slope") < 0, "downward").otherwise("flat")
    text = (
        F.when(F.col("n") < 2, "Global OLS Slope = 0.00, indicating an undefined/flat trend (insufficient data).")
        .when(F.col("std") == 0, "Global OLS Slope = 0.00, indicating a flat trend (zero variance).")
        .otherwise(F.format_string("Global OLS Slope = %.2f, indicating a %s trend.", "slope", word))
    )
    return s.select("series_id", text.alias("summary"))


def chunk_trend(pts: DataFrame, k: int = 4) -> DataFrame:
    placed = pts.withColumn("n", F.count("*").over(whole())).withColumn("chunk", chunk_of(F.col("n"), k))
    x, y = F.col("pos").cast("double"), F.col("value")
    return placed.groupBy("series_id", "chunk").agg(slope(y, x).alias("slope"), r_squared(y, x).alias("r2"))


def slope_acceleration(pts: DataFrame, k: int = 4) -> DataFrame:
    """Slope of the last chunk less that of the first."""
    of = lambda c: F.max(F.when(F.col("chunk") == c, F.col("slope")))
    return chunk_trend(pts, k).groupBy("series_id").agg((of(k - 1) - of(0)).alias("acceleration"))


def best_split(pts: DataFrame) -> DataFrame:
    """The split that takes most off the squared error about the means; the first of equals.

    Values are centred first, so that sums of squares don't cancel.
    """
    centred = pts.select("series_id", "pos", (F.col("value") - F.avg("value").over(whole())).alias("v"))
    left = by_pos().rowsBetween(W.unboundedPreceding, 0)
    sums = centred.select("series_id", "pos", F.sum("v").over(left).alias("s"), F.sum("v").over(whole()).alias("t"), F.count("*").over(whole()).alias("n"))
    at = F.col("pos") + 1
    gain = F.col("s") * F.col("s") / at + (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / (F.col("n") - at) - F.col("t") * F.col("t") / F.col("n")
    scored = sums.filter(at < F.col("n")).select("series_id", at.alias("split"), F.round(gain, 9).alias("gain"))
    best = scored.groupBy("series_id").agg(F.max(F.struct("gain", (-F.col("split")).alias("at"))).alias("b"))
    return best.select("series_id", (-F.col("b.at")).alias("split"), F.col("b.gain").alias("gain"))


def binary_segmentation(pts: DataFrame, n_breaks: int = 1) -> DataFrame:
    """``series_id, breaks``: right ends of segments from ``n_breaks`` greedy splits, each where it takes most off the squared error.

    Segments under 4 points aren't split; of equal gains the first segment and place are taken.  A series ends with its length.
    """
    placed = cleaned(pts).withColumns({"start": F.lit(0).cast("long"), "n": F.count("*").over(whole())})
    for _ in range(n_breaks):
        part = W.partitionBy("series_id", "start")
        so_far = part.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        v = placed.withColumn("v", F.col("value") - F.avg("value").over(part))
        sums = v.select("series_id", "start", "pos", F.sum("v").over(so_far).alias("s"), F.sum("v").over(part).alias("t"), F.count("*").over(part).alias("m"))
        at = F.col("pos") + 1 - F.col("start")
        rest = F.col("t") - F.col("s")
        gain = F.col("s") * F.col("s") / at + rest * rest / (F.col("m") - at) - F.col("t") * F.col("t") / F.col("m")
        scored = sums.filter((F.col("m") >= 4) & (at < F.col("m"))).select("series_id", F.round(gain, 9).alias("gain"), (-F.col("start")).alias("s"), (-(F.col("pos") + 1)).alias("p"))
        best = scored.groupBy("series_id").agg(F.max(F.struct("gain", "s", "p")).alias("b")).select("series_id", (-F.col("b.s")).alias("of"), (-F.col("b.p")).alias("split"))
        placed = placed.join(best, "series_id", "left")
        moves = (F.col("start") == F.col("of")) & (F.col("pos") >= F.col("split"))
        placed = placed.withColumn("start", F.when(moves, F.col("split")).otherwise(F.col("start"))).drop("of", "split")
    ends = placed.select("series_id", "n", "start").distinct().groupBy("series_id").agg(F.max("n").alias("n"), F.collect_set(F.when(F.col("start") > 0, F.col("start"))).alias("inner"))
    return ends.select("series_id", F.array_sort(F.concat("inner", F.array("n"))).alias("breaks"))


def hurst(pts: DataFrame) -> DataFrame:
    """Rescaled-range exponent over windows of 2 .. min(n / 2, 100) - 1 points; series under 20 points are left out."""
    n = pts.groupBy("series_id").agg(F.count("*").alias("n")).filter("n >= 20")
    lags = n.select("series_id", "n", F.explode(F.expr("sequence(2, CAST(least(n DIV 2, 100) - 1 AS INT))")).alias("lag"))
    cut = pts.join(lags, "series_id").withColumn("part", F.floor(F.col("pos") / F.col("lag"))).filter("(part + 1) * lag <= n")
    group = W.partitionBy("series_id", "lag", "part")
    walk = cut.withColumn("d", F.col("value") - F.avg("value").over(group)).withColumn(
        "c", F.sum("d").over(group.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    )
    per = walk.groupBy("series_id", "lag", "part").agg((F.max("c") - F.min("c")).alias("r"), F.stddev_samp("d").alias("s")).filter("s > 0")
    mean = per.groupBy("series_id", "lag").agg(F.avg(F.col("r") / F.col("s")).alias("rs")).filter("rs > 0")
    h = mean.groupBy("series_id").agg(slope(F.ln("rs"), F.ln("lag")).alias("hurst"))
    label = F.when(F.col("hurst") > 0.55, "persistent").when(F.col("hurst") < 0.45, "anti-persistent").otherwise("random walk")
    return h.withColumn("label", label)

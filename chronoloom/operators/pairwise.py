"""Operators on pairs of series: rows ``(pair_id, pos, a, b)``, one per common position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.guards import correlation, slope
from chronoloom.operators.trend import trend_direction


def aligned(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Points of the pairs ``(pair_id, a_id, b_id)`` at their common positions."""
    a = left.select(F.col("series_id").alias("a_id"), "pos", F.col("value").alias("a"))
    b = right.select(F.col("series_id").alias("b_id"), "pos", F.col("value").alias("b"))
    return pairs.join(a, "a_id").join(b, ["b_id", "pos"]).select("pair_id", "pos", "a", "b")


def lag_correlation(pair: DataFrame, max_lag: int, part: int | None = None) -> DataFrame:
    """The lag of largest |r| among -L .. L with 3 common points or more; positive: a leads.

    Of equals lag 0 is taken first, then the smallest.  With ``part``, no lag exceeds that part of a pair's points.
    """
    shifted = pair.select("pair_id", F.col("pos").alias("at"), "a", F.explode(F.expr(f"sequence(-{max_lag}, {max_lag})")).alias("lag"))
    shifted = shifted.withColumn("pos", F.col("at") + F.col("lag"))
    met = shifted.join(pair.select("pair_id", "pos", "b"), ["pair_id", "pos"])
    r = met.groupBy("pair_id", "lag").agg(correlation(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n")).filter("n >= 3 AND r IS NOT NULL")
    if part:
        most = pair.groupBy("pair_id").agg(F.floor(F.count("*") / part).alias("most"))
        r = r.join(most, "pair_id").filter(F.abs("lag") <= F.col("most"))
    order = F.struct(F.round(F.abs("r"), 9).alias("s"), (F.col("lag") == 0).alias("zero"), (-F.col("lag")).alias("l"), F.col("r"))
    best = r.groupBy("pair_id").agg(F.max(order).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("corr_at_zero"))
    return best.select("pair_id", (-F.col("b.l")).cast("long").alias("best_lag"), F.col("b.r").alias("best_corr"), "corr_at_zero")


def similarity_labels(pair: DataFrame) -> DataFrame:
    """Trend, level, range and variance of both sides compared, as high, medium or low, and which side varies more."""
    x = F.col("pos").cast("double")
    s = pair.groupBy("pair_id").agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"),
        (F.max("a") - F.min("a")).alias("ra"), (F.max("b") - F.min("b")).alias("rb"), slope(F.col("a"), x).alias("ta"), slope(F.col("b"), x).alias("tb"),
    )
    like = lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(1.0)
    apart, bend = F.abs(F.col("ma") - F.col("mb")), F.abs(F.col("ta") - F.col("tb"))
    alike = trend_direction(F.col("ta"), F.col("sa")) == trend_direction(F.col("tb"), F.col("sb"))
    width, spread = like(F.col("ra"), F.col("rb")), like(F.col("sa"), F.col("sb"))
    more = F.when(spread > 0.85, "same").when(F.col("sa") > F.col("sb"), "series_1").otherwise("series_2")
    return s.select(
        "pair_id", F.when(alike & (bend < 0.1), "high").when(alike | (bend < 0.5), "medium").otherwise("low").alias("trend"),
        F.when(apart < 0.1, "high").when(apart < 1.0, "medium").otherwise("low").alias("level"),
        F.when(width > 0.8, "high").when(width > 0.5, "medium").otherwise("low").alias("range"),
        F.when(spread > 0.85, "high").otherwise("low").alias("variance"), more.alias("higher_variance"), spread.alias("std_ratio"),
    )


def scaled_version(pair: DataFrame) -> DataFrame:
    """Least-squares scale both ways; a scaled copy has relative error under .15 and a scale over .15 from 1."""
    m = pair.groupBy("pair_id").agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb")
    )
    ab, aa, bb = F.col("ab"), F.col("aa"), F.col("bb")
    s12, s21 = ab / (bb + 1e-12), ab / (aa + 1e-12)
    off = lambda own, other, s: F.round(F.sqrt(F.greatest(F.lit(0.0), own - 2 * s * ab + s * s * other)) / (F.sqrt(own) + 1e-12), 9)
    both = m.select("pair_id", s12.alias("s12"), s21.alias("s21"), off(aa, bb, s12).alias("e12"), off(bb, aa, s21).alias("e21"))
    found = F.coalesce((F.least("e12", "e21") < 0.15) & (F.abs(F.col("s12") - 1) > 0.15), F.lit(False))
    first = F.col("e12") <= F.col("e21")
    way = F.when(~found, "none").when(first, "series_1_scaled_from_series_2").otherwise("series_2_scaled_from_series_1")
    return both.select(
        "pair_id", F.least("e12", "e21").alias("error"), found.alias("scaled"), way.alias("direction"), F.when(found, F.when(first, F.col("s12")).otherwise(F.col("s21"))).alias("factor")
    )


def acf_similarity(pair: DataFrame, max_lag: int = 20) -> DataFrame:
    """Correlation of both sides' autocorrelations at lags 1 .. ``max_lag``, with each side's peak, and its label."""
    from chronoloom.operators.spectral import autocorrelation

    def side(c: str) -> DataFrame:
        acf = autocorrelation(pair.select(F.col("pair_id").alias("series_id"), "pos", F.col(c).alias("value")), max_lag, half=False)
        return acf.select(F.col("series_id").alias("pair_id"), "lag", F.col("acf").alias(f"acf_{c}"))

    both = side("a").join(side("b"), ["pair_id", "lag"])
    peak = lambda c: F.max(F.struct(F.round(F.abs(f"acf_{c}"), 9).alias("size"), (-F.col("lag")).alias("lag")))
    r = both.groupBy("pair_id").agg(correlation(F.col("acf_a"), F.col("acf_b")).alias("acf_corr"), peak("a").alias("pa"), peak("b").alias("pb"))
    label = F.when(F.col("acf_corr") > 0.8, "high").when(F.col("acf_corr") > 0.5, "medium").otherwise("low")
    return r.select("pair_id", "acf_corr", (-F.col("pa.lag")).alias("peak_lag_1"), (-F.col("pb.lag")).alias("peak_lag_2"), label.alias("autocorr_similarity"))


def flipped_version(pair: DataFrame) -> DataFrame:
    r = pair.groupBy("pair_id").agg(correlation(F.col("a"), F.col("b")).alias("r"))
    return r.select("pair_id", F.col("r").alias("direct"), F.coalesce(-F.col("r") > 0.85, F.lit(False)).alias("flipped"))


def euclidean(pair: DataFrame) -> DataFrame:
    """Distance of the standardised sides over their common points, per point."""
    pair_window = W.partitionBy("pair_id")
    z = lambda c: F.when(F.stddev_pop(c).over(pair_window) > 0, (F.col(c) - F.avg(c).over(pair_window)) / F.stddev_pop(c).over(pair_window)).otherwise(0.0)
    d = pair.select("pair_id", (z("a") - z("b")).alias("d"))
    return d.groupBy("pair_id").agg((F.sqrt(F.sum(F.col("d") * F.col("d"))) / F.count("*")).alias("distance"))


def junction_costs(segments: DataFrame) -> DataFrame:
    """From segment edges ``(group, seg, head, head_slope, tail, tail_slope, n)`` the cost of putting b after a:

    squared gap plus half the squared gap of slopes (gap alone where a side has one point).
    """
    a = segments.select("group", *[F.col(c).alias(f"{c}_a") for c in ("seg", "tail", "tail_slope", "n")])
    b = segments.select("group", *[F.col(c).alias(f"{c}_b") for c in ("seg", "head", "head_slope", "n")])
    gap, bend = F.col("head_b") - F.col("tail_a"), F.col("head_slope_b") - F.col("tail_slope_a")
    cost = gap * gap + F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), 0.5 * bend * bend).otherwise(0.0)
    return a.join(b, "group").filter("seg_a != seg_b").select("group", F.col("seg_a").alias("left"), F.col("seg_b").alias("right"), cost.alias("cost"))


def jigsaw_by_reference(segments: DataFrame, reference: DataFrame) -> DataFrame:
    """Where each segment ``(group, seg, pos, value)`` fits its reference ``(group, pos, value)`` best."""
    starts = reference.select("group", F.col("pos").alias("at"), F.col("value").alias("r"))
    size = segments.groupBy("group", "seg").agg(F.count("*").alias("size"))
    met = segments.join(size, ["group", "seg"]).join(starts, "group").withColumn("start", F.col("at") - F.col("pos")).filter("start >= 0")
    fit = met.groupBy("group", "seg", "start", "size").agg(F.avg((F.col("value") - F.col("r")) * (F.col("value") - F.col("r"))).alias("mse"), F.count("*").alias("n"))
    best = fit.filter("n = size").groupBy("group", "seg").agg(F.min(F.struct(F.round("mse", 9).alias("mse"), "start")).alias("b"))
    place = F.row_number().over(W.partitionBy("group").orderBy("b.start", "seg")) - 1
    return best.select("group", "seg", F.col("b.start").alias("start"), place.cast("long").alias("place"))

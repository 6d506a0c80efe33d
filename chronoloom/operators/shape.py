"""Peaks and troughs of series with their prominence, and what they say of a series' shape; as windows and one row of extremes a series.

Null and NaN points are dropped first.  Equal neighbours are one point, in their middle; the ends are no extremes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.stats import by_pos, cleaned


def _lows(values: Column) -> Column:
    """For each of some values the least one back to the last higher value (or to the first one).

    Values that wait for a higher one are held in falling order, each with the least value behind it; a value takes all that are not
    higher off their end.  So work grows with the values times those that wait: few, but for waves that die away.
    """
    begun = F.struct(F.array().cast("array<struct<v: double, low: double>>").alias("waiting"), F.array().cast("array<double>").alias("lows"))

    def step(s: Column, x: Column) -> Column:
        passed = F.transform(F.filter(s["waiting"], lambda w: w["v"] <= x), lambda w: w["low"])
        low = F.transform(F.array(F.least(x, F.coalesce(F.array_min(passed), x))), lambda b: F.struct(b.alias("b")))
        higher = F.filter(s["waiting"], lambda w: w["v"] > x)
        return F.transform(low, lambda b: F.struct(F.concat(higher, F.array(F.struct(x.alias("v"), b["b"].alias("low")))).alias("waiting"), F.concat(s["lows"], F.array(b["b"])).alias("lows")))[0]

    return F.aggregate(values, begun, step, lambda s: s["lows"])


def extremes(pts: DataFrame) -> DataFrame:
    """``series_id, pos, value, kind, prominence`` of all peaks and troughs (of which prominence is that of the peak turned over)."""
    clean = cleaned(pts).withColumn("new", F.coalesce((F.col("value") != F.lag("value").over(by_pos())).cast("int"), F.lit(0)))
    runs = clean.withColumn("run", F.sum("new").over(by_pos())).groupBy("series_id", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("value").alias("value"))
    order = W.partitionBy("series_id").orderBy("run")
    near = runs.withColumns({"a": F.lag("value").over(order), "b": F.lead("value").over(order)})
    kind = F.when(F.expr("value > a AND value > b"), "peak").when(F.expr("value < a AND value < b"), "trough").when(F.col("a").isNull() | F.col("b").isNull(), "end")
    told = near.withColumn("kind", kind).filter("kind IS NOT NULL").select("series_id", F.struct("run", F.floor((F.col("first") + F.col("last")) / 2).alias("pos"), "value", "kind").alias("x"))
    held = told.groupBy("series_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    up = F.transform("xs", lambda x: x["value"])
    down = F.transform("xs", lambda x: -x["value"])
    both = held.withColumns({f"{name}_{side}": c for name, v in (("up", up), ("down", down)) for side, c in (("left", _lows(v)), ("right", F.reverse(_lows(F.reverse(v)))))})
    out = both.select("series_id", F.posexplode("xs").alias("i", "x"), "up_left", "up_right", "down_left", "down_right")
    base = lambda name: F.greatest(F.get(f"{name}_left", F.col("i")), F.get(f"{name}_right", F.col("i")))
    prominence = F.when(F.col("x.kind") == "peak", F.col("x.value") - base("up")).otherwise(-F.col("x.value") - base("down"))
    return out.filter("x.kind != 'end'").select("series_id", F.col("x.pos").alias("pos"), F.col("x.value").alias("value"), F.col("x.kind").alias("kind"), prominence.alias("prominence"))


def _mean(value: Column) -> Column:
    """The mean as an aggregate, whatever the order of rows: the parts of values above 2^-20 add up exactly to a sum of 2^33, the rests round off far below a double's digits."""
    near = F.abs(value) < 2.0**33
    coarse = F.when(near, F.rint(value * 2.0**20) / 2.0**20).otherwise(value)
    return F.when(F.count(value) > 0, (F.sum(coarse) + F.sum(F.when(near, value - coarse).otherwise(0.0))) / F.count(value))


def shape_summary(pts: DataFrame, share: float = 0.05) -> DataFrame:
    """Per series the peaks and troughs of a prominence of at least that share of the range, how regular and how symmetric they are.

    Without peaks (troughs) their mean is the largest (least) value; without two peaks regularity is 0, and without two peaks or a
    peak between two troughs the ratio is 1 with the hint ``insufficient_peaks``.  Means are of exact sums and the variation of gaps is
    of whole numbers, so neither hangs on the order of rows where it meets a bound or the middle of two rounded values.
    """
    ends = cleaned(pts).groupBy("series_id").agg(F.max("value").alias("most"), F.min("value").alias("least"))
    found = extremes(pts).join(ends, "series_id").filter(F.round("prominence", 12) >= F.round(share * (F.col("most") - F.col("least")), 12))
    is_ = lambda kind: F.col("kind") == kind
    order = by_pos()
    trough = F.when(is_("trough"), F.col("pos"))
    flanked = found.withColumns(
        {
            "before": F.last(trough, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), "after": F.first(trough, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)),
            "back": F.last(F.when(is_("peak"), F.col("pos")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)),
        }
    )
    gap = F.when(is_("peak"), F.col("pos") - F.col("back"))
    between = is_("peak") & F.col("before").isNotNull() & F.col("after").isNotNull()
    per = flanked.groupBy("series_id").agg(
        F.count_if(is_("peak")).alias("peaks"), F.count_if(is_("trough")).alias("troughs"), _mean(F.when(is_("peak"), F.col("value"))).alias("peak"), _mean(F.when(is_("trough"), F.col("value"))).alias("trough"),
        F.count(gap).cast("decimal(19,0)").alias("gaps"), F.sum(gap).cast("decimal(19,0)").alias("gap"), F.sum(gap.cast("decimal(19,0)") * gap.cast("decimal(19,0)")).cast("decimal(19,0)").alias("square"), F.avg(F.when(between, F.col("pos") - F.col("before"))).alias("rise"), F.avg(F.when(between, F.col("after") - F.col("pos"))).alias("fall"),
    )
    joined = ends.join(per, "series_id", "left")
    peaks = F.coalesce("peaks", F.lit(0))
    top, bottom = F.coalesce("peak", "most"), F.coalesce("trough", "least")
    cv = F.when(peaks >= 2, F.sqrt((F.col("gaps") * F.col("square") - F.col("gap") * F.col("gap")).cast("double")) / F.col("gap").cast("double")).otherwise(0.0)
    known = (peaks >= 2) & F.col("rise").isNotNull()
    ratio = F.when(known, F.col("rise") / F.col("fall")).otherwise(1.0)
    hint = F.when(~known, "insufficient_peaks").when(cv > 0.4, "irregular").when(ratio > 2.0, "slow_rise_fast_fall").when(ratio < 0.5, "fast_rise_slow_fall").otherwise("symmetric")
    return joined.select(
        "series_id", peaks.alias("peak_count"), F.coalesce("troughs", F.lit(0)).alias("trough_count"), top.alias("mean_peak_value"), bottom.alias("mean_trough_value"), (top - bottom).alias("peak_to_trough_amp"),
        cv.alias("inter_peak_cv"), F.when(peaks >= 2, 1 / (1 + cv)).otherwise(0.0).alias("peak_regularity"), ratio.alias("rise_fall_ratio"), hint.alias("waveform_hint"),
    )

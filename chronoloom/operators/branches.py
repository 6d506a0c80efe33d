"""Evidence branches: one row of evidence per series (or pair), joined from the operators.

A kernel's failure nulls its own fields; ``status`` says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import anomaly, kernels, pairwise, spectral, stats, trend, verify
from chronoloom.sources.series import to_arrays


def _flagged(rows: DataFrame, branch: str, keys: list[str]) -> DataFrame:
    return rows.withColumn("flags", verify.row_flags({c: F.col(c) for c in keys}, F.lit(branch)))


def trend_branch(pts: DataFrame) -> DataFrame:
    fit = trend.trend_fit(pts).join(trend.slope_acceleration(pts), "series_id", "left").join(trend.ols_summary(pts), "series_id", "left")
    local = trend.chunk_trend(pts).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "slope"))), lambda c: c["slope"]).alias("slopes"))
    fit = _flagged(fit, "trend", ["slope", "direction", "r2"])
    return fit.join(local, "series_id").join(kernels.series_kernels(to_arrays(pts), ["trend_segments", "shape_features"]), "series_id")


def periodicity_branch(pts: DataFrame) -> DataFrame:
    """The period is the autocorrelation's where both agree within a fifth, else the spectrum's."""
    s = spectral.dominant_period(pts).select("series_id", F.col("period").alias("fft_period"), F.col("entropy").alias("spectral_entropy"))
    peak = spectral.first_peak(spectral.autocorrelation(pts)).select("series_id", F.col("lag").alias("acf_lag"), F.col("strength").alias("acf_strength"))
    both = s.join(peak, "series_id", "left")
    near = F.abs(F.col("acf_lag") - F.col("fft_period")) <= 0.2 * F.col("fft_period")
    both = both.withColumn("period", F.when(near, F.col("acf_lag").cast("double")).otherwise(F.col("fft_period")))
    names = ["seasonal", "decomposition_type", "hilbert_envelope", "shape_features"]
    return both.join(kernels.series_kernels(to_arrays(pts), names), "series_id")


def anomaly_branch(pts: DataFrame) -> DataFrame:
    scores = anomaly.anomaly_score(pts).join(stats.basic_stats(pts).select("series_id", "n", "mean", "std", "range"), "series_id")
    return scores.join(kernels.series_kernels(to_arrays(pts), ["change_points"]), "series_id")


def noise_branch(pts: DataFrame) -> DataFrame:
    """Tests on the raw series; stationarity also after differencing and after detrending."""
    names = ["pacf", "ljung_box", "stationarity", "arch_lm", "hilbert_envelope"]
    raw = kernels.series_kernels(to_arrays(pts), names).join(spectral.rolling_std(pts).withColumnRenamed("trend", "variance_trend"), "series_id")
    again = lambda p, name: kernels.series_kernels(to_arrays(p), ["stationarity"]).select("series_id", F.col("is_stationary").alias(name))
    raw = raw.join(again(stats.difference(pts, 1), "is_stationary_after_diff"), "series_id", "left")
    raw = raw.join(again(stats.detrended(pts), "is_stationary_after_detrend"), "series_id", "left")
    return _flagged(raw, "noise", ["adf_pval", "kpss_pval", "arch_effect_detected", "is_stationary", "is_white_noise"])


def similarity_branch(pair: DataFrame, arrays: DataFrame) -> DataFrame:
    out = pairwise.similarity_labels(pair)
    for more in (pairwise.scaled_version(pair), pairwise.flipped_version(pair), pairwise.euclidean(pair)):
        out = out.join(more, "pair_id")
    return out.join(kernels.pair_kernels(arrays, ["warping"]), "pair_id").join(pairwise.lag_correlation(pair, 10), "pair_id", "left")


def causality_branch(pair: DataFrame, arrays: DataFrame, max_lag: int = 60) -> DataFrame:
    """Lags up to a fifth of the pair's points, ``max_lag`` at most."""
    rows = pairwise.lag_correlation(pair, max_lag, part=5).join(kernels.pair_kernels(arrays, ["causality"]), "pair_id")
    return _flagged(rows, "causality", ["best_lag", "pval_12", "pval_21", "direction", "best_corr"])

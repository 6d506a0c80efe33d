"""Evidence of a branch as a map of fields to variants: pruned by branch and subtype, summed up, and bundled.

Evidence comes as JSON text of one object; null, torn text and other JSON are evidence without fields.  A field of two
names differs in case; a repeated field counts once, as the parser of variants takes it.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields that every answer sees.
CORE = (
    "branch", "scope", "flags", "series_length", "series_length_1", "series_length_2", "vision_trigger", "vision_error", "vision_trigger_error", "best_fit_type", "ols_trend_summary",
    "dominant_period_fft", "dominant_freq", "seasonal_strength", "spectral_entropy", "amp_stats_1", "amp_stats_2", "amp_context", "variance", "is_stationary", "is_white_noise",
)
# Fields that answers to a branch's subtype see besides.
FIELDS: dict[tuple[str, str], tuple[str, ...]] = {
    ("trend", "direction"): ("slope", "direction", "r2", "best_fit_type", "ols_trend_summary"),
    ("trend", "functional_form"): ("slope", "direction", "r2", "exp_r2", "log_r2", "best_fit_type", "ols_trend_summary", "waveform_hint", "rise_fall_ratio", "pattern_type"),
    ("trend", "change_point"): (
        "n_breakpoints", "n_segments", "breakpoint_positions", "largest_mean_shift", "largest_std_shift", "segment_best_fit_types", "segment_slopes", "segment_directions", "segment_r2s",
        "chunk_edges", "slopes", "directions", "best_fit_types", "r2s", "slope_acceleration", "best_fit_type", "direction", "r2",
    ),
    ("periodicity", "period_value"): (
        "dominant_period_fft", "dominant_freq", "period_reconciled", "stl_period_used", "seasonal_strength", "waveform_hint", "rise_fall_ratio", "spectral_entropy",
    ),
    ("periodicity", "period_change"): (
        "chunk_edges", "chunk_periods", "chunk_freqs", "chunk_seasonal_strengths", "period_reconciled", "dominant_period_fft", "amplitude_change", "amplitude_ratio",
    ),
    ("periodicity", "amplitude_change"): (
        "amplitude_change", "amplitude_ratio", "envelope_mean", "envelope_trend", "envelope_slope", "envelope_r2", "first_half_mean", "second_half_mean", "chunk_edges",
        "chunk_seasonal_strengths",
    ),
    ("periodicity", "waveform_type"): (
        "waveform_hint", "peak_regularity", "rise_fall_ratio", "seasonal_strength", "decomp_type", "amplitude_change", "amplitude_ratio", "chunk_periods", "chunk_freqs", "period_reconciled",
    ),
    ("anomaly", "point_anomaly"): ("outlier_indices", "outlier_count", "max_deviation", "outlier_positions"),
    ("anomaly", "pattern_flip"): (
        "n_breakpoints", "breakpoint_positions", "largest_mean_shift", "largest_std_shift", "segment_means", "segment_stds", "chunk_edges", "chunk_outlier_counts",
    ),
    ("noise", "white_noise"): ("is_white_noise", "lb_pval_min", "variance", "acf_at_lag1"),
    ("noise", "stationarity"): ("adf_pval", "kpss_pval", "is_stationary", "is_stationary_after_diff", "is_stationary_after_detrend"),
    ("noise", "variance_level"): ("variance", "variance_trend", "variance_ratio", "arch_effect_detected", "arch_pvalue", "arch_lm_stat"),
    ("noise", "autocorr_value"): ("acf_at_lag1", "acf_peak_lag", "acf_peak_strength"),
    ("noise", "ar_ma_process"): ("acf_at_lag1", "pacf_at_lag1", "pacf_at_lag2", "process_type_hint", "pacf_confidence", "arch_effect_detected"),
    ("similarity", "statistical"): (
        "amp_stats_1", "amp_stats_2", "mean_diff", "range_ratio", "std_ratio", "variance_similarity", "higher_variance_series", "level_similarity", "range_similarity",
        "autocorr_similarity", "acf_similarity_corr", "acf_1", "acf_2",
    ),
    ("similarity", "shape"): (
        "shape_similarity", "dtw_distance_normalized", "shape_similarity_label", "overall_similarity_summary", "waveform_hints_match", "shape_features_1", "shape_features_2",
    ),
    ("similarity", "lag_offset"): ("direct_correlation", "flipped_correlation", "best_lag", "best_lag_corr", "shape_similarity", "dtw_distance_normalized"),
    ("causality", "lag_direction"): ("best_lag", "best_corr", "corr_at_zero", "granger_best_lag", "pval_12", "pval_21", "direction"),
    ("causality", "lag_value"): ("best_lag", "best_corr", "corr_at_zero", "granger_best_lag", "pval_12", "pval_21", "direction"),
}
# Long arrays that no answer sees; fields that steer the run and are no evidence; fields of the summary.
LONG = ("acf_values", "zscore", "iqr_outliers")
CONTROL = ("vision_struct", "vision_text", "vision_raw", "artifacts", "vision_tool", "_propose_force_vision", "propose_metadata", "_raw_pixel_answer")
SUMMARY = (
    "branch", "direction", "slope", "r2", "dominant_period_fft", "period_reconciled", "seasonal_strength", "is_stationary", "is_white_noise", "adf_pval", "kpss_pval", "outlier_count",
    "max_deviation", "best_lag", "best_corr", "pval_12", "pval_21", "vision_confidence",
)


def fields(evidence: Column) -> Column:
    """``map<string, variant>`` of evidence in JSON."""
    parsed = F.try_parse_json(evidence)
    return F.coalesce(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast("map<string,variant>")), F.create_map().cast("map<string,variant>"))


def key_table(spark: SparkSession, known: Mapping[tuple[str, str], Sequence[str]] = FIELDS) -> DataFrame:
    """``branch, subtype, keys``: one row a subtype, so small that it is always broadcast."""
    return spark.createDataFrame([(b, s, list(keys)) for (b, s), keys in known.items()], "branch string, subtype string, keys array<string>")


def without(math: Column, names: Sequence[str]) -> Column:
    return F.map_filter(math, lambda k, _: ~k.isin(*names))


def pruned(rows: DataFrame, math: str = "math", known: Mapping[tuple[str, str], Sequence[str]] = FIELDS, core: Sequence[str] = CORE) -> DataFrame:
    """``math`` with the core fields and those of the row's ``branch, subtype``; of other rows it only loses the long arrays."""
    table = F.broadcast(key_table(rows.sparkSession, known).withColumnsRenamed({"branch": "__b", "subtype": "__s", "keys": "__keys"}))
    joined = rows.join(table, (F.col("branch") == F.col("__b")) & (F.col("subtype") == F.col("__s")), "left")
    kept = F.map_filter(without(F.col(math), LONG), lambda k, _: F.col("__keys").isNull() | k.isin(*core) | F.array_contains("__keys", k))
    return joined.withColumn(math, kept).drop("__b", "__s", "__keys")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def rounded(v: Column, digits: int = 6) -> Column:
    """JSON text of a variant with fractions rounded, inside of flat arrays and objects, too."""
    one = lambda x: F.when(_kind(x).rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.to_json(F.round(F.try_variant_get(x, "$", "double"), digits).cast("variant"))).otherwise(F.to_json(x))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), ","), F.lit("]"))
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = F.transform(entries, lambda e: F.concat(F.lit('"'), F.replace(e["key"], F.lit('"'), F.lit('\\"')), F.lit('":'), one(e["value"])))
    return F.when(_kind(v).startswith("ARRAY"), listed).when(_kind(v).startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}"))).otherwise(one(v))


def summary(math: Column, digits: int = 6) -> Column:
    """``map<string, string>`` of the summary's fields that are there, as JSON: fractions rounded, arrays and objects as texts."""
    present = F.map_filter(math, lambda k, _: k.isin(*SUMMARY))
    return F.transform_values(present, lambda _, v: rounded(v, digits))


def bundle(math: Column) -> Column:
    """``struct<math_evidence, vision_evidence, vision_text, vision_suggestion, flags>``: control fields leave the evidence, the look's answer is told apart."""
    at = lambda name: F.element_at(math, F.lit(name))
    text = lambda name: F.when(_kind(at(name)) == "STRING", F.try_variant_get(at(name), "$", "string"))
    success = F.coalesce(F.try_variant_get(at("vision_answer_parse_success"), "$", "boolean"), F.lit(False))
    suggestion = F.struct(
        text("vision_letter").alias("letter"), text("vision_confidence").alias("confidence"), text("vision_answer_raw").alias("raw"), success.alias("parse_success"),
        text("vision_answer_error").alias("error"),
    )
    flags = F.coalesce(F.try_variant_get(at("flags"), "$", "array<string>"), F.array().cast("array<string>"))
    return F.struct(without(math, CONTROL).alias("math_evidence"), at("vision_struct").alias("vision_evidence"), text("vision_text").alias("vision_text"), suggestion.alias("vision_suggestion"), flags.alias("flags"))

"""Routing, evidence checks, gates and answer heads as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that lead to a branch, in the order in which branches are tried.
BRANCH_WORDS = (
    ("anomaly", ("anomaly", "outlier", "spike", "jump", "change point", "structural break", "unusual")),
    ("noise", ("noise", "stationary", "white noise", "volatility", "heteroskedastic", "autocorr", "random walk", "variance level", "ar(", "ma(")),
    ("periodicity", ("period", "cycle", "seasonal", "frequency", "waveform", "repeating", "sine", "cosine", "oscillat", "harmonic")),
    ("trend", ("trend", "slope", "linear", "exponential", "logarithmic", "upward", "downward", "increas", "decreas", "drift", "long-term")),
    ("causality", ("causal", "granger", "lead-lag", "lag", "drive", "predict")),
    ("similarity", ("similar", "distance", "dtw", "offset", "shape", "resemble", "look alike", "compare")),
)
# The answers a router may give, and questions that ask for a label.
BRANCHES = ("trend", "periodicity", "anomaly", "noise", "similarity", "causality")
SUBTYPES = {
    "trend": ("direction", "functional_form", "change_point"),
    "periodicity": ("period_value", "period_change", "amplitude_change", "waveform_type"),
    "anomaly": ("point_anomaly", "pattern_flip"),
    "noise": ("white_noise", "stationarity", "variance_level", "autocorr_value", "ar_ma_process"),
    "similarity": ("statistical", "shape", "lag_offset"),
    "causality": ("lag_direction", "lag_value"),
}
SCHEMAS = ("mcq", "numerical", "categorical")
LABEL_QUESTIONS = (
    "is the series stationary", "is this series stationary", "stationary or non-stationary", "stationary or not", "stationary or nonstationary",
)
# Fields that a branch's evidence needs, flags, and words of questions that the gate looks for.
REQUIRED = {
    "trend": ("slope", "direction", "r2"),
    "periodicity": ("dominant_period_fft", "dominant_freq", "period_reconciled"),
    "anomaly": ("outlier_indices", "outlier_count", "max_deviation"),
    "noise": ("adf_pval", "kpss_pval", "is_stationary", "is_white_noise"),
    "similarity": ("amp_stats_1", "amp_stats_2", "trend_1", "trend_2"),
    "causality": ("best_lag", "pval_12", "pval_21", "direction", "best_corr"),
}
LOCAL_REQUIRED = {
    "trend": ("chunk_edges", "slopes", "directions", "r2s"),
    "periodicity": ("chunk_edges", "chunk_periods"),
    "anomaly": ("chunk_edges", "chunk_outlier_counts"),
}
HARD_FLAGS = ("low_r2", "fft_unreliable", "adf_kpss_disagree", "granger_not_significant", "weak_correlation", "arch_effects", "high_volatility")
VISUAL_WORDS = (
    "shape", "visual", "visualize", "plot", "spectrogram", "regime shift", "topology", "pattern", "waveform", "morphology", "spectrum", "frequency",
    "amplitude", "envelope",
)
SPECTROGRAM_WORDS = ("spectrogram", "spectrum", "frequency", "time-frequency", "stft", "cwt", "period", "seasonal", "heteroskedastic", "regime")
SHAPE_WORDS = ("shape", "trend", "morphology", "waveform", "line", "plot")
SEASON_WORDS = ("seasonal", "period", "cycle", "frequency")
ANOMALY_WORDS = ("anomaly", "outlier", "spike", "jump", "break")
LINE_SUBTYPES = ("waveform_type", "amplitude_change", "period_change")
SPECTROGRAM_REASONS = (
    "fft_unreliable", "adf_kpss_disagree", "adf_high_pval", "pval_marginal", "corr_granger_conflict", "chunk_variance", "weak_seasonal_signal",
    "high_volatility", "arch_effects",
)
LINE_REASONS = ("low_r2", "weak_correlation", "fit_ambiguous", "low_fit")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def keyword_routes(question: Column, primary: Column | None = None, most: int = 3) -> Column:
    """The primary branch, if it is one, then branches whose words occur in the question, in fixed order, without repeats."""
    text = F.lower(F.coalesce(question, F.lit("")))
    hits = [F.when(contains_any(text, words), F.lit(branch)) for branch, words in BRANCH_WORDS]
    first = [] if primary is None else [F.when(F.lower(primary).isin(*BRANCHES), F.lower(primary))]
    return F.slice(F.array_distinct(F.array_compact(F.array(*first, *hits))), 1, most)


def parse_routing(raw: Column) -> Column:
    """``struct<branch, scope, series_type, subtype, expected_schema, parse_success>`` of a router's answer.

    JSON alone, in a fence, or between the outermost braces; an unknown branch fails, other unknown values become defaults.
    """
    text = F.trim(raw)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    text = F.when(fenced != "", fenced).otherwise(text)
    kind = "branch string, scope string, series_type string, subtype string, expected_schema string"
    whole = F.from_json(text, f"{kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), f"{kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = lambda j: F.when(j["_bad"].isNull() & j.isNotNull(), j)
    found = F.coalesce(good(whole), good(inner))
    said = lambda field, default: F.trim(F.lower(F.coalesce(found[field], F.lit(default))))
    branch = F.when(said("branch", "").isin(*BRANCHES), said("branch", ""))
    among = lambda field, known, default: F.when(branch.isNotNull() & said(field, default).isin(*known), said(field, default)).otherwise(default)
    allowed = reduce(Column.__or__, [(branch == b) & said("subtype", "").isin(*known) for b, known in SUBTYPES.items()])
    return F.struct(
        branch.alias("branch"), among("scope", ("global", "local"), "global").alias("scope"), among("series_type", ("single", "dual"), "single").alias("series_type"),
        F.when(allowed, said("subtype", "")).alias("subtype"), among("expected_schema", SCHEMAS, "mcq").alias("expected_schema"), branch.isNotNull().alias("parse_success"),
    )


def expected_schema(options: Column, question: Column) -> Column:
    """The shape of answer that a row asks for: two options that aren't empty make it a choice."""
    full = F.size(F.filter(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.trim(o) != ""))
    return F.when(full >= 2, "mcq").when(contains_any(F.lower(F.coalesce(question, F.lit(""))), LABEL_QUESTIONS), "categorical").otherwise("numerical")


def complies(answer: Column, schema: Column) -> Column:
    """Whether an answer in text has the shape of the schema: a finite number, a label that isn't empty, a letter A to D."""
    number = answer.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    full = F.trim(answer) != ""
    fits = F.when(schema == "numerical", finite).when(schema == "categorical", full).when(schema == "mcq", F.upper(F.trim(answer)).isin("A", "B", "C", "D"))
    return F.coalesce(fits, F.lit(False))


def is_number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double").isNotNull()


def answer_type(options: Column, answer: Column, qa_type: Column) -> Column:
    """mcq, numerical, categorical or open, from the options, the kind that the row names, and the answer's form."""
    qa = F.trim(F.lower(F.coalesce(qa_type, F.lit(""))))
    return (
        F.when((F.size(options) >= 2) | qa.contains("choice") | qa.contains("mcq"), "mcq").when(qa.contains("numeric") | is_number(answer), "numerical")
        .when(F.trim(F.coalesce(answer, F.lit(""))) != "", "categorical").otherwise("open")
    )


def option_type(options: Column) -> Column:
    """none, trajectory, scalar, range or categorical_text, from the options' texts."""
    low = F.transform(options, lambda o: F.trim(F.lower(o)))
    trajectory = F.exists(low, lambda o: contains_any(o, ("[", "]", "trajectory", "series", "sequence")))
    spans = F.forall(low, lambda o: contains_any(o, (" to ", "-", "range")))
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, "none").when(trajectory, "trajectory").when(F.forall(low, is_number), "scalar").when(spans, "range").otherwise("categorical_text")


def stated_confidence(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, r"(?i)\bconfidence\s*[:=-]\s*(high|medium|low|0(?:\.\d+)?|1(?:\.0+)?)\b", 1))
    return F.nullif(found, F.lit(""))


def gold_letter(options: Column, answer: Column) -> Column:
    """Letter of the first option that is the answer, whatever its case and spaces."""
    plain = lambda t: F.regexp_replace(F.trim(F.lower(t)), r"\s+", " ")
    at = F.array_position(F.transform(F.slice(options, 1, 26), plain), plain(answer))
    return F.when(at > 0, F.char(at + 64))


def _is_wild(mean: Column, std: Column) -> Column:
    """A deviation over one and a half of the mean, or any about a mean of nothing."""
    return F.when(F.abs(mean) < 1e-8, std > 0).otherwise(F.abs(std / mean) > 1.5)


def row_flags(e: dict[str, Column], branch: Column, scope: Column | None = None) -> Column:
    """The verifier's flags of an evidence row; absent fields are null, and a null scope is global.

    Of the local scope a trend is judged by its chunks' ``r2s``, a period by ``chunk_periods`` against ``chunk_edges`` (structs of start and
    end), and trend, periodicity and anomaly need other fields.  ``mean`` and ``std`` may also come as pairs for both series: ``mean_1``, ``std_1`` and so on.
    """
    get = lambda k: e.get(k, F.lit(None))
    number = lambda k: get(k).cast("double")
    local = F.lit(False) if scope is None else F.coalesce(scope != "global", F.lit(False))
    lacks = lambda fields: reduce(Column.__or__, [get(f).isNull() for f in fields])
    missing = reduce(Column.__or__, [(branch == b) & (F.when(local, lacks(LOCAL_REQUIRED[b])).otherwise(lacks(fields)) if b in LOCAL_REQUIRED else lacks(fields)) for b, fields in REQUIRED.items()])
    poor = number("r2") < 0.65
    if "r2s" in e:
        poor = F.when(local, F.exists(e["r2s"], lambda r: F.coalesce(r < 0.65, F.lit(False)))).otherwise(poor)
    elif scope is not None:
        poor = ~local & poor
    too_long = number("dominant_period_fft") > number("n") / 2
    if "chunk_periods" in e and "chunk_edges" in e:
        chunks = F.zip_with(e["chunk_edges"], e["chunk_periods"], lambda c, p: F.coalesce(p > (c["end"] - c["start"]) / 2, F.lit(False)))
        too_long = F.coalesce(too_long, F.lit(False)) | ((branch == "periodicity") & local & F.coalesce(F.array_contains(chunks, True), F.lit(False)))
    pairs = [(f"mean{end}", f"std{end}") for end in ("", "_1", "_2") if f"mean{end}" in e]
    wild = reduce(Column.__or__, [F.coalesce(_is_wild(number(m), number(d)), F.lit(False)) for m, d in pairs], F.lit(False))
    tests = [
        ((branch == "trend") & poor, "low_r2"),
        (too_long, "fft_unreliable"),
        ((number("adf_pval") < 0.10) != (number("kpss_pval") >= 0.05), "adf_kpss_disagree"),
        ((branch == "causality") & (get("direction") == "none"), "granger_not_significant"),
        (F.abs(number("best_corr")) < 0.2, "weak_correlation"),
        (get("arch_effect_detected").cast("boolean"), "arch_effects"),
        (wild, "high_volatility"),
        (missing, "evidence_incomplete"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def _uneven(values: Column) -> Column:
    """Three values or more whose deviation is over half of their mean."""
    kept = F.filter(values, lambda v: v.isNotNull())
    n = F.size(kept)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / n
    std = F.sqrt(F.aggregate(kept, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return F.when(n >= 3, F.when(mean == 0, std > 0).otherwise(F.abs(std / mean) > 0.5)).otherwise(False)


def visual_gate(e: dict[str, Column], flags: Column, branch: Column, subtype: Column, question: Column, chunks: Sequence[Column] = ()) -> Column:
    """``struct<triggered, viz_type, confidence, reasons>``: whether the numbers leave so much open that a picture is asked for."""
    number = lambda k: e.get(k, F.lit(None)).cast("double")
    text = F.lower(F.coalesce(question, F.lit("")))
    some = lambda test: F.coalesce(test, F.lit(False))
    fits = F.sort_array(F.array_compact(F.array(number("r2"), number("exp_r2"), number("log_r2"))), asc=False)
    best, second = F.try_element_at(fits, F.lit(1)), F.try_element_at(fits, F.lit(2))
    p12, p21 = (F.coalesce(number(k), F.lit(1.0)) for k in ("pval_12", "pval_21"))
    corr, arch = number("best_corr"), some(e.get("arch_effect_detected", F.lit(None)).cast("boolean"))
    ratio = number("variance_ratio")
    uneven = reduce(Column.__or__, [some(_uneven(c)) for c in chunks], some((ratio >= 1.5) | (ratio <= 0.67)))
    incomplete = F.array_contains(flags, "evidence_incomplete")
    season, anomaly = contains_any(text, SEASON_WORDS), contains_any(text, ANOMALY_WORDS)
    terms = [
        (some(best < 0.65), 0.2, "low_fit"), (some(best - second < 0.05), 0.15, "fit_ambiguous"),
        (p12.between(0.04, 0.10) | p21.between(0.04, 0.10), 0.15, "pval_marginal"), (arch, 0.2, "arch_effects"), (some(number("adf_pval") > 0.10), 0.15, "adf_high_pval"),
        (some((F.abs(corr) >= 0.3) & (F.greatest(p12, p21) >= 0.1)), 0.15, "corr_granger_conflict"), (uneven, 0.15, "chunk_variance"),
        (season & some(number("seasonal_strength") < 0.2), 0.1, "weak_seasonal_signal"), (season & some(number("trend_strength") < 0.2), 0.05, "weak_trend_signal"),
        (anomaly & some(number("max_deviation") < 2.0), 0.1, "weak_anomaly_signal"),
    ]
    count = F.size(flags)
    lost = reduce(Column.__add__, [F.when(test, cost).otherwise(0.0) for test, cost, _ in terms], 0.15 * count + F.when(incomplete, 0.25).otherwise(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost))
    reasons = F.concat(F.sort_array(flags), F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in terms])))
    explicit = contains_any(text, VISUAL_WORDS)
    nowhere = F.coalesce(branch, F.lit("")).isin("", "unknown")
    direct = (count >= 2) | (incomplete & nowhere) | (arch & some((branch == "noise") | (subtype == "variance_level")))
    sure = (count == 0) & (
        some((best >= 0.75) & (second.isNull() | (best - second >= 0.1))) | some((F.abs(corr) >= 0.3) & (F.least(p12, p21) <= 0.01))
        | some(number("seasonal_strength") >= 0.6) | some(number("trend_strength") >= 0.6)
    )
    fires = F.when(sure & ~explicit, False).otherwise(direct | (F.round(score, 9) <= 0.85) | explicit)
    has = lambda names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    kind = (
        F.when(some(subtype.isin(*LINE_SUBTYPES)), "line_plot").when(contains_any(text, SPECTROGRAM_WORDS) | has(SPECTROGRAM_REASONS), "spectrogram")
        .when(contains_any(text, SHAPE_WORDS) | has(LINE_REASONS), "line_plot").when(some(branch.isin("periodicity", "noise", "causality")), "spectrogram").otherwise("line_plot")
    )
    return F.struct(fires.alias("triggered"), F.when(fires, kind).alias("viz_type"), score.alias("confidence"), reasons.alias("reasons"))


def learned_gate(additive: Column, branch: Column, suppressed: Sequence[str]) -> Column:
    """The additive decision, but never on the branches where looks were found to do harm; and what the policy did."""
    shut = F.coalesce(branch.isin(*suppressed), F.lit(False))
    fires = additive["triggered"] & ~shut
    return F.struct(
        fires.alias("triggered"), F.when(fires, additive["viz_type"]).alias("viz_type"),
        F.when(shut, "suppress").when(additive["triggered"], "keep").otherwise("keep_skip").alias("policy_decision"), additive["triggered"].alias("additive_would_fire"),
    )


def quality_gate(e: dict[str, Column], flags: Column, branch: Column, vision: Column, threshold: float = 0.55) -> Column:
    """``struct<score, passed, completeness, penalty, math>``: .35 completeness + .30 (1 - penalty) + .20 maths + .15 vision."""
    get = lambda k: e.get(k, F.lit(None))
    number = lambda k: get(k).cast("double")
    share = lambda fields: reduce(Column.__add__, [get(f).isNotNull().cast("double") for f in fields]) / len(fields)
    complete = reduce(lambda rest, b: F.when(branch == b, share(REQUIRED[b])).otherwise(rest), REQUIRED, F.lit(1.0))
    hard = F.size(F.array_intersect(flags, F.array(*map(F.lit, HARD_FLAGS))))
    penalty = F.least(F.lit(1.0), 0.12 * hard + F.when(F.array_contains(flags, "evidence_incomplete"), 0.30).otherwise(0.0))
    r2, adf, kpss, corr = (number(k) for k in ("r2", "adf_pval", "kpss_pval", "best_corr"))
    agree = (adf < 0.10) == (kpss >= 0.05)
    math = (
        F.when(r2.isNotNull(), F.when(r2 >= 0.75, 1.0).when(r2 >= 0.50, 0.7).otherwise(0.4)).when(agree.isNotNull(), F.when(agree, 1.0).otherwise(0.5))
        .when(corr.isNotNull(), F.least(F.lit(1.0), F.abs(corr) * 2)).otherwise(1.0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * complete + 0.30 * (1 - penalty) + 0.20 * math + 0.15 * vision))
    return F.struct(F.round(score, 4).alias("score"), (score >= threshold).alias("passed"), complete.alias("completeness"), penalty.alias("penalty"), math.alias("math"))


def scalar_head(value: Column, options: Column) -> Column:
    """0-based index of the option nearest to the value, the first of equals."""
    return F.array_min(F.transform(options, lambda o, i: F.struct(F.abs(o - value).alias("d"), i.alias("i"))))["i"]


def forecasts(arrays: DataFrame, horizon: int) -> DataFrame:
    """Persistence and drift forecasts of ``series_id, values``: ``series_id, method, step, value``."""
    n = F.size("values")
    last, first = F.element_at("values", -1), F.element_at("values", 1)
    step = F.when(n > 1, (last - first) / (n - 1)).otherwise(0.0)
    steps = arrays.select("series_id", last.alias("last"), step.alias("drift"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    long = F.explode(F.map_from_arrays(F.array(F.lit("persistence"), F.lit("drift")), F.array(F.col("last"), F.col("last") + F.col("drift") * F.col("step"))))
    return steps.select("series_id", F.col("step").cast("long").alias("step"), long.alias("method", "value"))


def forecast_rank(arrays: DataFrame, holdout: int = 8) -> DataFrame:
    """The method of least squared error over the last ``holdout`` points."""
    size = F.size("values")
    known = arrays.filter(size > holdout + 1).select("series_id", F.slice("values", F.lit(1), size - holdout).alias("values"), F.slice("values", size - holdout + 1, F.lit(holdout)).alias("future"))
    f = forecasts(known, holdout).join(known.select("series_id", "future"), "series_id")
    miss = F.col("value") - F.element_at("future", F.col("step").cast("int"))
    mse = f.groupBy("series_id", "method").agg(F.avg(miss * miss).alias("mse"))
    best = mse.groupBy("series_id").agg(F.min(F.struct(F.round("mse", 8).alias("mse"), "method")).alias("b"))
    return best.select("series_id", F.col("b.method").alias("method"), F.col("b.mse").alias("mse"))


_NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
_COMPARISON = r"(?i)(?:greater than|more than|above|exceeds?|>=|at least|less than|below|under|<=|at most)\s*" + _NUMBER
# Words of options that say an event happens, or doesn't, and of questions that ask for low values.
POSITIVE = ("yes", "true", "occur", "occurs", "event", "above", "exceed", "greater")
NEGATIVE = ("no", "false", "not", "none", "below")
LOW = ("less than", "below", "under", "<=", "at most")


def numbers(text: Column) -> Column:
    """The numbers of a text, as they come (a dash before a digit is its sign)."""
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), 1), lambda n: n.cast("double"))


def number_range(text: Column) -> Column:
    """``struct<low, high>`` of the first two numbers, or null."""
    found = numbers(text)
    a, b = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))
    return F.when(b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def event_head(rows: DataFrame, pts: DataFrame) -> DataFrame:
    """``question_id, letter, event, threshold`` of rows ``question_id, series_id, question, options`` that ask for a comparison.

    The extremes of each series answer all its questions; a question without comparison or without a fitting option has no letter.
    """
    ends = pts.groupBy("series_id").agg(F.max("value").alias("most"), F.min("value").alias("least"))
    threshold = F.nullif(F.regexp_extract("question", _COMPARISON, 1), F.lit("")).cast("double")
    asked = rows.withColumn("threshold", F.when(F.size("options") >= 2, threshold)).join(ends, "series_id", "left")
    low = contains_any(F.lower("question"), LOW)
    asked = asked.withColumn("event", F.when(low, F.col("least") <= F.col("threshold")).otherwise(F.col("most") >= F.col("threshold")))
    fits = lambda o: F.when(F.col("event"), contains_any(F.trim(F.lower(o)), POSITIVE)).otherwise(contains_any(F.trim(F.lower(o)), NEGATIVE))
    at = F.array_position(F.transform("options", fits), True)
    return asked.select("question_id", F.when(F.col("event").isNotNull() & at.between(1, 26), F.char(at + 64)).alias("letter"), "event", "threshold")


def range_head(rows: DataFrame, pts: DataFrame) -> DataFrame:
    """``question_id, letter, method``: the range option that one of the forecasts of the next value fits best.

    A range that holds a forecast scores 1, another the negative distance from its middle in widths; the first of equals wins.
    Forecasts: the last value, the drift from first to last, and the value one season back (a season is the
    dominant period of series of 8 points or more, if it is between 2 and half their length).
    """
    from chronoloom.operators.spectral import dominant_period

    ends = pts.groupBy("series_id").agg(F.count("*").alias("n"), F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"))
    period = dominant_period(pts.join(ends.filter("n >= 8").select("series_id"), "series_id", "left_semi"), detrend=False)
    season = ends.join(period, "series_id", "left").withColumn("season", F.expr("CAST(bround(period) AS BIGINT)"))
    season = season.withColumn("season", F.when(F.col("season").between(2, F.floor(F.col("n") / 2)), F.col("season")))
    back = season.withColumn("pos", F.col("n") - F.col("season")).join(pts.select("series_id", "pos", "value"), ["series_id", "pos"], "left")
    drift = F.when(F.col("n") >= 2, F.col("last") + (F.col("last") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("last"))
    known = back.select("series_id", "n", F.col("last").alias("persistence"), drift.alias("drift"), F.coalesce("value", "last").alias("seasonal_naive"))
    methods = ("persistence", "drift", "seasonal_naive")
    asked = rows.withColumn("ranges", F.transform("options", number_range)).join(known, "series_id").filter("n >= 2 AND size(options) > 0 AND forall(ranges, r -> r IS NOT NULL)")

    def score(r: Column, point: Column) -> Column:
        width = F.greatest(r["high"] - r["low"], F.lit(1e-12))
        return F.when(point.between(r["low"], r["high"]), 1.0).otherwise(-F.abs(point - (r["low"] + r["high"]) / 2) / width)

    # Rounded, so that equals stay equal whatever the order of additions; of equals the first option and the first method.
    each = lambda r, i: F.array_max(F.array(*[
        F.struct(F.round(score(r, F.col(m)), 9).alias("score"), (-i).alias("option"), F.lit(-k).alias("place"), F.lit(m).alias("method")) for k, m in enumerate(methods)
    ]))
    best = F.array_max(F.transform("ranges", each))
    return asked.withColumn("best", best).filter("best.option > -26").select("question_id", F.char(F.lit(65) - F.col("best.option")).alias("letter"), F.col("best.method").alias("method"))

"""Replies of models read into columns, and the choices made from them; nothing is guessed where a reply is not well formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.verify import BRANCHES

# Actions that may be proposed, fields of a look's reply, and fields that a trace leaves out.
ACTIONS = (*BRANCHES, "vision", "numeric_head")
LOOK_FIELDS = ("pattern_type", "trend_direction", "noise_level", "dominant_ridges", "anomaly_regions", "phase_alignment", "confidence", "summary")
VOLATILE = (
    "path", "artifact_path", "artifacts", "tmp", "tmpdir", "timestamp", "time", "duration", "duration_ms", "raw", "raw_answer", "raw_router",
)
SPECTRAL = ("periodicity", "noise", "causality")


def json_text(raw: Column) -> Column:
    """What stands in a fence, else between the outermost braces, else all of it."""
    text = F.trim(raw)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braced != "", braced).otherwise(text)


def _object(text: Column, fields: str) -> Column:
    parsed = F.from_json(text, f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(parsed["_bad"].isNull(), parsed)


def proposal(raw: Column) -> Column:
    """``struct<action, reason>`` of a proposed action of the registry with a reason, or null."""
    said = _object(json_text(raw), "action string, reason string")
    action, reason = F.trim(F.lower(said["action"])), F.trim(said["reason"])
    return F.when(action.isin(*ACTIONS) & (reason != ""), F.struct(action.alias("action"), reason.alias("reason")))


def critic_choice(raw: Column, candidates: Column) -> Column:
    """The candidate that a critic's JSON names, else the first candidate that its text mentions, or null."""
    named = F.trim(F.lower(_object(json_text(raw), "branch string")["branch"]))
    same = F.filter(candidates, lambda c: F.lower(c) == named)
    mentioned = F.filter(candidates, lambda c: F.contains(F.lower(raw), F.lower(c)))
    return F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(mentioned, F.lit(1)))


def look(raw: Column) -> Column:
    """``struct`` of a look's fields with defaults for what is missing and ``parsed``; a reply without JSON has its text as summary."""
    bare = F.regexp_replace(raw, r"```[A-Za-z]*|```", "")
    kinds = {"dominant_ridges": "array<string>", "anomaly_regions": "array<string>", "confidence": "double"}
    said = _object(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), ", ".join(f"{f} {kinds.get(f, 'string')}" for f in LOOK_FIELDS))
    default = {"dominant_ridges": F.array().cast("array<string>"), "anomaly_regions": F.array().cast("array<string>"), "confidence": F.lit(0.0)}
    fields = [(F.coalesce(said[f], default[f]) if f in default else said[f]).alias(f) for f in LOOK_FIELDS[:-1]]
    summary = F.when(said.isNotNull(), F.trim(said["summary"])).otherwise(F.trim(raw))
    return F.struct(*fields, summary.alias("summary"), said.isNotNull().alias("parsed"))


def stationarity_label(is_stationary: Column, options: Column) -> Column:
    """``struct<label, note>``: the label, or the first option that contains it or is contained in it."""
    label = F.when(is_stationary, "stationary").otherwise("non-stationary")
    plain = lambda t: F.regexp_replace(F.trim(F.lower(t)), "[- ]", "")
    fits = F.filter(options, lambda o: F.contains(plain(o), plain(label)) | F.contains(plain(label), plain(o)))
    found = F.trim(F.try_element_at(fits, F.lit(1)))
    note = F.when(is_stationary.isNull(), "categorical:no_signal").when(found.isNotNull(), "categorical:stationarity:mapped").otherwise("categorical:stationarity")
    return F.struct(F.when(is_stationary.isNotNull(), F.coalesce(found, label)).alias("label"), note.alias("note"))


def look_override(fires: Column, viz: Column, branch: Column, proposed: Column, forced: Sequence[str] = (), shut: Sequence[str] = ()) -> Column:
    """``struct<triggered, viz_type, why>`` after forced branches, shut branches (which win) and proposed looks."""
    own = F.when(branch.isin(*SPECTRAL), "spectrogram").otherwise("line_plot")
    is_shut, is_forced = (F.coalesce(branch.isin(*names), F.lit(False)) if names else F.lit(False) for names in (shut, forced))
    asks = F.coalesce(proposed, F.lit(False)) & ~is_shut
    triggered = F.when(is_shut, False).otherwise(fires | is_forced | asks)
    kind = F.when(is_forced, own).when(fires, viz).otherwise(own)
    why = F.when(is_shut, "suppressed").when(asks, "proposed").when(is_forced, "forced").otherwise("gate")
    return F.struct(triggered.alias("triggered"), F.when(triggered, kind).alias("viz_type"), why.alias("why"))


def arbitrated(scores: DataFrame, by: str) -> DataFrame:
    """Per row the branch of best score (of equals the first by name), the second, and whether a critic would be asked.

    It would where the two best are within .10, or the best is below .55.
    """
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "branch"))
    place = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    top = scores.withColumn("place", rank).filter(F.col("place") <= 2).groupBy(by).agg(
        place(1, "branch").alias("branch"), place(1, "score").alias("score"), place(2, "branch").alias("second"), place(2, "score").alias("second_score")
    )
    close = (F.round(F.col("score") - F.col("second_score"), 9) < 0.10) | (F.col("score") < 0.55)
    return top.select(by, "branch", "score", "second", F.coalesce(close, F.lit(False)).alias("asks_critic"))


def trace_hash(row: dict[str, Column], numbers: Sequence[str] = ()) -> Column:
    """sha256 of a trace's fields as one JSON object in order of name, without volatile ones, numbers rounded to 6 places.

    Nulls are JSON's, so they differ from the text "null"; nested fields stay nested, and a text can imitate no field.
    """
    shown = lambda k: row[k].cast("decimal(38,6)") if k in numbers else row[k]
    fields = F.struct(*[shown(k).alias(k) for k in sorted(row) if k not in VOLATILE])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)

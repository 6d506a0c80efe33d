"""Mixing sources to target weights, as DataFrame aggregates.

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources in
order of code point, null last, take the weights in turn and share all words by weight; a target
stops at ``max_repeats`` times its source's size and the excess goes to the others by weight, until
none is above (water filling, solved in closed form over the sources sorted by cap per weight).
A source's repetition rate is target / size: each of its documents is emitted floor(rate) times,
plus once if a hash of seed and id, as a number in [0, 1), is below the rate's fraction.

Defined results: rows with null or repeated ids are documents like any other (equal ids draw
alike); documents without words are never emitted where a source has no words, as its rate is 0; sources of equal caps
are settled in order of name; a very long text is counted by one pass of a regular expression and is one document, so a source of few
such documents can miss its target by one of them; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Sources whose targets are broadcast (some MB), and salts of a join with more of them.
MOST_SOURCES, SALTS = 50_000, 64


def n_words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``; one row per source.

    The global windows run over one row per source, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        capped.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # With all sources before this one at their caps, the level is what is left per weight; the
    # first source whose cap is at or above that level, and all after it, take the level.
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    by_cap = F.row_number().over(W.orderBy(F.col("cap") / F.col("weight"), "place"))
    filled = filled.withColumn("level", level).withColumn("place_by_cap", by_cap)
    settled = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("place_by_cap", "level")))
    filled = filled.withColumn("settled", settled.over(everything))
    target = F.when(F.col("place_by_cap") < F.col("settled.place_by_cap"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("settled.level")
    )
    return filled.select("source", "source_size", target.alias("target"))


def draw(id_col: str | Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed, id); the same in any engine."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, copies, taken`` (taken = size * copies)."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    return _taken(sized, weights, max_repeats, seed).select("doc_id", "size", "source_size", "target", "copies", "taken")


def with_targets(sized: DataFrame, targets: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Documents with the target of their source, without a shuffle on the source.

    Targets are one row a source.  Up to ``most_sources`` of them are broadcast; more are joined on source and a salt of ``SALTS`` values, so
    that a source of many documents is dealt over as many tasks.
    """
    targets, _ = written(targets.withColumnRenamed("source", "__source"), "mixing-targets")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if targets.count() <= most_sources:
        return sized.join(F.broadcast(targets), same).drop("__source")
    salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = sized.withColumn("__deal", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("__deal") == F.col("__salt"))).drop("__source", "__salt", "__deal")


def _taken(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str, most_sources: int = MOST_SOURCES) -> DataFrame:
    joined = with_targets(sized, source_targets(sized.select("source", "size"), weights, max_repeats), most_sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw("doc_id", seed) < rate - whole, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    emitted = _taken(sized, weights, max_repeats, seed).filter("copies > 0")
    return emitted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals
), capped AS (
  SELECT *, CAST([5, 2, 1][place % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM ranked
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS cap_before,
    CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_before,
    row_number() OVER (ORDER BY cap / weight, place) AS place_by_cap
  FROM capped WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - cap_before) / (all_weight - weight_before) AS level FROM filled
), settled AS (
  SELECT min(place_by_cap) AS first_place, min_by(level, place_by_cap) AS at_level FROM levels WHERE cap >= weight * level
), targets AS (
  SELECT source, source_size,
    CASE WHEN place_by_cap < first_place THEN CAST(cap AS DOUBLE) ELSE weight * at_level END AS target
  FROM levels, settled
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""

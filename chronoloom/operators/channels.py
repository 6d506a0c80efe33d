"""Operators over several series of a row: all channels at once, and one reference against many candidates.

Null and empty arrays are no series; null points stay, as operators drop them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.guards import correlation
from chronoloom.operators.pairwise import euclidean, similarity_labels

Operator = Callable[[DataFrame], DataFrame]


def active_channels(channels: Sequence[str], alone: str | None = None) -> Column:
    """``array<struct<channel, values>>`` of the channels with points, in order; ``alone`` counts only where none of them has any."""
    entry = lambda c: F.struct(F.lit(c).alias("channel"), F.col(c).alias("values"))
    full = lambda entries: F.filter(entries, lambda e: F.size(e["values"]) > 0)
    some = full(F.array(*map(entry, channels)))
    return some if alone is None else F.when(F.size(some) > 0, some).otherwise(full(F.array(entry(alone))))


def over_channels(rows: DataFrame, operator: Operator, name: str, channels: Sequence[str] = ("ts1", "ts2"), alone: str = "ts", key: str = "question_id") -> DataFrame:
    """One operator over every active channel of rows with array columns, in one pass of points.

    ``operator`` turns points ``series_id, pos, value`` into one row of fields a series.  Adds the fields of the first
    channel, ``series_keys, series_lengths`` (a map), ``series_mode`` (``multi``, ``single`` or null for none) and, where there are
    several channels, the fields of each as ``<channel>_<name>``.  ``key`` names a row; rows without series keep null fields.
    """
    staged = rows.withColumn("__active", active_channels(channels, alone))
    each = staged.select(F.col(key).alias("__key"), F.posexplode("__active").alias("place", "__series"))
    of = F.struct("__key", "place", F.col("__series.channel").alias("channel")).alias("series_id")
    points = each.select(of, F.posexplode("__series.values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    found = operator(points)
    fields = [c for c in found.columns if c != "series_id"]
    told = F.struct(*[F.col(f"`{c}`") for c in fields])
    pick = lambda test: F.first(F.when(test, told), ignorenulls=True)
    known = [*channels, alone]
    wide = found.groupBy(F.col("series_id.__key").alias("__key")).agg(
        pick(F.col("series_id.place") == 0).alias("__first"), *[pick(F.col("series_id.channel") == c).alias(f"__{c}") for c in known]
    )
    joined = staged.join(wide, F.col(key).eqNullSafe(F.col("__key")), "left")
    several = F.size("__active") > 1
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.col("__first")[c].alias(c) for c in fields],
        F.when(several, "multi").when(F.size("__active") == 1, "single").alias("series_mode"), F.transform("__active", lambda a: a["channel"]).alias("series_keys"),
        F.map_from_arrays(F.transform("__active", lambda a: a["channel"]), F.transform("__active", lambda a: F.size(a["values"]))).alias("series_lengths"),
        *[F.when(several, F.col(f"__{c}")).alias(f"{c}_{name}") for c in channels],
    )


def against_candidates(rows: DataFrame, key: str = "question_id", reference: str = "reference", candidates: str = "candidates") -> DataFrame:
    """Each candidate array of a row compared with the row's reference over their common length, and ranked.

    ``key, candidate, letter, n, correlation, distance, trend, level, range, variance, place, error``: place 1 is the least distance of the standardised
    series, of equals the larger correlation, then the first; a candidate without a common point has an error and no place.  Candidates
    are aligned within their row, so rows grow with points and no list of pairs is made.
    """
    each = rows.select(F.col(key).alias("__key"), F.col(reference).alias("__r"), F.posexplode(candidates).alias("candidate", "__c"))
    n = F.when(F.col("__r").isNotNull() & F.col("__c").isNotNull(), F.least(F.size("__r"), F.size("__c"))).otherwise(0)
    each = each.withColumn("n", n)
    pair = F.struct("__key", "candidate").alias("pair_id")
    zipped = F.arrays_zip(F.slice("__r", F.lit(1), F.col("n")).alias("a"), F.slice("__c", F.lit(1), F.col("n")).alias("b"))
    points = each.filter("n > 0").select(pair, F.posexplode(zipped).alias("pos", "p")).select("pair_id", F.col("pos").cast("long").alias("pos"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    points = points.filter("a IS NOT NULL AND b IS NOT NULL")
    r = points.groupBy("pair_id").agg(correlation(F.col("a"), F.col("b")).alias("correlation"))
    found = r.join(euclidean(points), "pair_id").join(similarity_labels(points).select("pair_id", "trend", "level", "range", "variance"), "pair_id")
    told = found.select(F.col("pair_id.__key").alias("__k"), F.col("pair_id.candidate").alias("__at"), "correlation", "distance", "trend", "level", "range", "variance")
    joined = each.join(told, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("candidate") == F.col("__at")), "left")
    order = F.struct(F.round("distance", 9), -F.round(F.coalesce("correlation", F.lit(-2.0)), 9), "candidate")
    # A row's candidates are a list already, so their places come from sorting it.
    mine = F.struct(order.alias("order"), *[F.col(c) for c in ("candidate", "n", "correlation", "distance", "trend", "level", "range", "variance")])
    lists = joined.groupBy(F.col("__key").alias(key)).agg(
        F.array_sort(F.collect_list(F.when(F.col("distance").isNotNull(), mine))).alias("good"), F.collect_list(F.when(F.col("distance").isNull(), mine)).alias("none")
    )
    placed = F.transform("good", lambda g, i: F.struct(g.alias("g"), (i + 1).alias("place")))
    unplaced = F.transform("none", lambda g: F.struct(g.alias("g"), F.lit(None).cast("int").alias("place")))
    out = lists.select(key, F.explode(F.concat(placed, unplaced)).alias("x"))
    letter = F.when(F.col("x.g.candidate") < 26, F.char(F.col("x.g.candidate") + 65)).alias("letter")
    error = F.when(F.col("x.place").isNull(), "similarity_error").alias("error")
    return out.select(key, F.col("x.g.candidate").alias("candidate"), letter, *[F.col(f"x.g.{c}").alias(c) for c in ("n", "correlation", "distance", "trend", "level", "range", "variance")], "x.place", error)

"""Reports over result tables: metrics, rollups, audits, verdicts, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.guards import ratio
from chronoloom.operators.experiment import mcnemar_p
from chronoloom.operators.resampling import paired_bootstrap


def truthy(value: Column, wide: bool = True) -> Column:
    """Whether a cell says true: ``true``, ``1``, ``1.0`` and, if wide, ``yes``."""
    words = ("true", "1", "1.0", "yes") if wide else ("true", "1", "1.0")
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*words), F.lit(False))


def normal_letter(value: Column) -> Column:
    """Upper-cased letter, empty for null, ``nan`` and ``none``."""
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin("NAN", "NONE"), "").otherwise(text)


def confidence_bucket(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin("high", "medium", "low"), text).otherwise("other")


def scoreable(rows: DataFrame, gold: str = "gold") -> DataFrame:
    """Rows whose gold answer is a letter A to D."""
    return rows.filter(normal_letter(F.col(gold)).isin("A", "B", "C", "D"))


def metrics(rows: DataFrame) -> DataFrame:
    """``dim, key, total, correct, parse_failures, fallbacks`` overall and by category, branch and flag; rows without gold don't count.

    A row counts under each of its flags.  The overall row also has ``no_gold``.
    """
    counted = [F.count("*").alias("total"), F.sum(F.col("correct").cast("long")).alias("correct"), F.count_if(F.col("pred").isNull()).alias("parse_failures"), F.count_if("used_fallback").alias("fallbacks")]
    graded = rows.filter("gold IS NOT NULL")
    named = F.array(
        F.struct(F.lit("overall").alias("dim"), F.lit("all").alias("key")),
        F.struct(F.lit("category").alias("dim"), F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("key")),
        F.struct(F.lit("branch").alias("dim"), F.coalesce(F.nullif("branch", F.lit("")), F.lit("fallback")).alias("key")),
    )
    flags = F.transform("flags", lambda f: F.struct(F.lit("flag").alias("dim"), f.alias("key")))
    by = graded.withColumn("of", F.explode(F.concat(named, flags))).groupBy("of.dim", "of.key").agg(*counted)
    missing = rows.agg(F.count_if(F.col("gold").isNull()).alias("n"))
    return by.join(F.broadcast(missing)).select("*", F.when(F.col("dim") == "overall", F.col("n")).alias("no_gold")).drop("n")  # one row


def accuracy_rollup(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Accuracy per pair, per outer key, and of all rows (``OVERALL``)."""
    rolled = rows.rollup(outer, inner).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.grouping(outer).alias("o"), F.grouping(inner).alias("i"))
    named = lambda c, g: F.when(F.col(g) == 1, "OVERALL").otherwise(F.coalesce(c, F.lit("unknown"))).alias(c)
    return rolled.select(named(outer, "o"), named(inner, "i"), "n", "accuracy")


def router_disagreement(rows: DataFrame, by: str, first: str, last: str) -> DataFrame:
    """Share of rows that two runs route differently; null is a value."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg((~F.col(first).eqNullSafe(F.col(last))).cast("double")).alias("rate"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Values by falling count (then by value) with their place."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), F.asc_nulls_last(column))))  # one row a value


def routing_audit(rows: DataFrame) -> DataFrame:
    """Counts by branch, by branch and subtype, and by schema, in one pass."""
    keys = ["branch", "subtype", "schema"]
    sets = rows.groupingSets([["branch"], ["branch", "subtype"], ["schema"]], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    level = F.when(F.col("g") == 3, "branch").when(F.col("g") == 1, "branch_subtype").otherwise("schema")
    return sets.select(level.alias("level"), *keys, "n")


def gate_verdict(rows: DataFrame, floor: float = -0.005, reps: int = 10_000) -> DataFrame:
    """One row on ``correct, correct_t, looked, looked_t, branch, branch_t``.

    H1: the lower end of the difference's interval is at least the floor, at fewer looks.  H2: no branch gets significantly worse.
    """
    ends = paired_bootstrap(rows, reps, "verdict").select("low", "high")
    flag = lambda c: F.sum(F.col(c).cast("long"))
    all_rows = rows.agg(
        F.count("*").alias("n"), F.avg(F.col("correct_t") - F.col("correct")).alias("delta"), flag("looked").alias("looks"), flag("looked_t").alias("looks_t"),
        F.avg((~F.col("branch").eqNullSafe(F.col("branch_t"))).cast("double")).alias("drift"),
    )
    per = rows.groupBy("branch").agg(
        F.avg(F.col("correct_t") - F.col("correct")).alias("d"), F.count_if(F.expr("correct = 1 AND correct_t = 0")).alias("b"), F.count_if(F.expr("correct = 0 AND correct_t = 1")).alias("c")
    )
    worse = per.agg(F.count_if((F.col("d") < 0) & (mcnemar_p(F.col("b"), F.col("c")) < 0.05)).alias("regressions"))
    told = all_rows.join(F.broadcast(ends)).join(F.broadcast(worse))  # one row each
    return told.withColumns({"h1": (F.col("low") >= floor) & (F.col("looks_t") < F.col("looks")), "h2": F.col("regressions") == 0})


def fired_looks(rows: DataFrame) -> DataFrame:
    """Rows on which the arm ``s`` looked: ``fired`` is none of false, 0, none or nothing and ``look_s`` names a letter."""
    told = ~F.lower(F.trim(F.coalesce(F.col("fired").cast("string"), F.lit("")))).isin("false", "0", "none", "")
    return rows.filter(told & (normal_letter(F.col("look_s")) != ""))


def net_value(rows: DataFrame, by: str) -> DataFrame:
    """Net value of two looking arms (``s``, ``p``) over the arm without, and how often each follows a wrong look.

    ``rows`` has ``correct_off, math`` (the letter without looking), ``gold`` and per arm ``correct_, look_, pred_``.  Every row counts;
    for the rows with a look alone, pass those of ``fired_looks``.
    """
    gold, math = normal_letter(F.col("gold")), normal_letter(F.col("math"))
    out = [F.count("*").alias("n")]
    for arm in ("s", "p"):
        look = normal_letter(F.col(f"look_{arm}"))
        wrong = (look != "") & (math != "") & (look != math) & (gold != "") & (look != gold)
        followed = wrong & (normal_letter(F.col(f"pred_{arm}")) == look)
        out += [F.avg(F.col(f"correct_{arm}") - F.col("correct_off")).alias(f"net_{arm}"), F.count_if(wrong).alias(f"wrong_{arm}"), ratio(F.count_if(followed).cast("double"), F.count_if(wrong)).alias(f"sycophancy_{arm}")]
    return rows.groupBy(by).agg(*out)


# Quantities by how their values come about.
QUANTITY_CLASSES = {"count_local_max": "method_sensitive", "count_local_min": "method_sensitive", "period": "method_sensitive", "slope": "regression"}


def numeric_audit(rows: DataFrame) -> DataFrame:
    """Accuracy, mean relative accuracy, abstentions and accuracy of attempts of numerical rows, by class of quantity."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in QUANTITY_CLASSES.items() for x in pair])[F.col("quantity")], F.when(F.col("quantity").isNotNull(), "closed_form"), F.lit("none"))
    abstained = F.trim(F.coalesce("predicted_value", F.lit(""))) == ""
    ok = F.col("correct").cast("double")
    mine = rows.filter("schema = 'numerical'").withColumn("quantity_class", kind)
    return mine.groupBy("quantity_class").agg(
        F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.avg("rel_acc").alias("rel_acc"), F.avg(abstained.cast("double")).alias("abstain_rate"), F.avg(F.when(~abstained, ok)).alias("accuracy_attempted")
    )


def schema_agreement(rows: DataFrame) -> DataFrame:
    """How often the schema found is the one that the row's kind says, over rows of a known kind."""
    kind = F.lower("qa_type")
    said = F.when(kind.contains("numerical"), "numerical").when(kind.contains("choice"), "mcq")
    return rows.filter(said.isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col("schema") == said).cast("double")).alias("agreement"))


def agency(rows: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Gated, fired and executed rows, and what executed actions did to answers."""
    ran = F.size(F.coalesce(F.from_json("executed", "array<string>"), F.array().cast("array<string>"))) > 0
    right = lambda c: F.col(c) == 1
    return rows.agg(
        F.count("*").alias("n"), F.count("quality_score").alias("scored"), F.count_if(F.col("quality_score") < threshold).alias("gated"), F.count_if(truthy(F.col("fired"))).alias("fired"), F.count_if(ran).alias("executed"),
        F.count_if(ran & ~right("correct") & right("correct_t")).alias("corrected"), F.count_if(ran & right("correct") & ~right("correct_t")).alias("broken"),
    )


def actions(rows: DataFrame) -> DataFrame:
    """Histogram of executed actions."""
    return rows.select(F.explode(F.from_json("executed", "array<string>")).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def delta_matrix(rows: DataFrame, baselines: DataFrame) -> DataFrame:
    """Accuracy by category less that of each baseline ``name, category, accuracy`` (a short list); null where a baseline has none."""
    own = rows.groupBy("category").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    names = baselines.select("name").distinct()
    grid = own.join(F.broadcast(names))  # a name a baseline
    known = baselines.select("name", "category", F.col("accuracy").alias("baseline"))
    return grid.join(F.broadcast(known), ["name", "category"], "left").select("name", "category", "accuracy", "baseline", (F.col("accuracy") - F.col("baseline")).alias("delta"))


def three_arms(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Rows that all three arms have."""
    return a.join(b, key).join(c, key)


def enriched(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with missing values of ``columns`` filled from a lookup with the same keys."""
    known = lookup.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(known, list(keys), "left")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "sample") -> DataFrame:
    """``n`` rows of each stratum, by least md5 of seed and key; ranked within tasks first, so no stratum is sorted whole."""
    rank = F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")).alias("rank"), F.col(key))
    salted = rows.select("*", rank.alias("__rank"), F.pmod(F.xxhash64(key), F.lit(64)).alias("__salt"))
    some = salted.withColumn("__at", F.row_number().over(W.partitionBy(stratum, "__salt").orderBy("__rank"))).filter(F.col("__at") <= n)
    few = some.withColumn("__at", F.row_number().over(W.partitionBy(stratum).orderBy("__rank"))).filter(F.col("__at") <= n)
    return few.drop("__rank", "__salt", "__at")


def unknown_keys(given: Sequence[str], allowed: Sequence[str]) -> list[str]:
    """Settings that don't exist, in order (the caller refuses them)."""
    return sorted(set(given) - set(allowed))

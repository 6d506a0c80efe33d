"""Scoring, paired comparison and inferential statistics over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.guards import ratio


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion; (0, 0) without trials."""
    p = ratio(hits, n)
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    safe = lambda x: F.when(n > 0, x).otherwise(0.0)
    return safe(centre - half), safe(centre + half)


def accuracy_by(results: DataFrame, stratum: str, correct: str = "correct") -> DataFrame:
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    counted = results.groupBy(stratum).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("hits"))
    return counted.select(stratum, "n", "hits", (F.col("hits") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"))


def overall_accuracy(results: DataFrame, stratum: str, correct: str = "correct") -> DataFrame:
    """Macro (mean of strata) and micro (pooled) accuracy."""
    per = results.groupBy(stratum).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("hits"))
    return per.agg(F.avg(F.col("hits") / F.col("n")).alias("macro"), (F.sum("hits") / F.sum("n")).alias("micro"), F.count("*").alias("strata"))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: min(1, 2 P(X <= min) for a fair coin).

    Binomial terms come from running sums of logarithms.  Terms are summed up to min(b, c), so
    the work is linear in the discordant pairs of a stratum.
    """
    n, k = b + c, F.least(b, c)
    steps = F.sequence(F.lit(0), k.cast("int"))
    start = F.struct((F.lit(0.0) - n * F.ln(F.lit(2.0))).alias("log_term"), F.lit(0.0).alias("sum"))

    def add(done: Column, i: Column) -> Column:
        log_term = done["log_term"] + F.when(i > 0, F.ln(n - i + 1) - F.ln(i)).otherwise(0.0)
        return F.struct(log_term.alias("log_term"), (done["sum"] + F.exp(log_term)).alias("sum"))

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add, lambda d: d["sum"])))


def paired(base: DataFrame, treatment: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both arms with the same keys; of repeated keys the first by ``order`` counts."""
    first = lambda df: df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy("order"))).filter("__rn = 1").drop("__rn", "order")
    return first(base).join(first(treatment).withColumnRenamed("correct", "correct_t").select(*keys, "correct_t"), keys)


def paired_stats(pairs: DataFrame, stratum: str) -> DataFrame:
    """Per stratum (null is one): accuracies, their difference, discordant pairs and McNemar's p."""
    s = pairs.groupBy(stratum).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc_base"), F.avg(F.col("correct_t").cast("double")).alias("acc_treat"),
        F.count_if(F.expr("correct = 1 AND correct_t = 0")).alias("b"), F.count_if(F.expr("correct = 0 AND correct_t = 1")).alias("c"),
    )
    return s.withColumn("delta", F.col("acc_treat") - F.col("acc_base")).withColumn("p", mcnemar_p(F.col("b"), F.col("c")))


def holm(tests: DataFrame, p: str = "p", by: str = "name") -> DataFrame:
    """Step-down adjusted p; a table of tests, so the window over all its rows is small."""
    order = W.orderBy(F.col(p), F.col(by))
    scaled = tests.withColumn("__m", F.count("*").over(W.partitionBy())).withColumn("__r", F.row_number().over(order) - 1)
    adjusted = F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__r")) * F.col(p)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return scaled.withColumn("p_holm", adjusted).drop("__m", "__r")


def cluster_leave_one_out(pairs: DataFrame, cluster: str) -> DataFrame:
    """Overall difference of the arms without each cluster."""
    per = pairs.groupBy(cluster).agg(F.sum("correct").alias("b"), F.sum("correct_t").alias("t"), F.count("*").alias("n"))
    total = W.partitionBy()
    left = lambda c: F.sum(c).over(total) - F.col(c)
    return per.select(cluster, "n", F.when(left("n") > 0, (left("t") - left("b")) / left("n")).alias("delta_without"))


def cluster_bootstrap(pairs: DataFrame, cluster: str, reps: int = 200, seed: str = "boot") -> DataFrame:
    """Percentile interval of the arms' difference under resampling of clusters.

    Draws come from md5(seed, repetition, draw), so any engine gives the same ones; the rows are
    clusters times repetitions, never documents.
    """
    per = pairs.groupBy(cluster).agg(F.sum("correct").alias("b"), F.sum("correct_t").alias("t"), F.count("*").alias("n"))
    per = per.withColumn("i", F.row_number().over(W.orderBy(cluster)) - 1).withColumn("k", F.count("*").over(W.partitionBy()))
    draws = per.select("i", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("rep"), F.col("i")).cast("binary"))
    drawn = draws.select("rep", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.col("k")).cast("int").alias("i"))
    deltas = drawn.join(per, "i").groupBy("rep").agg(((F.sum("t") - F.sum("b")) / F.sum("n")).alias("delta"))
    return deltas.agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"), F.avg("delta").alias("mean"))


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return rows.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def flag_diagnostics(rows: DataFrame) -> DataFrame:
    """Precision, recall and lift of each flag of ``flags`` for wrong answers; ungraded rows don't count."""
    graded = rows.filter("correct IS NOT NULL")
    total = graded.agg(F.count("*").alias("rows"), F.count_if(F.col("correct") == 0).alias("wrong"))
    fired = graded.select("correct", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("fired"), F.count_if(F.col("correct") == 0).alias("caught"))
    both = fired.join(F.broadcast(total))  # one row
    precision = F.col("caught") / F.col("fired")
    return both.select(
        "flag", "fired", precision.alias("precision"), ratio(F.col("caught"), F.col("wrong")).alias("recall"),
        ratio(precision, F.col("wrong") / F.col("rows")).alias("lift"), (F.col("fired") / F.col("rows")).alias("fire_rate"),
    )


def majority_vote(votes: DataFrame, by: str, vote: str) -> DataFrame:
    """The commonest vote, upper-cased, nulls dropped; of equals the alphabetically smallest."""
    counted = votes.filter(F.col(vote).isNotNull()).groupBy(by, F.upper(vote).alias("v")).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")).select(by, F.col("b.v").alias("vote"), (-F.col("b.m")).alias("n"))


def numeric_score(rows: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """``correct`` and ``rel_acc`` of ``predicted`` against ``gold``; near-zero golds are compared absolutely."""
    gap = F.abs(F.col("predicted") - F.col("gold"))
    tiny = F.abs("gold") < 1e-9
    relative = F.when(~tiny, gap / F.abs("gold"))
    correct = F.when(tiny, gap <= 1e-9).otherwise(relative <= tolerance)
    accuracy = F.when(tiny, F.when(gap <= 1e-9, 1.0).otherwise(0.0)).otherwise(F.greatest(1 - relative, F.lit(0.0)))
    return rows.withColumns({"correct": F.coalesce(correct, F.lit(False)).cast("int"), "rel_acc": F.coalesce(accuracy, F.lit(0.0))})


def tolerance_sweep(rows: DataFrame, by: str, tolerances: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    swept = [numeric_score(rows, t).groupBy(by).agg(F.avg("correct").alias("accuracy")).withColumn("tolerance", F.lit(t)) for t in tolerances]
    out = swept[0]
    for s in swept[1:]:
        out = out.unionByName(s)
    return out


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key), key, "left_anti")


def _held_out(rows: DataFrame) -> DataFrame:
    """``fold, branch, g, n, mean``: gains of a branch in a subset, and its mean gain in all others (null: not met there).

    ``rows`` has ``subset, branch, gain`` (+1, 0, -1 for following a branch).  A fold without other rows is left out.
    """
    per = rows.groupBy("subset", "branch").agg(F.sum("gain").alias("g"), F.count("*").alias("n"))
    # What the other subsets have is the total less the own; branches are few, so their totals are one row.
    totals = per.groupBy("branch").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).agg(F.collect_list(F.struct("branch", "g", "n")).alias("all"), F.sum("n").alias("rows"))
    folds = per.groupBy(F.col("subset").alias("fold")).agg(F.collect_list(F.struct("branch", "g", "n")).alias("own"), F.sum("n").alias("held"))
    told = folds.join(F.broadcast(totals)).filter("held < rows").select("fold", "all", F.explode("own").alias("o"))  # one row of totals
    of = F.filter("all", lambda t: t["branch"].eqNullSafe(F.col("o.branch")))[0]
    rest = of["n"] - F.col("o.n")
    return told.select("fold", "o.branch", "o.g", "o.n", F.when(rest > 0, (of["g"] - F.col("o.g")) / rest).alias("mean"))


def tau_curve(rows: DataFrame, thresholds: int = 61) -> DataFrame:
    """``tau, gain, look_rate``: for each threshold, following the branches whose mean gain on the other subsets is above it, or that
    are not met there: gain and share of followed rows a held-out row, as means over the subsets."""
    grid = _held_out(rows).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1)))).withColumn("tau", (F.col("i") - (thresholds - 1) // 2) / F.lit(100.0))
    fires = F.col("mean").isNull() | (F.col("mean") > F.col("tau"))
    share = lambda c: F.sum(F.when(fires, F.col(c)).otherwise(0)) / F.sum("n")
    folds = grid.groupBy("fold", "tau").agg(share("g").alias("gain"), share("n").alias("look_rate"))
    return folds.groupBy("tau").agg(F.avg("gain").alias("gain"), F.avg("look_rate").alias("look_rate"))


def tau_rule(rows: DataFrame, thresholds: int = 61) -> DataFrame:
    """``branch, n, mean, tau, fires``: the threshold is 0 if it lies between the lowest and the highest of best gain, else the lowest of
    these; a branch fires if its mean gain over all rows is above it.  Without a second subset there is no curve and tau is null."""
    curve = tau_curve(rows, thresholds)
    best = curve.agg(F.max("gain").alias("best"))
    basin = curve.join(F.broadcast(best)).filter(F.abs(F.col("gain") - F.col("best")) < 1e-9).agg(F.min("tau").alias("low"), F.max("tau").alias("high"))  # one row
    tau = basin.select(F.when((F.col("low") <= 0) & (F.col("high") >= 0), 0.0).otherwise(F.col("low")).alias("tau"))
    pooled = rows.groupBy("branch").agg(F.count("*").alias("n"), F.avg(F.col("gain").cast("double")).alias("mean"))
    return pooled.join(F.broadcast(tau)).select("branch", "n", "mean", "tau", (F.col("mean") > F.col("tau")).alias("fires"))


def normal_label(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"[\s_-]", ""))


def to_float(text: Column) -> Column:
    """A text's number: all of it without commas, or else its first number; never infinite."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    first = F.nullif(F.regexp_extract(plain, r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1), F.lit(""))
    whole = plain.try_cast("double")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return F.when(whole.isNotNull(), finite(whole)).otherwise(finite(first.try_cast("double")))


def _choice(p: Column, g: Column) -> Column:
    """Letters A to Z are compared as such, or through the option they stand for; else the texts as labels."""
    p, g = F.trim(p), F.trim(g)
    at = lambda t: F.when(F.upper(t).rlike("^[A-Z]$"), F.ascii(F.upper(t)) - 64)
    option = lambda i: normal_label(F.try_element_at("options", i))
    some = F.coalesce(F.size("options"), F.lit(0)) > 0
    same = normal_label(p) == normal_label(g)
    inside = lambda i: i <= F.size("options")
    return (
        F.when(at(p).isNotNull() & at(g).isNotNull(), at(p) == at(g)).when(at(p).isNotNull() & some, inside(at(p)) & (option(at(p)) == normal_label(g)))
        .when(at(g).isNotNull() & some & inside(at(g)), normal_label(p) == option(at(g))).otherwise(same)
    )


def score_predictions(rows: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """``outcome, rel_acc`` of ``answer_type, predicted, gold, options, error``: error, open, abstain, correct or incorrect.

    Types are numerical, categorical, mcq, and textual or open, which aren't scored.
    """
    p, g = F.col("predicted"), F.col("gold")
    x, y = to_float(p), to_float(g)
    tiny, gap = F.abs(y) < 1e-9, F.abs(x - y)
    near = F.when(tiny, gap <= 1e-9).otherwise(gap / F.abs(y) <= tolerance)
    right = F.when(F.col("answer_type") == "mcq", _choice(p, g)).when(F.col("answer_type") == "numerical", near).otherwise(normal_label(p) == normal_label(F.coalesce(g, F.lit(""))))
    open_ = F.col("answer_type").isin("open", "textual")
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(open_, "open").when(p.isNull(), "abstain").when(F.coalesce(right, F.lit(False)), "correct").otherwise("incorrect")
    )
    accuracy = F.when(tiny, F.when(gap <= 1e-9, 1.0).otherwise(0.0)).when(gap.isNotNull(), F.greatest(1 - gap / F.abs(y), F.lit(0.0)))
    scored = F.col("error").isNull() & (F.col("answer_type") == "numerical") & p.isNotNull()
    return rows.withColumns({"outcome": outcome, "rel_acc": F.when(scored, accuracy), "eligible": ~open_})


def score_summary(scored: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return scored.agg(
        F.count("*").alias("total"), F.count_if("eligible").alias("eligible"), n("correct").alias("correct"), n("incorrect").alias("incorrect"),
        n("open").alias("open_excluded"), n("abstain").alias("abstained"), n("error").alias("errors"),
    )


def trust_table(rows: DataFrame, by: str) -> DataFrame:
    """Where maths and vision (``m, v``: right or not) disagree: how often the final answer ``f`` follows vision, and the net."""
    fired = rows.groupBy(by).agg(
        F.count("*").alias("n_fired"), F.count_if(F.expr("m != v")).alias("n_disc"), F.count_if(F.expr("m != v AND f = v")).alias("followed"),
        F.count_if(F.expr("m != v AND v = 1")).alias("v_right"), F.count_if(F.expr("m = 0 AND f = 1")).alias("gained"), F.count_if(F.expr("m = 1 AND f = 0")).alias("lost"),
    )
    return fired.select(
        by, "n_fired", "n_disc", ratio(F.col("followed"), F.col("n_disc")).alias("follow_rate"), ratio(F.col("v_right"), F.col("n_disc")).alias("p_vision"),
        (F.col("gained") - F.col("lost")).alias("net"),
    )


def gate_efficiency(rows: DataFrame, by: str) -> DataFrame:
    """Of the looks a gate suppressed: harmful (``base`` right, ``gated`` wrong), helpful (the reverse), neutral."""
    kind = F.when(F.expr("base = 1 AND gated = 0"), "harmful").when(F.expr("base = 0 AND gated = 1"), "helpful").otherwise("neutral")
    return crosstab(rows.withColumn("kind", kind), by, "kind", ["harmful", "helpful", "neutral"])


def spend(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by model; ``prices`` per million tokens is a short list, an unknown model has null cost."""
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return sums.join(prices, "model", "left").select("model", "calls", "tokens_in", "tokens_out", cost.alias("cost"))

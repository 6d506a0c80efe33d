"""Resampling from counts: a bootstrap or a permutation of any number of rows needs only how many of them are alike.

Resampled counts are multinomial, so they are drawn as binomials, one after the other.  A draw is a function of seed, repetition and
name (md5), so any engine and any rerun gives the same ones; its cost does not grow with the rows: below 10 expected
successes it inverts the distribution, else it takes the first accepted of transformed candidates (Hormann's rejection, which is exact).
Nulls in a column compared count as no row of it; without rows all results are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates of a draw; one is refused in less than 3 of 10 cases, so that all are is out of question.
TRIES = 40
#: Log k! less Stirling's formula, for k up to 9.
STIRLING = (
    0.08106146679532726, 0.04134069595540929, 0.02767792568499834, 0.02079067210376509, 0.01664469118982119, 0.01387612882307075, 0.01189670994589177, 0.01041126526197209,
    0.009255462182712733, 0.00833056343336287,
)


def uniform(seed: str, *names: Column | str) -> Column:
    """A number between 0 and 1, both excluded, from the first 32 bits of md5."""
    key = F.concat_ws(":", F.lit(seed), *[n.cast("string") if isinstance(n, Column) else F.lit(n) for n in names])
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def _tail(k: Column) -> Column:
    known = F.element_at(F.array(*map(F.lit, STIRLING)), F.least(k, F.lit(9)).cast("int") + 1)
    square = (k + 1) * (k + 1)
    return F.when(k <= 9, known).otherwise((1 / F.lit(12.0) - (1 / F.lit(360.0) - 1 / F.lit(1260.0) / square) / square) / (k + 1))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _inverted(n: Column, p: Column, u: Column) -> Column:
    """The least k whose distribution reaches ``u``, for n * p below 10."""
    begun = F.struct(F.lit(-1.0).alias("k"), F.exp(n * F.log1p(-p)).alias("next"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        go = F.struct((s["k"] + 1).alias("k"), (s["next"] * (n - s["k"] - 1) / (s["k"] + 2) * p / (1 - p)).alias("next"), (s["sum"] + s["next"]).alias("sum"))
        return F.when((s["sum"] >= u) | (s["k"] >= n), s).otherwise(go)

    return F.aggregate(F.sequence(F.lit(0), F.lit(110)), begun, step, lambda s: F.greatest(s["k"], F.lit(0.0)))


def _rejected(n: Column, p: Column, seed: str, rep: Column, name: str) -> Column:
    """The first accepted of ``TRIES`` candidates, for n * p of 10 and more and p up to a half."""
    spread = F.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    a = -0.0873 + 0.0248 * b + 0.01 * p
    alpha, mode, odds = (2.83 + 5.1 / b) * spread, F.floor((n + 1) * p).cast("double"), p / (1 - p)

    def one(t: Column) -> Column:
        u, v = uniform(seed, rep, name, t, "u") - 0.5, uniform(seed, rep, name, t, "v")
        return _let(F.struct(u.alias("u"), v.alias("v"), (0.5 - F.abs(u)).alias("us")), lambda d: _let(F.floor((2 * a / d["us"] + b) * d["u"] + n * p + 0.5).cast("double"), lambda k: judged(d, k)))

    def judged(d: Column, drawn: Column) -> Column:
        k = F.greatest(F.lit(0.0), F.least(drawn, n))  # others are refused, whatever the bound
        bound = (
            (mode + 0.5) * F.log((mode + 1) / (odds * (n - mode + 1))) + (n + 1) * F.log((n - mode + 1) / (n - k + 1)) + (k + 0.5) * F.log(odds * (n - k + 1) / (k + 1))
            + _tail(mode) + _tail(n - mode) - _tail(k) - _tail(n - k)
        )
        quick = (d["us"] >= 0.07) & (d["v"] <= 0.92 - 4.2 / b)
        slow = F.log(d["v"] * alpha / (a / (d["us"] * d["us"]) + b)) <= bound
        return F.when((k == drawn) & (quick | slow), k)

    tried = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda s, t: F.when(s.isNotNull(), s).otherwise(one(t)))
    return F.coalesce(tried, F.floor(n * p + 0.5).cast("double"))


def binomial(n: Column, p: Column, seed: str, rep: Column, name: str) -> Column:
    """A binomial draw of ``n`` trials with probability ``p``."""
    n, p = n.cast("double"), p.cast("double")

    def drawn(x: Column) -> Column:
        n, q = x["n"], x["q"]
        k = F.when(n * q < 10, _inverted(n, q, uniform(seed, rep, name))).otherwise(_rejected(n, q, seed, rep, name))
        return F.when(x["p"] > 0.5, n - k).otherwise(k)

    drawing = _let(F.struct(n.alias("n"), p.alias("p"), F.least(p, 1 - p).alias("q")), drawn)
    return F.when((n <= 0) | (p <= 0), 0.0).when(p >= 1, n).otherwise(drawing)


def _repeated(counts: DataFrame, reps: int) -> DataFrame:
    """One row of counts as many times as there are repetitions, dealt over the tasks."""
    return counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).repartition("rep")


def _ends(deltas: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return deltas.groupBy(*keys).agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"), F.avg("delta").alias("mean"))


def interval_of_counts(counts: DataFrame, keys: Sequence[str] = (), reps: int = 10_000, seed: str = "pair") -> DataFrame:
    """``low, high, mean`` of the difference (c - b) / n by ``keys``, one row of ``n, b, c`` each; equal counts draw alike."""
    drawn = _repeated(counts.filter("n > 0"), reps).withColumn("db", binomial(F.col("n"), F.col("b") / F.col("n"), seed, F.col("rep"), "b"))
    left = F.col("n") - F.col("b")
    rest = F.when(left > 0, F.col("c") / left).otherwise(0.0)
    drawn = drawn.withColumn("dc", binomial(F.col("n") - F.col("db"), rest, seed, F.col("rep"), "c"))
    return _ends(drawn.select(*keys, ((F.col("dc") - F.col("db")) / F.col("n")).alias("delta")), keys)


def paired_counts(rows: DataFrame, base: str = "correct", treatment: str = "correct_t") -> DataFrame:
    """``n, b, c``: rows with both, those that only the base and those that only the treatment has right."""
    both = F.col(base).isNotNull() & F.col(treatment).isNotNull()
    only = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 0))
    return rows.agg(F.count_if(both).alias("n"), only(base, treatment).alias("b"), only(treatment, base).alias("c"))


def paired_bootstrap(rows: DataFrame, reps: int = 10_000, seed: str = "pair") -> DataFrame:
    """``low, high, mean``: 95 % percentile interval of the arms' difference in accuracy, and the mean of the resampled differences."""
    return interval_of_counts(paired_counts(rows), (), reps, seed)


def single_bootstrap(rows: DataFrame, value: str, reps: int = 10_000, seed: str = "one") -> DataFrame:
    """The same for the mean of one column of 0 and 1."""
    counts = rows.agg(F.count(value).alias("n"), F.count_if(F.col(value) == 1).alias("k")).filter("n > 0")
    drawn = _repeated(counts, reps).withColumn("d", binomial(F.col("n"), F.col("k") / F.col("n"), seed, F.col("rep"), "k"))
    return _ends(drawn.select((F.col("d") / F.col("n")).alias("delta")))


def paired_permutation(rows: DataFrame, reps: int = 5_000, seed: str = "flip") -> DataFrame:
    """``observed, p``: the difference, and the share (count + 1) / (reps + 1) of sign flips whose difference is at least as large either way.

    Flips of rows on which the arms agree change nothing, so the others' signs are one draw a repetition.
    """
    counts = paired_counts(rows).filter("n > 0")
    drawn = _repeated(counts, reps).withColumn("d", binomial(F.col("b") + F.col("c"), F.lit(0.5), seed, F.col("rep"), "s"))
    m = F.col("b") + F.col("c")
    told = drawn.agg(F.first(F.expr("(c - b) / n")).alias("observed"), F.count_if(F.abs(2 * F.col("d") - m) >= F.abs(F.col("c") - F.col("b"))).alias("k"), F.count("*").alias("reps"))
    return told.select("observed", F.when(F.col("reps") > 0, (F.col("k") + 1) / (reps + 1)).alias("p"))

"""Heads that choose an option by numbers: trajectories ranked against forecasts of as many steps as they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.verify import numbers
from chronoloom.plans.numeric import period_of

# Fixed value: a list as it is written in code.
_LIST = r"^\s*(?:\[\s*[-+\d.eE]+(?:\s*,\s*[-+\d.eE]+)*\s*,?\s*\]|\(\s*[-+\d.eE]+\s*,(?:\s*[-+\d.eE]+\s*,?)*\s*\)|[-+\d.eE]+\s*,)\s*$"
METHODS = ("persistence", "drift", "seasonal_naive")


def number_list(text: Column) -> Column:
    """The numbers of a list in brackets, or of a text with two numbers or more; else null."""
    found = numbers(text)
    return F.when((F.size(found) >= 2) | ((F.size(found) == 1) & text.rlike(_LIST)), found)


def season(values: Column) -> Column:
    """The dominant period in whole points of a series of 8 points or more, if it is between 2 and half their number."""
    n = F.size(values)
    whole = F.when(n >= 8, F.bround(period_of(values)).cast("int"))
    return F.when(whole.between(2, F.floor(n / 2)), whole)


def forecast_at(values: Column, period: Column, step: Column) -> list[Column]:
    """The forecasts of ``METHODS`` for a step from 1 on: the last value, the line from first to last, the last season over and over."""
    n, last = F.size(values), F.element_at(values, -1)
    drift = last + F.when(n >= 2, (last - F.element_at(values, 1)) / (n - 1)).otherwise(0.0) * step
    back = F.when(period.isNotNull(), F.element_at(values, (n - period + F.pmod(step - 1, period) + 1).cast("int")))
    return [last, drift, F.coalesce(back, last)]


def trajectory_head(rows: DataFrame, arrays: DataFrame) -> DataFrame:
    """``question_id, letter, method, mse``: the option whose numbers are nearest to one of the forecasts of its own length.

    ``rows`` has ``question_id, series_id, options``, ``arrays`` has ``series_id, values``.  An option's error is the least mean squared error over
    its methods, of equals the first; of equal options the first wins.  A row without options, with one that is no list of numbers,
    with a series of less than two points, or whose best option is past Z has no answer and no row.
    """
    staged = rows.join(arrays, "series_id").withColumn("lists", F.transform("options", number_list))
    staged = staged.filter("size(values) >= 2 AND size(lists) > 0 AND forall(lists, x -> x IS NOT NULL)")
    steps = F.sequence(F.lit(1), F.array_max(F.transform("lists", F.size)))
    # One table of forecasts a row, up to its longest option; the season is bound once, outside of the steps.
    table = F.transform(F.array(season(F.col("values"))), lambda period: F.transform(steps, lambda i: F.array(*forecast_at(F.col("values"), period, i))))[0]
    best_of = lambda numbers, told: F.array_min(F.array(*[F.struct(F.round(mse(numbers, F.transform(told, lambda s: s[m])), 9).alias("mse"), F.lit(m).alias("method")) for m in range(len(METHODS))]))
    mse = lambda numbers, told: F.aggregate(F.zip_with(numbers, F.slice(told, F.lit(1), F.size(numbers)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(numbers)
    # Rounded, so that equals stay equal whatever the order of additions.
    judged = lambda told: F.array_min(F.transform("lists", lambda x, i: F.transform(F.array(best_of(x, told)), lambda b: F.struct(b["mse"].alias("mse"), i.alias("option"), b["method"].alias("method")))[0]))
    least = F.transform(F.array(table), judged)[0]
    done = staged.withColumn("__best", least).filter("__best.option < 26")
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.col("__best.method") + 1)
    return done.select("question_id", F.char(F.col("__best.option") + 65).alias("letter"), method.alias("method"), F.col("__best.mse").alias("mse"))

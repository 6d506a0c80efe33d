"""A stress set for the question parsers: questions over real series whose intended plan is known, and the scores of the parser's three arms.

Each series gets one question a layer: ``clean`` (a phrase of the ladder), ``compositional`` (two quantities), ``typo`` (a misspelt phrase) and, where
phrases for it are given, ``paraphrase`` (words that the synonyms do not know).  Choices are hashes of seed, series and layer, so any
engine makes the same set.  The right value is that of the intended plan, by the same evaluator, so only parsing is measured.

A null series id makes no questions; a series without points has no right value and is left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.experiment import mcnemar_p
from chronoloom.operators.resampling import interval_of_counts
from chronoloom.plans import numeric

# Phrases of quantities, forms of compositions, and misspelt phrases.
PHRASES = {"mean": "mean value", "var": "variance", "std": "standard deviation", "median": "median", "min": "minimum value", "max": "maximum value", "range": "range"}
FORMS = (("subtract", "the {a} minus the {b}"), ("subtract", "the difference between the {a} and the {b}"), ("add", "the sum of the {a} and the {b}"), ("ratio", "the ratio of the {a} to the {b}"))
TYPOS = {
    "standard deviation": "standar deviaton", "variance": "varaince", "median": "medain", "minimum value": "minimm value", "maximum value": "maximumm value", "mean value": "maen value",
}
QUESTION = "Based on the Time Series 1 data, what is {} of the sequence?"
LAYERS = ("clean", "compositional", "typo", "paraphrase")


def choice(seed: str, layer: str, name: str, n: int, key: str = "series_id") -> str:
    """SQL of a number below ``n`` from the first 28 bits of md5, the same in any engine."""
    return f"(CAST(conv(substr(md5(concat('{seed}:{layer}:{name}:', CAST({key} AS STRING))), 1, 7), 16, 10) AS BIGINT) % {n})"


def _of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def _leaf(quantity: Column) -> Column:
    return F.format_string('{"quantity": "%s"}', quantity)


def stress_set(series: DataFrame, seed: str = "stress", paraphrases: Mapping[str, str] | None = None) -> DataFrame:
    """``series_id, layer, question, intent`` (a plan in JSON) for each row of ``series_id``; ``paraphrases`` gives a question for each quantity."""
    at = lambda layer, name, n: F.expr(choice(seed, layer, name, n))
    names = list(PHRASES)
    asked = lambda what: F.format_string(QUESTION.replace("{}", "%s"), what)
    phrase = lambda q: _of(list(PHRASES.values()), q)
    clean = at("clean", "q", len(names))
    a = at("compositional", "a", len(names))
    b = (a + 1 + at("compositional", "b", len(names) - 1)) % len(names)  # another one
    form = at("compositional", "form", len(FORMS))
    said = F.replace(F.replace(_of([f for _, f in FORMS], form), F.lit("{a}"), phrase(a)), F.lit("{b}"), phrase(b))
    plan = F.format_string('{"op": "%s", "args": [%s, %s]}', _of([op for op, _ in FORMS], form), _leaf(_of(names, a)), _leaf(_of(names, b)))
    typo = at("typo", "q", len(TYPOS))
    meant = {p: q for q, p in PHRASES.items()}
    layers = [
        (F.lit("clean"), asked(F.concat(F.lit("the "), phrase(clean))), _leaf(_of(names, clean))), (F.lit("compositional"), asked(said), plan),
        (F.lit("typo"), asked(F.concat(F.lit("the "), _of(list(TYPOS.values()), typo))), _leaf(_of([meant[p] for p in TYPOS], typo))),
    ]
    if paraphrases:
        other = at("paraphrase", "q", len(paraphrases))
        layers.append((F.lit("paraphrase"), _of(list(paraphrases.values()), other), _leaf(_of(list(paraphrases), other))))
    each = F.explode(F.array(*[F.struct(n.alias("layer"), q.alias("question"), i.alias("intent")) for n, q, i in layers]))
    return series.filter("series_id IS NOT NULL").select("series_id", each.alias("x")).select("series_id", "x.*")


def arm_rows(questions: DataFrame, pts: DataFrame, reply: str = "reply", tolerance: float = 0.1) -> DataFrame:
    """``series_id, layer, arm, correct, planner_asked`` of the three arms, and all plans evaluated in one pass over the series.

    A value is right within ``tolerance`` of the intended plan's, relative to it; no value is wrong.
    """
    plain = questions.select("series_id", "layer", "question", "intent", F.col(reply).alias("reply"))
    exact = numeric.nodes_of(numeric.parse(plain, arm="A0")).select("series_id", "layer", F.col("nodes").alias("A0"))
    full = numeric.with_planner(numeric.parse(plain))
    own = F.when(~F.col("planner_asked"), F.col("nodes"))
    told = full.select("series_id", "layer", numeric.plan_nodes(F.col("intent")).alias("gold"), own.alias("A1"), F.col("nodes").alias("A2"), "planner_asked").join(exact, ["series_id", "layer"])
    arms = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("gold", "A0", "A1", "A2"))), F.array("gold", "A0", "A1", "A2")))
    long = told.select("series_id", F.col("series_id").alias("series_2_id"), "layer", "planner_asked", arms.alias("arm", "nodes"))
    done = numeric.evaluate_nodes(long, pts).groupBy("series_id", "layer", "planner_asked").agg(F.map_from_entries(F.collect_list(F.struct("arm", "value"))).alias("values"))
    done = done.filter("values['gold'] IS NOT NULL").select("series_id", "layer", "planner_asked", F.expr("values['gold']").alias("gold"), F.explode("values").alias("arm", "value")).filter("arm != 'gold'")
    right = F.abs(F.col("value") - F.col("gold")) <= tolerance * F.abs(F.col("gold"))
    return done.select("series_id", "layer", "arm", F.coalesce(right, F.lit(False)).cast("int").alias("correct"), "planner_asked")


def three_arms(rows: DataFrame, reps: int = 10_000) -> DataFrame:
    """Per layer and over all (``OVERALL``): accuracy of the arms, the differences A1 - A0 and A2 - A1, McNemar's p and the interval of the latter, and how often the planner was asked."""
    wide = rows.groupBy("series_id", "layer", "planner_asked").pivot("arm", ["A0", "A1", "A2"]).agg(F.max("correct"))
    both = wide.select(F.explode(F.array("layer", F.lit("OVERALL"))).alias("layer"), "A0", "A1", "A2", "planner_asked")
    per = both.groupBy("layer").agg(
        F.count("*").alias("n"), *[F.avg(F.col(a).cast("double")).alias(a) for a in ("A0", "A1", "A2")], F.count_if(F.expr("A1 = 1 AND A2 = 0")).alias("b"), F.count_if(F.expr("A1 = 0 AND A2 = 1")).alias("c"),
        F.avg(F.col("planner_asked").cast("double")).alias("fire_rate"),
    )
    ends = interval_of_counts(per.select("layer", "n", "b", "c"), ["layer"], reps, "stress").select("layer", "low", "high")
    deltas = {"a1_a0": F.col("A1") - F.col("A0"), "a2_a1": F.col("A2") - F.col("A1"), "p": mcnemar_p(F.col("b"), F.col("c"))}
    return per.withColumns(deltas).join(ends, "layer")

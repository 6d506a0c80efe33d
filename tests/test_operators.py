"""Series and experiment operators on small fixtures, and the registered queries against DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom import queries
from chronoloom.kernels import shape
from chronoloom.operators import shape as shapes
from chronoloom.operators import anomaly, answers, branches, channels, evidence, experiment, heads, kernels, loops, pairwise, replies, resampling, spectral, stats, trend, verify
from chronoloom.plans import numeric, stress
from chronoloom.sources import ingest
from chronoloom.sources.series import to_arrays, to_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A sample of the registered queries; the driver compares all of them.
COMPARED = [
    "basic_stats", "moving_average", "trend_fit", "autocorr", "rolling_std", "lag_corr", "acf_similarity", "jigsaw_ref", "plan_parse", "plan_eval", "route_parse", "answer_shapes", "visual_gate",
    "verifier_flags", "event_threshold", "forecast_range", "score_rows", "paired_stats", "holm", "hash_bootstrap", "loso_cv",
    "nested_plan_eval", "loop_propose", "answer_letters", "answer_numbers", "answer_labels", "multi_series", "evidence_prune", "evidence_summary", "trajectory_rank", "verifier_scopes", "spectrogram_rows", "shape_summary",
    "paired_bootstrap", "tau_rule",
]


@pytest.fixture(scope="module")
def pts(spark):
    series = {1: [1, 3, 6, 10], 2: [5.0] * 6, 3: list(np.random.default_rng(11).normal(5, 2, 128)), 4: [2.0]}
    return spark.createDataFrame([(k, i, float(v)) for k, values in series.items() for i, v in enumerate(values)], "series_id long, pos long, value double").cache()


def values(df, series_id):
    return [r["value"] for r in df.filter(F.col("series_id") == series_id).orderBy("pos").collect()]


def test_transforms(pts):
    assert values(stats.difference(pts, 1), 1) == [2, 3, 4] and values(stats.moving_average(pts, 2), 1) == [2, 4.5, 8]
    assert values(stats.lagged(pts, 1, 0.0), 1) == [0, 1, 3, 6] and values(stats.lagged(pts, -1, 9.0), 1) == [3, 6, 10, 9]
    assert values(stats.zscores(pts), 2) == [0.0] * 6 and np.allclose(values(stats.detrended(pts), 2), 0)
    with pytest.raises(ValueError):
        stats.percentile(pts, 101)
    with pytest.raises(ValueError):
        stats.count_threshold(pts, "~", 1)


def test_statistics_match_numpy(pts):
    row = stats.basic_stats(pts).filter("series_id = 3").first()
    assert row["std"] == pytest.approx(1.867818, abs=1e-6)
    flat = stats.basic_stats(pts).filter("series_id = 2").first()
    assert flat["std"] == 0 and flat["skewness"] is None


def test_nan_and_gaps(spark):
    p = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, float("nan")), (1, 3, 6.0), (1, 4, float("inf"))], "series_id long, pos long, value double")
    assert values(stats.interpolated(p), 1) == [2, 2, 4, 6, 6]
    assert stats.argmax_argmin(p).first()["argmin"] == 2
    assert stats.value_at(p, 9).first()["note"] == "index out of range"
    assert anomaly.iqr_outliers(p.filter("pos = 1")).first()["status"] == "too short"


def test_trend_of_constant_is_flat(pts):
    row = trend.trend_fit(pts).filter("series_id = 2").first()
    assert row["direction"] == "flat" and row["r2"] == 0.0


def test_array_and_point_forms(pts):
    assert to_points(to_arrays(pts)).exceptAll(pts).count() == 0


def test_kernels_isolate_failures(pts):
    rows = {r["series_id"]: r for r in kernels.series_kernels(to_arrays(pts), ["stationarity", "shape_features"]).collect()}
    assert rows[3]["status"] == "ok" and rows[4]["adf_pval"] is None and "stationarity" in rows[4]["status"]


def test_pairs(spark):
    t = np.arange(60)
    a, b = np.sin(t / 4), 2 * np.sin((t - 3) / 4)
    pair = spark.createDataFrame([("p", int(i), float(x), float(y)) for i, x, y in zip(t, a, b, strict=True)], "pair_id string, pos long, a double, b double")
    assert pairwise.lag_correlation(pair, 8).first()["best_lag"] == 3
    assert not pairwise.flipped_version(pair).first()["flipped"]


def test_plan_language(spark):
    questions = [
        "difference between the minimum value and the maximum value", "ratio of the range to the foo", "what is the mean of the series?", "90th percentile", "varaince",
        "typical value", "what is the mean?", "how many local maximum points", "Where does the global maximum occur?", "period length", "the skew of time series 1 and time series 2",
        "standrad deviatoin divided by the medain", "", None,
    ]
    table = spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")
    got = [tuple(r)[2:] for r in numeric.parse(table).orderBy("question_id").collect()]
    none = (None, None, None, None, None, "primary")
    one = lambda q, p=None, s="primary": (None, q, p, None, None, s)
    assert got == [
        ("subtract", "min", None, "max", None, "primary"), none, one("mean"), one("percentile", 90.0), one("var"), one("mean"), none, one("count_local_max"), one("argmax"),
        one("period"), one("skewness", None, "ts2"), ("ratio", "std", None, "median", None, "primary"), none, none,
    ]
    exact = [r["left_q"] for r in numeric.parse(table, arm="A0").orderBy("question_id").collect()]
    assert exact[3] == "percentile" and exact[4] is None and exact[5] is None
    with pytest.raises(ValueError):
        numeric.parse(table, arm="A9")


def test_typo_query_against_plain_loop(spark, sf_dir):
    """The query's plans, by the language's rules in plain Python."""
    import re

    from chronoloom import queries

    def ladder(q):
        for end, name in (("maximum", "argmax"), ("minimum", "argmin")):
            if f"where does the global {end}" in q or ("index" in q and end in q and "how many" not in q):
                return name
        for words, name in [(w, n) for n, w in numeric.COUNTS]:
            if any(x in q for x in words):
                return name
        if re.search(numeric.PERCENTILE, q):
            return "percentile"
        return next((n for n, words in numeric.SUMMARIES if any(x in q for x in words)), None)

    def named(q):
        for old, new in sorted(numeric.SYNONYMS, key=lambda x: -len(x[0])):
            q = q.replace(old, new)
        return ladder(q) or ladder(numeric.corrected(q)) or next((n for noun, n in numeric.BARE if re.search(rf"\b{noun}\b", q)), None)

    rows = queries.queries()["typo_parse"](spark, sf_dir).collect()
    assert any(r["op"] for r in rows) and any(r["left_q"] is None for r in rows)
    for r in rows:
        q = r["question"].lower()
        found = next(((op, *re.search(p, q).groups()) for op, p in numeric.PREFIX_FORMS if re.search(p, q)), None)
        found = found or next(((op, *q.split(t, 1)) for op, t in numeric.INFIX_FORMS if t in q), None)
        want = (None, named(q), None)
        if found:
            want = (found[0], named(found[1]), named(found[2]))
            want = want if want[1] and want[2] else (None, None, None)
        assert (r["op"], r["left_q"], r["right_q"]) == want, q


def test_plans_from_outside(spark):
    deep = '{"quantity": "mean"}'
    for _ in range(12):
        deep = f'{{"op": "add", "args": [{deep}, {{"quantity": "min"}}]}}'
    said = [
        'Sure: {"op":"ratio","args":[{"quantity":"max"},{"op":"subtract","args":[{"quantity":"mean"},{"quantity":"mean"}]}]} {', '{"quantity": "std", "series": "ts2"}',
        '{"op": "ratio", "args": [{"quantity": "max"}]}', '{"quantity": "skewness"}', '{"op": "power", "args": [{"quantity": "std"}, {"quantity": "mean"}]}', "none", None, "", "{", "{bad}",
        '{"op": null, "args": []}', '{"quantity": "percentile", "param": "90"}', '{"op": "add", "args": [1, {"quantity": "max"}]}', deep, '{"a": "}', '{"quantity": ["std"]}',
    ]
    schema = "question_id long, series_id long, series_2_id long, reply string"
    rows = spark.createDataFrame([(i, 1, 2, s) for i, s in enumerate(said)] + [(1, 7, 7, said[1])], schema).withColumn("nodes", numeric.plan_nodes(numeric.first_object(F.col("reply"))))
    pts = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 5.0, 5.0, 1.0, float("nan")])] + [(2, 0, 4.0)], "series_id long, pos long, value double")
    got = {(r["question_id"], r["series_id"]): r for r in numeric.evaluate_nodes(rows, pts).collect()}
    told = {k[0]: (r["value"], r["note"], r["reason"]) for k, r in got.items() if k[1] == 1}
    assert told[0] == (None, "composition:divzero", "composition:divzero")
    assert told[1] == (0.0, "closed_form", None) and tuple(got[1, 7])[-3:] == (None, "no_series", "no_series")
    assert told[2][1:] == ("composition:arity",) * 2 and told[3][1] == "closed_form" and told[4][1:] == ("invalid_op:power",) * 2
    assert {told[i] for i in (5, 6, 7, 8, 9, 14)} == {(None, "abstain", "abstain")}
    assert told[10][1] == "invalid_op:null" and told[11] == (None, "error:percentile", "error:percentile")
    assert told[12] == (None, "composition:operand_unavailable", "invalid_plan") and told[15][1] == "unknown_quantity"
    assert told[13] == (3.5 + 12 * 1.0, "composition:add", None)
    fit = [r[0] for r in rows.filter("series_id = 1").orderBy("question_id").select(numeric.well_formed(F.col("nodes"))).collect()]
    assert [i for i, ok in enumerate(fit) if ok] == [0, 1, 11, 13]
    assert numeric.evaluate_nodes(rows.limit(0), pts).count() == 0
    assert [r["value"] for r in numeric.evaluate_nodes(rows, pts.limit(0)).filter("value IS NOT NULL").collect()] == []


def test_evidence_goes_before_slope_and_period(spark):
    rows = spark.createDataFrame([(1, 1, 1, "slope", {"slope": 2.5}), (2, 1, 1, "period", {"dominant_period_fft": 8.0}), (3, 1, 1, "period", None), (4, 1, 1, "slope", {})], "question_id long, series_id long, series_2_id long, q string, evidence map<string,double>")
    rows = rows.withColumn("nodes", numeric.plan_nodes(F.format_string('{"quantity": "%s"}', "q")))
    wave = [0.0, 1.0, 0.0, -1.0] * 4
    pts = spark.createDataFrame([(1, i, v) for i, v in enumerate(wave)], "series_id long, pos long, value double")
    got = {r["question_id"]: (r["value"], r["note"]) for r in numeric.evaluate_nodes(rows, pts).collect()}
    assert got[1] == (2.5, "regression:branch") and got[2] == (8.0, "method_sensitive:branch:dominant_period_fft") and got[3] == (4.0, "method_sensitive:fft")
    assert got[4][0] == pytest.approx(np.polyfit(range(16), wave, 1)[0]) and got[4][1] == "regression:ols"


def test_words_are_repaired_by_nearness():
    assert numeric.corrected("the varaince, medain and avrage of it") == "the variance, median and average of it"
    assert numeric.corrected("mean men 12 skewness_x concentrated") == "mean men 12 skewness_x concentrated"


def test_answers(spark):
    said = {
        "E": "E", "I choose E": "I", "So I choose E": "E", "So\n**C**": "C", "b) as it rises": "B", "The answer is D because": "D", "the variance is A": None, "Option: c": "C", "A bad day": "A", "": None, None: None,
        "  \n": None, "it rises\r\n(d)": "D", "x" * 80 + " answer B": None, "selected=z": "Z",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i long, t string")
    assert [r[0] for r in rows.orderBy("i").select(answers.answer_letter(F.col("t"))).collect()] == list(said.values())
    why = rows.filter("i IN (4, 5, 12)").orderBy("i").select(answers.letter_reply(F.col("t"))["justification"]).collect()
    assert [r[0] for r in why] == ["", "because", "it rises\r\n(d)"]
    numbers = {
        ".5": 0.5, "3 of 50%": 3.0, "- 3.14": -3.14, "−3.14": -3.14, "Minus 3.14": -3.14, "about 1,234.5 units": 1234.5, "12 %": 0.12, "none": None, "Answer: = 7": 7.0, "1e3": 1000.0, "size5": None,
        "no\nthen 4": 4.0, "": None, None: None, "1,2345": 1234.0, "+ 2e-2%": 0.0002,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(numbers)], "i long, t string")
    got = [r[0] for r in rows.orderBy("i").select(answers.answer_number(F.col("t"))).collect()]
    assert got == pytest.approx(list(numbers.values()))
    labels = [
        ("Answer: Stationary", ["stationary", "non-stationary"], "stationary"), ("It is non-stationary.", ["stationary", "non-stationary"], "non-stationary"), ("x\n YES ", ["no", "yes"], "yes"),
        ("rising", ["slowly  rising", ""], "slowly  rising"), ("so\nfalling fast", ["falling", None], "falling"), ("nothing", ["a b"], None), ("", ["a"], None), (None, ["a"], None), ("a", [], None),
    ]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(labels)], "i long, t string, allowed array<string>, want string")
    for r in rows.withColumn("got", answers.answer_label(F.col("t"), F.col("allowed"))).collect():
        assert r["got"] == r["want"], r
    assert [r[0] for r in rows.filter("i < 2").orderBy("i").select(answers.answer_label(F.col("t"))).collect()] == ["Stationary", "It is non-stationary."]
    assert rows.limit(0).select(answers.answer_label(F.col("t"), F.col("allowed"))).count() == 0


def _loop_tables(spark):
    schema = "question_id long, question string, branch string, scope string, flags array<string>, evidence map<string,string>"
    rows = [
        (1, "trend?", "trend", "global", ["low_r2"], {}), (2, "x", "trend", "global", ["low_r2"], {}), (3, "x", "trend", "global", [], {}), (4, "x", None, None, None, None), (5, "x", "noise", "global", ["low_r2"], {}),
        (6, "an outlier, is it stationary?", "trend", "global", ["low_r2", "low_r2"], {}), (7, "x", "trend", "local", ["low_r2"], {}), (8, "x", "trend", "global", ["low_r2"], {}),
    ]
    return spark.createDataFrame(rows, schema)


def test_reroute_stops_for_each_reason(spark):
    rows, asked = _loop_tables(spark), []
    replies = {1: '{"branch": "anomaly"}', 2: '{"branch": "trend"}', 5: None, 6: "nothing", 7: '{"branch": "causality"}', 8: '{"branch": "noise", "scope": "local"}'}

    def route(ask):
        asked.append({r["question_id"] for r in ask.collect()})
        return ask.select("question_id", F.element_at(F.create_map(*[F.lit(x) for k, v in replies.items() for x in (k, v)]), F.col("question_id").cast("int")).alias("reply"))

    run = lambda ask: ask.select("question_id", F.when(F.col("branch") == "noise", F.array(F.lit("low_r2"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.create_map(F.lit("r2"), F.lit("1")).alias("evidence"))
    got = {r["question_id"]: r for r in loops.reroute(rows, route, run, ["trend", "anomaly", "noise"], ["trend", "noise"], ["low_r2"], most=2).collect()}
    assert asked == [{1, 2, 5, 6, 7, 8}, {8}]  # only the rows that ask
    told = {k: (r["loop_used"], r["loop_depth"], r["loop_final_branch"], r["loop_error"], r["loop_stopped"]) for k, r in got.items()}
    assert told[1] == (True, 1, "anomaly", None, None) and got[1]["evidence"] == {"r2": "1"} and got[1]["flags"] == []
    assert told[2] == (True, 0, "trend", None, "same_branch_noop") and told[3] == (False, 0, None, None, None) and told[4] == (False, 0, None, None, None)
    assert told[5][3] == "reroute_exception" and told[6][3] == "reroute_parse_failed" and told[7][3] == "branch_causality_disabled"
    assert told[8] == (True, 1, "noise", None, "same_branch_noop") and got[8]["scope"] == "local"
    assert loops.reroute(rows.limit(0), lambda a: a.select("question_id", F.lit("x").alias("reply")), run, [], [], []).count() == 0


def test_refine_and_propose_add_evidence(spark):
    rows = _loop_tables(spark)
    run = lambda ask: ask.filter("branch != 'anomaly'").select("question_id", F.array(F.lit("evidence_incomplete")).alias("flags"), F.create_map(F.lit("k"), F.col("branch")).alias("evidence"))
    got = {r["question_id"]: r for r in loops.refine(rows, run, ["trend", "anomaly", "noise"], ["trend", "anomaly", "noise"], most=3, threshold=0.9).collect()}
    assert got[6]["refine_branches"] == ["anomaly", "noise"] and got[6]["flags"] == ["low_r2", "branch_error", "evidence_incomplete"] and got[6]["evidence"] == {"refine_noise.k": "noise"}
    assert got[6]["refine_quality_trace"] == pytest.approx([0.464, 0.5, 0.5]) and got[6]["quality_score"] == pytest.approx(0.5)
    assert not got[4]["refine_fired"] and got[4]["quality_score"] is None and got[3]["quality_score"] == pytest.approx(0.5)
    said = ['{"action": "vision", "reason": "r"}', '{"action": "noise", "reason": "r"}']
    propose = lambda ask: ask.select("question_id", F.when(F.col("question_id") == 1, F.element_at(F.array(*map(F.lit, said)), F.col("turn") + 1)).when(F.col("question_id") == 2, '{"action": "trend", "reason": "r"}').when(F.col("question_id") == 3, '{"action": "numeric_head", "reason": "r"}').when(F.col("question_id") == 5, '{"action": "similarity", "reason": "r"}').when(F.col("question_id") == 6, "no").alias("reply"))
    got = {r["question_id"]: r for r in loops.propose_actions(rows, propose, run, ["trend", "noise"], ["trend", "noise"], most=2, threshold=0.9).collect()}
    assert got[1]["propose_executed"] == ["vision", "noise"] and got[1]["propose_force_vision"] and got[1]["evidence"] == {"propose_noise.k": "noise"}
    fell = {k: r["propose_fallbacks"] for k, r in got.items()}
    assert fell == {1: [], 2: ["already_run:trend"], 3: ["numeric_head_unavailable_on_mcq"], 4: [], 5: ["action_disabled:similarity"], 6: ["invalid_proposal"], 7: ["proposer_exception"], 8: ["proposer_exception"]}
    assert loops.refine(rows.limit(0), run, [], []).count() == 0 and loops.propose_actions(rows.limit(0), propose, run, [], []).count() == 0


def test_over_channels(spark):
    schema = "question_id long, ts1 array<double>, ts2 array<double>, ts array<double>, mean string"
    rows = spark.createDataFrame([(1, [1.0, 2.0, 4.0], [3.0, 1.0], [9.0], "x"), (2, None, None, [5.0, None, 8.0], "x"), (3, None, [], [], "x"), (4, None, [1.0], [2.0], "x"), (None, [7.0], None, None, "x")], schema)
    op = lambda p: stats.basic_stats(p).select("series_id", "n", F.col("mean").alias("average"))
    got = {r["question_id"]: r for r in channels.over_channels(rows, op, "noise").collect()}
    assert got[1]["average"] == pytest.approx(7 / 3) and got[1]["series_mode"] == "multi" and got[1]["series_lengths"] == {"ts1": 3, "ts2": 2} and got[1]["ts2_noise"]["average"] == 2.0
    assert got[2]["average"] == 6.5 and got[2]["n"] == 2 and got[2]["series_keys"] == ["ts"] and got[2]["ts1_noise"] is None
    assert got[3]["series_mode"] is None and got[3]["average"] is None and got[4]["series_keys"] == ["ts2"] and got[None]["average"] == 7.0
    assert channels.over_channels(rows.limit(0), op, "noise").count() == 0


def test_against_candidates(spark):
    schema = "question_id long, reference array<double>, candidates array<array<double>>"
    rows = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 3.0], [[2.0, 4.0, 8.0, 6.0], [4.0, 3.0], [], None, [1.0] * 5, [1.0, 2.0, 4.0, 3.0]]), (2, None, [[1.0]]), (3, [1.0], []), (4, [1.0], None)], schema)
    got = {(r["question_id"], r["candidate"]): r for r in channels.against_candidates(rows).collect()}
    assert {k: r["place"] for k, r in got.items()} == {(1, 0): 1, (1, 1): 4, (1, 2): None, (1, 3): None, (1, 4): 3, (1, 5): 2, (2, 0): None}
    assert got[1, 1]["n"] == 2 and got[1, 1]["correlation"] == pytest.approx(-1) and got[1, 3]["n"] == 0 and got[1, 3]["error"] == "similarity_error" and got[1, 5]["letter"] == "F"
    assert channels.against_candidates(rows.limit(0)).count() == 0


def test_evidence_fields(spark):
    said = '{"branch": "trend", "slope": 0.123456789, "r2": 1, "segment_slopes": [1.23456789, 2, "x"], "flags": ["low_r2"], "acf_values": [1], "vision_letter": "B", "vision_answer_parse_success": true, "artifacts": {"p": 1}, "x": {"a": 0.00000049}, "direction": null}'
    rows = spark.createDataFrame([(1, "trend", "change_point", said), (2, "trend", "nope", said), (3, None, None, None), (4, "trend", "direction", "[1]"), (5, "trend", "direction", "{bad"), (6, "trend", "direction", "{}")], "i long, branch string, subtype string, e string")
    rows = rows.withColumn("math", evidence.fields(F.col("e")))
    kept = {r["i"]: r["k"] for r in evidence.pruned(rows).select("i", F.array_sort(F.map_keys("math")).alias("k")).collect()}
    assert kept[1] == ["branch", "direction", "flags", "r2", "segment_slopes"] and "acf_values" not in kept[2] and len(kept[2]) == 10 and kept[3] == kept[4] == kept[5] == kept[6] == []
    first = rows.filter("i = 1").select(evidence.summary(F.col("math")).alias("s"), evidence.rounded(F.element_at("math", "segment_slopes")).alias("l"), evidence.rounded(F.element_at("math", "x")).alias("m"), evidence.bundle(F.col("math")).alias("b")).first()
    assert first["s"] == {"r2": "1", "slope": "0.123457", "branch": '"trend"', "direction": "null"} and first["l"] == '[1.234568,2,"x"]' and first["m"] == '{"a":0.0}'
    assert first["b"]["vision_suggestion"]["letter"] == "B" and first["b"]["vision_suggestion"]["parse_success"] and first["b"]["flags"] == ["low_r2"] and "artifacts" not in first["b"]["math_evidence"]
    assert evidence.pruned(rows.limit(0)).count() == 0


def test_trajectories(spark):
    wave = [0.0, 1.0, 0.0, -1.0] * 4
    arrays = spark.createDataFrame([(1, wave), (2, [1.0, 2.0, 3.0]), (3, [5.0]), (4, [2.0, 2.0])], "series_id long, values array<double>")
    rows = [
        (1, 1, ["[0, 1, 0, -1, 0, 1]", "9 and 9"]), (2, 2, ["[3]", "4, 5"]), (3, 3, ["[1]"]), (4, 2, ["[1, x]", "[1]"]), (5, 2, []), (6, 2, None), (7, 4, ["[2]", "(2,)", "2 2"]), (8, 9, ["[1]"]), (9, 2, [None, "[1]"]),
    ]
    got = {r["question_id"]: r for r in heads.trajectory_head(spark.createDataFrame(rows, "question_id long, series_id long, options array<string>"), arrays).collect()}
    assert {k: (r["letter"], r["method"], r["mse"]) for k, r in got.items()} == {1: ("A", "seasonal_naive", 0.0), 2: ("A", "persistence", 0.0), 7: ("A", "persistence", 0.0)}


def test_resampling_has_the_distribution_of_rows(spark):
    for n, p in ((0, 0.5), (7, 0.4), (30, 0.02), (200, 0.3), (5000, 0.97), (10**12, 0.25), (9, 0.0), (9, 1.0)):
        k = np.array([r[0] for r in spark.range(3000).select(resampling.binomial(F.lit(n), F.lit(p), "t", F.col("id"), "x")).collect()])
        assert k.min() >= 0 and k.max() <= n and (k == np.floor(k)).all()
        spread = np.sqrt(n * p * (1 - p))
        assert k.mean() == pytest.approx(n * p, abs=5 * spread / np.sqrt(3000) + 1e-9) and k.std() == pytest.approx(spread, rel=0.1, abs=0.02)
    pairs = [(1, 0)] * 30 + [(0, 1)] * 60 + [(1, 1)] * 110 + [(None, 1)]
    rows = spark.createDataFrame(pairs, "correct int, correct_t int")
    rng = np.random.default_rng(0)
    d = np.array([b - a for a, b in pairs[:-1]])
    want = np.percentile(d[rng.integers(0, 200, (10_000, 200))].mean(axis=1), [2.5, 97.5])
    got = resampling.paired_bootstrap(rows).first()
    assert (got["low"], got["high"]) == pytest.approx(tuple(want), abs=0.011) and got["mean"] == pytest.approx(0.15, abs=0.005)
    flip = resampling.paired_permutation(rows).first()
    assert flip["observed"] == pytest.approx(0.15) and 1 / 5001 <= flip["p"] < 0.01
    assert resampling.single_bootstrap(rows, "correct").first()["mean"] == pytest.approx(0.7, abs=0.005)
    nothing = rows.limit(0)
    assert resampling.paired_bootstrap(nothing).first()["low"] is None and resampling.paired_permutation(nothing).first()["p"] is None


def test_tau_rule(spark):
    rows = [("a", "x", 1)] * 3 + [("a", "x", -1)] + [("b", "x", 1), ("b", "x", 0)] + [("a", "y", -1), ("b", "y", -1), ("b", None, 1)]
    frame = spark.createDataFrame(rows, "subset string, branch string, gain int")
    curve = {round(r["tau"], 2): (r["gain"], r["look_rate"]) for r in experiment.tau_curve(frame).collect()}
    assert len(curve) == 61 and curve[0.0] == pytest.approx(((2 / 5 + 2 / 4) / 2, (4 / 5 + 3 / 4) / 2))  # x and the unmet branch fire, y does not
    got = {r["branch"]: r for r in experiment.tau_rule(frame).collect()}
    assert got["x"]["fires"] and not got["y"]["fires"] and got["x"]["tau"] == 0.0 and got[None]["fires"]
    assert experiment.tau_curve(frame.filter("subset = 'a'")).count() == 0 and experiment.tau_curve(frame.limit(0)).count() == 0


def test_verifier_judges_both_scopes(spark):
    schema = "i long, branch string, scope string, r2 double, r2s array<double>, slope double, direction string, slopes array<double>, directions array<string>, chunk_edges array<struct<start: int, end: int>>, chunk_periods array<double>, mean double, std double"
    edges = [(0, 10), (10, 20)]
    rows = [
        (1, "trend", "local", 0.1, [0.9, None], None, None, [1.0], ["up"], edges, None, None, None), (2, "trend", "local", 0.9, [0.6], None, None, None, ["up"], edges, None, 0.0, 1.0),
        (3, "trend", None, 0.1, [0.9], 1.0, "up", None, None, None, None, 1.0, 1.5), (4, "periodicity", "local", None, None, None, None, None, None, edges, [None, 6.0, 99.0], None, None),
        (5, "periodicity", "local", None, None, None, None, None, None, edges, [5.0], -1.0, 1.6), (6, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    t = spark.createDataFrame(rows, schema)
    flags = verify.row_flags({c: F.col(c) for c in t.columns[3:]}, F.col("branch"), F.col("scope"))
    got = {r["i"]: r["f"] for r in t.select("i", flags.alias("f")).collect()}
    assert got == {1: [], 2: ["low_r2", "high_volatility", "evidence_incomplete"], 3: ["low_r2"], 4: ["fft_unreliable"], 5: ["high_volatility"], 6: []}
    assert t.limit(0).select(flags).count() == 0


def test_spectrogram(spark):
    rng = np.random.default_rng(3)
    x = {1: rng.normal(size=600), 2: np.sin(np.arange(100) / 3), 3: np.full(9, 2.0), 4: np.array([1.0, 5.0])}
    pts = spark.createDataFrame([(k, i, float(v)) for k, values in x.items() for i, v in enumerate(values)] + [(1, 600, float("nan")), (1, 601, None)], "series_id long, pos long, value double")
    rows = spectral.spectrogram(pts).collect()
    assert {k: len({r["frame"] for r in rows if r["series_id"] == k}) for k in x} == {1: 2, 2: 1, 3: 1, 4: 1}
    for k, values in x.items():
        z = (values - values.mean()) / (values.std() or 1)
        m = min(len(z), 256)
        i, width = np.arange(m), m // 8
        w = np.where(i <= width, 0.5 * (1 + np.cos(np.pi * (-1 + 8 * i / m))), np.where(i < m - width, 1, 0.5 * (1 + np.cos(np.pi * (-7 + 8 * i / m)))))
        for f in range((len(z) - m // 8) // (m - m // 8)):
            y = z[f * (m - m // 8) :][:m]
            p = np.abs(np.fft.rfft((y - y.mean()) * w)) ** 2 / (w**2).sum()
            p[1 : (m + 1) // 2] *= 2
            got = sorted((r["bin"], r["power"]) for r in rows if r["series_id"] == k and r["frame"] == f)
            assert [v for _, v in got] == pytest.approx(list(p), abs=1e-9)
    assert spectral.spectrogram(pts.limit(0)).count() == 0


def test_array_literals(spark):
    said = {"[1, 2.5]": [1.0, 2.5], "['1','2']": [1.0, 2.0], "(1,2)": [1.0, 2.0], "(3,)": [3.0], "[1, None, 2]": [1.0, None, 2.0], "[]": [], "": [], None: [], "['a']": [], "x": [], "[1, 2,]": [1.0, 2.0]}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i long, t string")
    assert [r[0] for r in rows.orderBy("i").select(ingest.parse_array(F.col("t"))).collect()] == list(said.values())


def test_traces_differ_where_fields_do(spark):
    t = spark.createDataFrame([(None, 1.0), ("null", 1.0), ('x","b":2', 1.0), ("x", 1.0000001)], "a string, s double")
    got = [r[0] for r in t.select(replies.trace_hash({"a": F.col("a"), "s": F.col("s"), "raw": F.rand()}, ["s"])).collect()]
    assert len(set(got)) == 4 and got == [r[0] for r in t.select(replies.trace_hash({"s": F.col("s"), "a": F.col("a")}, ["s"])).collect()]


def brute_prominence(x):
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1]:
            left = next((k for k in range(i - 1, -1, -1) if x[k] > x[i]), -1)
            right = next((k for k in range(j + 1, len(x)) if x[k] > x[i]), len(x))
            out.append(((i + j) // 2, float(x[i] - max(min(x[left + 1 : i + 1]), min(x[j:right])))))
        i = j + 1
    return out


def test_peaks_have_the_prominence_of_a_plain_search(spark):
    rng = np.random.default_rng(8)
    x = {
        1: rng.normal(size=200).cumsum(), 2: rng.integers(0, 4, 150).astype(float), 3: np.exp(-np.arange(80) / 30) * np.cos(np.arange(80)), 4: np.arange(9.0), 5: np.ones(5), 6: np.array([1.0]),
        7: np.array([0, 2, 2, 1, 3, 3, 3, 0, 2, 0], float),
    }
    pts = spark.createDataFrame([(k, i, float(v)) for k, values in x.items() for i, v in enumerate(values)] + [(6, 1, None), (6, 2, float("nan"))], "series_id long, pos long, value double")
    rows = shapes.extremes(pts).collect()
    for k, values in x.items():
        for kind, sign in (("peak", 1), ("trough", -1)):
            got = sorted((r["pos"], r["prominence"]) for r in rows if r["series_id"] == k and r["kind"] == kind)
            want = brute_prominence(sign * values)
            assert [p for p, _ in got] == [p for p, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])
    told = {r["series_id"]: r for r in shapes.shape_summary(pts).collect()}
    assert len(told) == 7 and told[4]["waveform_hint"] == "insufficient_peaks" and told[4]["mean_peak_value"] == 8.0 and told[5]["peak_count"] == 0 and told[7]["peak_count"] == 3
    assert shapes.shape_summary(pts.limit(0)).count() == 0


def test_shape_summary_at_a_bound_and_in_the_middle_of_rounded_values(spark):
    # Peaks of mean 85.5040625, whose plain sum rounds off below; gaps whose deviation is 0.4 of their mean, and above it where means are carried on.
    cents = [2892, 3243, 13277, 7845, 3916, 2778, 18393, 12390, 1638, 5946, 13479, 6022, 15516, 6478, 13009, 2856, 16399, 15077, 11247, 13362, 2208, 12523, 9670, 1646, 1543, 9159, 14710, 14018, 4326, 3970, 5750, 8327]
    at = np.cumsum([1, 7, 7, 7, 7, 3, 4, 2, 5, 2, 6])
    x = {1: [v for c in cents for v in (0.0, c / 100)] + [0.0], 2: np.isin(np.arange(at[-1] + 2), at).astype(float), 3: [0.0, float("inf"), 0.0]}
    pts = spark.createDataFrame([(k, i, float(v)) for k, values in x.items() for i, v in enumerate(values)], "series_id long, pos long, value double")
    told = {r["series_id"]: r for r in queries.rounded(shapes.shape_summary(pts)).collect()}
    assert told[1]["peak_count"] == 32 and told[1]["mean_peak_value"] == 85.504063
    assert told[2]["inter_peak_cv"] == 0.4 and told[2]["waveform_hint"] == "symmetric" and told[3]["mean_peak_value"] == float("inf")


def test_stress_set_measures_parsing_only(spark):
    pts = spark.createDataFrame([(k, i, float(v)) for k, values in {1: [1, 5, 2, 8], 2: [3, 3, 3], 3: [7, 1]}.items() for i, v in enumerate(values)], "series_id long, pos long, value double")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "series_id long")
    asked = stress.stress_set(ids, paraphrases={"max": "How far up does it get?"})
    rows = asked.collect()
    assert sorted({r["series_id"] for r in rows}) == [1, 2, 3, 4] and len(rows) == 16 and rows == stress.stress_set(ids, paraphrases={"max": "How far up does it get?"}).collect()
    told = stress.arm_rows(asked.withColumn("reply", F.when(F.col("series_id") == 1, F.col("intent"))), pts).collect()
    right = {(r["layer"], r["arm"], r["series_id"]): r["correct"] for r in told}
    assert {s for _, _, s in right} <= {1, 2, 3}  # a series without points has no right value
    assert all(v for (layer, arm, _), v in right.items() if layer == "clean")
    assert [right["paraphrase", arm, s] for arm in ("A0", "A1", "A2") for s in (1, 2, 3)] == [0, 0, 0, 0, 0, 0, 1, 0, 0]
    table = {r["layer"]: r for r in stress.three_arms(spark.createDataFrame(told)).collect()}
    assert table["paraphrase"]["fire_rate"] == 1.0 and table["paraphrase"]["c"] == 1 and table["clean"]["a2_a1"] == 0.0 and table["OVERALL"]["n"] == sum(table[x]["n"] for x in table if x != "OVERALL")
    assert stress.stress_set(ids.limit(0)).count() == 0


def test_experiment(spark):
    rows = spark.createDataFrame([(0, ["low_r2"]), (0, ["low_r2"]), (1, ["low_r2"]), (0, []), (1, []), (None, ["low_r2"])], "correct int, flags array<string>")
    row = experiment.flag_diagnostics(rows).first()
    assert row["fired"] == 3 and row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3) and row["lift"] == pytest.approx((2 / 3) / 0.6)
    counts = spark.createDataFrame([(0, 0), (3, 3), (1, 9)], "b long, c long")
    got = [r[0] for r in counts.select(experiment.mcnemar_p(F.col("b"), F.col("c"))).collect()]
    assert got[:2] == [1.0, 1.0] and got[2] == pytest.approx(22 / 1024)
    votes = spark.createDataFrame([(1, "b"), (1, "A"), (1, None)], "k int, v string")
    assert experiment.majority_vote(votes, "k", "v").first()["vote"] == "A"


def test_branches_have_flags_segments_and_lags_of_the_reference(spark):
    rng = np.random.default_rng(4)
    series = {1: [*np.arange(60.0), *np.arange(60.0, 0.0, -1.0), *[30.0] * 60] + rng.normal(0, 0.1, 180), 2: rng.normal(0, 1, 120).cumsum(), 3: rng.normal(0, 1, 12)}
    pts = spark.createDataFrame([(k, i, float(v)) for k, values in series.items() for i, v in enumerate(values)], "series_id long, pos long, value double").cache()
    got = {r["series_id"]: r for r in branches.trend_branch(pts).collect()}
    for k, r in got.items():
        x, want = series[k], shape.change_points(series[k], 10.0)
        bounds = [0, *[round(p * len(x)) for p in want["breakpoint_positions"]], len(x)]
        parts = [x[a:b] for a, b in zip(bounds, bounds[1:])]
        assert r["n_breakpoints"] == want["n_breakpoints"] and r["n_segments"] == len(parts)
        assert r["segment_slopes"] == pytest.approx([np.polyfit(np.arange(len(y)), y, 1)[0] for y in parts])
        assert ("low_r2" in r["flags"]) == (r["r2"] < 0.65)
    assert shape.change_points(series[2])["n_breakpoints"] > got[2]["n_breakpoints"]
    noise = {r["series_id"]: r for r in branches.noise_branch(pts).collect()}
    for r in noise.values():
        assert ("adf_kpss_disagree" in r["flags"]) == ((r["adf_pval"] < 0.1) != (r["kpss_pval"] >= 0.05))
        assert ("arch_effects" in r["flags"]) == bool(r["arch_effect_detected"])
    assert any("arch_effects" in r["flags"] for r in noise.values())
    n = 40
    a = rng.normal(size=n)
    b = np.concatenate([rng.normal(size=20), a[:20]])
    pair = spark.createDataFrame([("p", i, float(a[i]), float(b[i])) for i in range(n)], "pair_id string, pos long, a double, b double")
    arrays = spark.createDataFrame([("p", a.tolist(), b.tolist())], "pair_id string, a array<double>, b array<double>")
    assert pairwise.lag_correlation(pair, 20).first()["best_lag"] == 20
    row = branches.causality_branch(pair, arrays).first()
    assert abs(row["best_lag"]) <= n // 5
    assert ("granger_not_significant" in row["flags"]) == (row["direction"] == "none") and "evidence_incomplete" not in row["flags"]
    nothing = spark.createDataFrame([("p", [1.0], [2.0])], "pair_id string, a array<double>, b array<double>")
    assert "evidence_incomplete" in branches.causality_branch(pair, nothing).first()["flags"]


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    key = lambda df: sorted(tuple("" if pd.isna(x) else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)


def test_partial_autocorrelation_solves_yule_walker(pts):
    rng = np.random.default_rng(11).normal(5, 2, 128)
    rows = {r["lag"]: r for r in spectral.partial_autocorrelation(pts.filter("series_id = 3"), 12).collect()}
    v = rng - rng.mean()
    acf = np.array([1.0] + [(v[:-k] * v[k:]).sum() / (v * v).sum() * 128 / (128 - k) for k in range(1, 13)])
    for k in range(1, 13):
        want = np.linalg.solve(np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)]), acf[1 : k + 1])[-1]
        assert rows[k]["pacf"] == pytest.approx(want) and rows[k]["significant"] == (abs(want) > 2 / np.sqrt(128))


def test_net_value_counts_every_row(spark):
    """Rows whose ``fired`` says no, and whose look names no letter, count too; ``fired_looks`` gives the others alone."""
    from chronoloom.operators import reports

    rows = spark.createDataFrame(
        [("x", 0, 1, 1, "A", "B", "C", "A", "A", "B", "yes"), ("x", 1, 0, 1, "C", "B", "A", "C", "C", "B", "0"), ("x", 0, 0, 1, "A", "B", "none", "C", "A", "C", "True")],
        "branch string, correct_off int, correct_s int, correct_p int, math string, gold string, look_s string, look_p string, pred_s string, pred_p string, fired string",
    )
    told = reports.net_value(rows, "branch").first().asDict()
    assert told == {"branch": "x", "n": 3, "net_s": 0.0, "wrong_s": 2, "sycophancy_s": 0.0, "net_p": pytest.approx(2 / 3), "wrong_p": 1, "sycophancy_p": 1.0}
    assert reports.net_value(reports.fired_looks(rows), "branch").first()["n"] == 1

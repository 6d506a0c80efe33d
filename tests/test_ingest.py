"""Files written to a temporary folder and read back."""

import json

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import reports
from chronoloom.sources import ingest


def test_csv_of_several_subsets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,question,time_series,option\n1,"say ""x"", then",[1],\n2,,,B\n')
    (tmp_path / "b.csv").write_text("id,question,time_series,option\n3,q,,C\n")
    rows = ingest.read_csv(spark, {"A": [str(tmp_path / "a.csv")], "B": [str(tmp_path / "b.csv")]}, "id string, question string, time_series string, option string")
    got = {r["num"]: r for r in ingest.normalised(rows).collect()}
    assert set(got) == {"1", "3"} and got["1"]["question"] == 'say "x", then' and got["1"]["option"] == "" and got["3"]["benchmark_set"] == "B"
    with pytest.raises(ValueError):
        ingest.read_csv(spark, {}, "id string")


def test_runs_last_wins(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps([{"id": "a", "correct": True}, {"id": None, "correct": True}, {"id": "b", "correct": True}, {"id": "a", "correct": False}]))
    got = {r["id"]: r["correct"] for r in ingest.read_runs(spark, str(tmp_path), "id: string, correct: boolean").collect()}
    assert got == {"a": False, "b": True}


def test_results_without_checkpoints(spark, tmp_path):
    for name in ("r.csv", "r_checkpoint.csv"):
        (tmp_path / name).write_text("sample_id,error\n1,\n2,skipped\n3,boom\n")
    kept = [f"{tmp_path}/r.csv", f"{tmp_path}/r_checkpoint.csv"]
    assert "checkpoint" not in str(tmp_path).replace("r_checkpoint", "")
    assert sorted(r["sample_id"] for r in ingest.read_results(spark, kept, "sample_id string, error string").collect()) == ["1", "3"]
    with pytest.raises(ValueError):
        ingest.read_results(spark, ["x_checkpoint.csv"], "sample_id string, error string")


def test_run_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, [1.0]), ("b", False, [2.0]), ("c", None, None)], "id string, correct boolean, ts array<double>")
    ingest.write_run(rows, str(tmp_path), "t")
    read = lambda name: spark.read.json(str(tmp_path / name))
    assert "ts" not in read("t-results").columns and sorted(r["id"] for r in read("t-failures").collect()) == ["b", "c"]
    sums = read("t-metrics").first()
    assert (sums["total"], sums["correct"]) == (3, 1) and sums["accuracy"] == pytest.approx(1 / 3)
    ingest.write_results(rows.drop("ts"), str(tmp_path / "out"), ["id", "absent"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "absent"]


def test_nested_series_and_controls(spark):
    values = [("1", "k", "q", "A) x B) y", "B", "[[1, 2], [3], [4]]"), ("2", None, "q", "x, y", "x", "[1, null]"), ("3", "", "q", None, "A", "junk")]
    rows = spark.createDataFrame(values, "id string, category string, question string, option string, answer string, value string")
    a, b, c = ingest.runner_rows(rows).orderBy("id").collect()
    assert a["answer"] == "y" and a["ts1"] == [1, 2] and a["ts2"] == [3] and a["ts"] is None
    assert b["ts"] == [1, None] and b["category"] == "unknown" and c["options"] == [] and c["answer"] == "A" and c["ts"] == []
    split = ingest.split_series(ingest.parse_nested(F.col("value")))
    got = rows.select(*[x.alias(n) for n, x in split.items()]).first()
    assert got["is_multi"] and not got["is_dual"] and got["candidates"] == [[3.0], [4.0]]
    hidden = ingest.controlled(ingest.runner_rows(rows), "metadata_only").orderBy("id").first()
    assert hidden["question"] == "Category: k" and hidden["ts1"] == []
    with pytest.raises(ValueError):
        ingest.controlled(rows, "nothing")


def test_settings():
    assert ingest.configured({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3} and reports.unknown_keys(["z", "a", "y"], ["a"]) == ["y", "z"]
    with pytest.raises(ValueError):
        ingest.configured({"a": 1}, {"c": 1})

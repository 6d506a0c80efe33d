"""Readers, literal parsers and sinks of benchmark and result tables; all schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALIASES = {"id": "num", "taxonomy_level": "task_type", "time_series": "value"}


def read_csv(spark: SparkSession, paths_by_tag: dict[str, list[str]], schema: str, tag: str = "benchmark_set") -> DataFrame:
    """CSV files of several subsets as one table with the subset in ``tag``."""
    out = None
    for name, paths in paths_by_tag.items():
        part = spark.read.csv(paths, schema=schema, header=True, multiLine=True, escape='"').withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def normalised(rows: DataFrame) -> DataFrame:
    """Column aliases renamed, rows without question and value dropped, text nulls as empty."""
    named = rows.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in rows.columns and b not in rows.columns})
    named = named.na.drop(how="all", subset=[c for c in ("question", "value") if c in named.columns])
    return named.na.fill("", [c for c in ("question", "option", "answer", "domain", "task_type") if c in named.columns])


def read_runs(spark: SparkSession, path: str, row: str) -> DataFrame:
    """JSON results (each file a list of objects of schema ``row``) by id: rows without id are left out; of a repeated id the last counts.

    Order is that of the files' names and of the rows within; a file is parsed as one value, as its list demands.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("__file"), F.from_json("value", f"array<struct<{row}>>").alias("rows"))
    rows = files.select("__file", F.posexplode("rows").alias("__pos", "row")).select("__file", "__pos", "row.*").filter("id IS NOT NULL")
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("__file"), F.desc("__pos")))
    return rows.withColumn("__rn", last).filter("__rn = 1").drop("__rn", "__file", "__pos")


def read_results(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Result tables in CSV but for checkpoints, without skipped rows; columns that a file lacks are null."""
    kept = [p for p in paths if "checkpoint" not in p]
    if not kept:
        raise ValueError("no result files")
    return spark.read.csv(kept, schema=schema, header=True, multiLine=True, escape='"').filter("error IS NULL OR error != 'skipped'")


# The exam's categories (with a typing error of its own) and their codes.
CATEGORY_CODES = {
    "Pattern Recognition": "PR", "Noise Understanding": "NU", "Anolmaly Detection": "AD", "Anomaly Detection": "AD", "Similarity Analysis": "SA",
    "Causality Analysis": "CA",
}


def exam_rows(rows: DataFrame, codes: dict[str, str] | None = None, per_category: int | None = None, key: str = "id") -> DataFrame:
    """Rows of known categories with their code in ``category``; with ``per_category`` a stratified sample."""
    from chronoloom.operators.reports import stratified_sample

    known = F.create_map(*[F.lit(x) for pair in (codes or CATEGORY_CODES).items() for x in pair])
    coded = rows.withColumn("category", known[F.col("category")]).filter("category IS NOT NULL")
    return coded if per_category is None else stratified_sample(coded, "category", key, per_category)


def parse_array(text: Column) -> Column:
    """A list or tuple literal, of JSON or with the quotes and None of another language, as doubles; numbers in quotes count, None is null.

    Null, blank and other texts, and lists with a text that is no number, are empty.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^\((.*?),?\s*\)$", "[$1]"), r"(?s),\s*\]$", "]")
    clean = F.replace(F.regexp_replace(bare, r"\bNone\b", "null"), F.lit("'"), F.lit('"'))
    cells = F.from_json(clean, "array<string>")
    values = F.transform(cells, lambda c: c.try_cast("double"))
    whole = F.forall(cells, lambda c: c.isNull() | c.try_cast("double").isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), values).otherwise(F.array().cast("array<double>"))


def parse_nested(text: Column) -> Column:
    """A list of lists, ragged or not; null for anything else."""
    return F.from_json(F.trim(text), "array<array<double>>")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def literal_list(text: Column) -> Column:
    """The texts of a list literal, JSON or with single quotes, or null."""
    listed = F.from_json(F.replace(stripped(text), F.lit("'"), F.lit('"')), "array<string>")
    return F.when(F.startswith(stripped(text), F.lit("[")), F.transform(listed, stripped))


def joined_list(text: Column) -> Column:
    """A list literal's texts joined by commas, any other text as it is, null as empty."""
    return F.coalesce(F.array_join(literal_list(text), ", "), stripped(text), F.lit(""))


def parse_options(text: Column) -> Column:
    """Answer options: a list literal, else what follows marks like ``A)``, ``B.`` or ``C:``, else comma-separated; empty ones are left out."""
    plain = stripped(F.coalesce(text, F.lit("")))
    full = lambda parts: F.filter(F.transform(parts, stripped), lambda o: o != "")
    parts = F.split(plain, r"(?:^|\s)[A-D][).:]\s+")
    lettered = full(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.coalesce(literal_list(plain), F.when(F.size(lettered) > 0, lettered), full(F.split(plain, ",")))


def split_series(nested: Column) -> dict[str, Column]:
    """Two rows are a pair; three or more a reference and its candidates."""
    n = F.size(nested)
    return {
        "is_dual": n == 2, "is_multi": n >= 3, "ts1": F.try_element_at(nested, F.lit(1)), "ts2": F.when(n == 2, F.try_element_at(nested, F.lit(2))),
        "candidates": F.when(n >= 3, F.slice(nested, F.lit(2), F.greatest(n - 1, F.lit(0)))),
    }


def shuffled(arrays: DataFrame, seed: str) -> DataFrame:
    """Input control: each series' points in the order of md5(seed, position)."""
    key = lambda i: F.md5(F.concat_ws(":", F.lit(seed), i.cast("string")).cast("binary"))
    keyed = F.array_sort(F.transform("values", lambda v, i: F.struct(key(i).alias("k"), v.alias("v"))))
    return arrays.withColumn("values", F.transform(keyed, lambda s: s["v"]))


def write_results(results: DataFrame, path: str, fields: list[str], fmt: str = "csv") -> None:
    """Named fields of a result table, missing ones as null; Spark's task commit replaces checkpoints."""
    chosen = [F.col(f) if f in results.columns else F.lit(None).cast("string").alias(f) for f in fields]
    writer = results.select(*chosen).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def controlled(rows: DataFrame, control: str) -> DataFrame:
    """Rows ``question, category, ts, ts1, ts2`` under an input control: what the answer may be drawn from.

    ``option_only`` and ``metadata_only`` hide question or category as well as the series, ``no_series`` only these.
    """
    if control not in ("none", "no_series", "option_only", "metadata_only"):
        raise ValueError(f"no such control: {control}")
    if control == "none":
        return rows
    hidden = {c: F.array().cast("array<double>") for c in ("ts", "ts1", "ts2")}
    if control == "option_only":
        hidden |= {"question": F.lit("Choose the best option."), "category": F.lit("unknown")}
    if control == "metadata_only":
        hidden["question"] = F.concat(F.lit("Category: "), F.coalesce("category", F.lit("unknown")))
    return rows.withColumns(hidden)


def runner_rows(rows: DataFrame) -> DataFrame:
    """Rows ``id, category, question, option, answer, value`` as a runner takes them: options as a list, a gold letter as the option it stands for,

    one series in ``ts``, two in ``ts1`` and ``ts2`` (of more the first two), category ``unknown`` where there is none.
    """
    nested = F.coalesce(parse_nested(F.col("value")), F.array(parse_array(F.col("value"))))
    staged = rows.withColumns({"options": parse_options(F.col("option")), "__series": nested})
    letter = F.upper(stripped(F.col("answer")))
    option = F.when(letter.rlike("^[A-Z]$"), F.try_element_at("options", F.ascii(letter) - 64))
    many = F.size("__series") >= 2
    at = lambda i: F.try_element_at("__series", F.lit(i))
    return staged.select(
        "id", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category"), "question", "options", F.coalesce(option, "answer").alias("answer"),
        F.when(~many, at(1)).alias("ts"), F.when(many, at(1)).alias("ts1"), F.when(many, at(2)).alias("ts2"),
    )


#: What a run's JSON leaves out: series and pictures.
HEAVY = ("ts", "ts1", "ts2", "evidence_raw", "image")


def write_run(results: DataFrame, folder: str, tag: str) -> None:
    """``<tag>-results`` without heavy fields, ``<tag>-failures`` (answers that aren't right) and ``<tag>-metrics``, as JSON."""
    light = results.drop(*[c for c in HEAVY if c in results.columns])
    light.write.mode("overwrite").json(f"{folder}/{tag}-results")
    light.filter("NOT coalesce(correct, false)").write.mode("overwrite").json(f"{folder}/{tag}-failures")
    sums = results.agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), (F.count_if("correct") / F.count("*")).alias("accuracy"))
    sums.write.mode("overwrite").json(f"{folder}/{tag}-metrics")


def configured(base: dict, overrides: dict) -> dict:
    """A named configuration with overrides; unknown keys are refused."""
    from chronoloom.operators.reports import unknown_keys

    if odd := unknown_keys(list(overrides), list(base)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return base | overrides

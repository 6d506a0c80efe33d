"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The turns of both sides are put in order; the longest common prefix of turns (equal role and text)
is rendered once as the prompt; what follows on each side is a completion with the spans of
characters to train on (the contents and end marks of assistant turns).

Both sides come as rows (``preference_pairs``), or the rejected side is made from one conversation (``corrupted_pairs``):
its turns up to an assistant turn that a hash picks, and in that one's place an assistant turn that a hash picks from the
neighbouring conversation (the id with its last bit flipped).

Defined results: turns of one side are ordered by turn, role, text (null first), so ties are equal turns; null role is
rendered as ``unknown``, null text as empty; equal nulls count as equal turns; repeated rows are turns like any other; markers
inside texts are broken up so that a text cannot open or close a turn; a pair without one side has status
``no_chosen`` or ``no_rejected`` with the other side whole as its completion; equal sides have status
``identical`` and empty completions; where one side is the start of the other, status ``chosen_is_prefix`` or ``rejected_is_prefix``,
its completion is empty; a conversation whose neighbour is missing or has no assistant turn has no rejected side, and one
without an assistant turn gets the neighbour's at its end; rows with null pair, side or conversation are left out; an empty
table gives an empty result; other columns are ignored.

A conversation is rendered as one string, so its turns meet in one task, however long its texts; no other group does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|im_"), F.lit("<| im_")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def masks(turns: Column, trained: str = "assistant") -> Column:
    """Array of (start, length) spans of the rendered turns to train on, in characters."""
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, length: int>>)").alias("spans"))

    def add(done: Column, turn: Column) -> Column:
        head, body = F.length(_head(turn)), F.length(_body(turn))
        span = F.struct((done["at"] + head).alias("start"), body.alias("length"))
        spans = F.when(turn["role"] == trained, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((done["at"] + head + body).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda done: done["spans"])


def preference_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """From rows ``pair_id, side (chosen | rejected), turn, role, text`` one row per pair:

    ``pair_id, status, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.
    """
    rows = turns.filter("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')")
    sided = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "side"))).alias("turns"))
    pick = lambda side: F.transform(F.filter("turns", lambda t: t["side"] == side), _said)
    return _formatted(sided.select("pair_id", pick("chosen").alias("c"), pick("rejected").alias("r")), trained)


def _said(turn: Column) -> Column:
    return F.struct(turn["role"].alias("role"), turn["text"].alias("text"))


def corrupted_pairs(turns: DataFrame, trained: str = "assistant", seed: str = "preference") -> DataFrame:
    """The same from rows ``conv_id, turn, role, text``, one pair a conversation (``pair_id``)."""
    whole = turns.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").alias("pair_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def picked(what: str) -> Column:
        """Place (from 0) of the assistant turn of least hash."""
        ranked = F.transform("turns", lambda t, i: F.struct(
            F.md5(F.concat_ws(":", F.lit(f"{seed}-{what}"), F.col("pair_id").cast("string"), i.cast("string")).cast("binary")).alias("rank"),
            i.alias("at"), (t["role"] == trained).alias("answers"),
        ))
        return F.array_min(F.filter(ranked, lambda x: x["answers"]))["at"]

    placed = whole.select("pair_id", "turns", F.coalesce(picked("cut"), F.size("turns")).alias("at"), picked("give").alias("gives"))
    given = placed.filter("gives IS NOT NULL").select(
        F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), _said(F.element_at("turns", F.col("gives") + 1)).alias("given")
    )
    rejected = F.concat(F.transform(F.slice("turns", F.lit(1), F.col("at")), _said), F.array("given"))
    none = F.expr("CAST(array() AS array<struct<role: string, text: string>>)")
    paired = placed.join(given, "pair_id", "left").select(
        "pair_id", F.transform("turns", _said).alias("c"), F.when(F.col("given").isNull(), none).otherwise(rejected).alias("r")
    )
    return _formatted(paired, trained)


def _formatted(paired: DataFrame, trained: str) -> DataFrame:
    """Pairs from the turns of both sides, ``pair_id, c, r``."""
    first_difference = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False)
    n = F.when(first_difference == 0, F.size("c")).otherwise(first_difference - 1).cast("int")
    cut = paired.withColumn("n", n)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("cc"), rest("r").alias("rr"), "c", "r")
    status = (
        F.when(F.size("c") == 0, "no_chosen").when(F.size("r") == 0, "no_rejected")
        .when((F.size("cc") == 0) & (F.size("rr") == 0), "identical")
        .when(F.size("cc") == 0, "chosen_is_prefix").when(F.size("rr") == 0, "rejected_is_prefix").otherwise("pair")
    )
    return cut.select(
        "pair_id", status.alias("status"), F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("cc")).alias("chosen"), render(F.col("rr")).alias("rejected"),
        masks(F.col("cc"), trained).alias("chosen_mask"), masks(F.col("rr"), trained).alias("rejected_mask"),
    )


def mask_text(mask: str) -> Column:
    """Spans as ``start+length`` joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",")

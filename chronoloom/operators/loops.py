"""Bounded loops over evidence: route again, add branches by keywords, or add what a proposer names.

A row is ``question_id, question, branch, scope, flags, evidence`` (a map of text).  What is asked from outside comes as functions from
DataFrame to DataFrame that get only the rows that ask: ``run`` turns ``question_id, branch, scope`` into ``question_id, flags,
evidence``; ``route`` and ``propose`` turn ``question_id, question, branch, scope, flags, turn`` (and ``executed``) into ``question_id, reply``.
A row without an answer, or with a null reply, counts as an error of that call.  There are at most ``most`` turns; the table is written
before each (``cut``), as a turn reads it several times, so plans don't grow with the turns.  Rows that have stopped are
handed on unchanged.  The functions' tables hold one row a question.

Null or empty flags trigger nothing; a null branch is in no list of branches and never loops; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.durable import cut
from chronoloom.operators.replies import proposal
from chronoloom.operators.verify import BRANCHES, REQUIRED, keyword_routes, parse_routing, quality_gate

Call = Callable[[DataFrame], DataFrame]
KEY = "question_id"
ERROR = "branch_error"
_TEXTS, _TEXT_MAP = "array<string>", "map<string,string>"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _texts() -> Column:
    return F.array().cast(_TEXTS)


def _answered(state: DataFrame, asks: Column, call: Call, columns: Sequence[str | Column], got: dict[str, str]) -> DataFrame:
    """The state with columns of the call's answers under the names of ``got``, null for rows that do not ask."""
    answers = call(state.filter(asks).select(KEY, *columns)).select(KEY, *[F.col(c).alias(name) for c, name in got.items()])
    return state.join(answers, KEY, "left")


def quality(evidence: Column, flags: Column, branch: Column) -> Column:
    """The score of the quality gate without a look at pictures."""
    fields = {*[f for fields in REQUIRED.values() for f in fields], "r2", "adf_pval", "kpss_pval", "best_corr"}
    return quality_gate({f: F.element_at(evidence, F.lit(f)) for f in sorted(fields)}, flags, branch, F.lit(0.0))["score"]


def _ran(state: DataFrame, asks: Column, run: Call, branch: str, scope: str) -> DataFrame:
    """The state with ``__flags, __evidence`` of the branch that was run; a branch without an answer has the error's flag."""
    found = _answered(state, asks, run, [F.col(branch).alias("branch"), F.col(scope).alias("scope")], {"flags": "__f", "evidence": "__e"})
    failed = F.col("__f").isNull() & F.col("__e").isNull()
    flags = F.when(failed, F.array(F.lit(ERROR))).otherwise(F.coalesce("__f", _texts()))
    return found.withColumns({"__failed": failed, "__flags": flags, "__evidence": F.coalesce("__e", F.create_map().cast(_TEXT_MAP))}).drop("__f", "__e")


def reroute(rows: DataFrame, route: Call, run: Call, enabled: Sequence[str], branches: Sequence[str], triggers: Sequence[str], most: int = 1) -> DataFrame:
    """Rows whose branch is one of ``branches`` and raised a trigger ask for another route, whose evidence takes the place of theirs.

    Adds ``loop_used, loop_depth, loop_trigger_flags, loop_original_branch, loop_final_branch, loop_error, loop_stopped``.
    """
    own = rows.columns
    raised = lambda flags: F.filter(F.coalesce(flags, _texts()), lambda f: f.isin(*triggers))
    among = lambda c, known: F.coalesce(c.isin(*known), F.lit(False))
    used = among(F.col("branch"), branches) & (F.size(raised(F.col("flags"))) > 0) & F.lit(most > 0)
    state = rows.withColumns(
        {
            "loop_used": used, "__on": used, "loop_depth": F.lit(0), "loop_trigger_flags": F.when(used, raised(F.col("flags"))), "loop_original_branch": F.when(used, F.col("branch")),
            "loop_error": _none(), "loop_stopped": _none(),
        }
    )
    for turn in range(most):
        state, on = cut(state), F.col("__on")
        asked = ["question", "branch", "scope", F.col("loop_trigger_flags").alias("flags"), F.lit(turn).alias("turn")]
        state = _answered(state, on, route, asked, {"reply": "__reply"}).withColumn("__to", parse_routing(F.col("__reply")))
        error = F.when(F.col("__reply").isNull(), "reroute_exception").when(~F.col("__to.parse_success"), "reroute_parse_failed")
        same = F.col("__to.branch") == F.col("branch")
        error = error.when(~same & ~among(F.col("__to.branch"), enabled), F.concat(F.lit("branch_"), F.col("__to.branch"), F.lit("_disabled")))
        state = state.withColumns({"__error": F.when(on, error), "__branch": F.col("__to.branch"), "__scope": F.col("__to.scope")})
        state = state.withColumn("__same", on & F.col("__error").isNull() & same).withColumn("__go", on & F.col("__error").isNull() & ~F.col("__same"))
        state = _ran(state, F.col("__go"), run, "__branch", "__scope")
        state = state.withColumn("__error", F.when(F.col("__go") & F.col("__failed"), ERROR).otherwise(F.col("__error")))
        moved, now = F.col("__go") & F.col("__error").isNull(), raised(F.col("__flags"))
        still = moved & (F.size(now) > 0)
        deepest = turn + 1 >= most
        state = state.withColumns(
            {
                "__on": still & F.lit(not deepest) & among(F.col("__branch"), branches), "loop_depth": F.when(moved, F.lit(turn + 1)).otherwise(F.col("loop_depth")),
                "loop_trigger_flags": F.when(still, now).otherwise(F.col("loop_trigger_flags")), "loop_error": F.coalesce("loop_error", "__error"),
                "loop_stopped": F.when(F.col("__same"), "same_branch_noop").when(still & F.lit(deepest), "max_depth").otherwise(F.col("loop_stopped")),
                **{c: F.when(moved, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("branch", "scope", "flags", "evidence")},
            }
        ).drop("__reply", "__to", "__error", "__branch", "__scope", "__same", "__go", "__failed", "__flags", "__evidence")
    told = ["loop_used", "loop_depth", "loop_trigger_flags", "loop_original_branch", F.when(F.col("loop_used"), F.col("branch")).alias("loop_final_branch"), "loop_error", "loop_stopped"]
    return state.select(*own, *told)


def _added(state: DataFrame, ran: Column, prefix: str) -> dict[str, Column]:
    """Flags and evidence with those of the branch ``__branch`` that ran; its fields have the prefix and its name."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("__branch"), F.lit("."))
    more = F.transform_keys("__evidence", lambda k, _: F.concat(name, k))
    return {
        "flags": F.when(ran, F.array_distinct(F.concat(F.coalesce("flags", _texts()), "__flags"))).otherwise(F.col("flags")),
        "evidence": F.when(ran, F.map_concat("evidence", more)).otherwise(F.col("evidence")),
    }


def refine(rows: DataFrame, run: Call, enabled: Sequence[str], branches: Sequence[str], most: int = 3, threshold: float = 0.55) -> DataFrame:
    """Rows below the quality threshold add evidence of branches that their question's words name, at most ``most`` - 1, until one clears it.

    Adds ``quality_score, refine_fired, refine_branches, refine_quality_trace`` (score and trace null where the loop was not entered).
    """
    own = rows.columns
    entered = F.coalesce(F.col("branch").isin(*branches), F.lit(False)) & F.lit(most > 1)
    first = quality(F.col("evidence"), F.coalesce("flags", _texts()), F.col("branch"))
    state = rows.withColumn("quality_score", F.when(entered, first)).withColumns(
        {"refine_branches": _texts(), "refine_quality_trace": F.when(entered, F.array("quality_score")), "__words": keyword_routes(F.col("question"), F.col("branch"), most + 1), "__first": F.col("branch")}
    )
    for place in range(most + 1 if most > 1 else 0):
        state = cut(state).withColumn("__branch", F.try_element_at("__words", F.lit(place + 1)))
        usable = F.col("__branch").isin(*[b for b in branches if b in enabled]) & (F.col("__branch") != F.col("__first"))
        asks = F.coalesce((F.col("quality_score") < threshold) & (F.size("refine_branches") < most - 1) & usable, F.lit(False))
        state = _ran(state.withColumn("__asks", asks), F.col("__asks"), run, "__branch", "scope")
        ran = F.col("__asks")
        best = F.greatest("quality_score", quality(F.col("__evidence"), F.col("__flags"), F.col("__branch")))
        state = state.withColumn("__best", best).withColumns(
            {
                **_added(state, ran, "refine"), "quality_score": F.when(ran, F.col("__best")).otherwise(F.col("quality_score")),
                "refine_branches": F.when(ran, F.concat("refine_branches", F.array("__branch"))).otherwise(F.col("refine_branches")),
                "refine_quality_trace": F.when(ran, F.concat("refine_quality_trace", F.array("__best"))).otherwise(F.col("refine_quality_trace")),
            }
        ).drop("__branch", "__asks", "__failed", "__flags", "__evidence", "__best")
    return state.select(*own, "quality_score", (F.size("refine_branches") > 0).alias("refine_fired"), "refine_branches", "refine_quality_trace")


def propose_actions(rows: DataFrame, propose: Call, run: Call, enabled: Sequence[str], branches: Sequence[str], most: int = 2, threshold: float = 0.55) -> DataFrame:
    """Rows below the quality threshold ask a proposer for an action of the registry, at most ``most`` times, until it names none that can be run.

    Adds ``propose_quality_score, propose_fired, propose_executed, propose_force_vision, propose_fallbacks``.
    """
    own = rows.columns
    entered = F.coalesce(F.col("branch").isin(*branches), F.lit(False)) & F.lit(most > 0)
    state = rows.withColumn("propose_quality_score", F.when(entered, quality(F.col("evidence"), F.coalesce("flags", _texts()), F.col("branch"))))
    state = state.withColumns(
        {"propose_executed": _texts(), "propose_fallbacks": _texts(), "__on": F.coalesce(F.col("propose_quality_score") < threshold, F.lit(False)), "__first": F.col("branch")}
    )
    for turn in range(most):
        state, on = cut(state), F.col("__on")
        asked = ["question", "branch", "scope", "flags", F.lit(turn).alias("turn"), F.col("propose_executed").alias("executed")]
        state = _answered(state, on, propose, asked, {"reply": "__reply"}).withColumn("__branch", proposal(F.col("__reply"))["action"])
        action = F.col("__branch")
        again = (action == F.col("__first")) | F.array_contains("propose_executed", action)
        fallback = (
            F.when(F.col("__reply").isNull(), "proposer_exception").when(action.isNull(), "invalid_proposal").when(again, F.concat(F.lit("already_run:"), action))
            .when(action == "numeric_head", "numeric_head_unavailable_on_mcq").when((action != "vision") & ~action.isin(*[b for b in enabled if b in BRANCHES]), F.concat(F.lit("action_disabled:"), action))
        )
        state = state.withColumn("__fallback", F.when(on, fallback)).withColumn("__go", on & F.col("__fallback").isNull())
        state = _ran(state.withColumn("__asks", F.col("__go") & (action != "vision")), F.col("__asks"), run, "__branch", "scope")
        state = state.withColumns(
            {
                **_added(state, F.col("__asks"), "propose"), "propose_executed": F.when(F.col("__go"), F.concat("propose_executed", F.array("__branch"))).otherwise(F.col("propose_executed")),
                "propose_fallbacks": F.when(F.col("__fallback").isNotNull(), F.concat("propose_fallbacks", F.array("__fallback"))).otherwise(F.col("propose_fallbacks")), "__on": F.col("__go"),
            }
        ).drop("__reply", "__branch", "__fallback", "__go", "__asks", "__failed", "__flags", "__evidence")
    done = F.col("propose_executed")
    return state.select(*own, "propose_quality_score", (F.size(done) > 0).alias("propose_fired"), "propose_executed", F.array_contains(done, "vision").alias("propose_force_vision"), "propose_fallbacks")

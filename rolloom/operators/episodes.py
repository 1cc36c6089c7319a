"""Rewards and feedback of tool-using episodes, a row an episode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools that change something, and words of a refusal; fixed.
WRITES = ("cancel_reservation", "update_reservation", "modify_reservation", "update_reservation_flights", "update_reservation_baggages", "update_reservation_passengers", "send_certificate", "book_reservation")
REFUSALS = ("cannot", "can't", "unable", "not eligible", "not allowed", "not covered")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def task_reward(label: str | Column, expected: str | Column, wanted_writes: str | Column, executed: str | Column, final_text: str | Column) -> Column:
    """1 or 0: a refusal without writing for tasks to refuse; else all expected tools; else
    as many writes as expected."""
    done = F.coalesce(_c(executed), F.array().cast("array<string>"))
    names = F.coalesce(_c(expected), F.array().cast("array<string>"))
    writes = F.size(F.filter(done, lambda t: t.isin(*WRITES)))
    refuses = F.lower(F.coalesce(_c(final_text), F.lit(""))).rlike("|".join(REFUSALS))
    n = F.coalesce(_c(wanted_writes), F.lit(0))
    good = (
        F.when(F.lower(F.trim(F.coalesce(_c(label), F.lit("")))) == "refuse", (writes == 0) & refuses)
        .when(F.size(names) > 0, F.size(F.array_except(names, done)) == 0).when(n > 0, writes >= n).otherwise(F.lit(False))
    )
    return good.cast("double")


def best_reward(live: Sequence[str], terminal: str | Column, runtime: str | Column, propagated: str | Column, fallback: Column) -> Column:
    """``reward, source``: the run's own reward (the first of ``live`` that is there) once it
    has ended; 0 for an official run without one; the run's reward anyway; the largest
    propagated one; else the fallback."""
    own = F.coalesce(*[F.col(c).cast("double") for c in live])
    over = F.coalesce(_c(terminal), F.lit(False))
    official = F.lower(F.coalesce(_c(runtime), F.lit(""))) == "official_gym"
    passed = F.array_max(F.filter(_c(propagated), lambda x: x.isNotNull()))
    tell = lambda r, s: F.struct(r.cast("double").alias("reward"), F.lit(s).alias("source"))
    return (
        F.when(over & own.isNotNull(), tell(own, "official_or_runtime")).when(official & over, tell(F.lit(0.0), "official_gym_missing_final_reward")).when(official, tell(F.lit(0.0), "official_gym_nonterminal_snapshot"))
        .when(own.isNotNull(), tell(own, "official_or_runtime")).when(passed.isNotNull(), tell(passed, "propagated_turn_or_tool_reward")).otherwise(tell(fallback, "legacy_proxy_heuristic"))
    )


def instruction_text(persona: Column, known: Column, reason: Column, task: Column, unknown: Column) -> Column:
    """The sections of a user scenario that have a text."""
    sections = [("Persona", persona), ("Known info", known), ("Reason for call", reason), ("Task instructions", task), ("Unknown info", unknown)]
    return F.concat_ws("\n\n", *[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}:\n"), F.trim(c))) for name, c in sections])


def feedback(df: DataFrame, names: Sequence[str] = ("feedback", "teacher_feedback", "reward_feedback"), serialise: bool = True) -> Column:
    """The first feedback column there is; other types as JSON; blank texts are null."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        return F.lit(None).cast("string")
    kind = dict(df.dtypes)[found]
    if kind == "string":
        text = F.col(found)
    elif kind == "binary":
        text = F.decode(found, "utf-8")
    elif not serialise:
        text = F.lit(None).cast("string")
    else:
        text = F.to_json(found) if kind.startswith(("struct", "array", "map")) else F.col(found).cast("string")
    return F.when(F.trim(text) != "", text)


def teacher_rows(samples: DataFrame, threshold: float, score: str = "score", prompt: str = "prompt", response: str = "response", note: Column | None = None) -> DataFrame:
    """Rows for a second try: ``failed, teacher_prompt`` (with a sibling's solution and the
    feedback, null where there is neither)."""
    from .curation import peer_solutions

    out = peer_solutions(samples, threshold, score=score, text=response).withColumn("failed", F.col(score) < threshold)
    told = note if note is not None else F.lit(None).cast("string")
    hints = F.concat_ws("\n\n", F.when(F.col("peer").isNotNull(), F.concat(F.lit("A correct solution:\n"), "peer")), F.when(told.isNotNull(), F.concat(F.lit("Feedback:\n"), told)))
    return out.withColumn("teacher_prompt", F.when(F.col("failed") & (hints != ""), F.concat(F.col(prompt), F.lit("\n\n"), hints)))

"""Why an episode failed, from a row an episode: ``reward, terminal_reason, final_text,
reward_text, parse_error, db_match`` and ``calls``, an array of ``name, arguments`` (JSON).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import tool_role
from .messages import strip_thinking

#: Fixed patterns of final messages.
CLAIMS = (
    r"\b(?:successfully\s+)?cancel(?:led|ed)\b", r"\bcancellation (?:is|was) complete\b", r"\brefund (?:has been|was) processed\b", r"\brefund has been issued\b", r"\b(?:successfully\s+)?refund(?:ed)?\b",
    r"\b(?:successfully\s+)?rebook(?:ed)?\b", r"\b(?:successfully\s+)?update(?:d)?\b", r"\breservation (?:has been )?(?:updated|changed|booked)\b", r"\bbooking (?:is|was) complete\b",
)
QUESTIONS = (r"\bcould you\b", r"\bcan you provide\b", r"\bplease provide\b", r"\bconfirm\b", r"\bwhat is your\b", r"\bwhich\b", r"\bdo you want\b", r"\bwould you like\b")
POLICY = (r"\bpolicy\b", r"\bnot eligible\b", r"\bnot allowed\b", r"\binsurance\b", r"\bbasic economy\b", r"\bnot refundable\b", r"\bunable to process\b")

#: Fixed stages of failure types.
STAGES = {
    "length_or_step_budget_failure": "information_gathering",
    "read_and_stall": "information_gathering",
    "incomplete_workflow": "information_gathering",
    "missing_required_argument": "action_execution",
    "invalid_tool_arguments": "action_execution",
    "wrong_write_action": "action_execution",
    "unverified_write_action": "action_execution",
    "unsupported_final_claim": "final_response",
    "asks_user_instead_of_finishing": "final_response",
    "policy_grounding_error": "policy_or_escalation",
    "invalid_escalation": "policy_or_escalation",
    "valid_escalation_or_transfer": "policy_or_escalation",
    "state_tracking_error": "state_tracking",
}


def _any(text: Column, patterns) -> Column:
    return text.rlike("(?i)" + "|".join(patterns))


def diagnose(episodes: DataFrame) -> DataFrame:
    """Add ``failure_type`` (the first rule that fits) and ``failure_stage``."""
    none = F.lit("")
    roles = F.transform("calls", lambda c: tool_role(c["name"]))
    out = episodes.withColumns({"__roles": F.coalesce(roles, F.array().cast("array<string>")), "__end": F.lower(F.coalesce("terminal_reason", none)), "__final": strip_thinking(F.col("final_text")), "__told": F.lower(F.coalesce("reward_text", none)), "__err": F.coalesce("parse_error", none)})
    has = lambda r: F.array_contains("__roles", r)
    told = lambda *texts: F.col("__told").rlike("|".join(texts))
    last = F.try_element_at("__roles", F.lit(-1))
    good, db = F.coalesce(F.col("reward"), F.lit(0.0)) >= 1, F.coalesce(F.col("db_match"), F.lit(False))
    claims, writes, moves = _any(F.col("__final"), CLAIMS), has("write"), has("transfer")
    ids = lambda key: F.size(F.array_distinct(F.filter(F.transform("calls", lambda c: F.get_json_object(c["arguments"], f"$.{key}")), lambda x: x.isNotNull())))
    kind = (
        F.when(good & moves, "valid_escalation_or_transfer").when(good, "unknown")
        .when(F.col("__end").isin("running", "max_steps", "max_user_turns", "context_overflow", "truncated") | told("max_steps", "context overflow", "terminated prematurely"), "length_or_step_budget_failure")
        .when((F.col("__err") != "") & F.col("__err").rlike("(?i)missing") & F.col("__err").rlike("(?i)argument"), "missing_required_argument").when(F.col("__err") != "", "invalid_tool_arguments")
        .when(told("missing required argument"), "missing_required_argument").when(told("invalid argument", "expected list got string", "validation error", "type error"), "invalid_tool_arguments")
        .when(claims & ~db & ~writes, "unsupported_final_claim").when(writes & ~db & claims, "unsupported_final_claim").when(writes & ~db & (last == "write"), "unverified_write_action").when(writes & ~db, "wrong_write_action")
        .when((F.size(F.filter("__roles", lambda r: r == "read")) >= 2) & ~writes & ~moves, "read_and_stall").when((last == "read") & ~writes & ~moves, "incomplete_workflow")
        .when(_any(F.col("__final"), QUESTIONS), "asks_user_instead_of_finishing").when(moves, "invalid_escalation").when(_any(F.col("__final"), POLICY), "policy_grounding_error")
        .when((ids("reservation_id") > 1) | (ids("order_id") > 1), "state_tracking_error").otherwise("unknown")
    )
    out = out.withColumn("failure_type", kind)
    stage = None
    for k, v in STAGES.items():
        stage = F.when(F.col("failure_type") == k, v) if stage is None else stage.when(F.col("failure_type") == k, v)
    out = out.withColumn("failure_stage", stage.when(has("write"), "write_or_verification").otherwise("unknown"))
    return out.drop("__roles", "__end", "__final", "__told", "__err")


def one_hot(diagnosed: DataFrame, prefix: str = "diag") -> DataFrame:
    """``metric, value``: the share of each failure type and stage."""
    n = diagnosed.agg(F.count(F.lit(1)).alias("n"))  # one row
    kinds = F.explode(F.array(F.concat(F.lit(f"{prefix}/type/"), "failure_type"), F.concat(F.lit(f"{prefix}/stage/"), "failure_stage"))).alias("metric")
    return diagnosed.select(kinds).groupBy("metric").count().join(F.broadcast(n)).select("metric", (F.col("count") / F.col("n")).alias("value"))


def match_events(events: DataFrame, simulated: DataFrame, key: str = "episode") -> DataFrame:
    """Live tool events with the call of the simulation that belongs to each: the next one
    of the same name after the last that was matched. The cursor makes it a walk along an
    episode, so episodes are walked one by one."""
    kinds = dict(events.dtypes)

    def walk(key_value, live: pd.DataFrame, sim: pd.DataFrame) -> pd.DataFrame:
        calls, at, rows = sim.sort_values("pos")[["name", "arguments"]].to_numpy().tolist(), 0, []
        for e in live.sort_values("pos").itertuples(index=False):
            hit = next((i for i in range(at, len(calls)) if calls[i][0] == e.name), None)
            at = hit + 1 if hit is not None else at
            rows.append((e.episode, e.pos, e.name, calls[hit][1] if hit is not None else e.arguments, hit is not None))
        return pd.DataFrame(rows, columns=["episode", "pos", "name", "arguments", "matched"])

    walk.__annotations__.clear()
    left = events.select(F.col(key).alias("episode"), "pos", "name", "arguments")
    right = simulated.select(F.col(key).alias("episode"), "pos", "name", "arguments")
    return left.groupBy("episode").cogroup(right.groupBy("episode")).applyInPandas(walk, f"episode {kinds[key]}, pos {kinds['pos']}, name string, arguments string, matched boolean").withColumnRenamed("episode", key)


#: Ends that cut an episode off, and words of a note that say so (fixed values).
CUT_OFF = ("max_user_turns", "max_steps", "truncated", "parse_error", "running", "context_overflow")
CUT_OFF_NOTES = ("termination", "max_steps", "running")
#: How sure a failure type is (fixed values); any other is of low confidence.
CONFIDENCE = {
    "high": ("length_or_step_budget_failure", "missing_required_argument", "invalid_tool_arguments", "read_and_stall", "incomplete_workflow", "unsupported_final_claim", "unverified_write_action"),
    "medium": ("wrong_write_action", "policy_grounding_error", "invalid_escalation", "valid_escalation_or_transfer", "state_tracking_error"),
}
DECISIONS = ("policy_grounding_error", "valid_escalation_or_transfer", "invalid_escalation")


def failed_components(info: Column, reward: Column, parse_error: Column, terminal_reason: Column) -> Column:
    """Which parts of an evaluation an episode without full reward failed, sorted: those the
    reward's details (``info``, JSON) have entries for. UNKNOWN where none shows."""
    at = lambda path: F.get_json_object(info, path)
    some = lambda path: F.coalesce(~at(path).isin("[]", "{}", "", "null", "false", "0"), F.lit(False))
    listed = lambda path: F.coalesce(at(path).startswith("[") & (at(path) != "[]"), F.lit(False))
    note = F.lower(F.coalesce(at("$.info.note"), F.when(~F.coalesce(at("$.info").startswith("{"), F.lit(False)), at("$.info")), F.lit("")))
    found = {
        "ACTION": (F.coalesce(parse_error, F.lit("")) != "") | listed("$.action_checks"),
        "COMMUNICATION": listed("$.communicate_checks") | some("$.info.communicate"),
        "ENV": F.coalesce(at("$.db_check") != "null", F.lit(False)) | listed("$.env_assertions"),
        "NL_ASSERTION": listed("$.nl_assertions") | F.coalesce(at("$.nl_assertions").startswith("{"), F.lit(False)),
        "TERMINATION": note.rlike("|".join(CUT_OFF_NOTES)) | F.lower(F.coalesce(terminal_reason, F.lit(""))).isin(*CUT_OFF),
    }
    failed = F.filter(F.array(*[F.when(c, k) for k, c in found.items()]), lambda x: x.isNotNull())
    failed = F.when(F.size(failed) == 0, F.array(F.lit("UNKNOWN"))).otherwise(failed)
    return F.when(F.coalesce(reward, F.lit(0.0)) >= 1, F.array().cast("array<string>")).otherwise(failed)


def workflow_status(calls: Column, failure_type: Column, reward: Column, db_match: Column) -> Column:
    """How far an episode's work got: struct of four booleans."""
    has = lambda *roles: F.exists(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")), lambda c: tool_role(c["name"]).isin(*roles))
    db, good = F.coalesce(db_match, F.lit(False)), F.coalesce(reward, F.lit(0.0)) >= 1
    return F.struct(
        has("read").alias("information_gathered"), (has("write", "transfer") | failure_type.isin(*DECISIONS)).alias("required_decision_made"), (has("write") & db).alias("required_write_action_completed"), (good | db).alias("final_state_verified"),
    )


def confidence(failure_type: Column) -> Column:
    out = F.when(failure_type.isin(*CONFIDENCE["high"]), "high").when(failure_type.isin(*CONFIDENCE["medium"]), "medium")
    return out.otherwise("low")


RECORDS = ("reservation_id", "order_id", "user_id", "payment_id", "product_id")


def _last_argument(calls: Column, key: str) -> Column:
    values = F.filter(F.transform(calls, lambda c: F.get_json_object(c["arguments"], f"$.{key}")), lambda x: x.isNotNull() & (x != ""))
    return F.concat(F.lit(f"{key}="), F.try_element_at(values, F.lit(-1)))


def record_at_risk(calls: Column) -> Column:
    """``key=value`` of the last call that names a record, by kinds of keys in their order."""
    return F.coalesce(*[_last_argument(calls, k) for k in RECORDS])


def leaks(rows: DataFrame, patterns: DataFrame, text: str, key: str, pattern: str = "pattern", most: int = 1_000_000) -> DataFrame:
    """``key, pattern, places`` of each pattern that a text holds, whatever the case.

    Patterns (up to ``most`` characters in all, else it raises) are sent to every task, which
    builds one automaton over them, so a text is read once however many there are. Null and
    empty patterns are none; null texts hold nothing."""
    size = patterns.agg(F.sum(F.length(pattern))).first()[0] or 0
    if size > most:
        raise ValueError(f"patterns have {size} characters, more than {most}")
    wanted = sorted({r[0].lower() for r in patterns.select(pattern).distinct().collect() if r[0]})  # bounded above
    kind = dict(rows.dtypes)[key]
    given = rows.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))

    def scan(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(wanted):
            automaton.add_word(w, i)
        automaton.make_automaton()
        for batch in batches:
            owner, found, places = [], [], []
            for at, t in enumerate(batch.column(1).to_pylist()):
                seen: dict[int, int] = {}
                for _, i in automaton.iter(t) if t and wanted else ():
                    seen[i] = seen.get(i, 0) + 1
                owner += [at] * len(seen)
                found += [wanted[i] for i in seen]
                places += seen.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int64())], names=["key", "pattern", "places"])

    return given.mapInArrow(scan, f"key {kind}, pattern string, places long").withColumnRenamed("key", key)


#: What feedback must not name: what only the evaluator knows (fixed values).
FORBIDDEN = ("correct_user_id", "correct_action_sequence", "expected_action_sequence", "target_database_state", "ground_truth", "expected_final_answer", "correct_final_answer")


def assert_no_leak(rows: DataFrame, text: str, key: str, patterns: DataFrame | None = None) -> None:
    """Raises if a text names what only the evaluator knows, with an example."""
    if patterns is None:
        patterns = rows.sparkSession.createDataFrame([(k,) for k in FORBIDDEN], "pattern string")
    found = leaks(rows, patterns, text, key).first()
    if found is not None:
        raise ValueError(f"{found['pattern']!r} leaks in {key} {found[key]}")


def render_feedback(mode: str, failure_type: Column, stage: Column, workflow: Column, components: Column, at_risk: Column, reason: Column) -> Column:
    """Feedback as text or JSON, or an empty text for mode "none"."""
    kinds = {"plain_text": ("text", "plain", "plain_text", "plaintext"), "json": ("structured", "json"), "none": ("none", "off", "false", "0")}
    found = next((k for k, names in kinds.items() if mode.strip().lower() in names), None)
    if found is None:
        raise ValueError(f"unknown feedback mode {mode!r}")
    if found == "none":
        return F.lit("")
    parts = {"primary_failure_type": failure_type, "failure_stage": stage, "diagnostic_confidence": confidence(failure_type), "failed_components": components, "entity_or_record_at_risk": at_risk, "workflow_status": workflow, "terminal_reason": reason}
    if found == "json":
        return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})
    steps = F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), F.when(workflow[s], "True").otherwise("False")) for s in ("information_gathered", "required_decision_made", "required_write_action_completed", "final_state_verified")])
    none = F.lit("None")
    lines = [
        F.lit("Diagnostic feedback:"), F.concat(F.lit("Primary failure: "), failure_type, F.lit(".")), F.concat(F.lit("Failure stage: "), stage, F.lit(".")), F.concat(F.lit("Workflow status: "), steps, F.lit(".")),
        F.concat(F.lit("Failed components: "), F.array_join(components, ", "), F.lit(".")), F.concat(F.lit("Entity or record at risk: "), F.coalesce(at_risk, none), F.lit(".")), F.concat(F.lit("Terminal reason: "), F.coalesce(reason, none), F.lit("; confidence="), confidence(failure_type)),
    ]
    return F.concat_ws("\n", *lines)

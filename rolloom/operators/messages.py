"""Conversations: turns, targets, protocol checks. A conversation is an array of structs
``role, content, tools`` (names of the tools that a message calls).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THINK = r"(?is)<think\b[^>]*>.*?</think>"


def conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``key, messages`` from a row a message (``role, text`` and, if there, ``tools``)."""
    tools = F.col("tools") if "tools" in turns.columns else F.array().cast("array<string>")
    item = F.struct(F.col(order).alias("__o"), "role", F.col("text").alias("content"), tools.alias("tools"))
    sorted_items = turns.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    return sorted_items.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["tools"].alias("tools"))).alias("messages"))


def strip_thinking(text: Column) -> Column:
    """Text without closed thinking blocks, cut at an open one, without stray ends."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), THINK, "")
    out = F.regexp_replace(out, r"(?is)<think\b[^>]*>.*", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)</think>", ""), r"^\s+|\s+$", "")


def leading_greeting(messages: Column) -> Column:
    """Whether the first message that isn't the system's is the assistant's."""
    rest = F.filter(messages, lambda m: m["role"] != "system")
    return F.coalesce(F.get(rest, F.lit(0))["role"] == "assistant", F.lit(False))


def expand_turns(convs: DataFrame, key: str = "conv_id", messages: str = "messages") -> DataFrame:
    """A row for each assistant message with what came before: ``key, assistant_turn_index,
    source_message_index, history, target``. A greeting at the start is no target, and
    thinking is cut from the history."""
    m = F.col(messages)
    cleaned = F.transform(m, lambda x: F.when(x["role"] == "assistant", x.withField("content", strip_thinking(x["content"]))).otherwise(x))
    first = F.aggregate(m, F.lit(0), lambda a, x: a + F.when(x["role"] == "system", 1).otherwise(0))
    rows = convs.select("*", cleaned.alias("__clean"), leading_greeting(m).alias("__greet"), first.alias("__sys"), F.posexplode(m).alias("__at", "target"))
    rows = rows.where(F.col("target")["role"] == "assistant").where(~(F.col("__greet") & (F.col("__at") == F.col("__sys"))))
    before = F.size(F.filter(F.slice(messages, 1, F.col("__at")), lambda x: x["role"] == "assistant"))
    turn = before - F.col("__greet").cast("int")
    return rows.select(key, turn.cast("long").alias("assistant_turn_index"), F.col("__at").cast("long").alias("source_message_index"), F.slice("__clean", 1, F.col("__at")).alias("history"), "target")


REASONS = ("missing_messages", "bad_role", "tool_without_call", "dangling_tool_calls", "content_with_tool_calls", "empty_assistant", "unknown_tool")


def protocol_reason(messages: Column, allowed: Sequence[str] | None = None) -> Column:
    """Why a conversation breaks the protocol (the first reason), or null.

    A fold over the messages with the number of tool answers still owed: roles are
    known, a tool's message answers a call, nothing but tools speaks while answers are
    owed, an assistant either calls tools or says something, and calls known tools."""
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("owed"), none.alias("why"))
    known = F.array(*[F.lit(a) for a in allowed]) if allowed else None

    def step(acc, m):
        said = F.trim(F.coalesce(m["content"], F.lit(""))) != ""
        calls = F.coalesce(F.size(m["tools"]), F.lit(0))
        role = m["role"]
        is_tool = role == "tool"
        why = (
            F.when(~role.isin("system", "user", "assistant", "tool") | role.isNull(), "bad_role")
            .when(is_tool & (acc["owed"] <= 0), "tool_without_call")
            .when(~is_tool & (acc["owed"] > 0), "dangling_tool_calls")
            .when((role == "assistant") & (calls > 0) & said, "content_with_tool_calls")
            .when((role == "assistant") & (calls == 0) & ~said, "empty_assistant")
        )
        if known is not None:
            why = F.coalesce(why, F.when((calls > 0) & (F.size(F.array_except(m["tools"], known)) > 0), "unknown_tool"))
        owed = F.when(is_tool, acc["owed"] - 1).when(role == "assistant", calls).otherwise(acc["owed"])
        return F.struct(F.when(acc["why"].isNull(), owed).otherwise(acc["owed"]).alias("owed"), F.coalesce(acc["why"], why).alias("why"))

    end = F.aggregate(messages, start, step)
    return F.when(messages.isNull() | (F.size(messages) == 0), "missing_messages").otherwise(F.coalesce(end["why"], F.when(end["owed"] > 0, "dangling_tool_calls")))


def verified_success(rewards: Sequence[str], success: str = "success", runtime: str = "runtime", status: str = "status", terminal_reason: str = "terminal_reason") -> Column:
    """Whether an official run came to its end with success or a reward of 1 (fields that
    are no number are left out)."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    ended = (low(status) == "terminated") | ~low(terminal_reason).isin("", "running")
    best = F.greatest(*[F.col(r).try_cast("double") for r in rewards], F.lit(float("-inf"))) >= 1
    return low(runtime).isin("", "official_gym") & ended & (F.coalesce(F.col(success), F.lit(False)) | best)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, or null."""
    out = None
    for name, broken in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def loss_mask(tokens_per_message: Column, roles: Column) -> Column:
    """1 on tokens of assistant messages: from lengths and roles, in order."""
    return F.flatten(F.zip_with(tokens_per_message, roles, lambda n, r: F.array_repeat((r == "assistant").cast("int"), n)))


def segments(tokens_per_message: Column, roles: Column) -> Column:
    """``message_index, role, token_start, token_end, loss`` of every message."""
    starts = F.transform(tokens_per_message, lambda n, i: F.aggregate(F.slice(tokens_per_message, 1, i), F.lit(0), lambda a, x: a + x))
    return F.transform(roles, lambda r, i: F.struct(i.alias("message_index"), r.alias("role"), F.get(starts, i).alias("token_start"), (F.get(starts, i) + F.get(tokens_per_message, i)).alias("token_end"), (r == "assistant").cast("int").alias("loss")))


def clip_segments(segs: Column, length: Column | int, total: Column, side: str = "right") -> Column:
    """Segments after cutting a sequence of ``total`` tokens to ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    off = F.greatest(F.lit(0), total - n) if side == "left" else F.lit(0)
    kept = F.transform(segs, lambda s: s.withField("token_start", F.least(n, F.greatest(F.lit(0), s["token_start"] - off))).withField("token_end", F.least(n, F.greatest(F.lit(0), s["token_end"] - off))))
    return F.filter(kept, lambda s: s["token_end"] > s["token_start"])


def token_budget(rows: DataFrame, segs: str = "segments") -> DataFrame:
    """``role, segments, tokens, share`` over all rows."""
    each = rows.select(F.explode(segs).alias("s")).groupBy("s.role").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("s.token_end") - F.col("s.token_start")).alias("tokens"))
    whole = each.agg(F.sum("tokens").alias("t"))  # one row
    return each.join(F.broadcast(whole)).select("role", "segments", "tokens", (F.col("tokens") / F.col("t")).alias("share"))


def found_messages(direct: Column, *payloads: Column) -> Column:
    """The messages of an episode: its own list, or that of the first of the recorded runs
    (JSON texts with ``messages``) that has one. Null if none has."""
    kind = "struct<messages:array<struct<role:string,content:string,tools:array<string>>>>"
    return F.coalesce(direct, *[F.from_json(p, kind)["messages"] for p in payloads])


def thoughts_of(turns: Column) -> Column:
    """Trimmed thinking of each turn of an episode; empty where a turn has none."""
    return F.coalesce(F.transform(turns, lambda t: F.trim(F.coalesce(t["thinking_text"], F.lit("")))), F.array().cast("array<string>"))


def without_greeting(messages: Column) -> Column:
    """Messages less an assistant's greeting (no calls) before anybody else but the system spoke."""
    greets = lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(m["tools"]), F.lit(0)) <= 0)
    first = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] != "system", i)), lambda i: i.isNotNull())
    drop = F.coalesce(greets(F.get(F.filter(messages, lambda m: m["role"] != "system"), F.lit(0))), F.lit(False))
    place = F.when(drop, F.get(first, F.lit(0))).otherwise(-1)
    return F.filter(messages, lambda m, i: i != place)


def training_messages(messages: Column, system_prompt: Column | None = None, thoughts: Column | None = None) -> Column:
    """What a model is trained on: a system prompt put first where there is none, without
    the greeting, and each assistant turn's thinking (``thoughts``, by turn) before its
    text. An unknown role raises."""
    fine = F.forall(messages, lambda m: F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)))
    known = F.when(fine, messages).otherwise(F.raise_error(F.lit("a message has an unknown role")))
    kept = without_greeting(known)
    if thoughts is not None:
        turn = lambda i: F.size(F.filter(F.slice(kept, 1, i), lambda m: m["role"] == "assistant"))
        lead = lambda i: F.concat(F.lit("<think>\n"), F.get(thoughts, turn(i)), F.lit("\n</think>"))
        calls = lambda m: F.coalesce(F.size(m["tools"]), F.lit(0)) > 0

        def said(m, i):
            some = (m["role"] == "assistant") & (F.coalesce(F.get(thoughts, turn(i)), F.lit("")) != "")
            text = F.when(m["content"].isNotNull(), F.concat(lead(i), F.lit("\n"), m["content"])).when(calls(m), lead(i))
            return m.withField("content", F.when(some, text).otherwise(m["content"]))

        kept = F.transform(kept, said)
    if system_prompt is None:
        return kept
    prompt = F.trim(F.coalesce(system_prompt, F.lit("")))
    lead_in = F.array(F.struct(F.lit("system").alias("role"), prompt.alias("content"), F.array().cast("array<string>").alias("tools")))
    first = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.when((prompt != "") & ~first, F.concat(lead_in, kept)).otherwise(kept)

"""Conversations as training sequences: messages rendered and tokenised, loss masks and
segments, checks and statistics.

A row is a message until the end: each is rendered and tokenised by itself, in parallel, and
running sums along a conversation say where its tokens lie in the rendered prefixes. The
template may drop the thinking of assistant messages once a user has spoken again
(``keep_thinking=False``); then a longer prefix may render to fewer tokens, and a message's
tokens depend on what comes later. Nothing is rendered once a prefix: with ``saved`` tokens
dropped before the last user message, a prefix has the full sum of its messages less those.

Edge cases: a null text is empty; a null role renders as an empty one and is nobody's; a
conversation of one message, or without any assistant, keeps its row with the reason why it
can't be trained on; repeated places (same key and order) are ordered by role and text."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .messages import strip_thinking

Tokenizer = Callable[[Column], Column]

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of the plain tokenizer, first fit: the two markers, a line feed, a run with the blank
#: before it, a sign that opens nothing, any other white space.
WORD = r"<\|im_start\|>|<\|im_end\|>|\n| ?[^\s<]+| ?<|\s"


def word_ids(text: Column, size: int = 50_000) -> Column:
    """A tokenizer without a vocabulary: words numbered by hash from 10 on, the markers 1, 2."""
    number = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"), F.lit(size)) + 10
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(w == START, F.lit(1).cast("long")).when(w == END, F.lit(2).cast("long")).otherwise(number(w)))


# -- messages as they come -----------------------------------------------------------


def without_nulls(value: Any) -> Any:
    """Keys without a value left out, at any depth."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def as_mapping(arguments: Any) -> dict:
    """Arguments as a mapping; text that holds none under a name of its own."""
    if arguments in (None, ""):
        return {}
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except ValueError:
            return {"__raw_arguments__": arguments}
    return without_nulls(arguments) if isinstance(arguments, dict) else {"__value__": arguments}


def normal_call(call: Any) -> dict:
    """A tool call with its arguments as a mapping, in the shape it came in."""
    if not isinstance(call, dict):
        raise ValueError("a tool call is no mapping")
    call = without_nulls(call)
    inner = call.get("function")
    if isinstance(inner, dict):
        return {"type": "function"} | call | {"function": inner | {"arguments": as_mapping(inner.get("arguments"))}}
    return call | {"arguments": as_mapping(call.get("arguments"))} if "name" in call else call


def flat_call(call: dict) -> dict:
    """``name, arguments`` of a nested call; any other as it is."""
    inner = call.get("function")
    return {"name": inner.get("name", call.get("name", "")), "arguments": as_mapping(inner.get("arguments"))} if isinstance(inner, dict) else call


def normal_messages(messages: list, flat: bool = False) -> list[dict]:
    """Messages without nulls, empty call lists and a greeting at the start, calls normal."""
    out, spoken = [], False
    for m in messages:
        if not isinstance(m, dict):
            raise ValueError("a message is no mapping")
        m = without_nulls(m)
        calls = m.pop("tool_calls", None)
        greets = m.get("role") == "assistant" and not spoken and not calls
        spoken = spoken or m.get("role") != "system"
        if greets:
            continue
        if calls:
            m["tool_calls"] = [flat_call(normal_call(c)) if flat else normal_call(c) for c in calls]
        out.append(m)
    return out


def normalise_messages(flat: bool = False) -> Callable[[Column], Column]:
    """A function of messages as JSON texts; what is no list of messages raises."""

    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        made = [None if t is None else normal_messages(json.loads(t), flat) for t in texts]
        return pd.Series([None if m is None else json.dumps(m, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for m in made], dtype=object)

    return normal


# -- rendering -----------------------------------------------------------------------


def rendered(role: Column, text: Column, calls: Column | None = None) -> Column:
    """A message as text: markers around role, content and calls, each in tags of its own.
    ``calls``: JSON texts, nested (``function.name``) or flat (``name``)."""
    body = F.coalesce(text, F.lit(""))
    if calls is not None:
        name = lambda c: F.coalesce(F.get_json_object(c, "$.function.name"), F.get_json_object(c, "$.name"), F.lit(""))
        given = lambda c: F.coalesce(F.get_json_object(c, "$.function.arguments"), F.get_json_object(c, "$.arguments"), F.lit("{}"))
        one = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), name(c), F.lit('", "arguments": '), given(c), F.lit("}\n</tool_call>"))
        body = F.concat(body, F.array_join(F.transform(F.coalesce(calls, F.array().cast("array<string>")), one), ""))
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), body, F.lit(END + "\n"))


def _prefixed(turns: DataFrame, tokenizer: Tokenizer, keep_thinking: bool, key: str, order: str) -> DataFrame:
    """A row a message: ``message_index, role, calls, thinks, ids`` as in its own prefix,
    ``used`` as in the whole conversation, ``token_start, token_end`` by prefixes, ``skipped``
    (tokens of the message that lie before ``token_start``) and ``turn`` (assistants so far)."""
    calls = F.col("calls") if "calls" in turns.columns else F.array().cast("array<string>")
    rows = turns.select(F.col(key).alias("__key"), F.col(order).alias("__order"), "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(calls, F.array().cast("array<string>")).alias("calls"))
    assistant, user = F.col("role").eqNullSafe("assistant"), F.col("role").eqNullSafe("user")
    rows = rows.withColumn("ids", tokenizer(rendered(F.col("role"), F.col("text"), F.col("calls"))))
    cut = F.col("ids") if keep_thinking else F.when(assistant, tokenizer(rendered(F.col("role"), strip_thinking(F.col("text")), F.col("calls")))).otherwise(F.col("ids"))
    rows = rows.withColumn("cut", cut).withColumn("thinks", assistant & F.col("text").contains("<think")).withColumn("size", F.size("ids")).withColumn("saved", F.size("ids") - F.size("cut"))
    along = Window.partitionBy("__key").orderBy("__order", "role", "text")
    so_far, whole = along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("__key")
    rows = rows.withColumn("message_index", F.row_number().over(along) - 1).withColumn("__before", F.sum("saved").over(so_far) - F.col("saved"))
    dropped = F.coalesce(F.last(F.when(user, F.col("__before")), ignorenulls=True).over(so_far), F.lit(0))
    rows = rows.withColumn("token_end", (F.sum("size").over(so_far) - dropped).cast("int"))
    rows = rows.withColumn("token_start", F.coalesce(F.lag("token_end").over(along), F.lit(0))).withColumn("turn", F.sum(assistant.cast("int")).over(so_far) - 1)
    last = F.coalesce(F.max(F.when(user, F.col("message_index"))).over(whole), F.lit(-1))
    rows = rows.withColumn("used", F.when(F.col("message_index") < last, F.col("cut")).otherwise(F.col("ids"))).withColumn("stripped", F.col("message_index") < last)
    rows = rows.withColumn("skipped", F.col("token_start") - (F.col("token_end") - F.col("size")))
    return rows.select("__key", "message_index", "role", "calls", "thinks", "stripped", "ids", "used", "token_start", "token_end", "skipped", "turn")


def _gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """A row a conversation, its messages as an ordered array ``m``."""
    return rows.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("message_index", *columns))).alias("m"))


def _clipped(values: Column, total: Column, most: int, side: str) -> Column:
    """At most ``most`` values, from the end if ``side`` is left."""
    return F.slice(values, F.when(total > most, total - most + 1).otherwise(1) if side == "left" else F.lit(1), F.lit(most))


#: Why a conversation is not trained on.
ERRORS = ("prefix_shrinks", "too_long", "no_labels", "span_count", "missing_thinking")


def pretokenize(turns: DataFrame, tokenizer: Tokenizer = word_ids, max_length: int = 32_768, truncation: str = "error", keep_thinking: bool = True, audit: bool = True, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A row a conversation: ``input_ids, loss_mask, segments, seq_len, original_seq_len,
    labeled_tokens, assistant_count, truncated, template_shape, error``.

    Tokens of assistant messages have loss, but not the first token of all. A segment has
    ``message_index, role, segment_type, assistant_turn_index, token_start, token_end, loss,
    tool_names``. Too long sequences are an ``error`` or cut on the ``right`` or ``left``,
    segments with them. ``audit`` also asks for one span of loss for each assistant message
    and for its thinking within. Rows with an ``error`` stay, with all that is known of them."""
    if truncation not in ("error", "left", "right"):
        raise ValueError(f"unknown truncation {truncation!r}")
    rows = _gathered(_prefixed(turns, tokenizer, keep_thinking, key, order), "role", "calls", "thinks", "stripped", "used", "token_start", "token_end", "turn")
    is_assistant = lambda x: x["role"].eqNullSafe("assistant")
    name = lambda c: F.coalesce(F.get_json_object(c, "$.function.name"), F.get_json_object(c, "$.name"))
    kind = lambda x: F.when(is_assistant(x), F.when(F.size(x["calls"]) > 0, "assistant_tool_call").otherwise("assistant_text")).otherwise(F.coalesce(x["role"], F.lit("")))
    segment = lambda x: F.struct(
        x["message_index"].alias("message_index"), x["role"].alias("role"), kind(x).alias("segment_type"), F.when(is_assistant(x), x["turn"].cast("int")).alias("assistant_turn_index"),
        x["token_start"].alias("token_start"), x["token_end"].alias("token_end"), is_assistant(x).cast("int").alias("loss"), F.filter(F.transform(x["calls"], name), lambda n: n.isNotNull() & (n != "")).alias("tool_names"),
    )
    rows = rows.select(
        "__key", F.flatten(F.transform("m", lambda x: x["used"])).alias("ids"), F.transform("m", segment).alias("segs"),
        F.exists("m", lambda x: is_assistant(x) & x["thinks"] & x["stripped"] & F.lit(not keep_thinking)).alias("__unthought"),
        F.when(F.exists("m", lambda x: F.exists(x["calls"], lambda c: F.get_json_object(c, "$.function.name").isNull())), "flat").otherwise("nested").alias("template_shape"),
    )
    rows = rows.withColumn("original_seq_len", F.size("ids")).withColumn("assistant_count", F.size(F.filter("segs", lambda s: s["loss"] == 1)))
    shrinks = F.exists("segs", lambda s: s["token_end"] < s["token_start"])
    mask = F.flatten(F.transform("segs", lambda s: F.array_repeat(s["loss"], F.greatest(F.lit(0), s["token_end"] - s["token_start"]))))
    rows = rows.withColumn("__shrinks", shrinks).withColumn("mask", F.slice(mask, F.lit(1), F.greatest(F.lit(0), F.col("original_seq_len"))))
    total, long = F.col("original_seq_len"), F.col("original_seq_len") > max_length
    cut = truncation != "error"
    ids, mask = (_clipped(F.col(c), total, max_length, truncation) if cut else F.col(c) for c in ("ids", "mask"))
    off = F.when(long, total - max_length).otherwise(0) if truncation == "left" else F.lit(0)
    end = F.when(long, F.lit(max_length)).otherwise(total) if cut else F.greatest(total, F.lit(0))
    inside = lambda at: F.least(end, F.greatest(F.lit(0), at - off))
    moved = F.transform("segs", lambda s: s.withField("token_start", inside(s["token_start"])).withField("token_end", inside(s["token_end"])))
    kept = {"right": lambda s: s["token_start"] < max_length, "left": lambda s: s["token_end"] > off}.get(truncation)
    segs = F.when(long, F.transform(F.filter(F.arrays_zip(F.col("segs").alias("a"), moved.alias("b")), lambda z: kept(z["a"])), lambda z: z["b"])).otherwise(F.col("segs")) if cut else F.col("segs")
    rows = rows.withColumns({"input_ids": ids, "loss_mask": F.transform(mask, lambda x, i: F.when(i == 0, 0).otherwise(x)), "segments": segs, "truncated": long & F.lit(cut)})
    rows = rows.withColumn("labeled_tokens", F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x)).withColumn("seq_len", F.size("input_ids"))
    spans = F.size(F.filter(F.transform("loss_mask", lambda x, i: (x == 1) & ((i == 0) | (F.get("loss_mask", i - 1) == 0))), lambda x: x))
    error = F.when(F.col("__shrinks"), "prefix_shrinks").when(F.lit(not cut) & long, "too_long").when(F.col("labeled_tokens") <= 0, "no_labels")
    if audit:
        error = error.when(~F.col("truncated") & (spans != F.col("assistant_count")), "span_count").when(F.col("__unthought"), "missing_thinking")
    return rows.select(F.col("__key").alias(key), "input_ids", "loss_mask", "segments", "seq_len", "original_seq_len", "labeled_tokens", "assistant_count", "truncated", "template_shape", error.alias("error"))


def pretokenize_stats(made: DataFrame) -> DataFrame:
    """One row: rows in and out, errors, lengths (mean, 90th and 95th percentile, most), and
    counts by shape, over the rows without an error."""
    fine = F.col("error").isNull()
    of = lambda c: F.when(fine, F.col(c))
    q = F.percentile(of("seq_len"), [0.9, 0.95])
    out = made.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(fine).alias("output_rows"), F.count_if(~fine).alias("errors"), F.coalesce(F.avg(of("seq_len")), F.lit(0.0)).alias("avg_seq_len"), q.alias("q"),
        F.coalesce(F.max(of("seq_len")), F.lit(0)).alias("max_seq_len"), F.coalesce(F.max(of("original_seq_len")), F.lit(0)).alias("max_original_seq_len"), F.coalesce(F.avg(of("labeled_tokens")), F.lit(0.0)).alias("avg_labeled_tokens"),
        F.coalesce(F.avg(of("assistant_count")), F.lit(0.0)).alias("avg_assistant_count"), F.count_if(fine & F.col("truncated")).alias("truncated_rows"),
        F.count_if(fine & (F.col("template_shape") == "nested")).alias("nested"), F.count_if(fine & (F.col("template_shape") == "flat")).alias("flat"),
    )
    return out.withColumn("p90_seq_len", F.coalesce(F.get("q", F.lit(0)), F.lit(0.0))).withColumn("p95_seq_len", F.coalesce(F.get("q", F.lit(1)), F.lit(0.0))).drop("q")


def sft_examples(turns: DataFrame, tokenizer: Tokenizer = word_ids, max_length: int = 1024, pad_mode: str = "right", truncation: str = "error", keep_thinking: bool = True, ignore_mismatch: bool = False, pad_id: int = 0, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A row a conversation: ``input_ids, attention_mask, position_ids, loss_mask,
    sequence_length, matches, error``.

    A message's tokens are what its prefix adds to the one before; joined, they should be
    the tokens of the whole conversation, and ``matches`` says whether they are: if not, and
    unless ``ignore_mismatch``, ``error`` is "ids_mismatch". Assistant tokens have loss, less
    the generation prompt that leads each of them in. Right padding to ``max_length`` or none;
    too long sequences are cut, or have the error "too_long"."""
    if pad_mode not in ("right", "no_padding") or truncation not in ("error", "left", "right"):
        raise ValueError(f"unknown padding {pad_mode!r} or truncation {truncation!r}")
    prompt = F.size(tokenizer(F.lit(f"{START}assistant\n")))
    rows = _prefixed(turns, tokenizer, keep_thinking, key, order)
    own = F.when(F.col("skipped") > 0, F.slice("ids", F.col("skipped") + 1, F.greatest(F.lit(0), F.size("ids") - F.col("skipped")))).otherwise(F.col("ids"))
    rows = rows.withColumn("own", own).withColumn("lead", F.least(prompt, F.size("own")))
    loss = F.when(F.col("role").eqNullSafe("assistant"), F.concat(F.array_repeat(F.lit(0), F.col("lead")), F.array_repeat(F.lit(1), F.size("own") - F.col("lead")))).otherwise(F.array_repeat(F.lit(0), F.size("own")))
    rows = _gathered(rows.withColumn("loss", loss), "own", "loss", "used")
    rows = rows.select("__key", *[F.flatten(F.col(f"m.{c}")).alias(c) for c in ("own", "loss", "used")])
    rows = rows.withColumn("sequence_length", F.size("own")).withColumn("matches", F.col("own") == F.col("used"))
    n, side = F.col("sequence_length"), "left" if truncation == "left" and pad_mode == "right" else "right"
    gap = F.greatest(F.lit(0), F.lit(max_length) - n) if pad_mode == "right" else F.lit(0)
    filled = lambda c, filler: F.concat(_clipped(c, n, max_length, side), F.array_repeat(F.lit(filler).cast("long"), gap))
    places = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    error = F.when(~F.col("matches") & F.lit(not ignore_mismatch), "ids_mismatch").when((n > max_length) & F.lit(truncation == "error"), "too_long")
    return rows.select(
        F.col("__key").alias(key), filled(F.col("own"), pad_id).alias("input_ids"), filled(F.array_repeat(F.lit(1).cast("long"), n), 0).alias("attention_mask"),
        filled(places, 0).alias("position_ids"), filled(F.transform("loss", lambda x: x.cast("long")), 0).alias("loss_mask"), "sequence_length", "matches", error.alias("error"),
    )


def read_conversations(spark, paths: Sequence[str], most: int | None = None, seed: int | None = None, messages: str = "messages") -> DataFrame:
    """Message rows ``conv_id, turn, role, text, calls`` of conversation files: all of them,
    the first ``most`` rows, or with a seed a sample of so many. ``messages`` is an array of
    structs ``role, content`` and, if there, ``tool_calls`` (any struct, kept as JSON)."""
    from ..sources.files import read_files

    rows = read_files(spark, paths, most=most, seed=seed)
    item = rows.schema[messages].dataType.elementType.fieldNames()
    calls = (lambda m: F.transform(m["tool_calls"], lambda c: F.to_json(c))) if "tool_calls" in item else (lambda m: F.array().cast("array<string>"))
    each = rows.select(F.col("row_id").alias("conv_id"), F.posexplode(messages).alias("turn", "m"))
    return each.select("conv_id", "turn", "m.role", F.col("m.content").alias("text"), calls(F.col("m")).alias("calls"))

"""What a model's output says: actions, tool calls, identifiers."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
FUNCTION = re.compile(r"<function=([^>\s]+)>(.*?)</function>", re.DOTALL)
PARAMETER = re.compile(r"<parameter=([^>\s]+)>(.*?)</parameter>", re.DOTALL)


def first_call_object(text: str) -> dict | None:
    """The first JSON object in the text that has a name and arguments."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict) and {"name", "arguments"} <= found.keys():
            return found
    return None


def decoded_containers(value):
    """Texts that hold a JSON object or list become that, at any depth; others stay texts."""
    if isinstance(value, str):
        inner = value.strip()
        if inner[:1] + inner[-1:] in ("{}", "[]"):
            try:
                return decoded_containers(json.loads(inner))
            except ValueError:
                return value
        return value
    if isinstance(value, list):
        return [decoded_containers(v) for v in value]
    if isinstance(value, dict):
        return {str(k): decoded_containers(v) for k, v in value.items()}
    return value


def parameter_value(raw: str):
    raw = raw.strip()
    try:
        value = json.loads(raw) if raw else ""
    except ValueError:
        return raw
    return decoded_containers(value) if isinstance(value, list | dict) else value if isinstance(value, str) else raw


def tagged_call(text: str) -> dict | None:
    """A call in tags: a function with parameters."""
    outer = TOOL_CALL.search(text)
    body = FUNCTION.search(outer[1] if outer else text)
    return {"name": body[1], "arguments": {k: parameter_value(v) for k, v in PARAMETER.findall(body[2])}} if body else None


def functional(text: str) -> bool:
    return bool(re.fullmatch(r"[a-zA-Z_]\w*\s*\(.*\)", text.strip(), re.DOTALL))


def visible(text: str | None) -> str:
    """Text without thinking, as ``messages.strip_thinking``."""
    out = re.sub(r"(?is)<think\b[^>]*>.*?</think>", "", text or "")
    out = re.sub(r"(?is)<think\b[^>]*>.*", "", out)
    return re.sub(r"(?i)</think>", "", out).strip()


def action_of(text: str | None) -> tuple[str, str | None, str | None]:
    """(kind, tool name, arguments as JSON): tool_json, tool_qwen_xml, tool_functional,
    plain_text or invalid (nothing visible)."""
    shown = visible(text)
    if not shown:
        return "invalid", None, None
    for kind, call in (("tool_json", first_call_object(shown)), ("tool_qwen_xml", tagged_call(shown))):
        if call:
            return kind, str(call["name"]), json.dumps(decoded_containers(call["arguments"]), sort_keys=True, ensure_ascii=False)
    if functional(shown):
        return "tool_functional", re.match(r"\w+", shown)[0], None
    return "plain_text", None, None


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))
def parse_action(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([action_of(t) for t in text], columns=["kind", "name", "arguments"])


def tagged_json_calls(text: Column) -> Column:
    """``name, arguments`` of every call in tags whose body is a JSON object with both."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")


#: Fixed patterns of identifiers, in the order they are looked for.
IDENTIFIERS = (
    ("payment", re.compile(r"\b(?:gift_card|certificate|credit_card)_\d+\b")),
    ("user", re.compile(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+_\d{4}\b")),
    ("flight", re.compile(r"\b[A-Z]{3}\d{3}\b")),
    ("reservation", re.compile(r"\b(?=[A-Z0-9]{6}\b)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{6}\b")),
)
#: What stays of an identifier: the name of a payment kind, the carrier of a flight.
KEPT = {"payment": re.compile(r"^[a-z_]+_"), "flight": re.compile(r"^[A-Z]{3}")}


def find_identifiers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) without overlaps, earlier classes first, by place."""
    taken: list[tuple[int, int, str]] = []
    for name, pattern in IDENTIFIERS:
        for m in pattern.finditer(text):
            if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                taken.append((m.start(), m.end(), name))
    return sorted(taken)


def _kept_part(kind: str, value: str) -> int:
    return m.end() if kind in KEPT and (m := KEPT[kind].match(value)) else 0


def _shaped(value: str, numbers) -> str:
    """The value with its capitals, small letters and digits drawn anew."""
    base = lambda c: (65, 26) if "A" <= c <= "Z" else (97, 26) if "a" <= c <= "z" else (48, 10) if c.isdigit() else None
    return "".join(chr(b[0] + next(numbers) % b[1]) if (b := base(c)) else c for c in value)


def pseudonym(kind: str, value: str, seed: str, used: set[str]) -> str:
    """A text of the same shape, the same for the same seed and unlike any used one."""
    keep = _kept_part(kind, value)
    for attempt in range(10_000):
        stream = hashlib.sha256(f"{seed}|{kind}|{value}|{attempt}".encode()).digest() * (1 + len(value) // 32)
        made = value[:keep] + _shaped(value[keep:], iter(stream))
        if made not in used and made != value:
            return made
    raise ValueError("no free pseudonym")


def replaced(text: str, spans: list[tuple[int, int, str]], names: dict[str, str]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], names[text[a:b]]]
        at = b
    return "".join(out) + text[at:]


def identifier_mapping(text: str, seed: str) -> dict[str, str]:
    spans = find_identifiers(text)
    used, names = {text[a:b] for a, b, _ in spans}, {}
    for a, b, kind in spans:
        if text[a:b] not in names:
            names[text[a:b]] = pseudonym(kind, text[a:b], seed, used)
            used.add(names[text[a:b]])
    return names


def randomise_text(text: str | None, seed: str) -> str | None:
    """Every identifier replaced, the same one by the same pseudonym within a record."""
    return None if text is None else replaced(text, find_identifiers(text), identifier_mapping(text, seed))


@F.pandas_udf(T.StringType())
def randomise_identifiers(text: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([randomise_text(t, str(s)) for t, s in zip(text, seed, strict=True)], dtype=object)


def canonical_mapping(text: str) -> dict[str, str]:
    """Identifiers and counters of the same shape, in the order of their texts within a
    class; a counter that is taken is passed over."""
    spans = find_identifiers(text)
    names: dict[str, str] = {}
    for kind, _ in IDENTIFIERS:
        count = 0
        for old in sorted({text[a:b] for a, b, k in spans if k == kind}):
            keep = _kept_part(kind, old)
            while True:
                count, rest, made = count + 1, count + 1, list(old)
                for i in range(len(old) - 1, keep - 1, -1):
                    size = 10 if old[i].isdigit() else 26 if old[i].isascii() and old[i].isalpha() else 0
                    if size:
                        made[i] = chr((48 if size == 10 else 65 if old[i].isupper() else 97) + rest % size)
                        rest //= size
                if "".join(made) not in names.values():
                    break
            names[old] = "".join(made)
    return names


def canonical_text(text: str | None) -> str | None:
    """Identifiers replaced by their counters."""
    return None if text is None else replaced(text, find_identifiers(text), canonical_mapping(text))


@F.pandas_udf(T.StringType())
def canonical_identifiers(text: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(t) for t in text], dtype=object)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def identifiers_of(text: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([identifier_mapping(t or "", str(s)) for t, s in zip(text, seed, strict=True)], dtype=object)


def argument_errors(text: Column) -> Column:
    """``missing`` and ``invalid`` argument names of an error text, each once."""
    names = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    flag = lambda p, name: F.when(text.rlike(p), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    missing = F.filter(names(r"(?i)missing required arguments?:?\s*([a-zA-Z0-9_\[\].]+)?"), lambda x: x != "")
    invalid = F.filter(names(r"(?i)invalid arguments?:?\s*([a-zA-Z0-9_\[\].]+)?"), lambda x: x != "")
    invalid = F.concat(invalid, flag(r"(?i)expected\s+[a-zA-Z0-9_]+\s+got\s+[a-zA-Z0-9_]+", "type_mismatch"), flag("(?i)validation error", "schema_validation"))
    return F.struct(F.array_distinct(F.coalesce(missing, F.array().cast("array<string>"))).alias("missing"), F.array_distinct(F.coalesce(invalid, F.array().cast("array<string>"))).alias("invalid"))


#: Fixed beginnings of tool names by what a tool does.
WRITE_TOOLS = ("cancel_", "update_", "book_", "modify_", "return_", "exchange_")
READ_TOOLS = ("get_", "search_", "list_", "calculate")


def tool_role(name: Column) -> Column:
    """read, write, transfer, done, other or none, by a tool's name."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    starts = lambda names: n.rlike("^(" + "|".join(names) + ")")
    return (
        F.when(n == "", "none").when(n == "transfer_to_human_agents", "transfer").when(n == "done", "done").when(starts(WRITE_TOOLS), "write")
        .when(starts(READ_TOOLS) | n.endswith("_status") | n.endswith("_details"), "read").otherwise("other")
    )


def text_reject_reason(text: Column, allowed: list[str]) -> Column:
    """Why an assistant's text can't be learned from (the first reason), or null."""
    known = F.array(*[F.lit(a) for a in allowed])
    strange = lambda p: F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda n: ~F.array_contains(known, n)), F.lit(1))
    named = [("unknown_xml_tool", r"<function\s*=\s*([a-zA-Z_]\w*)\s*>"), ("unknown_json_tool", r'"name"\s*:\s*"([a-zA-Z_]\w*)"'), ("unknown_functional_tool", r"(?m)^\s*([a-zA-Z_]\w*)\s*\(")]
    return F.coalesce(
        F.when(text.rlike(r"(?m)^\s*(user|tool|assistant)\s*:"), "transcript_replay"), F.when(F.contains(text, F.lit("```")), "markdown_tool_or_fence"),
        F.when(F.contains(F.lower(text), F.lit("get_reservations")), "known_fake_tool_get_reservations"), *[F.concat(F.lit(f"{k}:"), strange(p)) for k, p in named],
    )


def channel_calls(text: Column) -> Column:
    """``name, arguments`` of calls in channel tags, analysis left out."""
    shown = without_analysis(text)
    names = F.regexp_extract_all(shown, F.lit(CHANNEL_CALL), F.lit(1))
    bodies = F.regexp_extract_all(shown, F.lit(CHANNEL_CALL), F.lit(2))
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("arguments")))


#: Fixed form of a call in channel tags.
CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def without_analysis(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")


def typed_argument(value: Column, kind: Column) -> Column:
    """An argument's text as JSON of the kind that its schema names; what doesn't fit stays
    a text."""
    quoted = F.to_json(F.struct(value.alias("v")))
    text = F.regexp_extract(quoted, r'(?s)^\{"v":(.*)\}$', 1)
    low = F.lower(F.trim(value))
    number = F.when(kind == "integer", F.trim(value).try_cast("long").cast("string")).when(kind == "number", F.trim(value).try_cast("double").cast("string"))
    truth = F.when((kind == "boolean") & low.isin("true", "false"), low)
    nested = F.when(kind.isin("object", "array") & F.try_parse_json(value).isNotNull(), F.trim(value))
    return F.coalesce(F.when(low == "null", "null"), number, truth, nested, text)


def numbered_passages(passages: Column) -> Column:
    """Search results (an array of ``title, text``) as the text that a model reads: one
    line each, numbered from 1, with its title."""
    line = lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.coalesce(p["title"], F.lit("")), F.lit(") "), F.coalesce(p["text"], F.lit("")))
    return F.array_join(F.transform(passages, line), "\n")

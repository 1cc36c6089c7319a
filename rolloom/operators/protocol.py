"""Protocol datasets: from recorded episodes to training rows, with every reject and its
reason, variants under pseudonyms, splits that keep tasks together, and a manifest.

An episode is a row with ``source_path, source_index, task_id, sample_id, messages`` (structs
``role, content, tools``) and what the rules look at. The first rule that an episode breaks is
its reason; the others fan out to one row for each variant, and a variant renames identifiers
by one mapping for the whole trajectory, drawn from the record's key, so messages stay
consistent and reruns agree. The manifest is a table of counts; nothing is collected."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import canonical_mapping, find_identifiers, identifier_mapping, replaced
from ..sources.stable import stable
from . import curation
from .messages import expand_turns

#: Fixed patterns of an assistant that opens by speaking as the user.
USER_ECHOES = {"my_user_id": r"(?i)\bmy user id\b", "my_name_is": r"(?i)\bmy name is\b", "i_am_named_user": r"\b[iI] [aA][mM] [a-zA-Z][A-Za-z'-]+ [a-zA-Z][A-Za-z'-]+\b"}


@dataclass(frozen=True)
class Variant:
    """A name, what is done to identifiers (none, canonicalize, randomize), and a number."""

    name: str
    transform: str
    index: int


def variants(transform: str = "none", count: int = 1, include_original: bool = False) -> list[Variant]:
    """The variants of every episode. Only random pseudonyms can have several, or the
    original beside them."""
    if count < 1:
        raise ValueError(f"at least one variant is needed, not {count}")
    if transform not in ("none", "canonicalize", "randomize"):
        raise ValueError(f"unknown transform {transform!r}")
    if transform != "randomize" and (count > 1 or include_original):
        raise ValueError("several variants need random pseudonyms")
    own = [Variant(f"{transform}_{i}", transform, i) for i in range(count)]
    return ([Variant("original", "none", 0)] if include_original else []) + own


def user_echo(action_type: Column, text: Column) -> Column:
    """Names of the patterns by which a first turn of plain text speaks as the user; null
    where it does not."""
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in USER_ECHOES.items()]), lambda x: x.isNotNull())
    return F.when((action_type == "plain_text") & (F.size(hits) > 0), hits)


def thinking_enabled(flag: Column, kwargs: Column | None = None, mode: Column | None = None) -> Column:
    """Whether an episode was made with thinking: its flag if that says true or false, else
    the template's, else its mode. All are texts (``kwargs`` JSON)."""
    low = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    out = F.when(low(flag).isin("true", "1", "yes"), True).when(low(flag) == "false", False)
    if kwargs is not None:
        given = F.get_json_object(kwargs, "$.enable_thinking")
        out = out.when(given.isNotNull(), ~F.lower(given).isin("false", "0", "", "null", "[]", "{}"))
    return out.otherwise(low(mode) == "on" if mode is not None else F.lit(False))


def has_traces(messages: Column) -> Column:
    """Whether any message holds a thinking tag."""
    return F.exists(messages, lambda m: F.coalesce(m["content"], F.lit("")).rlike(r"(?i)<think\b|</think>"))


def _renamed(texts: list, names: dict[str, str]) -> list:
    if not names:
        return list(texts)
    any_name = re.compile("|".join(sorted(map(re.escape, names), key=len, reverse=True)))
    spans = lambda t: [s for s in find_identifiers(t) if t[s[0] : s[1]] in names]
    return [t if t is None or not any_name.search(t) else replaced(t, spans(t), names) for t in texts]


@F.pandas_udf(T.ArrayType(T.StringType()))
def pseudonymised(texts: pd.Series, transform: pd.Series, seed: pd.Series) -> pd.Series:
    """Texts of one trajectory with their identifiers renamed by one mapping."""
    out = []
    for some, how, own in zip(texts, transform, seed, strict=True):
        some = list(some)
        whole = "\n".join(t or "" for t in some)
        names = {} if how == "none" else canonical_mapping(whole) if how == "canonicalize" else identifier_mapping(whole, own)
        out.append(_renamed(some, names))
    return pd.Series(out, dtype=object)


def record_seed(seed: Column, key: Column) -> Column:
    """The seed of a record's pseudonyms, as text."""
    return F.substring(F.sha2(F.concat(seed.cast("string"), F.lit("|"), key), 256), 1, 16)


def record_key() -> Column:
    part = lambda c, missing: F.coalesce(F.col(c).cast("string"), missing)
    index = F.coalesce(F.col("source_index").cast("string"), F.lit(""))
    return F.concat(part("source_path", F.lit("")), F.lit("::task="), part("task_id", F.lit("unknown")), F.lit("::sample="), part("sample_id", index), F.lit("::idx="), index)


CARRIED = ("source_path", "source_index", "task_id", "sample_id")


@dataclass
class ProtocolDataset:
    """Training and test rows, rejects with their reasons, the manifest's counts, and how the
    split was made."""

    train: DataFrame
    test: DataFrame
    rejected: DataFrame
    manifest: DataFrame
    split_mode: str


def build(
    episodes: DataFrame, rules: Sequence[tuple[str, Column]], form: str = "trajectory", transform: str = "none", seed: int = 0, count: int = 1, include_original: bool = False, train_tasks: DataFrame | None = None, test_tasks: DataFrame | None = None,
    fraction: float = 0.1, local_hold_out: bool = False, allow_test_tasks: bool = False, need_traces: bool = False, force_thinking: bool = False, most_per_task: int | None = None, carry: Sequence[str] = (),
) -> ProtocolDataset:
    """Accept, vary, expand, split and cap.

    ``rules``: names and conditions that reject, the first that holds counts; ``episodes``
    also has ``enable_thinking`` (boolean). ``form``: a row a trajectory, or one a turn with
    ``history, target``. Tasks go to train or test by lists (then rows of test tasks are refused
    unless allowed, rows of neither are rejected, and with ``local_hold_out`` a share of the
    training rows is held out where there are no test rows) or, without lists, by hash.
    Rows of no accepted episode, or of one side alone, raise."""
    if form not in ("trajectory", "turn"):
        raise ValueError(f"unknown form {form!r}")
    if (train_tasks is None) != (test_tasks is None):
        raise ValueError("train and test tasks are listed both or neither")
    specs = variants(transform, count, include_original)
    reason = F.lit(None).cast("string")
    for name, broken in reversed(list(rules)):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    base = episodes.withColumn("__why", reason).withColumn("task_id", F.coalesce(F.col("task_id").cast("string"), F.lit("")))
    refused = base.where("__why is not null").select(*CARRIED, *carry, F.lit(None).cast("string").alias("id_variant"), F.col("__why").alias("reason"))
    spec = F.array(*[F.struct(F.lit(v.name).alias("name"), F.lit(v.transform).alias("transform"), F.lit(v.index).alias("index")) for v in specs])
    fanned = base.where("__why is null").withColumn("__v", F.explode(spec))
    own = record_seed(F.col("__v.index") + seed, F.concat(record_key(), F.lit("::variant="), F.col("__v.name")))
    texts = pseudonymised(F.transform("messages", lambda m: m["content"]), F.col("__v.transform"), own)
    made = fanned.withColumn("__texts", texts).withColumn("messages", F.zip_with("messages", "__texts", lambda m, t: m.withField("content", t)))
    kept = list(dict.fromkeys([*CARRIED, *carry, "enable_thinking", "messages", "__v"]))
    made = stable(made.select(*kept), "protocol-trajectories")  # names are drawn once, a few trajectories at a time
    traces = has_traces(F.col("messages"))
    thinking = F.coalesce(F.col("enable_thinking"), F.lit(False))
    mode = F.when(F.lit(need_traces) & traces, "source_thinking_traces").when(F.lit(force_thinking), "template_override_only").when(thinking, "source_thinking_metadata").otherwise("non_thinking")
    made = made.select(
        *CARRIED, *carry, "messages", F.col("__v.name").alias("id_variant"), F.col("__v.transform").alias("id_transform"), thinking.alias("source_enable_thinking"), traces.alias("contains_reasoning_traces"),
        (F.lit(force_thinking) | traces | thinking).alias("enable_thinking"), mode.alias("thinking_supervision_mode"),
    )
    reject = lambda df, why: df.select(*CARRIED, *carry, "id_variant", F.lit(why).alias("reason"))
    if need_traces:
        refused = refused.unionByName(reject(made.where(~F.col("contains_reasoning_traces")), "missing_thinking_traces"))
        made = made.where("contains_reasoning_traces")
    if form == "turn":
        keyed = made.withColumn("__row", F.struct(*CARRIED, "id_variant"))
        expanded = expand_turns(keyed.select("__row", "messages"), "__row")
        # the target's own thinking stays with it; a message that says and calls nothing is none
        said = (F.trim(F.coalesce("target.content", F.lit(""))) != "") | (F.coalesce(F.size("target.tools"), F.lit(0)) > 0)
        expanded = expanded.where(said)
        without = keyed.join(expanded.select("__row").distinct(), "__row", "left_anti")
        refused = refused.unionByName(reject(without, "no_turns"))
        made = keyed.drop("messages").join(expanded, "__row").drop("__row")
    else:
        made = made.withColumns({"assistant_turn_index": F.lit(None).cast("long"), "source_message_index": F.lit(None).cast("long")})
    made = made.withColumn("row_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_path", "source_index", "sample_id", "id_variant", "assistant_turn_index")]))
    made = stable(made, "protocol-rows") if form == "turn" else made  # read by every part below
    train, test, refused, how = _split(made, refused, reject, train_tasks, test_tasks, fraction, seed, local_hold_out, allow_test_tasks)
    if most_per_task is not None:
        train, test = (curation.cap_by_hash(x, most_per_task, seed, ["task_id"]) for x in (train, test))
    return ProtocolDataset(train, test, refused, _manifest(made, train, test, refused), how)


def _split(made, refused, reject, train_tasks, test_tasks, fraction, seed, local_hold_out, allow_test_tasks):
    if made.isEmpty():
        raise ValueError("no episode was accepted")
    if train_tasks is None:
        sides = curation.task_partition(made, fraction, seed)
        marked = made.join(sides, "task_id")
        train, test, how = marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test"), "hashed_task_id"
    else:
        train, test, neither = curation.split_by_manifest(made, train_tasks, test_tasks)
        how = "manifest"
        if not test.isEmpty() and not allow_test_tasks:
            raise ValueError("rows of test tasks are not used for validation")
        refused = refused.unionByName(reject(neither, "not_in_split"))
        if local_hold_out and test.isEmpty() and not train.isEmpty():
            held = curation.hold_out(train, fraction, seed)
            train, test, how = held.where("not is_test").drop("is_test"), held.where("is_test").drop("is_test"), "manifest_local_hold_out"
    if train.isEmpty() or test.isEmpty():
        raise ValueError("one side of the split is empty")
    return train, test, refused, how


def _manifest(made, train, test, refused) -> DataFrame:
    """``name, key, rows``: counts of the tables (no key) and, a row each, by task, by way of
    supervision and by reason. Tasks may be many, so nothing is gathered."""
    tables = {"accepted": made, "train": train, "test": test, "rejected": refused}
    of = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "key", "rows")
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"{name}_rows").alias("name"), F.lit(None).cast("string").alias("key"), "rows") for name, df in tables.items()]
    parts += [of(df, f"{name}_per_task", F.col("task_id")) for name, df in tables.items() if name != "rejected"]
    flags = {"with_source_thinking": "source_enable_thinking", "with_traces": "contains_reasoning_traces"}
    parts += [made.agg(F.count_if(c).alias("rows")).select(F.lit(name).alias("name"), F.lit(None).cast("string").alias("key"), "rows") for name, c in flags.items()]
    parts += [of(made, "thinking_modes", F.col("thinking_supervision_mode")), of(refused, "rejected_reasons", F.col("reason"))]
    return reduce(DataFrame.unionByName, parts)


def write(made: ProtocolDataset, path: str) -> None:
    """Train and test as Parquet, rejects and the manifest as JSON lines, below ``path``."""
    root = path.rstrip("/")
    made.train.write.parquet(f"{root}/train")
    made.test.write.parquet(f"{root}/test")
    made.rejected.write.json(f"{root}/rejected")
    made.manifest.coalesce(1).write.json(f"{root}/manifest")


def stable_seed(seed: int, key: str) -> str:
    """What ``record_seed`` gives, for one record."""
    return hashlib.sha256(f"{seed}|{key}".encode()).hexdigest()[:16]

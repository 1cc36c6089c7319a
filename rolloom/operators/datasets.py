"""Preparing datasets: maps from raw rows to prompt, preference and message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch import number_rows


def prompts(rows: DataFrame, source: str, question: Column, truth: Column, ability: str = "math", style: str = "rule", split: str = "train", tool: str | None = None) -> DataFrame:
    """Rows with ``data_source, prompt, ability, reward_model, extra_info`` beside their own.

    With ``tool`` each row carries what creates that tool for it."""
    kwargs = F.to_json(F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool))) if tool else F.lit("{}")
    return rows.withColumns(
        {
            "data_source": F.lit(source),
            "prompt": F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))),
            "ability": F.lit(ability),
            "reward_model": F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")),
            "extra_info": F.struct(F.lit(split).alias("split"), F.monotonically_increasing_id().alias("index"), F.lit(tool is not None).alias("need_tools_kwargs"), kwargs.alias("tools_kwargs")),
        }
    )


def after_mark(text: Column) -> Column:
    """The number after "####", without thousands separators."""
    return F.regexp_replace(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), ",", "")


def clean_choice_text(text: Column) -> Column:
    """Without title marks and bracketed notes, single blanks."""
    out = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def choices(rows: DataFrame, context: Column, endings: Column, label: Column) -> DataFrame:
    """Multiple choice rows with a label: ``query, choices, gold``."""
    return rows.where(F.coalesce(label.cast("string"), F.lit("")) != "").select("*", clean_choice_text(context).alias("query"), F.transform(endings, clean_choice_text).alias("choices"), label.cast("int").alias("gold"))


def preference_rows(rows: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two rows for each pair: ``side, response``."""
    both = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("response")) for c in (chosen, rejected)])
    return rows.withColumn("__p", F.explode(both)).drop(chosen, rejected).select("*", "__p.*").drop("__p")


def positional_split(rows: DataFrame, share: float, *order: str) -> DataFrame:
    """Add ``split``: train for the first ``share`` of the rows in order."""
    numbered = number_rows(rows, *order)
    n = rows.count()
    return numbered.withColumn("split", F.when(F.col("row_id") < int(n * share), "train").otherwise("test"))


def hashed_split(rows: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """Add ``split``: train for about ``share`` of the keys."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("split", F.when(u < share, "train").otherwise("test"))


def answered(rows: DataFrame, question: Column, answer: Column, system: str | None = None) -> DataFrame:
    """Add ``messages``: a question and its answer."""
    said = [("user", question), ("assistant", answer)]
    parts = ([("system", F.lit(system))] if system else []) + said
    return rows.withColumn("messages", F.array(*[F.struct(F.lit(r).alias("role"), c.cast("string").alias("content")) for r, c in parts]))


def renamed_roles(messages: Column, names: dict[str, str]) -> Column:
    """Messages with other names of roles; an unknown one stays."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(messages, lambda m: m.withField("role", F.coalesce(F.try_element_at(table, m["role"]), m["role"])))


def pretokenized(rows: DataFrame, most: int, side: str = "right", ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """Checked and cut token rows: equal lengths, a mask of 0 and 1, the first token never
    counted; a row that breaks this or has nothing left to learn raises when read."""
    from ..functions.tokens import truncate

    fit = (F.size(ids) == F.size(mask)) & F.forall(mask, lambda m: m.isin(0, 1))
    out = rows.withColumns({ids: truncate(F.col(ids), most, side), mask: truncate(F.col(mask), most, side), "__fit": fit})
    out = out.withColumn(mask, F.transform(mask, lambda m, i: F.when(i == 0, 0).otherwise(m)))
    good = F.col("__fit") & F.exists(mask, lambda m: m == 1)
    return out.withColumn(mask, F.when(good, F.col(mask)).otherwise(F.raise_error(F.lit("a row without a valid, non-empty mask")))).drop("__fit")


def reward_pairs(rows: DataFrame, length: int, filler: int, prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids") -> DataFrame:
    """``input_ids, attention_mask``: both answers after the prompt, padded or cut to length."""
    from ..functions.tokens import pad

    def one(answer: str) -> tuple[Column, Column]:
        tokens = F.slice(F.concat(prompt, answer), 1, length)
        return pad(tokens, length, filler), pad(F.transform(tokens, lambda x: F.lit(1)), length, 0)

    (a, ma), (b, mb) = one(chosen), one(rejected)
    return rows.withColumns({"input_ids": F.array(a, b), "attention_mask": F.array(ma, mb)})

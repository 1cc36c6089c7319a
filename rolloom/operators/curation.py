"""Building a dataset: splits that don't leak, caps, deduplication, stratified choice.

Random order is a salted hash of a row's key throughout, so every choice is the same on
any cluster; keys are ranked by windows over groups, never over the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import number_rows


def digest(seed: int, salt: str, *keys: Column | str) -> Column:
    """sha256 of seed, salt and keys (null: empty), as hex."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *parts), 256)


def task_number(task: Column) -> Column:
    """The digits that a task id ends with; the trimmed id without any; null: empty."""
    text = F.trim(F.coalesce(task.cast("string"), F.lit("")))
    digits = F.regexp_extract(text, r"(\d+)\z", 1)
    return F.when(digits != "", digits).otherwise(text)


def task_partition(rows: DataFrame, fraction: float, seed: int, task: str = "task_id") -> DataFrame:
    """``task, is_test``: the first tasks in the order of their hashes, a half-even rounded
    share of them, one at least and not all. Tasks are few; rows stay where they are."""
    tasks = rows.select(F.col(task).alias("__task")).distinct().withColumn("__hash", F.substring(F.sha2(F.concat(F.lit(f"{seed}/"), "__task"), 256), 1, 16))
    tasks = number_rows(tasks, "__hash", "__task")
    count = tasks.agg(F.count("*").alias("__n"))  # one row
    held = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.bround(F.col("__n") * F.lit(float(fraction))).cast("long")))
    return tasks.join(F.broadcast(count)).select(F.col("__task").alias(task), (F.col("row_id") < held).alias("is_test"))


def hold_out(rows: DataFrame, fraction: float, seed: int, task: str = "task_id", row: str = "row_id") -> DataFrame:
    """Add ``is_test``: by task where there are two or more, else by row."""
    several = rows.select(task).distinct().limit(2).count() > 1
    key = task if several else row
    return rows.join(task_partition(rows.withColumn(key, F.col(key).cast("string")), fraction, seed, key), key)


def split_by_manifest(rows: DataFrame, train: DataFrame, test: DataFrame, task: str = "task_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of train tasks, of test tasks, and of neither. Overlapping lists raise."""
    if not train.select(task).intersect(test.select(task)).isEmpty():
        raise ValueError("a task is in both lists")
    left = rows.join(train, task, "left_semi"), rows.join(test, task, "left_semi")
    return *left, rows.join(train, task, "left_anti").join(test, task, "left_anti")


def cap_by_hash(rows: DataFrame, most: int, seed: int, keys: Sequence[str], row: str = "row_id") -> DataFrame:
    """The first ``most`` rows of each group in hash order."""
    w = Window.partitionBy(*keys).orderBy(digest(seed, "cap", *keys, row), row)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def cap_variants(rows: DataFrame, most: int, seed: int, turn: Sequence[str], variant: str = "id_variant", row: str = "row_id") -> DataFrame:
    """As ``cap_by_hash`` for the variants of a turn, the original one first."""
    first = (F.lower(F.coalesce(variant, F.lit(""))) != "original").cast("int")
    w = Window.partitionBy(*turn).orderBy(first, digest(seed, "variant_rank", *turn, variant, row), row)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def keep_first(rows: DataFrame, keys: Sequence[Column | str], row: str = "row_id") -> DataFrame:
    """One row for each hash of the keys: the one that came first."""
    hashed = F.sha2(F.to_json(F.struct(*keys)), 256)
    w = Window.partitionBy("__h").orderBy(row)
    return rows.withColumn("__h", hashed).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__h", "__k")


def round_robin(rows: DataFrame, most: int, seed: int, task: str = "task_id", stratum: str = "stratum", row: str = "row_id") -> DataFrame:
    """``most`` rows of each task, one stratum after another: first of each stratum, then
    second of each, and so on, in hash order within a stratum. ``pick`` numbers them."""
    inside = Window.partitionBy(task, stratum).orderBy(digest(seed, "stratum", stratum, row), row)
    turn = Window.partitionBy(task).orderBy("__turn", stratum)
    out = rows.withColumn("__turn", F.row_number().over(inside)).withColumn("pick", F.row_number().over(turn))
    return out.where(F.col("pick") <= most).drop("__turn")


def validation_trajectories(rows: DataFrame, train_rows: int, val_rows: int, seed: int, task: str = "task_id", trajectory: str = "trajectory") -> DataFrame:
    """Add ``split``: whole trajectories go to validation in hash order, those that would
    leave too few for training skipped, until there are ``val_rows``; of the rest the
    first ``train_rows`` by hash stay. The choice depends on what was chosen before, so one
    task's trajectories (a hash and a number each) are walked once, in order."""
    sizes = rows.groupBy(task, trajectory).agg(F.count(F.lit(1)).alias("n")).withColumn("h", digest(seed, "trajectory_split", trajectory))
    kinds = dict(rows.dtypes)

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), (trajectory, "ascending")])
        total, taken, chosen = sum(group["n"].to_pylist()), 0, []
        for n in group["n"].to_pylist():
            fits = total > train_rows and taken < val_rows and total - (taken + n) >= train_rows
            taken += n if fits else 0
            chosen.append(fits)
        return pa.table({task: group[task], trajectory: group[trajectory], "__held": pa.array(chosen)})

    held = sizes.groupBy(task).applyInArrow(choose, f"{task} {kinds[task]}, {trajectory} {kinds[trajectory]}, __held boolean").where("__held")
    same = rows[task].eqNullSafe(F.col("__t")) & rows[trajectory].eqNullSafe(F.col("__j"))
    out = rows.join(held.select(F.col(task).alias("__t"), F.col(trajectory).alias("__j"), "__held"), same, "left")
    out = out.withColumn("split", F.when(F.col("__held"), "test").otherwise("train")).drop("__held", "__t", "__j")
    w = Window.partitionBy(task, "split").orderBy(digest(seed, "split", task, trajectory, "row_id"), "row_id")
    return out.withColumn("__k", F.row_number().over(w)).where((F.col("split") == "test") | (F.col("__k") <= train_rows)).drop("__k")


def target_profile(rows: DataFrame, content: str = "content", tools: str = "tools", thinking: str = "thinking", turn: str = "assistant_turn_index") -> DataFrame:
    """Add ``target_kind, target_tool, turn_bucket, has_thinking, stratum``."""
    text, calls = F.trim(F.coalesce(content, F.lit(""))) != "", F.coalesce(F.size(tools), F.lit(0)) > 0
    t = F.coalesce(turn, F.lit(-1))
    out = rows.withColumns(
        {
            "target_kind": F.when(calls & text, "tool_call_with_text").when(calls, "tool_call").when(text, "final_or_clarify_text").otherwise("empty_text"),
            "target_tool": F.when(calls, F.get(tools, F.lit(0))).otherwise("no_tool"),
            "turn_bucket": F.when(t < 0, "unknown").when(t <= 1, "early").when(t <= 5, "middle").otherwise("late"),
            "has_thinking": F.trim(F.coalesce(thinking, F.lit(""))) != "",
        }
    )
    return out.withColumn("stratum", F.concat_ws("|", "target_kind", "target_tool", "turn_bucket"))


def drop_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows each filter of the chain drops, and ``kept``."""
    passed, told = F.lit(True), []
    for name, keep in rules.items():
        told.append(F.count_if(passed & ~F.coalesce(keep, F.lit(False))).alias(name))
        passed = passed & F.coalesce(keep, F.lit(False))
    return rows.agg(*told, F.count_if(passed).alias("kept"))


def lookup_in_order(rows: DataFrame, ids: Sequence[str], key: str = "task_id") -> DataFrame:
    """Rows of the listed ids in list order (``pos``); a missing one raises."""
    want = rows.sparkSession.createDataFrame([(p, i) for p, i in enumerate(ids)], f"pos int, {key} string")
    out = F.broadcast(want).join(rows.withColumn("__there", F.lit(True)), key, "left")
    return out.withColumn("pos", F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no such id: "), key))).otherwise(F.col("pos"))).drop("__there")


def peer_solutions(samples: DataFrame, threshold: float, uid: str = "uid", score: str = "score", text: str = "response", row: str = "row_id") -> DataFrame:
    """Add ``peer``: the text of the earliest other sample of the group that reached the
    threshold. The two earliest of a group are enough to leave out oneself."""
    good = samples.where(F.col(score) >= threshold).select(uid, F.struct(row, text).alias("__g"))
    least = good.groupBy(uid).agg(F.min("__g").alias("__first"))
    # the second by the same minimum over the others, so no task holds a group's texts
    others = good.join(least, uid).where(F.col(f"__g.{row}") != F.col(f"__first.{row}")).groupBy(uid).agg(F.min("__g").alias("__second"))
    out = samples.join(least, uid, "left").join(others, uid, "left")
    peer = F.when(F.col(f"__first.{row}") != F.col(row), F.col(f"__first.{text}")).otherwise(F.col(f"__second.{text}"))
    return out.withColumn("peer", peer).drop("__first", "__second")

"""Roll-ups of metrics: by name, over ranks, of a batch, of validation samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .losses import mean_over_mask


def reduce_by_name(log: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """``name, value``: a name with "max" in it takes the largest value, else one with "min"
    the smallest, any other the mean."""
    n = F.col(name)
    pick = F.when(n.contains("max"), F.max(value)).when(n.contains("min"), F.min(value)).otherwise(F.avg(value))
    return log.groupBy(name).agg(pick.alias("value"))


def aggregate_metrics(log: DataFrame) -> DataFrame:
    """``name, value`` from ``name, agg, value``: agg is mean, sum, min or max."""
    a = F.col("agg")
    return log.groupBy("name", "agg").agg(F.when(a == "sum", F.sum("value")).when(a == "min", F.min("value")).when(a == "max", F.max("value")).otherwise(F.avg("value")).alias("value")).select("name", "value")


def aggregate_over_ranks(log: DataFrame) -> DataFrame:
    """``name, value`` from ``rank, slot, name, agg, value``. Sums and means first take the
    mean over ranks in each slot; extremes go over all. Every rank must have each slot."""
    slots = log.groupBy("name", "agg", "slot").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    a = F.col("agg")
    value = F.when(a == "sum", F.sum("m")).when(a == "mean", F.avg("m")).when(a == "min", F.min("lo")).otherwise(F.max("hi"))
    even = F.when(F.min("n") != F.max("n"), F.raise_error(F.lit("ranks have different numbers of values"))).otherwise(value)
    return slots.groupBy("name", "agg").agg(even.alias("value")).select("name", "value")


#: Keywords of a metric's name (lower case), tested in this order, and how such a metric
#: is rolled up; fixed. "weighted_avg" holds "avg", so it never comes to its own rule.
KEYWORDS = (("timing_s/", "sum"), ("mean", "avg"), ("avg", "avg"), ("average", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"), ("weighted_avg", "weighted_avg"))
#: Metrics with a rule of their own; fixed.
NAMED = {
    "perf/time_per_step": "sum",
    "timing_s/agent_loop/tool_calls/min": "min",
    "timing_s/agent_loop/tool_calls/mean": "avg",
    "timing_s/agent_loop/tool_calls/max": "max",
    "fully_async/count/total_generated_samples": "last",
    "fully_async/count/stale_samples_processed": "last",
    "fully_async/count/stale_trajectory_processed": "last",
    "fully_async/count/current_param_version": "last",
    "fully_async/count/dropped_stale_samples": "last",
    "training/global_step": "last",
}


def roll_up_kind(name: Column, rules: dict[str, str] | None = None) -> Column:
    kind = None
    for known, how in (NAMED | (rules or {})).items():
        kind = F.when(name == known, how) if kind is None else kind.when(name == known, how)
    for key, how in KEYWORDS:
        kind = kind.when(F.lower(name).contains(key), how)
    return kind.otherwise("avg")


def roll_up(log: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """``name, value`` from ``seq, name, value, samples``: last, weighted_avg (by samples),
    sum, avg, max or min, by rule or by keyword."""
    typed = log.withColumn("kind", roll_up_kind(F.col("name"), rules))
    k = F.col("kind")
    value = (
        F.when(k == "last", F.max_by("value", "seq")).when(k == "weighted_avg", F.sum(F.col("value") * F.col("samples")) / F.sum("samples")).when(k == "sum", F.sum("value")).when(k == "max", F.max("value")).when(k == "min", F.min("value")).otherwise(F.avg("value"))
    )
    return typed.groupBy("name", "kind").agg(value.alias("value")).select("name", "value")


def batch_metrics(samples: DataFrame, tokens: DataFrame, critic: bool = True, most_response: int | None = None, most_prompt: int | None = None) -> DataFrame:
    """One row of statistics. ``samples``: ``row_id, score, reward, prompt_length,
    response_length``; ``tokens``: ``mask, advantage, returns`` and with critic ``value``.

    Samples without a response don't count for score and reward."""
    there = F.col("response_length") > 0
    three = lambda c, when, to: [F.avg(F.when(when, F.col(c))).alias(f"{to}_mean"), F.max(F.when(when, F.col(c))).alias(f"{to}_max"), F.min(F.when(when, F.col(c))).alias(f"{to}_min")]
    always = F.lit(True)
    longest, widest = (F.lit(x) if x is not None else F.max(c) for x, c in ((most_response, "response_length"), (most_prompt, "prompt_length")))
    top = samples.agg(longest.alias("__r"), widest.alias("__p"))  # one row
    rows = samples.join(F.broadcast(top)).agg(
        *three("score", there, "score"), *three("reward", there, "reward"), *three("response_length", always, "response_length"), *three("response_length", there, "response_length_non_aborted"),
        *three("prompt_length", always, "prompt_length"), F.avg((F.col("response_length") == F.col("__r")).cast("double")).alias("response_length_clip_ratio"),
        F.avg((F.col("prompt_length") == F.col("__p")).cast("double")).alias("prompt_length_clip_ratio"), F.avg((~there).cast("double")).alias("aborted_ratio"),
    )
    inside = F.col("mask") != 0
    told = [*three("advantage", inside, "advantage"), *three("returns", inside, "returns")]
    if critic:
        told += [*three("value", inside, "value"), (1 - F.var_samp(F.when(inside, F.col("returns") - F.col("value"))) / (F.var_samp(F.when(inside, F.col("returns"))) + 1e-5)).alias("vf_explained_var")]
    return rows.join(F.broadcast(tokens.agg(*told)))


def timing_metrics(samples: DataFrame, timing: DataFrame, devices: int = 1) -> DataFrame:
    """``name, seconds, ms_per_token`` from timings ``name, seconds``: generation is set
    against response tokens, the rest against all; ``tokens_per_second`` for a step."""
    total = samples.agg(F.sum("response_length").alias("r"), F.sum(F.col("prompt_length") + F.col("response_length")).alias("a"))  # one row
    each = timing.groupBy("name").agg(F.sum("seconds").alias("seconds")).join(F.broadcast(total))
    base = F.when(F.col("name") == "gen", F.col("r")).otherwise(F.col("a"))
    rate = F.when(F.col("name") == "step", F.col("a") / (F.col("seconds") * devices))
    return each.select("name", "seconds", (F.col("seconds") * 1000 / base).alias("ms_per_token"), rate.alias("tokens_per_second"))


def reduce_timing(timing: DataFrame, k: float = 10.0) -> DataFrame:
    """``name, mean, lo, hi, share_high`` over ranks (share above the (1 - k/100) quantile)."""
    cut = timing.groupBy("name").agg(F.percentile("seconds", F.lit(1 - k / 100)).alias("cut"))
    return timing.join(cut, "name").groupBy("name").agg(F.avg("seconds").alias("mean"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi"), F.avg((F.col("seconds") > F.col("cut")).cast("double")).alias("share_high"))


def variance_proxies(tokens: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """One row: power of the gradient from ``logp, sum_pi2, advantage``, its noise given
    the norm of the mean gradient, and the parts."""
    energy = 1 - 2 * F.exp("logp") + F.col("sum_pi2")
    rows = tokens.groupBy("row_id").agg(F.coalesce(F.sum(F.when(F.col("mask") != 0, energy)), F.lit(0.0)).alias("w"), mean_over_mask(F.col("advantage")).alias("a"))
    signal = gradient_norm**2 if gradient_norm is not None else None
    out = rows.agg(F.avg(F.col("a") * F.col("a") * F.greatest("w", F.lit(0.0))).alias("total_power"), F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"), F.count(F.lit(1)).alias("n"))
    noise = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("total_power") - (signal or 0.0)) / (F.col("n") - 1))).otherwise(0.0) if signal is not None else F.lit(0.0)
    return out.withColumn("signal_strength", F.lit(float(signal or 0.0))).withColumn("pure_noise", noise).drop("n")


def agreement(tokens: DataFrame, a: str = "logp", b: str = "rollout_logp") -> DataFrame:
    """One row on how two log-probabilities differ as probabilities, over masked tokens."""
    inside = tokens.where("mask <> 0").select(F.exp(a).alias("x"), F.exp(b).alias("y"))
    d = F.abs(F.col("x") - F.col("y"))
    return inside.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr("x", "y").alias("pearson"))


def majority(df: DataFrame, keys: Sequence[str], vote: str = "pred", value: str = "score", order: str = "pos") -> DataFrame:
    """``keys, value``: the first value of the most frequent vote; of equally frequent
    ones, of that seen first."""
    counted = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("v"))
    return counted.groupBy(*keys).agg(F.max_by("v", F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def sizes_for(n: int) -> list[int]:
    """2, 4, 8, ... below n, and n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


#: About how many drawn values a task holds at once (one prompt's at least).
MOST_DRAWN = 1 << 20


def validation_metrics(samples: DataFrame, source: str = "data_source", uid: str = "uid", pos: str = "pos", value: str = "score", vote: str | None = None, draws: int = 1000, seed: int = 42, hashed: bool = False) -> DataFrame:
    """``data_source, metric, value``: mean@n and std@n of each prompt's answers, and mean
    and deviation of the best, the worst and the majority's value of k of them, from
    ``draws`` seeded bootstrap draws; then the mean over prompts.

    Draws depend on (n, k, seed) alone, so each task makes the index tables it needs once;
    ``hashed`` takes them from hashes of (seed, n, k, draw, place), on which other engines
    agree, in place of the random generator. Majorities are found from the counts of votes;
    of equally frequent votes, that drawn first. Prompts of as many answers are drawn
    together; a figure that is undefined is left out of the mean."""
    item = F.struct(pos, F.col(value).cast("double").alias("v"), (F.col(vote) if vote else F.lit(None)).cast("string").alias("p"))
    groups = samples.groupBy(source, uid).agg(F.array_sort(F.collect_list(item)).alias("items")).select(source, "items.v", "items.p")
    schema = T.StructType([T.StructField(source, samples.schema[source].dataType), T.StructField("metric", T.StringType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}

        def table(n: int, k: int) -> np.ndarray:
            if (n, k) not in tables:
                if hashed:
                    drawn = [int(hashlib.md5(f"{seed}/{n}/{k}/{d}/{j}".encode()).hexdigest()[:8], 16) % n for d in range(draws) for j in range(k)]
                    tables[n, k] = np.array(drawn).reshape(draws, k)
                else:
                    tables[n, k] = np.random.RandomState(seed).choice(n, size=(draws, k), replace=True)
            return tables[n, k]

        def most(votes: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            many, n = votes.shape
            kinds = (votes[:, :, None] == votes[:, None, :]).argmax(axis=2)  # a vote is known by its first place
            at = np.arange(many * draws).reshape(many, draws, 1) * n + kinds[:, rows]
            first = np.bincount(at.ravel(), minlength=many * draws * n)[at].argmax(axis=2)
            return values[np.arange(many)[:, None], rows[np.arange(draws), first]]

        def figures(v: np.ndarray, votes: np.ndarray | None) -> Iterator[tuple[str, np.ndarray]]:
            """Each figure of all prompts with ``n`` answers (rows of ``v``)."""
            n = v.shape[1]
            yield f"mean@{n}", v.mean(axis=1)
            if n == 1:
                return
            yield f"std@{n}", v.std(axis=1)
            for k in sizes_for(n):
                rows, told = table(n, k), {}
                step = max(1, MOST_DRAWN // max(draws * n, n * n))
                for i in range(0, len(v), step):
                    some = v[i : i + step]
                    drawn = some[:, rows]
                    sets = {"best": drawn.max(axis=2), "worst": drawn.min(axis=2)}
                    if votes is not None:
                        sets["maj"] = most(votes[i : i + step], rows, some)
                    for name, x in sets.items():
                        told.setdefault(f"{name}@{k}/mean", []).append(x.mean(axis=1))
                        told.setdefault(f"{name}@{k}/std", []).append(x.std(axis=1))
                yield from ((name, np.concatenate(x)) for name, x in told.items())

        for batch in batches:
            origin = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, size = origin.indices.to_numpy(), len(origin.dictionary)
            counts = batch.column(1).value_lengths().to_numpy()
            starts, values = np.cumsum(counts) - counts, batch.column(1).flatten().to_numpy(zero_copy_only=False)
            votes = batch.column(2).flatten().fill_null("None").dictionary_encode().indices.to_numpy() if vote else None
            out: dict[str, list] = {f.name: [] for f in arrow}
            for n in np.unique(counts):
                own = np.flatnonzero(counts == n)
                at = starts[own][:, None] + np.arange(n)
                for metric, x in figures(values[at], votes[at] if vote else None):
                    known = ~np.isnan(x)
                    there = np.unique(codes[own])
                    totals = np.bincount(codes[own][known], x[known], minlength=size)[there]
                    out[source] += origin.dictionary.take(pa.array(there)).to_pylist()
                    out["metric"] += [metric] * len(there)
                    out["total"] += totals.tolist()
                    out["n"] += np.bincount(codes[own][known], minlength=size)[there].tolist()
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    each = groups.mapInArrow(summarise, schema)
    return each.groupBy(source, "metric").agg(F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).alias("value"))


def core_or_aux(metrics: DataFrame, source: str = "data_source") -> DataFrame:
    """Label ``core`` the mean, majority and best figures over the most samples, else aux."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    largest = F.max(n).over(Window.partitionBy(source))
    core = (n == largest) & F.regexp_extract("metric", "^([a-z]+)@", 1).isin("mean", "maj", "best") & ~F.col("metric").endswith("/std")
    return metrics.withColumn("section", F.when(core, "core").otherwise("aux"))


def distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean and linearly interpolated p50, p90, p95, p99, and the largest."""
    ps = (0.5, 0.9, 0.95, 0.99)
    agg = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.percentile(value, [float(p) for p in ps]).alias("q"), F.max(value).alias("max"))
    return agg.select(*keys, "count", "mean", *[F.get("q", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)], "max")


def slowest(samples: DataFrame, timings: Sequence[str], carry: Sequence[str] = (), order: str = "row_id") -> DataFrame:
    """One row: extremes and mean of each timing, and the sample with the largest sum (the
    first of several)."""
    total = sum((F.col(t) for t in timings[1:]), F.col(timings[0]))
    told = [a for t in timings for a in (F.min(t).alias(f"{t}_min"), F.max(t).alias(f"{t}_max"), F.avg(t).alias(f"{t}_mean"))]
    worst = F.max_by(F.struct(order, *timings, *carry), F.struct(total, -F.col(order))).alias("slowest")
    return samples.agg(*told, worst)


def mixed_groups(df: DataFrame, uid: str = "uid", metric: str = "acc") -> DataFrame:
    """Rows of groups whose metric differs within the group."""
    w = Window.partitionBy(uid)
    return df.withColumn("__lo", F.min(metric).over(w)).withColumn("__hi", F.max(metric).over(w)).where("__lo < __hi").drop("__lo", "__hi")

"""Advantage estimators.

Outcome estimators work on samples: one row each, with a group ``uid``, a ``score`` and
where needed the number ``n`` of its response tokens; they add a scalar ``advantage``
that holds for all of them, at the cost of one shuffle by group. ``over_tokens`` spreads
it. Estimators along tokens work on arrays (no shuffle) or, where they compare samples
position by position, on a long table ``row_id, uid, t, mask, ...``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.divergence import kl as divergence
from .groupwise import group_stats

ESTIMATORS: dict[str, Callable] = {}


def estimator(name: str):
    """Register an estimator; a name can't be given to a second function."""

    def add(fn: Callable) -> Callable:
        if ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"estimator {name!r} is registered already")
        ESTIMATORS[name] = fn
        return fn

    return add


def get_estimator(name: str) -> Callable:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def over_tokens(df: DataFrame, mask: str = "response_mask", advantage: str = "advantage", to: str = "advantages") -> DataFrame:
    return df.withColumn(to, F.transform(mask, lambda m: m * F.col(advantage)))


def _with(df: DataFrame, column: Column, *extra: str) -> DataFrame:
    return df.withColumn("advantage", column).drop("g_n", "g_mean", "g_std", *extra)


@estimator("grpo")
def grpo(df: DataFrame, score: str = "score", uid: str = "uid", epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(score - group mean) / (group deviation + epsilon); alone: the score itself, scaled."""
    gap = F.col(score) - F.col("g_mean")
    return _with(group_stats(df, score, uid, None), gap / (F.col("g_std") + epsilon) if by_std else gap)


@estimator("grpo_vectorized")
def grpo_floor(df: DataFrame, score: str = "score", uid: str = "uid", epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """As ``grpo``, with the group variance at least epsilon."""
    gap = F.col(score) - F.col("g_mean")
    return _with(group_stats(df, score, uid, epsilon), gap / (F.col("g_std") + epsilon) if by_std else gap)


@estimator("grpo_passk")
def best_of_k(df: DataFrame, score: str = "score", uid: str = "uid", order: str = "row_id", epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """The best sample of a group gets its lead over the second, the others nothing.
    Groups of one raise."""
    w = Window.partitionBy(uid)
    down = w.orderBy(F.desc(score), order)
    out = df.withColumns({"__rank": F.row_number().over(down), "__second": F.lead(score).over(down), "__n": F.count(F.lit(1)).over(w), "__std": F.stddev_samp(score).over(w)})
    lead = F.col(score) - F.col("__second")
    lead = lead / (F.col("__std") + epsilon) if by_std else lead
    value = F.when(F.col("__n") < 2, F.raise_error(F.lit("a group needs two samples"))).when(F.col("__rank") == 1, lead).otherwise(0.0)
    return out.withColumn("advantage", value).drop("__rank", "__second", "__n", "__std")


def _moments(mean: DataFrame, deviations: DataFrame) -> DataFrame:
    """One row ``__mean, __var``: squares are taken from the mean in a second pass, as the
    difference of sums cancels where means are large."""
    var = F.col("square") / (F.col("c") + 1e-8) * F.col("c") / (F.col("c") - 1)
    return mean.crossJoin(deviations).select("__mean", var.alias("__var"))  # a row each


def whiten_samples(df: DataFrame, value: str = "advantage", n: str = "n") -> DataFrame:
    """Whiten a value that all ``n`` tokens of a sample share, over all tokens."""
    v, k = F.col(value), F.col(n)
    mean = df.agg((F.sum(v * k) / (F.sum(k) + 1e-8)).alias("__mean"), F.sum(k).alias("c"))
    square = df.select(value, n).join(F.broadcast(mean.select("__mean"))).agg(F.sum(F.pow(v - F.col("__mean"), 2) * k).alias("square"))
    return df.join(F.broadcast(_moments(mean, square))).withColumn(value, (v - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)).drop("__mean", "__var")


@estimator("gdpo")
def gdpo(df: DataFrame, scores: Sequence[str] = ("score",), weights: Sequence[float] | None = None, uid: str = "uid", n: str = "n", epsilon: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Each reward is normalised within its group by itself; the weighted sum is whitened."""
    weights = list(weights or [1.0] * len(scores))
    out, terms = df, []
    for i, (s, w) in enumerate(zip(scores, weights, strict=True)):
        out = grpo(out, s, uid, epsilon, by_std).withColumnRenamed("advantage", f"__a{i}")
        terms.append(F.col(f"__a{i}") * w)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return whiten_samples(out.withColumn("advantage", total).drop(*[f"__a{i}" for i in range(len(terms))]), n=n)


@estimator("reinforce_plus_plus_baseline")
def centred_whitened(df: DataFrame, score: str = "score", uid: str = "uid", n: str = "n") -> DataFrame:
    """Score less group mean (0 for a group of one), whitened over all tokens."""
    return whiten_samples(_with(group_stats(df, score, uid, None), F.col(score) - F.col("g_mean")), n=n)


@estimator("rloo")
def leave_one_out(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """Score less the mean of the others; a group of one keeps its score."""
    n = F.col("g_n")
    return _with(group_stats(df, score, uid, None), F.when(n > 1, n / (n - 1) * (F.col(score) - F.col("g_mean"))).otherwise(F.col(score)))


@estimator("rloo_vectorized")
def leave_one_out_or_zero(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """As ``rloo``, but a group of one gets 0."""
    w = Window.partitionBy(uid)
    n = F.count(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col(score) - F.sum(score).over(w)) / (n - 1)).otherwise(0.0))


@estimator("opo")
def length_weighted(df: DataFrame, score: str = "score", uid: str = "uid", n: str = "n") -> DataFrame:
    """Score less the group mean weighted by response length; a group of one has baseline 0."""
    w = Window.partitionBy(uid)
    base = F.sum(F.col(n) * F.col(score)).over(w) / F.sum(n).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count(F.lit(1)).over(w) > 1, base).otherwise(0.0))


@estimator("gpg")
def gpg(df: DataFrame, score: str = "score", uid: str = "uid", f_norm: float = 1.0) -> DataFrame:
    """alpha * (score - group mean) / f_norm, alpha: samples by non-zero scores of the batch."""
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(F.col(score) != 0))).alias("__alpha"))  # one row
    out = group_stats(df, score, uid, None).join(F.broadcast(alpha))
    return _with(out, F.col("__alpha") * (F.col(score) - F.col("g_mean")) / f_norm, "__alpha")


def whiten_arrays(df: DataFrame, column: str, mask: str = "response_mask", times_mask: bool = False) -> DataFrame:
    v, m = F.col(column), F.col(mask)
    mean = df.agg((F.sum(tk.masked_sum(v, m)) / (F.sum(tk.mask_size(m)) + 1e-8)).alias("__mean"), F.sum(tk.mask_size(m)).alias("c"))
    away = F.transform(v, lambda x: F.pow(x - F.col("__mean"), 2))
    square = df.select(column, mask).join(F.broadcast(mean.select("__mean"))).agg(F.sum(tk.masked_sum(away, m)).alias("square"))
    white = F.transform(column, lambda x: (x - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8))
    if times_mask:
        white = F.zip_with(white, mask, lambda x, k: x * k)
    return df.join(F.broadcast(_moments(mean, square))).withColumn(column, white).drop("__mean", "__var")


@estimator("gae")
def gae(df: DataFrame, rewards: str = "rewards", values: str = "values", mask: str = "response_mask", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Arrays ``advantages`` (whitened, not multiplied by the mask) and ``returns`` (from
    the estimates before whitening)."""
    out = df.withColumn("advantages", tk.gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam))
    out = out.withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    return whiten_arrays(out, "advantages", mask)


@estimator("reinforce_plus_plus")
def discounted_whitened(df: DataFrame, rewards: str = "rewards", mask: str = "response_mask", gamma: float = 1.0) -> DataFrame:
    out = df.withColumn("returns", tk.reward_to_go(F.col(rewards), F.col(mask), gamma)).withColumn("advantages", F.col("returns"))
    return whiten_arrays(out, "advantages", mask, times_mask=True)


@estimator("remax")
def greedy_baseline(df: DataFrame, rewards: str = "rewards", mask: str = "response_mask", baseline: str = "reward_baselines") -> DataFrame:
    """Sums of later masked rewards less the reward of the greedy answer."""
    inside = tk.masked(F.col(rewards), F.col(mask))
    ones = F.transform(mask, lambda m: F.lit(1))
    out = df.withColumn("returns", tk.reward_to_go(inside, ones))
    less = F.zip_with("returns", mask, lambda r, m: r - F.col(baseline) * m)
    return out.withColumn("advantages", F.zip_with(less, mask, lambda x, m: x * m))


def _token_baseline(tokens: DataFrame, place: str, zero_tail: bool, epsilon: float, weight: str | None) -> DataFrame:
    """``returns`` and ``advantage`` of a long table with ``reward, logp, sum_pi2``.

    ``place``: the column whose equal values are compared across the group."""
    along = Window.partitionBy("row_id").orderBy("t")
    energy = 1 - 2 * F.exp("logp") + F.col("sum_pi2")
    energy = energy * F.col(weight) * F.col(weight) if weight else energy
    out = tokens.withColumns(
        {
            "returns": F.sum(F.col("reward") * F.col("mask")).over(along.rowsBetween(0, Window.unboundedFollowing)),
            "__w": F.sum(energy * F.col("mask")).over(along.rowsBetween(Window.unboundedPreceding, 0)),
            "__len": F.sum("mask").over(Window.partitionBy("row_id")),
        }
    )
    # lengths of a group's samples: a row each
    rows = out.groupBy("uid", "row_id").agg(F.max("__len").alias("len"))
    if place != "t":
        rows = rows.where("len > 0")
    lengths = rows.groupBy("uid").agg(F.slice(F.sort_array(F.collect_list("len"), asc=False), 1, 2).alias("two"), F.count(F.lit(1)).alias("__n"))
    out = out.join(lengths, "uid", "left")
    spot = Window.partitionBy("uid", place)
    inside = F.col("mask") != 0
    b = F.sum(F.when(inside, F.col("returns") * F.col("__w") * F.col("mask"))).over(spot) / (F.coalesce(F.sum(F.when(inside, F.col("__w") * F.col("mask"))).over(spot), F.lit(0.0)) + epsilon)
    alone = F.col("__n").isNull() | (F.col("__n") < 2)
    base = F.when(alone, F.lit(0.0)).otherwise(F.coalesce(b, F.lit(0.0)))
    if zero_tail:
        second, longest = F.try_element_at("two", F.lit(2)), F.element_at("two", 1)
        tail = ~alone & (F.col("__len") == longest) & (longest > second) & (F.col(place) >= second)
        base = F.when(tail, F.lit(0.0)).otherwise(base)
    return out.withColumn("advantage", (F.col("returns") - base) * F.col("mask")).drop("__w", "__len", "__n", "two")


@estimator("optimal_token_baseline")
def token_baseline(tokens: DataFrame, zero_tail: bool = True, epsilon: float = 1e-8, weight: str | None = None) -> DataFrame:
    """A baseline for each place t of a group: returns weighted by the running energy."""
    return _token_baseline(tokens, "t", zero_tail, epsilon, weight)


@estimator("tir_optimal_token_baseline")
def turn_token_baseline(tokens: DataFrame, zero_tail: bool = True, epsilon: float = 1e-8, weight: str | None = None) -> DataFrame:
    """The same with places counted over the tokens within the mask only."""
    along = Window.partitionBy("row_id").orderBy("t")
    placed = tokens.withColumn("__place", F.when(F.col("mask") != 0, F.sum(F.col("mask").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    return _token_baseline(placed, "__place", zero_tail, epsilon, weight).drop("__place")


def session_advantage(df: DataFrame, session: str = "session", step: str = "step", score: str = "score", uid: str = "uid", **options) -> DataFrame:
    """``grpo`` over the last row of each session, given to all rows of the session."""
    last = df.groupBy(uid, session).agg(F.max_by(score, step).alias("__last"))
    judged = grpo(last, "__last", uid, **options).select(uid, session, "advantage")
    return df.join(judged, [uid, session])


def compute_advantage(df: DataFrame, name: str, **options) -> DataFrame:
    return get_estimator(name)(df, **options)


#: Estimators of arrays along tokens, and of positions across a group, with the columns that
#: each takes beside ``token_level_rewards`` and ``response_mask``. All others judge whole samples.
ALONG = {"gae": ("values",), "reinforce_plus_plus": (), "remax": ("reward_baselines",)}
ACROSS = {"optimal_token_baseline": ("uid", "old_log_probs", "sum_pi_squared"), "tir_optimal_token_baseline": ("uid", "old_log_probs", "sum_pi_squared")}


def advantages_of(batch: DataFrame, name: str, row: str = "row_id", **options) -> DataFrame:
    """Arrays ``advantages`` and ``returns`` of a wide batch, by any estimator.

    The batch has ``token_level_rewards`` and ``response_mask`` as arrays and what the
    estimator asks for; a missing column raises. A sample's score is the sum of its rewards,
    what holds for a sample is spread over its mask, and its returns are its advantages. Of
    ``options`` an estimator gets those it knows."""
    fn = get_estimator(name)
    known = inspect.signature(fn).parameters
    options = {k: v for k, v in options.items() if k in known}
    needed = ("token_level_rewards", "response_mask", *ALONG.get(name, ACROSS.get(name, ("uid",))))
    if missing := [c for c in needed if c not in batch.columns]:
        raise ValueError(f"{name} needs the columns {missing}")
    if name in ALONG:
        return fn(batch, "token_level_rewards", **options)
    if name in ACROSS:
        parts = {"reward": "token_level_rewards", "mask": "response_mask", "logp": "old_log_probs", "sum_pi2": "sum_pi_squared"}
        zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in parts.items()])
        tokens = batch.select(F.col(row).alias("row_id"), "uid", F.posexplode(zipped).alias("t", "z")).select("row_id", "uid", "t", "z.*")
        told = fn(tokens, **options).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("t", "advantage", "returns"))).alias("__a"))
        joined = batch.join(told.withColumnRenamed("row_id", "__row"), F.col(row) == F.col("__row"), "left").drop("__row")
        return joined.withColumns({"advantages": F.col("__a.advantage"), "returns": F.col("__a.returns")}).drop("__a")
    scored = batch.withColumns({"__score": tk.total(F.col("token_level_rewards")), "__n": tk.mask_size(F.col("response_mask"))})
    given = {k: v for k, v in (("n", "__n"), ("score", "__score"), ("order", row)) if k in known}
    if "scores" in known and "scores" not in options:
        given["scores"] = ("__score",)
    out = over_tokens(fn(scored, **{**given, **options})).drop("__score", "__n", "advantage")
    return out.withColumn("returns", F.col("advantages"))


def kl_in_reward(df: DataFrame, beta: float, kind: str = "k1", scores: str = "scores", logp: str = "old_log_probs", ref: str = "ref_log_prob", mask: str = "response_mask") -> tuple[DataFrame, DataFrame]:
    """``rewards`` = scores - beta * divergence * mask, and one row with the mean over
    samples of each one's mean divergence (``kl``), which a controller takes."""
    gap = F.transform(F.arrays_zip(F.col(logp).alias("a"), F.col(ref).alias("b")), lambda z: divergence(z["a"], z["b"], kind))
    out = df.withColumn("__kl", tk.masked(gap, F.col(mask)))
    mean = out.agg(F.avg(tk.masked_sum(F.col("__kl"), F.col(mask)) / (tk.mask_size(F.col(mask)) + 1e-8)).alias("kl"))
    return out.withColumn("rewards", F.zip_with(scores, "__kl", lambda s, k: s - k * beta)).drop("__kl"), mean


class AdaptiveCoefficient:
    """A coefficient that follows a target divergence."""

    def __init__(self, value: float, target: float, horizon: float) -> None:
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, steps: int) -> None:
        error = min(max(current / self.target - 1, -0.2), 0.2)
        self.value *= 1 + error * steps / self.horizon


class FixedCoefficient:
    def __init__(self, value: float) -> None:
        self.value = value

    def update(self, current: float, steps: int) -> None:
        pass


def resampling_weights(df: DataFrame, score: str = "score", method: str = "pow", power: float = 2.0) -> DataFrame:
    """``weight`` of every sample for drawing with replacement."""
    s = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(s), F.lit(power)) + 1e-8)
    ends = df.agg(F.max(score).alias("__hi"), F.min(score).alias("__lo"))  # one row
    out = df.join(F.broadcast(ends))
    if method == "max_min":
        w = F.when((s == F.col("__hi")) | (s == F.col("__lo")), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(s == F.col("__hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("weight", w + 1e-8).drop("__hi", "__lo")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / float(1 << 52)


#: Rows of a cell of the running sum, and draws that share a slot.
CELL_ROWS, SLOT_DRAWS = 50_000, 16


def resample(df: DataFrame, seed: int = 0, row: str = "row_id", **options) -> DataFrame:
    """As many rows as given, drawn by weight with replacement; ``draw`` numbers them.

    Uniform draws are hashes. Rows lie side by side on a line, each as long as its weight, by
    running sums in two levels: cells of hashed rows, and rows within a cell. The line is cut
    into slots of equal length; a row is listed in every slot it reaches into, and a draw
    looks among the rows of its own slot. So neither a heavy row, listed once a slot, nor the
    draws that fall on it meet in one task."""
    weighted = resampling_weights(df, **options)
    total = weighted.agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    n, line = total["n"], total["w"]
    if not n:
        return weighted.withColumn("draw", F.lit(0).cast("long"))
    cells, slots = max(64, -(-n // CELL_ROWS)), max(1, n // SLOT_DRAWS)
    cell = F.least(F.floor(_uniform(F.lit("cell"), F.col(row)) * cells), F.lit(cells - 1))
    along = Window.partitionBy("__c").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    sized = weighted.select(F.col(row).alias("__row"), "weight", cell.alias("__c")).withColumn("__at", F.coalesce(F.sum("weight").over(along), F.lit(0.0)))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("__c").agg(F.sum("weight").alias("__cw")).withColumn("__start", F.coalesce(F.sum("__cw").over(before), F.lit(0.0)))  # a row a cell
    placed = sized.join(starts.select("__c", "__start"), "__c").select("__row", (F.col("__start") + F.col("__at")).alias("__from"), (F.col("__start") + F.col("__at") + F.col("weight")).alias("__to"))
    slot = lambda x: F.least(F.floor(x / F.lit(line) * slots), F.lit(slots - 1)).cast("long")
    block = 1 << 16  # slots are listed block by block, as a row may reach into very many
    reached = placed.withColumns({"__s0": slot(F.col("__from")), "__s1": slot(F.col("__to"))})
    reached = reached.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s0") / block), F.floor(F.col("__s1") / block))))
    reached = reached.withColumn("__slot", F.explode(F.sequence(F.greatest("__s0", F.col("__b") * block), F.least("__s1", (F.col("__b") + 1) * block - 1))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (_uniform(F.lit(seed), F.col("id")) * line).alias("__u")).withColumn("__slot", slot(F.col("__u")))
    taken = draws.join(reached.select("__slot", "__row", "__from", "__to"), "__slot").where((F.col("__from") <= F.col("__u")) & (F.col("__u") < F.col("__to")))
    # where sums in another order leave a gap between two rows, the row before it is taken
    missed = draws.join(taken.select("draw"), "draw", "left_anti").join(F.broadcast(placed.agg(F.max_by("__row", "__from").alias("__row"))))
    chosen = taken.select("draw", "__row").dropDuplicates(["draw"]).unionByName(missed.select("draw", "__row"))
    return weighted.join(chosen.withColumnRenamed("__row", row), row)

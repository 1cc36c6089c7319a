"""Queries of the operators over the provided tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import divergence, parsing, scores
from ..functions import tokens as tk
from ..operators import advantage, balance, batch, correction, curation, datasets, groupwise, losses, messages, metrics, rewards
from ..sources import files
from ..streaming import queue as sample_queue
from ..streaming import replay
from .standins import ORDERS_SQL, SAMPLES_SQL, TOKENS_SQL, numbered_orders, rollouts, rounded, samples, table, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query and its SQL."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r4(expr: str, alias: str) -> str:
    return f"round({expr}, 4) + 0.0 AS {alias}"


def _orders(spark, d):
    return numbered_orders(spark, d)


# -- batches -------------------------------------------------------------------------


@query(f"WITH {ORDERS_SQL} SELECT row_id, price FROM ord")
def batch_select(spark, d):
    return batch.select(_orders(spark, d), ["price"])


@query(f"WITH {ORDERS_SQL} SELECT (row_id - 10) // 3 AS row_id, cust, status, price FROM ord WHERE row_id >= 10 AND row_id < (SELECT count(*) FROM ord) - 5 AND (row_id - 10) % 3 = 0")
def batch_slice(spark, d):
    return batch.slice_rows(_orders(spark, d), 10, -5, 3)


@query(f"WITH {ORDERS_SQL}, want AS (SELECT unnest([5, 3, 3, 0, 7]) AS i, unnest([0, 1, 2, 3, 4]) AS p) SELECT p::BIGINT AS row_id, cust, status, price FROM want JOIN ord ON row_id = i")
def batch_take(spark, d):
    return batch.take(_orders(spark, d), [5, 3, 3, 0, 7])


@query(f"WITH {ORDERS_SQL} SELECT * FROM ord WHERE price > 100000")
def batch_mask(spark, d):
    return batch.where(_orders(spark, d), F.col("price") > 100000)


@query(f"WITH {ORDERS_SQL} SELECT row_id * 3 + rep AS row_id, cust, status, price, rep FROM ord, (SELECT unnest([0, 1, 2]::BIGINT[]) AS rep)")
def batch_repeat_interleaved(spark, d):
    return batch.repeat(_orders(spark, d), 3, True)


@query(f"WITH {ORDERS_SQL} SELECT rep * (SELECT count(*) FROM ord) + row_id AS row_id, cust, status, price, rep FROM ord, (SELECT unnest([0, 1]::BIGINT[]) AS rep)")
def batch_repeat_whole(spark, d):
    return batch.repeat(_orders(spark, d), 2, False)


@query(f"WITH {ORDERS_SQL} SELECT ord.*, unnest(range(row_id % 4))::BIGINT AS rep FROM ord")
def batch_repeat_by_row(spark, d):
    return batch.repeat_by(_orders(spark, d), F.col("row_id") % 4)


@query(f"WITH {ORDERS_SQL} SELECT row_id * 2 + part AS row_id, cust, xs[part * 2 + 1 : part * 2 + 2] AS xs, part FROM (SELECT row_id, cust, [row_id, cust, row_id + 1, cust + 1] AS xs FROM ord), (SELECT unnest([0, 1]::BIGINT[]) AS part)")
def batch_unfold_columns(spark, d):
    df = _orders(spark, d).select("row_id", "cust", F.array(F.col("row_id"), F.col("cust"), F.col("row_id") + 1, F.col("cust") + 1).alias("xs"))
    return batch.unfold_chunks(df, 2, ["xs"])


@query(f"WITH {ORDERS_SQL} SELECT row_id // 5 AS chunk, count(*) AS n, round(sum(price), 2) AS s FROM ord GROUP BY 1")
def batch_chunk(spark, d):
    df = _orders(spark, d)
    n = batch.size(df)
    return batch.chunk(df, n // 5).groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("s"))


@query(f"WITH {ORDERS_SQL} SELECT row_id // 7 AS chunk, count(*) AS n, min(row_id) AS first FROM ord GROUP BY 1")
def batch_split(spark, d):
    return batch.split(_orders(spark, d), 7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))


@query(f"WITH {ORDERS_SQL}, n AS (SELECT count(*) AS n FROM ord) SELECT * FROM ord UNION ALL SELECT row_id + n, cust, status, price FROM ord, n WHERE row_id < (-n % 7 + 7) % 7")
def batch_pad(spark, d):
    return batch.pad_to_divisor(_orders(spark, d), 7)[0]


@query(f"WITH {ORDERS_SQL} SELECT * FROM ord")
def batch_pad_unpad(spark, d):
    padded, n = batch.pad_to_divisor(_orders(spark, d), 13)
    return batch.unpad(padded, n)


@query(f"WITH {ORDERS_SQL}, n AS (SELECT count(*) AS n FROM ord) SELECT * FROM ord UNION ALL SELECT n + k, cust, status, price FROM ord, n, (SELECT unnest([0, 1, 2]) AS k) WHERE row_id = n - 1")
def batch_pad_last(spark, d):
    return batch.pad_last(_orders(spark, d), 3)


@query(f"WITH {ORDERS_SQL} SELECT row_id, cust, status, price, price * 2 AS twice FROM ord")
def batch_union(spark, d):
    df = _orders(spark, d)
    return batch.union(df, df.select("row_id", "cust", (F.col("price") * 2).alias("twice")))


@query(f"WITH {ORDERS_SQL}, n AS (SELECT count(*) AS n FROM ord) SELECT * FROM ord UNION ALL SELECT row_id + n, cust, status, price FROM ord, n")
def batch_concat(spark, d):
    df = _orders(spark, d)
    return batch.concat([df, df])


@query(f"WITH {ORDERS_SQL} SELECT row_id, cust AS customer, status, price AS amount FROM ord")
def batch_rename(spark, d):
    return batch.rename(_orders(spark, d), ["cust", "price"], ["customer", "amount"])


@query(f"WITH {ORDERS_SQL} SELECT row_id, cust, status FROM ord")
def batch_pop(spark, d):
    return batch.pop(_orders(spark, d), ["price"])[1]


@query(f"WITH {ORDERS_SQL} SELECT row_id, cust, price FROM ord")
def batch_fold_unfold(spark, d):
    df = _orders(spark, d).select("row_id", "cust", "price")
    return batch.unfold(batch.fold(df, batch.size(df) // 5))


@query(f"""WITH {ORDERS_SQL}, e AS (SELECT *, unnest([0, 1]::BIGINT[]) AS epoch FROM ord),
    r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5('7/' || epoch || '/' || row_id), row_id) - 1 AS k FROM e)
    SELECT row_id, cust, status, price, epoch, k // 5 AS minibatch FROM r""")
def batch_minibatches(spark, d):
    return batch.minibatches(_orders(spark, d), 5, 2, 7)


@query(f"WITH {ORDERS_SQL}, r AS (SELECT *, row_id - row_number() OVER (PARTITION BY status ORDER BY row_id) AS run FROM ord) SELECT row_id, status, row_number() OVER (PARTITION BY status, run ORDER BY row_id) - 1 AS ordinal FROM r")
def batch_run_ordinal(spark, d):
    return batch.run_ordinal(_orders(spark, d).select("row_id", "status"), "status")


@query(f"WITH {ORDERS_SQL} SELECT cust, list(row_id ORDER BY row_id) AS row_ids FROM ord GROUP BY cust")
def batch_groups(spark, d):
    return batch.groups_of(_orders(spark, d), "cust")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id, o_orderkey FROM orders")
def batch_number_rows(spark, d):
    return batch.number_rows(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey").select("row_id", "o_orderkey")


# -- masked statistics ---------------------------------------------------------------


@query(f"WITH {TOKENS_SQL} SELECT row_id, {r4('coalesce(sum(reward * mask) FILTER (mask <> 0), 0)', 's')}, {r4('coalesce(sum(reward * mask) FILTER (mask <> 0), 0) / (sum(mask) + 1e-8)', 'm')} FROM tok GROUP BY row_id")
def masked_row_stats(spark, d):
    r = rollouts(spark, d)
    return rounded(r.select("row_id", tk.masked_sum(F.col("rewards"), F.col("masks")).alias("s"), tk.masked_mean(F.col("rewards"), F.col("masks")).alias("m")))


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT sum(reward * mask) / (sum(mask) + 1e-8) AS m FROM tok),
    v AS (SELECT sum((reward - m) * (reward - m) * mask) / (sum(mask) + 1e-8) * sum(mask) / (sum(mask) - 1) AS v FROM tok, s)
    SELECT row_id, t, {r4('(reward - m) / sqrt(v + 1e-8)', 'reward')} FROM tok, s, v""")
def masked_whiten(spark, d):
    return rounded(groupwise.whiten(tokens(spark, d).select("row_id", "t", "mask", "reward"), "reward").drop("mask"))


@query(f"WITH {TOKENS_SQL} SELECT row_id, list(CASE WHEN t <= coalesce(e, 1000000) THEN 1 ELSE 0 END ORDER BY t) AS m FROM tok JOIN (SELECT row_id, min(t) FILTER (t % 6 = 5) AS e FROM tok GROUP BY row_id) USING (row_id) GROUP BY row_id")
def response_mask(spark, d):
    r = tokens(spark, d).groupBy("row_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return r.select("row_id", tk.response_mask(F.transform("ts", lambda x: x % 6), [5]).alias("m"))


@query(f"WITH {TOKENS_SQL} SELECT row_id, list(t ORDER BY t) FILTER (mask <> 0) AS kept FROM tok GROUP BY row_id")
def keep_where(spark, d):
    r = tokens(spark, d).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("t", "mask"))).alias("a"))
    k = r.select("row_id", tk.keep_where(F.transform("a", lambda x: x["t"]), F.transform("a", lambda x: x["mask"])).alias("kept"))
    return k.withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")))


@query(f"""WITH {TOKENS_SQL}, i AS (SELECT *, t - row_number() OVER (PARTITION BY row_id ORDER BY t) AS g FROM tok WHERE mask <> 0)
    SELECT row_id, min(t)::INTEGER AS start, (max(t) + 1)::INTEGER AS stop FROM i GROUP BY row_id, g""")
def mask_spans(spark, d):
    r = rollouts(spark, d).select("row_id", F.explode(tk.spans(F.col("masks"))).alias("s"))
    return r.select("row_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(f"WITH {TOKENS_SQL} SELECT row_id, t, {r4('sum(reward * mask) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'g')} FROM tok")
def reward_to_go(spark, d):
    r = rollouts(spark, d)
    g = tk.reward_to_go(tk.masked(F.col("rewards"), F.col("masks")), F.transform("masks", lambda m: F.lit(1)))
    return rounded(r.select("row_id", F.posexplode(g).alias("t", "g")).withColumn("t", F.col("t").cast("long")))


@query(f"""WITH {TOKENS_SQL}, l AS (SELECT *, lead(mask) OVER (PARTITION BY row_id ORDER BY t) AS nm FROM tok)
    SELECT {r4('-sum(logp * nm) / sum(nm)', 'loss')} FROM l""")
def sft_loss(spark, d):
    return rounded(losses.sft_loss(tokens(spark, d)))


@query(f"WITH {TOKENS_SQL} SELECT {r4('max(abs(exp(logp) - exp(rollout_logp)))', 'diff_max')}, {r4('avg(abs(exp(logp) - exp(rollout_logp)))', 'diff_mean')}, {r4('stddev_samp(abs(exp(logp) - exp(rollout_logp)))', 'diff_std')}, {r4('corr(exp(logp), exp(rollout_logp))', 'pearson')} FROM tok WHERE mask <> 0")
def policy_agreement(spark, d):
    return rounded(metrics.agreement(tokens(spark, d)))


# -- advantages ----------------------------------------------------------------------

_G = "avg(score) OVER g AS gm, stddev_samp(score) OVER g AS gs, var_samp(score) OVER g AS gv, count(*) OVER g AS gn"
_STATS = f"{SAMPLES_SQL}, st AS (SELECT *, {_G} FROM smp WINDOW g AS (PARTITION BY uid))"
_ID = "uid, row_id"


def _outcome(name: str, **options) -> Query:
    def run(spark, d):
        cols = ["uid", "row_id", "advantage"]
        return rounded(advantage.compute_advantage(samples(spark, d), name, **options).select(cols))

    return run


def _outcome_sql(expr: str, stats: str = _STATS, source: str = "st") -> str:
    return f"WITH {stats} SELECT {_ID}, {r4(expr, 'advantage')} FROM {source}"


for _name, _sql, _options in [
    ("grpo", _outcome_sql("CASE WHEN gn > 1 THEN (score - gm) / (gs + 1e-6) ELSE score / (1 + 1e-6) END"), {}),
    ("grpo_no_std", _outcome_sql("CASE WHEN gn > 1 THEN score - gm ELSE score END"), {"by_std": False}),
    ("grpo_vectorized", _outcome_sql("CASE WHEN gn > 1 THEN (score - gm) / (sqrt(greatest(gv, 1e-6)) + 1e-6) ELSE score / (1 + 1e-6) END"), {}),
    ("rloo", _outcome_sql("CASE WHEN gn > 1 THEN gn / (gn - 1) * (score - gm) ELSE score END"), {}),
    ("rloo_vectorized", _outcome_sql("CASE WHEN gn > 1 THEN (gn * score - gm * gn) / (gn - 1) ELSE 0 END"), {}),
    ("opo", f"WITH {SAMPLES_SQL} SELECT {_ID}, {r4('CASE WHEN count(*) OVER g > 1 THEN score - sum(n * score) OVER g / sum(n) OVER g ELSE score END', 'advantage')} FROM smp WINDOW g AS (PARTITION BY uid)", {}),
    ("gpg", f"WITH {_STATS} SELECT {_ID}, {r4('(SELECT count(*) / greatest(1, count(*) FILTER (score <> 0)) FROM smp) * CASE WHEN gn > 1 THEN score - gm ELSE score END', 'advantage')} FROM st", {}),
]:
    query(_sql, f"adv_{_name}")(_outcome(_name.removesuffix("_no_std"), **_options))

_WHITE = """w AS (SELECT sum(a * n) / (sum(n) + 1e-8) AS m FROM adv), v AS (SELECT sum((a - m) * (a - m) * n) / (sum(n) + 1e-8) * sum(n) / (sum(n) - 1) AS v FROM adv, w)"""
query(f"WITH {_STATS}, adv AS (SELECT *, CASE WHEN gn > 1 THEN score - gm ELSE score END AS a FROM st), {_WHITE} SELECT {_ID}, {r4('(a - m) / sqrt(v + 1e-8)', 'advantage')} FROM adv, w, v", "adv_reinforce_plus_plus_baseline")(_outcome("reinforce_plus_plus_baseline"))
query(
    f"""WITH {SAMPLES_SQL}, st AS (SELECT *, avg(score) OVER g AS gm, stddev_samp(score) OVER g AS gs, avg(bonus) OVER g AS bm, stddev_samp(bonus) OVER g AS bs, count(*) OVER g AS gn FROM smp WINDOW g AS (PARTITION BY uid)),
    adv AS (SELECT *, CASE WHEN gn > 1 THEN (score - gm) / (gs + 1e-6) + 0.5 * (bonus - bm) / (bs + 1e-6) ELSE (score + 0.5 * bonus) / (1 + 1e-6) END AS a FROM st), {_WHITE}
    SELECT {_ID}, {r4('(a - m) / sqrt(v + 1e-8)', 'advantage')} FROM adv, w, v""",
    "adv_gdpo",
)(_outcome("gdpo", scores=["score", "bonus"], weights=[1.0, 0.5]))


@query(f"""WITH {SAMPLES_SQL}, st AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS rk, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS second,
    stddev_samp(score) OVER (PARTITION BY uid) AS sd, count(*) OVER (PARTITION BY uid) AS gn FROM smp)
    SELECT {_ID}, {r4('CASE WHEN rk = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END', 'advantage')} FROM st WHERE gn > 1""")
def adv_grpo_passk(spark, d):
    s = samples(spark, d)
    w = Window.partitionBy("uid")
    several = s.withColumn("k", F.count(F.lit(1)).over(w)).where("k > 1").drop("k")
    return rounded(advantage.best_of_k(several).select("uid", "row_id", "advantage"))


_GAE = f"""WITH RECURSIVE {TOKENS_SQL}, last AS (SELECT row_id, max(t) AS t FROM tok GROUP BY row_id),
    rec AS (
        SELECT k.row_id, k.t, k.value, k.mask, CASE WHEN mask = 1 THEN value ELSE 0::DOUBLE END AS nv, CASE WHEN mask = 1 THEN reward - value ELSE 0::DOUBLE END AS a FROM tok k JOIN last USING (row_id, t)
        UNION ALL
        SELECT k.row_id, k.t, k.value, k.mask, CASE WHEN k.mask = 1 THEN k.value ELSE r.nv END, CASE WHEN k.mask = 1 THEN k.reward + 0.99::DOUBLE * r.nv - k.value + 0.99::DOUBLE * 0.95::DOUBLE * r.a ELSE r.a END
        FROM rec r JOIN tok k ON k.row_id = r.row_id AND k.t = r.t - 1),
    w AS (SELECT sum(a * mask) / (sum(mask) + 1e-8) AS m FROM rec), v AS (SELECT sum((a - m) * (a - m) * mask) / (sum(mask) + 1e-8) * sum(mask) / (sum(mask) - 1) AS v FROM rec, w)"""


@query(f"{_GAE} SELECT row_id, t, {r4('(a - m) / sqrt(v + 1e-8)', 'advantage')}, {r4('a + value', 'returns')} FROM rec, w, v")
def adv_gae(spark, d):
    r = advantage.gae(rollouts(spark, d), "rewards", "values", "masks", 0.99, 0.95)
    z = r.select("row_id", F.posexplode(F.arrays_zip("advantages", "returns")).alias("t", "z"))
    return rounded(z.select("row_id", F.col("t").cast("long").alias("t"), F.col("z.advantages").alias("advantage"), F.col("z.returns").alias("returns")))


@query(f"""WITH RECURSIVE {TOKENS_SQL}, last AS (SELECT row_id, max(t) AS t FROM tok GROUP BY row_id),
    rec AS (SELECT k.row_id, k.t, k.mask, reward AS g, reward * mask AS run FROM tok k JOIN last USING (row_id, t)
        UNION ALL SELECT k.row_id, k.t, k.mask, k.reward + 0.9::DOUBLE * r.run, (k.reward + 0.9::DOUBLE * r.run) * k.mask FROM rec r JOIN tok k ON k.row_id = r.row_id AND k.t = r.t - 1),
    w AS (SELECT sum(g * mask) / (sum(mask) + 1e-8) AS m FROM rec), v AS (SELECT sum((g - m) * (g - m) * mask) / (sum(mask) + 1e-8) * sum(mask) / (sum(mask) - 1) AS v FROM rec, w)
    SELECT row_id, t, {r4('(g - m) / sqrt(v + 1e-8) * mask', 'advantage')}, {r4('g', 'returns')} FROM rec, w, v""")
def adv_reinforce_plus_plus(spark, d):
    r = advantage.discounted_whitened(rollouts(spark, d), "rewards", "masks", 0.9)
    z = r.select("row_id", F.posexplode(F.arrays_zip("advantages", "returns")).alias("t", "z"))
    return rounded(z.select("row_id", F.col("t").cast("long").alias("t"), F.col("z.advantages").alias("advantage"), F.col("z.returns").alias("returns")))


@query(f"WITH {TOKENS_SQL}, g AS (SELECT *, sum(reward * mask) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM tok) SELECT row_id, t, {r4('(g - (row_id % 7) / 10.0::DOUBLE) * mask', 'advantage')} FROM g")
def adv_remax(spark, d):
    r = rollouts(spark, d).withColumn("base", F.col("row_id") % 7 / 10.0)
    r = advantage.greedy_baseline(r, "rewards", "masks", "base")
    return rounded(r.select("row_id", F.posexplode("advantages").alias("t", "advantage")).withColumn("t", F.col("t").cast("long")))


def _baseline_sql(place: str, rows: str) -> str:
    return f"""WITH {TOKENS_SQL}, a AS (
        SELECT *, sum(reward * mask) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
               sum((1 - 2 * exp(logp) + sum_pi2) * mask) OVER (PARTITION BY row_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS w,
               sum(mask) OVER (PARTITION BY row_id) AS len, {place} AS p FROM tok),
    ln AS (SELECT uid, max(len) AS l1, list(len ORDER BY len DESC)[2] AS l2, count(*) AS k FROM (SELECT DISTINCT uid, row_id, len FROM a {rows}) GROUP BY uid),
    b AS (SELECT uid, p, sum(g * w * mask) / (sum(w * mask) + 1e-8) AS b FROM a WHERE mask <> 0 GROUP BY uid, p)
    SELECT row_id, t, {r4('(g - CASE WHEN k < 2 OR k IS NULL OR (len = l1 AND l1 > l2 AND a.p >= l2) THEN 0 ELSE coalesce(b, 0) END) * mask', 'advantage')}
    FROM a LEFT JOIN ln USING (uid) LEFT JOIN b ON a.uid = b.uid AND a.p = b.p"""


@query(_baseline_sql("t", ""))
def adv_optimal_token_baseline(spark, d):
    return rounded(advantage.token_baseline(tokens(spark, d)).select("row_id", "t", "advantage"))


@query(_baseline_sql("CASE WHEN mask <> 0 THEN sum(mask) OVER (PARTITION BY row_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 END", "WHERE len > 0"))
def adv_tir_optimal_token_baseline(spark, d):
    return rounded(advantage.turn_token_baseline(tokens(spark, d)).select("row_id", "t", "advantage"))


@query("""WITH o AS (SELECT o_custkey % 50 AS uid, o_custkey AS session, o_orderkey AS step, o_totalprice / 1000 AS score FROM orders),
    l AS (SELECT uid, session, arg_max(score, step) AS s FROM o GROUP BY ALL),
    a AS (SELECT uid, session, CASE WHEN count(*) OVER g > 1 THEN (s - avg(s) OVER g) / (stddev_samp(s) OVER g + 1e-6) ELSE s / (1 + 1e-6) END AS a FROM l WINDOW g AS (PARTITION BY uid))
    SELECT step, round(a, 4) + 0.0 AS advantage FROM o JOIN a USING (uid, session)""")
def adv_multi_session(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("uid"), F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("step"), (F.col("o_totalprice") / 1000).alias("score"))
    return rounded(advantage.session_advantage(o).select("step", "advantage"))


@query(f"WITH {TOKENS_SQL} SELECT row_id, {r4('sum(reward - 0.1 * (logp - old_logp) * mask)', 'total')} FROM tok GROUP BY row_id")
def kl_in_reward(spark, d):
    out, _ = advantage.kl_in_reward(rollouts(spark, d), 0.1, "k1", "rewards", "logps", "old_logps", "masks")
    return rounded(out.select("row_id", tk.total(F.col("rewards")).alias("total")))


@query(f"WITH {SAMPLES_SQL} SELECT row_id, {r4('score * score + 1e-8', 'weight')} FROM smp")
def resampling_weights(spark, d):
    return rounded(advantage.resampling_weights(samples(spark, d)).select("row_id", "weight"))


_U = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT row_id, any_value(score) AS score FROM smp GROUP BY row_id), w AS (SELECT row_id, pow(abs(score), 2) + 1e-8 AS weight, floor({_U.format("'cell/' || row_id")} * greatest(64, ceil((SELECT count(*) FROM s) / 50000))) AS c FROM s),
    line AS (SELECT row_id, sum(weight) OVER (ORDER BY c, row_id) - weight AS begins FROM w),
    draws AS (SELECT draw, {_U.format("'3/' || draw")} * (SELECT sum(weight) FROM w) AS u FROM (SELECT unnest(range((SELECT count(*) FROM s))) AS draw))
    SELECT draw, row_id FROM draws ASOF JOIN line ON u >= begins""")
def resample(spark, d):
    s = samples(spark, d).dropDuplicates(["row_id"]).select("row_id", "score")
    return advantage.resample(s, seed=3).select("draw", "row_id")


# -- divergences and losses ----------------------------------------------------------

_KL = {"k1": "logp - old_logp", "abs": "abs(logp - old_logp)", "k2": "0.5 * (logp - old_logp) * (logp - old_logp)", "k3": "exp(old_logp - logp) - (old_logp - logp) - 1"}


@query(f"WITH {TOKENS_SQL} SELECT row_id, t, " + ", ".join(r4(e, k) for k, e in _KL.items()) + " FROM tok")
def kl_estimates(spark, d):
    return rounded(tokens(spark, d).select("row_id", "t", *[divergence.kl(F.col("logp"), F.col("old_logp"), k).alias(k) for k in _KL]))


_MM = lambda e: f"coalesce(sum(({e}) * mask), 0) / (sum(mask) + 1e-8)"
_TM = "sum(loss * mask) / sum(mask)"
_STM = "(SELECT sum(s) / count(*) FROM (SELECT sum(loss * mask) / (sum(mask) + 1e-8) AS s FROM x GROUP BY row_id HAVING sum(mask) > 0))"
_STS = "(SELECT sum(s) / count(*) FROM (SELECT sum(loss * mask) AS s FROM x GROUP BY row_id HAVING sum(mask) > 0))"
_CUT = "greatest(least(ratio, 1.2), 0.8)"


def _loss_sql(loss: str, mode: str, told: dict[str, str], extra: str = "") -> str:
    return f"""WITH {TOKENS_SQL}, q AS (SELECT *, exp(logp - old_logp) AS ratio, logp - old_logp AS gap{extra} FROM tok), x AS (SELECT *, {loss} AS loss FROM q)
    SELECT {r4(mode, 'loss')}{''.join(', ' + r4(_MM(f'CASE WHEN {e} THEN 1 ELSE 0 END' if ' IS ' in e or '>' in e or '<' in e else e), k) for k, e in told.items())} FROM x"""


_WORST = f"greatest(-advantage * ratio, -advantage * {_CUT})"
_SEQ = ", exp(least(coalesce(sum((logp - old_logp) * mask) OVER (PARTITION BY row_id), 0) / greatest(sum(mask) OVER (PARTITION BY row_id), 1), 10)) AS seq"
_SCUT = "greatest(least(seq, 1.2), 0.8)"
_TV = "(CASE WHEN advantage > 0 THEN exp(logp) - exp(old_logp) <= 0.2 ELSE exp(logp) - exp(old_logp) >= -0.2 END)"
_BK = "(exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * ln((1 - exp(old_logp) + 1e-8) / (1 - exp(logp) + 1e-8)))"
_BKT = f"(CASE WHEN advantage > 0 THEN {_BK} <= 0.2 OR exp(logp) <= exp(old_logp) ELSE {_BK} <= 0.2 OR exp(logp) >= exp(old_logp) END)"
_TAU = "(CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END)"

for _name, _sql, _options in [
    ("vanilla", _loss_sql(f"CASE WHEN advantage < 0 THEN least(-advantage * 3, {_WORST}) ELSE {_WORST} END", _TM, {"pg_clipfrac": f"-advantage * {_CUT} > -advantage * ratio", "ppo_kl": "-gap", "pg_clipfrac_lower": f"{_WORST} > -advantage * 3 AND advantage < 0"}), {}),
    ("dppo_tv", _loss_sql(f"CASE WHEN {_TV} THEN -advantage * least(ratio, 20) * logp ELSE 0 END", _TM, {"pg_clipfrac": f"NOT {_TV} AND 1 > 0", "ppo_kl": "-gap", "pg_clipfrac_lower": f"ratio > 20 AND {_TV}"}), {}),
    ("dppo_kl", _loss_sql(f"CASE WHEN {_BKT} THEN -advantage * least(ratio, 20) * logp ELSE 0 END", _TM, {"pg_clipfrac": f"NOT {_BKT} AND 1 > 0", "ppo_kl": "-gap", "pg_clipfrac_lower": f"ratio > 20 AND {_BKT}"}), {}),
    ("gspo", _loss_sql(f"greatest(-advantage * seq, -advantage * {_SCUT})", _STM, {"pg_clipfrac": f"-advantage * {_SCUT} > -advantage * seq", "ppo_kl": "-gap", "pg_clipfrac_lower": "0"}, _SEQ), {}),
    ("sapo", _loss_sql(f"-advantage * 4.0 / {_TAU} / (1 + exp(-{_TAU} * (ratio - 1)))", _STM, {"pg_clipfrac": "0", "ppo_kl": "-gap", "pg_clipfrac_lower": "0"}), {}),
    ("cispo", _loss_sql(f"-{_CUT} * advantage * logp", _TM, {"pg_clipfrac": f"ratio > {_CUT} OR ratio < {_CUT}", "ppo_kl": "-gap", "pg_clipfrac_lower": "0"}), {}),
    ("reinforce", _loss_sql("-advantage * logp", _STS, {"ppo_kl": "-gap"}), {}),
]:

    def _run(spark, d, name=_name, options=_options):
        return rounded(losses.get_loss(name)(tokens(spark, d), **options))

    query(_sql, f"loss_{_name}")(_run)


@query(f"WITH {TOKENS_SQL}, x AS (SELECT *, -logp * advantage AS loss FROM tok) SELECT {r4(_TM, 'loss')} FROM x")
def loss_gpg(spark, d):
    return rounded(losses.plain_gradient(tokens(spark, d)).select("loss"))


@query(f"""WITH {TOKENS_SQL}, q AS (SELECT *, logp - old_logp AS gap, sign(advantage) AS sg FROM tok), y AS (SELECT *, greatest(least(gap, 0.2), -0.2) AS cut FROM q),
    s AS (SELECT row_id, coalesce(sum(sg * least(sg * gap, sg * cut) * mask), 0) / (sum(mask) + 1e-8) AS k, coalesce(sum(advantage * mask), 0) / (sum(mask) + 1e-8) AS a FROM y GROUP BY row_id)
    SELECT round((SELECT avg(-a * exp(k)) FROM s), 4) + 0.0 AS loss, {r4(_MM('CASE WHEN gap <> cut AND advantage > 0 THEN 1 ELSE 0 END'), 'pg_clipfrac')}, {r4(_MM('-gap'), 'ppo_kl')}, {r4(_MM('CASE WHEN gap <> cut AND advantage < 0 THEN 1 ELSE 0 END'), 'pg_clipfrac_lower')} FROM y""")
def loss_geo_mean(spark, d):
    return rounded(losses.geometric_mean(tokens(spark, d)))


@query(f"""WITH {TOKENS_SQL}, m AS (SELECT avg(advantage) AS ma, avg(logp) AS ml, greatest(1, floor(count(*) * 0.01))::BIGINT AS k FROM tok WHERE mask > 0),
    c AS (SELECT row_id, t, row_number() OVER (ORDER BY (advantage - ma) * (logp - ml) DESC, row_id, t) AS r FROM tok, m WHERE mask > 0),
    x AS (SELECT tok.*, -advantage * exp(logp - old_logp) + CASE WHEN r <= k THEN abs(logp - old_logp) ELSE 0 END AS loss FROM tok LEFT JOIN c USING (row_id, t), m)
    SELECT {r4(_TM, 'loss')}, {r4(_MM('abs(logp - old_logp)'), 'ppo_kl')} FROM x""")
def loss_kl_cov(spark, d):
    return rounded(losses.penalise_by_covariance(tokens(spark, d), ratio=0.01), 4)


@query()
def loss_clip_cov(spark, d):
    return rounded(losses.clip_by_covariance(tokens(spark, d), ratio=0.01, lb=0.05, ub=5.0))


@query(f"""WITH {TOKENS_SQL}, x AS (SELECT *, greatest(power(value * 1.5 - reward, 2), power(greatest(least(value * 1.5, value + 0.1), value - 0.1) - reward, 2)) AS loss, power(value * 1.5 - reward, 2) AS plain,
    power(greatest(least(value * 1.5, value + 0.1), value - 0.1) - reward, 2) AS cut FROM tok) SELECT {r4('0.5 * ' + _TM, 'loss')}, {r4(_MM('CASE WHEN cut > plain THEN 1 ELSE 0 END'), 'vf_clipfrac')} FROM x""")
def loss_value(spark, d):
    t = tokens(spark, d).withColumns({"vpred": F.col("value") * 1.5, "returns": F.col("reward")})
    return rounded(losses.value_loss(t, 0.1))


_MODES = {"token-mean": _TM, "seq-mean-token-sum": _STS, "seq-mean-token-sum-norm": f"{_STS} / (SELECT max(c) FROM (SELECT count(*) AS c FROM x GROUP BY row_id))", "seq-mean-token-mean": _STM}


@query(f"WITH {TOKENS_SQL}, x AS (SELECT *, reward AS loss FROM tok) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, {r4(f'any_value({e})' if e.startswith('(SELECT') else e, 'loss')} FROM x" for m, e in _MODES.items()))
def loss_aggregation_modes(spark, d):
    t, out = tokens(spark, d), None
    for m in losses.MODES:
        one = losses.aggregate_loss(t, "reward", m).select(F.lit(m).alias("mode"), "loss")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"WITH {TOKENS_SQL}, x AS (SELECT *, 0.5 * (logp - rollout_logp) * (logp - rollout_logp) AS loss FROM tok) SELECT {r4(_TM, 'loss')}, {r4('min(loss) FILTER (mask <> 0)', 'loss_min')}, {r4('max(loss) FILTER (mask <> 0)', 'loss_max')} FROM x")
def loss_distillation(spark, d):
    return rounded(losses.distillation_loss(tokens(spark, d).withColumn("teacher", F.col("rollout_logp")), "k2"))


# -- corrections ---------------------------------------------------------------------

_X = "old_logp - rollout_logp"
_TOKEN = {"k1": f"-({_X})", "k2": f"0.5 * ({_X}) * ({_X})", "k3": f"exp({_X}) - 1 - ({_X})"}
_REJECT = {"token_k1": "0.7_1.4", "token_k2": "0.05", "token_k3": "0.05", "seq_sum_k1": "0.5_2", "seq_sum_k2": "0.5", "seq_sum_k3": "0.5", "seq_mean_k1": "0.9_1.1", "seq_mean_k2": "0.06", "seq_mean_k3": "0.06", "seq_max_k2": "0.2", "seq_max_k3": "0.2"}


def _stat_sql(option: str) -> str:
    e = _TOKEN[option[-2:]]
    if option.startswith("token"):
        return e
    if option.startswith("seq_max"):
        return f"coalesce(max({e}) FILTER (mask <> 0) OVER r, 0)"
    total = f"coalesce(sum(({e}) * mask) OVER r, 0)"
    return f"{total} / (sum(mask) OVER r + 1e-8)" if "mean" in option else total


def _keep_sql(option: str) -> str:
    if option.endswith("k1"):
        a, b = _REJECT[option].split("_")
        return f"st BETWEEN ln({a}) AND ln({b})"
    return f"st <= {_REJECT[option]}"


def _corrected(spark, d):
    return tokens(spark, d).withColumn("log_ratio", F.col("old_logp") - F.col("rollout_logp"))


@query(" UNION ALL ".join(f"(WITH {TOKENS_SQL}, x AS (SELECT row_id, mask, {_stat_sql(o)} AS st FROM tok WINDOW r AS (PARTITION BY row_id)) SELECT '{o}' AS option, sum(CASE WHEN {_keep_sql(o)} THEN mask ELSE 0 END)::BIGINT AS kept FROM x)" for o in _REJECT))
def rejection_options(spark, d):
    t, out = _corrected(spark, d), None
    for o, band in _REJECT.items():
        one = correction.rejection_mask(t, o, band).agg(F.sum("mask").alias("kept")).select(F.lit(o).alias("option"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {TOKENS_SQL}, x AS (SELECT row_id, t, mask, {_TOKEN['k2']} AS a, {_stat_sql('seq_mean_k1')} AS b FROM tok WINDOW r AS (PARTITION BY row_id))
    SELECT row_id, t, CASE WHEN a <= 0.05 AND b BETWEEN ln(0.9) AND ln(1.1) THEN mask ELSE 0 END AS mask FROM x""")
def rejection_mask(spark, d):
    return correction.rejection_mask(_corrected(spark, d), "token_k2,seq_mean_k1", "0.05,0.9_1.1").select("row_id", "t", "mask")


@query(f"""WITH {TOKENS_SQL}, x AS (SELECT row_id, mask, {_TOKEN['k3']} AS st FROM tok WHERE mask > 0), s AS (SELECT row_id, max(CASE WHEN st > 0.05 THEN 1 ELSE 0 END) AS bad FROM x GROUP BY row_id)
    SELECT 'token_k3' AS option, {r4('avg(st)', 'stat_mean')}, {r4('max(st)', 'stat_max')}, {r4('min(st)', 'stat_min')}, {r4('avg(CASE WHEN st > 0.05 THEN 1.0 ELSE 0 END)', 'masked_fraction')}, round((SELECT avg(bad) FROM s), 4) + 0.0 AS seq_masked_fraction FROM x""")
def rejection_metrics(spark, d):
    return rounded(correction.rejection_metrics(_corrected(spark, d), "token_k3", 0.05))


@query(f"WITH {TOKENS_SQL}, x AS (SELECT *, least(exp({_X}) * mask, 1.3) AS w FROM tok), m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS m FROM x) SELECT row_id, t, {r4('w / m', 'weight')} FROM x, m")
def importance_truncated(spark, d):
    return rounded(correction.importance_weights(_corrected(spark, d), "token", 1.3, True).select("row_id", "t", "weight"))


@query(f"WITH {TOKENS_SQL}, x AS (SELECT *, exp(greatest(least(sum(({_X}) * mask) OVER (PARTITION BY row_id), 20), -20)) * mask AS w FROM tok) SELECT row_id, t, {r4('CASE WHEN w BETWEEN 0.5 AND 2 THEN w ELSE 0 END', 'weight')} FROM x")
def importance_sequence_band(spark, d):
    return rounded(correction.importance_weights(_corrected(spark, d), "sequence", "0.5_2.0").select("row_id", "t", "weight"))


@query(f"""WITH {TOKENS_SQL}, x AS (SELECT *, exp({_X}) * mask AS raw, least(exp({_X}) * mask, 1.3) AS w FROM tok), s AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS s FROM x GROUP BY row_id),
    a AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS m1, sum(w * w * mask) / (sum(mask) + 1e-8) AS m2, max(w) FILTER (mask <> 0) AS hi, min(w) FILTER (mask <> 0) AS lo,
        {_MM('CASE WHEN raw > 1.3 THEN 1 ELSE 0 END')} AS fh, {_MM('CASE WHEN raw < 1 / 1.3 THEN 1 ELSE 0 END')} AS fl FROM x),
    b AS (SELECT avg(s) AS sm, stddev_samp(s) AS ss, max(s) AS sx, min(s) AS sn, max(abs(s - 1)) AS sd, avg(CASE WHEN s > 1.3 THEN 1.0 ELSE 0 END) AS sh, avg(CASE WHEN s < 1 / 1.3 THEN 1.0 ELSE 0 END) AS sl FROM s)
    SELECT {r4('m1', 'is_mean')}, {r4('hi', 'is_max')}, {r4('lo', 'is_min')}, {r4('fh', 'fraction_high')}, {r4('fl', 'fraction_low')}, {r4('sqrt(greatest(m2 - m1 * m1, 0))', 'is_std')}, {r4('power(m1 + 1e-8, 2) / m2', 'eff_sample_size')},
    {r4('sm', 'seq_mean')}, {r4('ss', 'seq_std')}, {r4('sx', 'seq_max')}, {r4('sn', 'seq_min')}, {r4('sd', 'seq_max_deviation')}, {r4('sh', 'seq_fraction_high')}, {r4('sl', 'seq_fraction_low')} FROM a, b""")
def importance_metrics(spark, d):
    return rounded(correction.weight_metrics(correction.importance_weights(_corrected(spark, d), "token", 1.3), 1.3))


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT row_id, coalesce(sum(old_logp * mask), 0) / (sum(mask) + 1e-8) AS t, coalesce(sum(rollout_logp * mask), 0) / (sum(mask) + 1e-8) AS r, coalesce(sum(({_X}) * mask), 0) AS x FROM tok GROUP BY row_id),
    a AS (SELECT {_MM('rollout_logp - old_logp')} AS kl, {_MM(_TOKEN['k3'])} AS k3, {_MM(f'exp(2 * ({_X}))')} - 1 AS c FROM tok)
    SELECT {r4('avg(exp(-t))', 'training_ppl')}, {r4('avg(-t)', 'training_log_ppl')}, {r4('any_value(kl)', 'kl')}, {r4('any_value(k3)', 'k3_kl')}, {r4('avg(exp(-r))', 'rollout_ppl')}, {r4('avg(-r)', 'rollout_log_ppl')}, {r4('avg(r - t)', 'log_ppl_diff')},
    {r4('avg(abs(r - t))', 'log_ppl_abs_diff')}, {r4('max(r - t)', 'log_ppl_diff_max')}, {r4('min(r - t)', 'log_ppl_diff_min')}, {r4('avg(exp(r - t))', 'ppl_ratio')}, {r4('any_value(c)', 'chi2_token')}, {r4('avg(exp(2 * greatest(least(x, 20), -20))) - 1', 'chi2_seq')} FROM s, a""")
def offpolicy_metrics(spark, d):
    return rounded(correction.offpolicy_metrics(tokens(spark, d)))


# -- metrics -------------------------------------------------------------------------

_LOG = "log AS (SELECT l_linenumber AS slot, l_suppkey % 4 AS rank, unnest(['loss', 'x/max', 'x/min', 'grad_minmax_diff', 'tokens_sum']) AS name, unnest(['mean', 'max', 'min', 'mean', 'sum']) AS agg, l_quantity AS value, l_orderkey AS seq, l_tax + 1 AS samples FROM lineitem)"


def _log(spark, d):
    li = table(spark, d, "lineitem")
    kinds = [("loss", "mean"), ("x/max", "max"), ("x/min", "min"), ("grad_minmax_diff", "mean"), ("tokens_sum", "sum")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("agg")) for n, a in kinds])).alias("k")
    return li.select(F.col("l_linenumber").alias("slot"), (F.col("l_suppkey") % 4).alias("rank"), each, F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("seq"), (F.col("l_tax") + 1).alias("samples")).select("*", "k.*").drop("k")


@query(f"WITH {_LOG} SELECT name, {r4('''CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END''', 'value')} FROM log GROUP BY name")
def metrics_reduce(spark, d):
    return rounded(metrics.reduce_by_name(_log(spark, d)))


@query(f"WITH {_LOG} SELECT name, {r4('''CASE agg WHEN 'sum' THEN sum(value) WHEN 'min' THEN min(value) WHEN 'max' THEN max(value) ELSE avg(value) END''', 'value')} FROM log GROUP BY name, agg")
def metrics_aggregate(spark, d):
    return rounded(metrics.aggregate_metrics(_log(spark, d)))


@query(f"""WITH {_LOG}, l AS (SELECT rank, slot, name, agg, avg(value) AS value FROM log WHERE slot <= 7 GROUP BY ALL), s AS (SELECT name, agg, slot, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL)
    SELECT name, {r4('''CASE agg WHEN 'sum' THEN sum(m) WHEN 'mean' THEN avg(m) WHEN 'min' THEN min(lo) ELSE max(hi) END''', 'value')} FROM s GROUP BY name, agg""")
def metrics_over_ranks(spark, d):
    l = _log(spark, d).where("slot <= 7").groupBy("rank", "slot", "name", "agg").agg(F.avg("value").alias("value"))
    return rounded(metrics.aggregate_over_ranks(l))


@query(f"WITH {_LOG} SELECT name, {r4('''CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) WHEN name LIKE '%sum%' THEN sum(value) ELSE avg(value) END''', 'value')} FROM log GROUP BY name")
def metrics_roll_up(spark, d):
    return rounded(metrics.roll_up(_log(spark, d)))


_SMP2 = f"{TOKENS_SQL}, s AS (SELECT row_id, sum(reward) AS score, sum(reward) * 0.9 AS reward, sum(mask) AS response_length, row_id % 5 + 1 AS prompt_length FROM tok GROUP BY row_id)"


def _batch_samples(spark, d):
    return tokens(spark, d).groupBy("row_id").agg(F.sum("reward").alias("score"), (F.sum("reward") * 0.9).alias("reward"), F.sum("mask").alias("response_length"), (F.first("row_id") % 5 + 1).alias("prompt_length"))


def _three(c: str, when: str, to: str) -> str:
    return ", ".join(r4(f"{f}({c}) FILTER ({when})", f"{to}_{n}") for f, n in (("avg", "mean"), ("max", "max"), ("min", "min")))


@query(f"""WITH {_SMP2}, a AS (SELECT {_three('score', 'response_length > 0', 'score')}, {_three('reward', 'response_length > 0', 'reward')}, {_three('response_length', 'true', 'response_length')}, {_three('response_length', 'response_length > 0', 'response_length_non_aborted')},
    {_three('prompt_length', 'true', 'prompt_length')}, {r4('avg(CASE WHEN response_length = (SELECT max(response_length) FROM s) THEN 1.0 ELSE 0 END)', 'response_length_clip_ratio')}, {r4('avg(CASE WHEN prompt_length = (SELECT max(prompt_length) FROM s) THEN 1.0 ELSE 0 END)', 'prompt_length_clip_ratio')},
    {r4('avg(CASE WHEN response_length > 0 THEN 0.0 ELSE 1 END)', 'aborted_ratio')} FROM s),
    b AS (SELECT {_three('advantage', 'mask <> 0', 'advantage')}, {_three('reward', 'mask <> 0', 'returns')}, {_three('value', 'mask <> 0', 'value')}, {r4('1 - var_samp(reward - value) FILTER (mask <> 0) / (var_samp(reward) FILTER (mask <> 0) + 1e-5)', 'vf_explained_var')} FROM tok)
    SELECT a.* REPLACE (response_length_max::BIGINT AS response_length_max, response_length_min::BIGINT AS response_length_min, response_length_non_aborted_max::BIGINT AS response_length_non_aborted_max, response_length_non_aborted_min::BIGINT AS response_length_non_aborted_min, prompt_length_max::BIGINT AS prompt_length_max, prompt_length_min::BIGINT AS prompt_length_min), b.* FROM a, b""")
def metrics_batch(spark, d):
    return rounded(metrics.batch_metrics(_batch_samples(spark, d), tokens(spark, d).withColumn("returns", F.col("reward"))))


@query(f"""WITH {_SMP2}, tm AS (SELECT unnest(['gen', 'update', 'step']) AS name, unnest([2.0, 3.0, 6.0]::DOUBLE[]) AS seconds), n AS (SELECT sum(response_length) AS r, sum(prompt_length + response_length) AS a FROM s)
    SELECT name, seconds, {r4("seconds * 1000 / CASE WHEN name = 'gen' THEN r ELSE a END", 'ms_per_token')}, {r4("CASE WHEN name = 'step' THEN a / (seconds * 4) END", 'tokens_per_second')} FROM tm, n""")
def metrics_timing(spark, d):
    timing = spark.createDataFrame([("gen", 2.0), ("update", 3.0), ("step", 6.0)], "name string, seconds double")
    return rounded(metrics.timing_metrics(_batch_samples(spark, d), timing, 4))


@query("""WITH c AS (SELECT o_orderpriority AS name, percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS cut FROM orders GROUP BY 1)
    SELECT o_orderpriority AS name, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(CASE WHEN o_totalprice > cut THEN 1.0 ELSE 0 END), 4) AS share_high FROM orders JOIN c ON name = o_orderpriority GROUP BY 1""")
def metrics_reduce_timing(spark, d):
    return rounded(metrics.reduce_timing(table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("seconds"))))


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT coalesce(sum((1 - 2 * exp(logp) + sum_pi2) * mask), 0) AS w, coalesce(sum(advantage * mask), 0) / (sum(mask) + 1e-8) AS a FROM tok GROUP BY row_id)
    SELECT {r4('avg(a * a * greatest(w, 0))', 'total_power')}, {r4('avg(a * a)', 'expected_a_squared')}, {r4('avg(w)', 'expected_w')}, 0.25::DOUBLE AS signal_strength, {r4('greatest(0, (avg(a * a * greatest(w, 0)) - 0.25) / (count(*) - 1))', 'pure_noise')} FROM s""")
def metrics_variance_proxies(spark, d):
    return rounded(metrics.variance_proxies(tokens(spark, d), 0.5))


@query("""WITH v AS (SELECT o_custkey AS uid, o_orderstatus AS pred, o_totalprice AS score, o_orderkey AS pos FROM orders), c AS (SELECT uid, pred, count(*) AS n, min(pos) AS f, arg_min(score, pos) AS s FROM v GROUP BY ALL)
    SELECT uid, s AS score FROM c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) = 1""")
def metrics_majority(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("pred"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("pos"))
    return metrics.majority(v, ["uid"])


def _validation(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("data_source"), F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("pred"), (F.col("o_totalprice") / 1000).alias("score"), F.col("o_orderkey").alias("pos"))


@query()
def metrics_validation(spark, d):
    return rounded(metrics.core_or_aux(metrics.validation_metrics(_validation(spark, d), vote="pred", draws=200)))


@query("""WITH v AS (SELECT o_orderpriority AS data_source, o_custkey AS uid, o_orderstatus AS p, o_totalprice / 1000 AS v, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) - 1 AS i,
              count(*) OVER (PARTITION BY o_orderpriority, o_custkey) AS n FROM orders),
    sizes AS (SELECT DISTINCT n, least(n, (2 ** e)::BIGINT) AS k FROM v, (SELECT unnest(range(1, 20)) AS e) WHERE n > 1),
    place AS (SELECT n, k, d, j, ('0x' || substr(md5('42/' || n || '/' || k || '/' || d || '/' || j), 1, 8))::BIGINT % n AS i FROM (SELECT n, k, d, unnest(range(k)) AS j FROM (SELECT n, k, unnest(range(200)) AS d FROM sizes))),
    drawn AS (SELECT data_source, uid, place.n, k, d, j, p, v FROM v JOIN place ON v.n = place.n AND v.i = place.i),
    votes AS (SELECT data_source, uid, k, d, p, count(*) AS c, min(j) AS first, arg_min(v, j) AS v, max(v) AS hi, min(v) AS lo FROM drawn GROUP BY ALL),
    each AS (SELECT data_source, uid, k, d, max(hi) AS best, min(lo) AS worst, arg_max(v, c * 1000 - first) AS maj FROM votes GROUP BY ALL),
    long AS (SELECT data_source, uid, s || '@' || k AS m, x FROM (UNPIVOT each ON best, worst, maj INTO NAME s VALUE x)),
    told AS (SELECT data_source, uid, m || '/mean' AS metric, avg(x) AS value FROM long GROUP BY ALL UNION ALL SELECT data_source, uid, m || '/std', stddev_pop(x) FROM long GROUP BY ALL
             UNION ALL SELECT data_source, uid, 'mean@' || n, avg(v) FROM v GROUP BY data_source, uid, n UNION ALL SELECT data_source, uid, 'std@' || n, stddev_pop(v) FROM v WHERE n > 1 GROUP BY data_source, uid, n),
    rolled AS (SELECT data_source, metric, avg(value) AS value, regexp_extract(metric, '@([0-9]+)', 1)::INTEGER AS n FROM told GROUP BY ALL)
    SELECT data_source, metric, round(value, 4) + 0.0 AS value, CASE WHEN n = max(n) OVER (PARTITION BY data_source) AND split_part(metric, '@', 1) IN ('mean', 'maj', 'best') AND NOT ends_with(metric, '/std') THEN 'core' ELSE 'aux' END AS section FROM rolled""")
def metrics_validation_hashed(spark, d):
    return rounded(metrics.core_or_aux(metrics.validation_metrics(_validation(spark, d), vote="pred", draws=200, hashed=True)))


@query("""SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 4) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 4) AS p90,
    round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 4) AS p95, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY value), 4) AS p99, max(value) AS max FROM events GROUP BY event_type""")
def metrics_distribution(spark, d):
    return rounded(metrics.distribution(table(spark, d, "events"), "value", ["event_type"]))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderstatus) < max(o_orderstatus))""")
def metrics_mixed_groups(spark, d):
    return metrics.mixed_groups(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")


@query("""WITH r AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS s FROM orders GROUP BY o_custkey)
    SELECT 'source' || (o_custkey % 7) AS data_source, round(avg(s), 4) + 0.0 AS test_score FROM r GROUP BY 1""")
def eval_by_source(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.collect_list("o_orderstatus").alias("responses"))
    rows = o.withColumn("data_source", F.concat(F.lit("source"), F.col("row_id") % 7)).withColumn("ground_truth", F.lit("F"))
    return rounded(rewards.evaluate(rows, lambda source, said, truth: (said == truth).cast("double")))


# -- reward managers -----------------------------------------------------------------

_RESPONSES = "res AS (SELECT row_id, uid, count(*) AS size, sum(mask) AS n FROM tok GROUP BY row_id, uid), placed AS (SELECT *, CASE WHEN n > 0 THEN n - 1 ELSE size - 1 END AS place FROM res)"


def _responses(spark, d):
    return rollouts(spark, d).select("row_id", "uid", F.col("masks").alias("response_mask"))


def _reward_rows(df, *more):
    """Where a reward stands in its response, and how large it is (never 0 here)."""
    found = F.filter(F.transform(rewards.TOKEN_SCORES, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)
    out = df.select("row_id", *more, F.size(rewards.TOKEN_SCORES).cast("long").alias("size"), F.size(found).cast("long").alias("n_rewards"), F.get(found, F.lit(0)).alias("f"))
    return rounded(out.select("row_id", *more, "size", "n_rewards", F.col("f.i").cast("long").alias("place"), F.col("f.x").alias("reward")))


@query(f"WITH {TOKENS_SQL}, {_RESPONSES} SELECT row_id, uid % 2 = 0 AS even, size, 1::BIGINT AS n_rewards, place::BIGINT AS place, round((uid % 5 + 1) / 4.0::DOUBLE, 4) + 0.0 AS reward FROM placed")
def reward_naive(spark, d):
    return _reward_rows(rewards.naive(_responses(spark, d), (F.col("uid") % 5 + 1) / 4.0, {"even": F.col("uid") % 2 == 0}), "even")


@query(f"WITH {TOKENS_SQL}, {_RESPONSES} SELECT row_id, round((uid % 3 + 1) / 8.0::DOUBLE, 4) + 0.0 AS acc, size, 1::BIGINT AS n_rewards, place::BIGINT AS place, round((uid % 3 + 1) / 8.0::DOUBLE, 4) + 0.0 AS reward FROM placed")
def reward_batch(spark, d):
    return _reward_rows(rewards.get_manager("batch")(_responses(spark, d), (F.col("uid") % 3 + 1) / 8.0), "acc")


@query(f"""WITH {TOKENS_SQL}, {_RESPONSES} SELECT row_id, CASE WHEN uid % 4 = 0 THEN 0.0::DOUBLE ELSE uid % 4 END AS acc, 0.0::DOUBLE AS acc_failed FROM placed""")
def reward_prime(spark, d):
    rows, score = _responses(spark, d), F.when(F.col("uid") % 4 != 0, F.col("uid") % 4)
    good = rewards.all_or_nothing(rows, score, F.lit(False)).select("row_id", "acc")
    failed = rewards.all_or_nothing(rows, score, F.col("uid") % 4 == 0).select("row_id", F.col("acc").alias("acc_failed"))
    return good.join(failed, "row_id")


@query(f"""WITH {TOKENS_SQL}, {_RESPONSES}, p AS (SELECT *, least(0.0::DOUBLE, -(n - (12 - 8)) / 8.0::DOUBLE * 0.5) AS over FROM placed)
    SELECT row_id, 2.5::DOUBLE AS acc, round(over, 4) + 0.0 AS overlong_reward, over < 0 AS overlong, size, 1::BIGINT AS n_rewards, place::BIGINT AS place, round(2.5 + over, 4) + 0.0 AS reward FROM p""")
def reward_dapo(spark, d):
    made = rewards.with_overlong(_responses(spark, d), F.lit(2.5), most=12, buffer=8, factor=0.5, log=True)
    return _reward_rows(made, "acc", "overlong_reward", "overlong")


@query(f"WITH {TOKENS_SQL}, {_RESPONSES} SELECT row_id, uid % 2 AS shape, uid % 3 AS answer, size, 1::BIGINT AS n_rewards, place::BIGINT AS place, (uid % 2 + uid % 3 + 1)::DOUBLE AS reward FROM placed")
def reward_gdpo(spark, d):
    parts = {"shape": F.col("uid") % 2, "answer": F.col("uid") % 3}
    return _reward_rows(rewards.several_scores(_responses(spark, d), F.col("uid") % 2 + F.col("uid") % 3 + 1, parts), "shape", "answer")


@query(f"WITH {TOKENS_SQL} SELECT row_id, round(sum(reward), 4) + 0.0 AS total FROM tok GROUP BY row_id")
def reward_from_model(spark, d):
    rows = rollouts(spark, d).withColumnsRenamed({"rewards": "rm_scores", "masks": "response_mask"})
    return rounded(rewards.naive(rows, F.lit(1.0)).select("row_id", tk.total(F.col(rewards.TOKEN_SCORES)).alias("total")))


@query(f"WITH {TOKENS_SQL} SELECT round(sum(reward * mask) / sum(mask), 4) + 0.0 AS mean FROM tok")
def masked_mean_global(spark, d):
    return rounded(groupwise.global_masked_mean(tokens(spark, d), "reward"))


@query(f"WITH {TOKENS_SQL} SELECT {r4('avg(reward)', 'mean')}, {r4('max(reward)', 'max')}, {r4('min(reward)', 'min')}, {r4('stddev_samp(reward)', 'std')} FROM tok")
def global_extent(spark, d):
    return rounded(groupwise.global_extent(tokens(spark, d), "reward"))


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS gid FROM orders")
def dense_groups(spark, d):
    return groupwise.dense_group_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey", "gid")


@query(f"""WITH {ORDERS_SQL}, n AS (SELECT count(*) AS n FROM ord) SELECT row_id, cust, status, price, FALSE AS is_padding FROM ord
    UNION ALL SELECT n + k, -1, status, 0.0, TRUE FROM (SELECT * FROM ord WHERE row_id = 0), n, (SELECT unnest(range(64)) AS k) WHERE k < (64 - n % 64) % 64""")
def batch_upsample(spark, d):
    return batch.upsample(_orders(spark, d), 64, {"cust": F.lit(-1), "price": F.lit(0.0)})


@query("SELECT list_append([1.5::DOUBLE, 2.5], avg(o_totalprice) - avg(o_totalprice)) AS loss, [count(*)] AS n FROM orders")
def lists_appended(spark, d):
    kept = spark.range(1).select(F.array(F.lit(1.5), F.lit(2.5)).alias("loss"))
    return batch.appended(kept, table(spark, d, "orders").agg((F.avg("o_totalprice") - F.avg("o_totalprice")).alias("loss"), F.count("*").alias("n")))


# -- curation ------------------------------------------------------------------------

_DOCS = "docs AS (SELECT doc_id AS row_id, source AS task_id, lang AS stratum, doc_id % 40 AS trajectory, text FROM documents)"


def _tasks(spark, d, *more):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("task_id"), F.col("lang").alias("stratum"), (F.col("doc_id") % 40).alias("trajectory"), *more)


@query("""WITH t AS (SELECT DISTINCT source AS task_id FROM documents), r AS (SELECT task_id, row_number() OVER (ORDER BY substr(sha256('11/' || task_id), 1, 16), task_id) AS r, count(*) OVER () AS n FROM t)
    SELECT task_id, r <= greatest(1, least(n - 1, round_even(n * 0.25, 0))) AS is_test FROM r""")
def split_by_task(spark, d):
    return curation.task_partition(_tasks(spark, d), 0.25, 11)


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND NOT (source IN ('src3'))")
def split_by_manifest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("task_id"))
    train = spark.createDataFrame([("src1",), ("src2",)], "task_id string")
    test = spark.createDataFrame([("src3",)], "task_id string")
    return curation.split_by_manifest(docs, train, test)[0].select("doc_id", F.col("task_id").alias("source"))


@query(f"""WITH {_DOCS} SELECT row_id, task_id FROM docs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY sha256('5|cap|' || coalesce(task_id, '') || '|' || row_id), row_id) <= 10""")
def cap_by_hash(spark, d):
    return curation.cap_by_hash(_tasks(spark, d), 10, 5, ["task_id"]).select("row_id", "task_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first(spark, d):
    return curation.keep_first(table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


@query(f"""WITH {_DOCS}, a AS (SELECT *, row_number() OVER (PARTITION BY task_id, stratum ORDER BY sha256('3|stratum|' || coalesce(stratum, '') || '|' || row_id), row_id) AS k FROM docs),
    b AS (SELECT *, (row_number() OVER (PARTITION BY task_id ORDER BY k, stratum))::INTEGER AS pick FROM a) SELECT row_id, task_id, stratum, pick FROM b WHERE pick <= 12""")
def round_robin(spark, d):
    return curation.round_robin(_tasks(spark, d), 12, 3).select("row_id", "task_id", "stratum", "pick")


_PICKED = f"""{_DOCS}, turned AS (SELECT *, row_number() OVER (PARTITION BY task_id, stratum ORDER BY sha256('3|stratum|' || coalesce(stratum, '') || '|' || row_id), row_id) AS turn FROM docs),
    picked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY turn, stratum) AS pick FROM turned QUALIFY pick <= 12)"""


#: One trajectory of each task after the other is held out if enough is left to train on.
@query(f"""WITH RECURSIVE {_PICKED}, counted AS (SELECT task_id, trajectory, count(*) AS n FROM picked GROUP BY task_id, trajectory),
    sizes AS (SELECT *, sum(n) OVER (PARTITION BY task_id) AS total, row_number() OVER (PARTITION BY task_id ORDER BY sha256('3|trajectory_split|' || trajectory), trajectory) AS k FROM counted),
    walk(task_id, trajectory, k, held, taken) AS (SELECT task_id, NULL::BIGINT, 0::BIGINT, false, 0::HUGEINT FROM (SELECT DISTINCT task_id FROM sizes)
      UNION ALL SELECT s.task_id, s.trajectory, s.k, total > 8 AND taken < 4 AND total - (taken + n) >= 8, taken + CASE WHEN total > 8 AND taken < 4 AND total - (taken + n) >= 8 THEN n ELSE 0 END FROM walk JOIN sizes s ON s.task_id IS NOT DISTINCT FROM walk.task_id AND s.k = walk.k + 1),
    marked AS (SELECT p.row_id, p.task_id, p.trajectory, CASE WHEN held THEN 'test' ELSE 'train' END AS split FROM picked p JOIN walk w ON p.task_id IS NOT DISTINCT FROM w.task_id AND p.trajectory = w.trajectory)
    SELECT * FROM marked QUALIFY split = 'test' OR row_number() OVER (PARTITION BY task_id, split ORDER BY sha256('3|split|' || coalesce(task_id, '') || '|' || trajectory || '|' || row_id), row_id) <= 8""")
def validation_split(spark, d):
    picked = curation.round_robin(_tasks(spark, d), 12, 3)
    return curation.validation_trajectories(picked, 8, 4, 3).select("row_id", "task_id", "trajectory", "split")


@query(f"""WITH {_DOCS} SELECT row_id, task_id FROM docs QUALIFY row_number() OVER (PARTITION BY task_id, trajectory ORDER BY CASE WHEN lower(coalesce(stratum, '')) <> 'original' THEN 1 ELSE 0 END,
    sha256('2|variant_rank|' || coalesce(task_id, '') || '|' || trajectory || '|' || coalesce(stratum, '') || '|' || row_id), row_id) <= 1""")
def cap_variants(spark, d):
    return curation.cap_variants(_tasks(spark, d), 1, 2, ["task_id", "trajectory"], "stratum").select("row_id", "task_id")


@query("SELECT count(*) FILTER (lang <> 'en') AS not_english, count(*) FILTER (lang = 'en' AND n_chars < 500) AS short, count(*) FILTER (lang = 'en' AND n_chars >= 500) AS kept FROM documents")
def drop_counts(spark, d):
    return curation.drop_counts(table(spark, d, "documents").select("lang", "n_chars"), {"not_english": F.col("lang") == "en", "short": F.col("n_chars") >= 500})


@query("SELECT doc_id, source, regexp_extract(source, '(\\d+)$', 1) AS number FROM documents")
def task_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", curation.task_number(F.col("source")).alias("number"))


@query("""SELECT a.o_orderkey, arg_min(b.o_orderstatus, b.o_orderkey) AS peer FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.o_totalprice >= 300000 GROUP BY a.o_orderkey""")
def peer_solution(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("response"), F.col("o_orderkey").alias("row_id"))
    return curation.peer_solutions(o, 300000).select(F.col("row_id").alias("o_orderkey"), "peer")


@query("SELECT doc_id, source AS task_id, CASE source WHEN 'src5' THEN 0 ELSE 1 END AS pos FROM documents WHERE source IN ('src5', 'src2')")
def lookup_in_order(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("task_id"))
    return curation.lookup_in_order(docs, ["src5", "src2"])


# -- conversations -------------------------------------------------------------------


def _convs(spark, d):
    return messages.conversations(table(spark, d, "conversations"))


_FIRST = "first AS (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations WHERE role <> 'system' GROUP BY conv_id)"


@query(f"""WITH {_FIRST}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS k,
      count(*) FILTER (role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS said FROM conversations)
    SELECT conv_id, k - CASE WHEN first_role = 'assistant' THEN 1 ELSE 0 END AS assistant_turn_index, pos AS source_message_index, pos AS history_size, length(text) AS target_size
    FROM n JOIN first USING (conv_id) WHERE role = 'assistant' AND NOT (first_role = 'assistant' AND said = 1)""")
def expand_turns(spark, d):
    t = messages.expand_turns(_convs(spark, d))
    return t.select("conv_id", "assistant_turn_index", "source_message_index", F.size("history").cast("long").alias("history_size"), F.length("target.content").cast("long").alias("target_size"))


@query(f"""WITH {_FIRST}, c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, coalesce(first_role, '') AS first_role FROM conversations LEFT JOIN first USING (conv_id)),
      kept AS (SELECT *, k - CASE WHEN first_role = 'assistant' THEN 2 ELSE 1 END AS t FROM c WHERE NOT (role = 'assistant' AND first_role = 'assistant' AND k = 1)),
      said AS (SELECT conv_id, p, role, CASE WHEN role = 'assistant' AND t % 2 = 0 THEN '<think>' || chr(10) || 'turn ' || t || chr(10) || '</think>' || chr(10) || text ELSE text END AS content FROM kept
        UNION ALL SELECT conv_id, 0, 'system', 'Be brief.' FROM (SELECT conv_id, arg_min(role, turn) AS r FROM conversations GROUP BY conv_id) WHERE conv_id % 3 = 0 AND r <> 'system')
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS pos, role, content FROM said""")
def sft_messages(spark, d):
    turns = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.struct(F.when(i % 2 == 0, F.concat(F.lit(" turn "), i.cast("string"), F.lit(" "))).alias("thinking_text")))
    direct = F.when(F.col("conv_id") % 2 == 0, F.col("messages"))
    episodes = _convs(spark, d).withColumn("run", F.to_json(F.struct("messages")))
    found = messages.found_messages(direct, F.lit("{}"), F.col("run"))
    prompt = F.when(F.col("conv_id") % 3 == 0, " Be brief. ").otherwise("  ")
    made = episodes.select("conv_id", F.posexplode(messages.training_messages(found, prompt, messages.thoughts_of(turns))).alias("pos", "m"))
    return made.select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


@query(f"""WITH {TOKENS_SQL} SELECT {r4('avg(old_logp + 2) FILTER (mask <> 0)', 'student_mass')}, {r4('min(old_logp + 2) FILTER (mask <> 0)', 'student_mass_min')}, {r4('max(old_logp + 2) FILTER (mask <> 0)', 'student_mass_max')},
    {r4('avg(logp + 2) FILTER (mask <> 0)', 'teacher_mass')}, {r4('min(logp + 2) FILTER (mask <> 0)', 'teacher_mass_min')}, {r4('max(logp + 2) FILTER (mask <> 0)', 'teacher_mass_max')}, {r4('(SELECT sum(greatest(advantage, 0)) FROM tok)', 'loss')} FROM tok""")
def loss_topk_distillation(spark, d):
    t = tokens(spark, d).select("mask", F.col("advantage").alias("loss"), (F.col("old_logp") + 2).alias("student_mass"), (F.col("logp") + 2).alias("teacher_mass"))
    made, told = losses.topk_forward_kl(t)
    return rounded(told.join(made.agg(F.sum("loss").alias("loss"))))


@query("""SELECT conv_id, CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) THEN 'bad_role' WHEN bool_or(role = 'assistant' AND trim(coalesce(text, '')) = '') THEN 'empty_assistant' END AS reason FROM conversations GROUP BY conv_id""")
def protocol_reason(spark, d):
    return _convs(spark, d).select("conv_id", messages.protocol_reason(F.col("messages")).alias("reason"))


@query("SELECT role, count(*) AS segments, sum(length(coalesce(text, '')))::BIGINT AS tokens, round(sum(length(coalesce(text, ''))) / (SELECT sum(length(coalesce(text, ''))) FROM conversations), 4) AS share FROM conversations WHERE length(coalesce(text, '')) > 0 GROUP BY role")
def token_budget(spark, d):
    c = _convs(spark, d)
    sizes, roles = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit("")))), F.transform("messages", lambda m: m["role"])
    whole = c.select(messages.clip_segments(messages.segments(sizes, roles), 10_000_000, F.lit(0)).alias("segments"))
    return rounded(messages.token_budget(whole).withColumn("tokens", F.col("tokens").cast("long")))


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END)::BIGINT AS labelled, sum(length(coalesce(text, '')))::BIGINT AS total FROM conversations GROUP BY conv_id")
def loss_masks(spark, d):
    c = _convs(spark, d)
    sizes, roles = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit("")))), F.transform("messages", lambda m: m["role"])
    m = c.select("conv_id", messages.loss_mask(sizes, roles).alias("m"))
    return m.select("conv_id", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("labelled"), F.size("m").cast("long").alias("total"))


# -- scores --------------------------------------------------------------------------

_SAID = "said AS (SELECT o_orderkey, 'So the total is 1,' || (o_orderkey % 1000) || ' #### ' || (o_orderkey % 10) || ',' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') AS text, ((o_orderkey % 10) * 1000 + o_custkey % 1000 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR AS truth FROM orders)"


def _said(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("So the total is 1,"), k % 1000, F.lit(" #### "), k % 10, F.lit(","), F.lpad((c % 1000).cast("string"), 3, "0"))
    return o.select("o_orderkey", text.alias("text"), ((k % 10) * 1000 + c % 1000 + F.when(k % 3 == 0, 1).otherwise(0)).cast("string").alias("truth"))


@query(f"WITH {_SAID} SELECT o_orderkey, replace(regexp_extract(text, '#### (-?[0-9.,]+)', 1), ',', '') AS answer, CASE WHEN replace(regexp_extract(text, '#### (-?[0-9.,]+)', 1), ',', '') = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM said")
def score_number(spark, d):
    s = _said(spark, d)
    return s.select("o_orderkey", scores.final_number(F.col("text")).alias("answer"), scores.number_score(F.col("text"), F.col("truth")).alias("score"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) = lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part""")
def score_question(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("<answer> The "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")), F.lit("!</answer>"))
    return p.select("p_partkey", scores.qa_score(text, F.array("p_name")).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def score_boxed(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_size")
    text = F.concat(F.lit("thus $\\boxed{\\dfrac{"), k, F.lit("}{"), k + 1, F.lit("}}$"))
    truth = F.when(F.col("p_partkey") % 2 == 0, F.concat(k, F.lit("/"), k + 1)).otherwise(F.lit("0"))
    return p.select("p_partkey", scores.boxed_score(text, truth).alias("score"))


@query("SELECT event_id, round(least(0, -(value - 80) / 20.0), 4) + 0.0 AS penalty FROM events")
def overlong_penalty(spark, d):
    return rounded(table(spark, d, "events").select("event_id", scores.overlong_penalty(F.col("value"), 100, 20).alias("penalty")))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tool_json' WHEN 1 THEN 'tool_functional' ELSE 'plain_text' END AS kind, CASE WHEN event_id % 3 < 2 THEN event_type END AS name FROM events""")
def parsed_actions(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('<think>x</think>{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.col("event_type"), F.lit("(1)"))).otherwise(F.col("event_type"))
    return e.select("event_id", parsing.parse_action(text).alias("a")).select("event_id", "a.kind", "a.name")


@query("""SELECT event_id, 'Doc 1 (Title: ' || event_type || ') ' || props || chr(10) || 'Doc 2 (Title: id) ' || event_id AS rendered,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'transfer' WHEN 'error' THEN 'done' ELSE 'other' END AS role FROM events""")
def rendered_passages(spark, d):
    e = table(spark, d, "events")
    passages = F.array(F.struct(F.col("event_type").alias("title"), F.col("props").alias("text")), F.struct(F.lit("id").alias("title"), F.col("event_id").cast("string").alias("text")))
    kind = F.col("event_type")
    tool = F.when(kind == "view", "get_view").when(kind == "purchase", "book_purchase").when(kind == "signup", "transfer_to_human_agents").when(kind == "error", " Done ").otherwise(kind)
    return e.select("event_id", parsing.numbered_passages(passages).alias("rendered"), parsing.tool_role(tool).alias("role"))


# -- balance, dataset maps, streams --------------------------------------------------


@query("SELECT o_custkey AS row_id, count(*)::BIGINT * 24576 + count(*)::BIGINT * count(*)::BIGINT AS load FROM orders GROUP BY 1")
def workload(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(balance.workload(F.count("*")).alias("load"))


@query()
def balanced_bins(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("row_id")).agg(F.count("*").alias("seqlen"))
    return balance.balance(n, 8, equal_size=False).select("row_id", "seqlen", "bin", "bin_pos")


@query()
def micro_batches(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("row_id")).agg(F.count("*").alias("seqlen"))
    most = n.agg(F.max("seqlen")).first()[0] * 4
    return balance.dynamic_batches(n, most).select("row_id", "seqlen", "bin")


@query("SELECT round((6.0::DOUBLE * (28::DOUBLE * (3584::DOUBLE * 18944 * 3 + 3584 * (3584 + 2 * 512 + 3584)) + 2 * 152064::DOUBLE * 3584) * sum(n) + 6.0 * 128 * 28 * 28 * sum(n * n)) / 10.0 / 1e12, 4) AS tflops FROM (SELECT count(*)::DOUBLE AS n FROM events GROUP BY user_id)")
def model_flops(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"))
    return rounded(balance.flops(n, "n", 10.0, 28, 3584, 28, 4, 128, 18944, 152064))


@query("SELECT conv_id, turn, side, text FROM (SELECT conv_id, turn, unnest(['chosen', 'rejected']) AS side, unnest([text, 'no: ' || text]) AS text FROM conversations WHERE role = 'assistant')")
def preference_unpivot(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    pairs = c.select("conv_id", "turn", F.col("text").alias("chosen"), F.concat(F.lit("no: "), "text").alias("rejected"))
    return datasets.preference_rows(pairs).withColumnRenamed("response", "text")


@query("SELECT conv_id, turn, 'user' AS role, text || ' Answer after ####.' AS content, 'rule' AS style, length(text)::VARCHAR AS ground_truth FROM conversations WHERE role = 'user'")
def prompt_rows(spark, d):
    rows = datasets.prompts(table(spark, d, "conversations").where("role = 'user'"), "conversations", F.concat("text", F.lit(" Answer after ####.")), F.length("text").cast("string"))
    return rows.select("extra_info.index", "turn", F.explode("prompt").alias("p"), "reward_model.*", "conv_id").select("conv_id", "turn", "p.role", "p.content", "style", "ground_truth")


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(length(text), 1001) <= 1000")
def short_prompts(spark, d):
    docs = table(spark, d, "documents")
    return files.short_prompts(docs, F.length("text"), 1000).select("doc_id", "n_chars")


@query("SELECT event_type AS data_source, count(*) AS samples, count(*) FILTER (30 - day(ts) >= 1) AS stale, max(30 - day(ts))::INTEGER AS oldest FROM events GROUP BY 1")
def sample_staleness(spark, d):
    e = table(spark, d, "events").select("event_type", F.dayofmonth("ts").alias("min_version"))
    return sample_queue.staleness(e.withColumnRenamed("event_type", "data_source"), 30, by=["data_source"])


@query("""WITH v AS (SELECT value AS p, day(ts) AS hi, day(ts) - event_id % 3 AS lo FROM events) SELECT count(*) AS samples, round(avg(p), 4) AS time_mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY p), 4) AS time_p50,
    round(percentile_cont(0.95) WITHIN GROUP (ORDER BY p), 4) AS time_p95, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY p), 4) AS time_p99, round(avg(CASE WHEN hi > lo THEN 1.0 ELSE 0 END), 4) AS partial_ratio, max(hi - lo)::BIGINT AS partial_span, count(DISTINCT hi) AS versions FROM v""")
def stream_batch(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("processing_time"), F.dayofmonth("ts").cast("long").alias("max_version"), (F.dayofmonth("ts") - F.col("event_id") % 3).alias("min_version"))
    return rounded(sample_queue.assemble(e))


@query()
def bounded_queue(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 50 == 49, "get").when(F.col("event_id") % 97 == 96, "version").otherwise("put")
    n = F.when(F.col("event_id") % 50 == 49, 20).otherwise((F.col("event_id") / 97).cast("int"))
    log = e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("sample_id"), n.alias("n"))
    return sample_queue.run_queue_batch(log, 64)


@query("""WITH l AS (SELECT 'p' || (o_custkey % 3) AS partition, o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failure' ELSE CASE WHEN o_custkey % 20 < 10 THEN 'success' ELSE 'running' END END AS tag, o_custkey % 20 AS step, o_orderkey AS version FROM orders),
    n AS (SELECT partition, key, arg_max(tag, version) AS tag, arg_max(step, version) AS step FROM l GROUP BY ALL), d AS (SELECT step FROM n WHERE partition = 'p1' GROUP BY step HAVING count(*) FILTER (tag = 'running') = 0)
    SELECT key, step FROM n WHERE partition = 'p1' AND tag = 'success' AND step IN (SELECT step FROM d)""")
def replay_ready(spark, d):
    o = table(spark, d, "orders")
    tag = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failure").when(F.col("o_custkey") % 20 < 10, "success").otherwise("running")
    log = o.select(F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("partition"), F.col("o_custkey").alias("key"), tag.alias("tag"), (F.col("o_custkey") % 20).alias("step"), F.col("o_orderkey").alias("version"))
    return replay.ready(replay.latest(log), "p1").select("key", "step")


@query()
def bucket_delays(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.unix_timestamp("ts") / 1000.0).alias("at"), F.col("value").alias("tokens"))
    return replay.bucket_delays(e, 1.0, 100.0)


# -- flagship ------------------------------------------------------------------------


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT uid, row_id, sum(reward * mask) AS score, sum(mask) AS n FROM tok GROUP BY uid, row_id),
    a AS (SELECT *, CASE WHEN count(*) OVER g > 1 THEN (score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-6) ELSE score / (1 + 1e-6) END AS adv FROM s WINDOW g AS (PARTITION BY uid))
    SELECT uid, count(*) AS samples, {r4('avg(score)', 'score_mean')}, {r4('max(score)', 'score_max')}, {r4('max(adv)', 'adv_max')}, sum(n)::BIGINT AS tokens FROM a GROUP BY uid""")
def training_step(spark, d):
    """Score, group-relative advantage and roll-up of every group of a step."""
    s = tokens(spark, d).groupBy("uid", "row_id").agg(F.coalesce(F.sum(F.when(F.col("mask") != 0, F.col("reward"))), F.lit(0.0)).alias("score"), F.sum("mask").alias("n"))
    a = advantage.grpo(s)
    return rounded(a.groupBy("uid").agg(F.count("*").alias("samples"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.max("advantage").alias("adv_max"), F.sum("n").alias("tokens")))


from . import loss_queries as _loss_queries  # noqa: E402, F401  they register their queries here
from . import text_queries as _text_queries  # noqa: E402, F401
from . import training_queries as _training_queries  # noqa: E402, F401

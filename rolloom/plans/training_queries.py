"""Queries of what surrounds a training loop: rewards of the user's own, samplers, ragged
columns, growing datasets, staleness, diagnostics and leaks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import ragged
from ..operators import advantage, diagnostics, rewards, sampling
from ..sources.extern import custom_score
from ..streaming import growing
from ..streaming import queue as sample_queue
from .queries import query, r4
from .standins import ORDERS_SQL, TOKENS_SQL, numbered_orders, rollouts, rounded, table

USER_CODE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "user_code.py")


# -- rewards -------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS row_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'assistant'),
    s AS (SELECT *, ends_with(t, 'e.') AS hit, 0.5 * CASE WHEN ends_with(t, 'e.') THEN 1 ELSE 0 END + greatest(0, 0.5 - n / 1000.0::DOUBLE) + 0.25 AS score FROM c)
    SELECT row_id, hit AS "right", n AS size, round(score, 4) + 0.0 AS acc, round(score, 4) + 0.0 AS reward, n % 7 AS place FROM s""")
def reward_custom(spark, d):
    """A user's function, by file and name, scores texts through a manager."""
    score = custom_score(USER_CODE, "brevity", {"most": 500, "bonus": 0.25}, {"right": "boolean", "size": "bigint"})
    c = table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a response of as many tokens as the text's length tells, the last of them padding
    valid = F.length("text") % 7 + 1
    batch = c.withColumn("response_mask", F.concat(F.array_repeat(F.lit(1), valid), F.array_repeat(F.lit(0), 7 - valid))).withColumn("s", score(F.lit("custom"), F.col("text"), F.lit("e.")))
    made = rewards.get_manager("batch")(batch, F.col("s.score"), {"right": F.col("s.right"), "size": F.col("s.size")})
    place = F.array_position(F.transform("token_level_scores", lambda x: (x != 0).cast("int")), 1) - 1
    return rounded(made.select("row_id", "right", "size", "acc", F.aggregate("token_level_scores", F.lit(0.0), lambda a, x: a + x).alias("reward"), place.alias("place")))


# -- advantages ----------------------------------------------------------------------


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT row_id, uid, sum(reward) AS s FROM tok GROUP BY row_id, uid), g AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS m, stddev_samp(s) OVER w AS d FROM s WINDOW w AS (PARTITION BY uid))
    SELECT row_id, t, {r4("CASE WHEN n > 1 THEN (s - m) / (d + 1e-6) ELSE s / (1 + 1e-6) END * mask", "advantage")} FROM g JOIN tok USING (row_id, uid)""")
def batch_advantages(spark, d):
    """A wide batch through the estimator of its name, back as arrays."""
    batch = rollouts(spark, d).select("row_id", "uid", F.col("rewards").alias("token_level_rewards"), F.col("masks").alias("response_mask"))
    made = advantage.advantages_of(batch, "grpo", epsilon=1e-6, gamma=0.9)
    return rounded(made.select("row_id", F.posexplode("advantages").alias("t", "advantage")).withColumn("t", F.col("t").cast("long")))


# -- samplers ------------------------------------------------------------------------

_KEY = "-ln((('0x' || substr(md5({seed} || '/' || row_id), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / ({weight})"


@query(f"WITH {ORDERS_SQL}, k AS (SELECT row_id, {_KEY.format(seed=chr(39) + '9' + chr(39), weight='price / 1000')} AS key FROM ord) SELECT row_id, row_number() OVER (ORDER BY key, row_id) - 1 AS place FROM k QUALIFY place < 700")
def weighted_sample(spark, d):
    return sampling.weighted_sample(numbered_orders(spark, d), 700, F.col("price") / 1000, 9).select("row_id", "place")


_RATE = "(coalesce({h}, 0) + 1.0) / (coalesce({n}, 0) + 2.0)"


@query(f"""WITH {ORDERS_SQL}, t AS (SELECT row_id, cust % 25 AS task, price > 60000 + cust % 25 * 8000 AS hit FROM ord),
    one AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format(seed="'4/0'", weight='0.25 + 0.02')}, row_id) - 1 AS place FROM t QUALIFY place < 400),
    first AS (SELECT task, count(*) AS n, count(*) FILTER (hit) AS h FROM one GROUP BY task),
    two AS (SELECT t.*, row_number() OVER (ORDER BY {_KEY.format(seed="'4/1'", weight=_RATE.format(h='h', n='n') + ' * (1 - ' + _RATE.format(h='h', n='n') + ') + 0.02')}, row_id) - 1 AS place FROM t LEFT JOIN first USING (task) QUALIFY place < 400)
    SELECT 0 AS step, row_id, place FROM one UNION ALL SELECT 1, row_id, place FROM two""")
def curriculum(spark, d):
    """Two steps of a curriculum that learns from the first."""
    rows = numbered_orders(spark, d).select("row_id", (F.col("cust") % 25).alias("task_id"), (F.col("price") > 60000 + F.col("cust") % 25 * 8000).alias("success"))
    sampler = sampling.create_sampler(seed=4, path=f"pkg://{sampling.__name__}", name="SuccessCurriculum")
    one = sampler.draw(rows, 400, 0)
    sampler.update(one)
    two = sampler.draw(rows, 400, 1)
    return one.select(F.lit(0).alias("step"), "row_id", "place").unionByName(two.select(F.lit(1).alias("step"), "row_id", "place"))


# -- ragged columns ------------------------------------------------------------------


@query(f"""WITH {TOKENS_SQL}, seq AS (SELECT uid, row_id, list(round(reward, 4) + 0.0 ORDER BY t) AS r FROM tok GROUP BY uid, row_id), l AS (SELECT uid, list(r ORDER BY row_id) AS r FROM seq GROUP BY uid),
    cut AS (SELECT uid, r, list_concat(r[2:], r[:2]) AS turned FROM l)
    SELECT uid, len(flatten(r))::BIGINT AS n_values, list_sum(list_transform(r, lambda x, i: i * len(x)))::BIGINT AS weighted, flatten(turned) AS turned, list_transform(turned, lambda x: len(x)::BIGINT) AS lengths,
           list_transform(r, lambda x: list_concat(x[:3], list_transform(range(greatest(0, 3 - len(x))), lambda j: -1.0::DOUBLE))) AS padded, flatten(list_transform(r, lambda x: x[len(x) - len(x) // 2 : len(x) - 1])) AS responses, ceil(len(r) / 2.0)::BIGINT AS parts, true AS sound FROM cut""")
def ragged_columns(spark, d):
    """Sequences of a user as one ragged value: cut, joined the other way round, padded, split."""
    seq = rollouts(spark, d).select("uid", "row_id", F.transform("rewards", lambda x: F.round(x, 4) + 0.0).alias("r"))
    rows = seq.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "r"))), lambda x: x["r"]).alias("lists"))
    rows = rows.withColumn("x", ragged.from_lists(F.col("lists")))
    x = F.col("x")
    turned = ragged.concat(ragged.take(x, F.lit(1), ragged.count(x)), ragged.take(x, F.lit(0), F.lit(2)))
    rows = rows.withColumn("y", turned).withColumn("half", F.transform(ragged.lengths(x), lambda n: F.floor(n / 2)))
    sizes = ragged.lengths(x)
    weighted = F.aggregate(F.transform(sizes, lambda n, i: n * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select(
        "uid", F.size("x.values").cast("long").alias("n_values"), weighted.alias("weighted"), F.col("y.values").alias("turned"), ragged.lengths(F.col("y")).alias("lengths"), ragged.to_padded(x, -1.0, 3).alias("padded"),
        F.flatten(ragged.to_lists(ragged.responses(x, F.col("half")))).alias("responses"), F.size(ragged.split(x, 2)).cast("long").alias("parts"), (ragged.is_sound(x) & ragged.is_sound(F.col("y")) & (ragged.to_lists(x) == F.col("lists"))).alias("sound"),
    )


# -- growing datasets ----------------------------------------------------------------


def _scratch(spark) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="rolloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/rolloom/growing-{uuid.uuid4().hex}"


@query(f"""WITH {ORDERS_SQL}, base AS (SELECT row_id, price FROM ord), one AS (SELECT row_id, price * 2 AS price FROM base WHERE price < 20000), two AS (SELECT row_id, price * 2 AS price FROM (FROM base UNION ALL FROM one) WHERE price < 20000)
    SELECT row_id, round(price, 2) + 0.0 AS price, count(*) AS times FROM (FROM base UNION ALL FROM one UNION ALL FROM two) GROUP BY ALL""")
def growing_dataset(spark, d):
    """Orders, and twice what a generator makes of the rows so far; each batch is sent twice."""
    data = growing.GrowingDataset(spark, _scratch(spark))
    base = numbered_orders(spark, d).select("row_id", "price")
    maker = growing.load_generator(USER_CODE, "Echo", below=20000)
    for _ in range(2):
        data.append(base, 0)
    for step in (1, 1, 2, 2):
        data.grow(maker, step)
    return data.read().groupBy("row_id", (F.round("price", 2) + 0.0).alias("price")).agg(F.count(F.lit(1)).alias("times"))


@query("""WITH e AS (SELECT user_id AS queue, event_id AS seq, CASE event_type WHEN 'view' THEN 'put' WHEN 'click' THEN 'put' WHEN 'purchase' THEN 'get' WHEN 'signup' THEN 'version' ELSE event_type END AS kind, epoch(ts) AS ts FROM events),
    w AS (SELECT *, sum(CASE kind WHEN 'put' THEN 1 WHEN 'get' THEN -1 ELSE 0 END) OVER a AS waiting, max(CASE WHEN kind = 'version' THEN seq END) OVER a AS reset FROM e WINDOW a AS (PARTITION BY queue ORDER BY seq)),
    v AS (SELECT queue, seq AS reset, waiting AS held FROM w WHERE kind = 'version'),
    c AS (SELECT w.*, coalesce(held, 0) + count(*) FILTER (kind = 'put') OVER (PARTITION BY w.queue, w.reset ORDER BY seq) AS stale FROM w LEFT JOIN v ON w.queue = v.queue AND w.reset = v.reset)
    SELECT queue, seq, waiting::BIGINT AS waiting, stale::BIGINT AS stale_samples FROM c""")
def staleness_since_reset(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "put").when(F.col("event_type") == "purchase", "get").when(F.col("event_type") == "signup", "version").otherwise(F.col("event_type"))
    made = sample_queue.since_reset(e.select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), kind.alias("kind"), F.unix_timestamp("ts").alias("ts")))
    return made.select("queue", "seq", F.col("waiting").cast("long").alias("waiting"), F.col("stale_samples").cast("long").alias("stale_samples"))


# -- diagnostics ---------------------------------------------------------------------

_RUNS = """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS reward, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE '' END AS parse_error, CASE WHEN o_orderkey % 11 = 0 THEN 'max_steps' ELSE 'done' END AS reason,
    o_orderkey % 6 AS q, o_orderkey % 4 AS c, o_orderkey % 6 = 2 AS db, o_custkey AS cust, CASE o_orderkey % 3 WHEN 0 THEN 'read_and_stall' WHEN 1 THEN 'invalid_escalation' ELSE 'unknown' END AS kind,
    CASE o_orderkey % 6 WHEN 0 THEN '{"action_checks":[1]}' WHEN 1 THEN '{"communicate_checks":[],"info":{"communicate":{"a":1}}}' WHEN 2 THEN '{"db_check":{"db_match":true}}' WHEN 3 THEN '{"nl_assertions":{"x":1}}'
      WHEN 4 THEN '{"info":{"note":"Stopped: max_steps"}}' ELSE '{}' END AS info FROM orders"""


@query(f"""WITH r AS ({_RUNS}), f AS (SELECT *, CASE WHEN reward >= 1 THEN [] ELSE list_filter([CASE WHEN parse_error <> '' OR q = 0 THEN 'ACTION' END, CASE WHEN q = 1 THEN 'COMMUNICATION' END, CASE WHEN q = 2 THEN 'ENV' END, CASE WHEN q = 3 THEN 'NL_ASSERTION' END,
      CASE WHEN q = 4 OR reason = 'max_steps' THEN 'TERMINATION' END], lambda x: x IS NOT NULL) END AS found, CASE kind WHEN 'read_and_stall' THEN 'high' WHEN 'invalid_escalation' THEN 'medium' ELSE 'low' END AS sure,
      CASE c WHEN 1 THEN 'user_id=' || cust WHEN 2 THEN 'reservation_id=' || row_id END AS risk, c IN (1, 2) AS a, c IN (2, 3) OR kind = 'invalid_escalation' AS b, c = 2 AND db AS w, reward >= 1 OR db AS v FROM r),
    g AS (SELECT *, CASE WHEN reward < 1 AND len(found) = 0 THEN 'UNKNOWN' ELSE array_to_string(found, ', ') END AS parts FROM f)
    SELECT row_id, parts AS components, risk AS at_risk, sure AS confidence, md5('Diagnostic feedback:' || chr(10) || 'Primary failure: ' || kind || '.' || chr(10) || 'Failure stage: x.' || chr(10) || 'Workflow status: information_gathered=' || t(a) || ', required_decision_made=' || t(b)
      || ', required_write_action_completed=' || t(w) || ', final_state_verified=' || t(v) || '.' || chr(10) || 'Failed components: ' || parts || '.' || chr(10) || 'Entity or record at risk: ' || coalesce(risk, 'None') || '.' || chr(10) || 'Terminal reason: ' || reason || '; confidence=' || sure) AS feedback FROM g""".replace("t(a)", "CASE WHEN a THEN 'True' ELSE 'False' END").replace("t(b)", "CASE WHEN b THEN 'True' ELSE 'False' END").replace("t(w)", "CASE WHEN w THEN 'True' ELSE 'False' END").replace("t(v)", "CASE WHEN v THEN 'True' ELSE 'False' END"))
def diagnostic_feedback(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_RUNS)
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("arguments"))
    none, user = F.lit("{}"), F.concat(F.lit('{"user_id": "'), F.col("cust").cast("string"), F.lit('"}'))
    booked = F.concat(F.lit('{"reservation_id": "'), F.col("row_id").cast("string"), F.lit('"}'))
    calls = F.when(F.col("c") == 1, F.array(call("get_user_details", user))).when(F.col("c") == 2, F.array(call("search_flights", none), call("cancel_reservation", booked))).when(F.col("c") == 3, F.array(call("transfer_to_human_agents", none)))
    rows = rows.withColumn("calls", F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")))
    parts = diagnostics.failed_components(F.col("info"), F.col("reward"), F.col("parse_error"), F.col("reason"))
    work = diagnostics.workflow_status(F.col("calls"), F.col("kind"), F.col("reward"), F.col("db"))
    rows = rows.withColumns({"parts": parts, "work": work, "at_risk": diagnostics.record_at_risk(F.col("calls"))})
    text = diagnostics.render_feedback("plain", F.col("kind"), F.lit("x"), F.col("work"), F.col("parts"), F.col("at_risk"), F.col("reason"))
    diagnostics.assert_no_leak(rows.select("row_id", text.alias("text")), "text", "row_id")
    return rows.select("row_id", F.array_join("parts", ", ").alias("components"), "at_risk", diagnostics.confidence(F.col("kind")).alias("confidence"), F.md5(text).alias("feedback"))


@query("""WITH p AS (SELECT DISTINCT lower(substr(text, 1, 40)) AS pattern FROM benchmark WHERE length(text) > 0), d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, pattern, ((length(t) - length(replace(t, pattern, ''))) / length(pattern))::BIGINT AS places FROM d JOIN p ON contains(t, pattern)""")
def leaks(spark, d):
    """Which documents hold the first 40 characters of a benchmark item."""
    patterns = table(spark, d, "benchmark").select(F.substring("text", 1, 40).alias("pattern"))
    return diagnostics.leaks(table(spark, d, "documents"), patterns, "text", "doc_id")

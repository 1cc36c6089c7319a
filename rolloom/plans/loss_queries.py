"""Queries of distillation losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distillation
from .queries import query, r4
from .standins import TOKENS_SQL, rounded, tokens

VOCABULARY = 40


def _listed(spark, d):
    """Tokens with the teacher's four likeliest and the student's six, three in common."""
    t = tokens(spark, d)
    at = F.col("t") * 3 + F.col("uid")
    ids = lambda steps: F.array(*[(at + k) % VOCABULARY for k in steps])
    return t.withColumns(
        {
            "teacher_ids": ids(range(0, 8, 2)), "teacher_logprobs": F.array(*[F.log(F.lit((4 - k) / 12.0)) + F.col("logp") / 50 for k in range(4)]),
            "student_ids": ids(range(6)), "student_logits": F.array(*[F.lit(1.5 - 0.3 * k) + F.col("old_logp") for k in range(6)]), "student_rest": 0.2 + F.col("rollout_logp"),
        }
    )


_TOPK = f"""WITH {TOKENS_SQL}, n AS (SELECT *, ln(exp(1.5 + old_logp) + exp(1.2 + old_logp) + exp(0.9 + old_logp) + exp(0.6 + old_logp) + exp(0.3 + old_logp) + exp(old_logp) + exp(0.2 + rollout_logp)) AS norm FROM tok),
    p AS (SELECT n.*, ln((4 - k) / 12.0::DOUBLE) + logp / 50 AS te, CASE WHEN k < 3 THEN 1.5 - 0.6 * k + old_logp ELSE 0.2 + rollout_logp - ln(34.0::DOUBLE) END - norm AS st FROM n, (SELECT unnest([0, 1, 2, 3]) AS k)),
    d AS (SELECT row_id, t, any_value(mask) AS mask, any_value(logp) AS logp, any_value(old_logp) AS old_logp, any_value(advantage) AS advantage, sum(exp(te)) AS tm, sum(exp(st)) AS sm,
                 greatest(0, sum(exp(greatest(te, -2)) * (greatest(te, -2) - greatest(st, -2)))) AS raw FROM p GROUP BY row_id, t),
    x AS (SELECT *, least(raw, 0.4) AS held, exp(greatest(least(logp - old_logp, 20), -20)) AS ratio FROM d)"""
_TOLD = f"{r4('min(raw) FILTER (mask <> 0)', 'loss_min')}, {r4('max(raw) FILTER (mask <> 0)', 'loss_max')}, " + ", ".join(r4(f"{f}({c}) FILTER (mask <> 0)", f"{n}{e}") for n, c in (("student_mass", "sm"), ("teacher_mass", "tm")) for f, e in (("avg", ""), ("min", "_min"), ("max", "_max")))


@query(f"{_TOPK} SELECT {r4('sum(held * mask) / sum(mask)', 'loss')}, {r4('sum(held * mask) / sum(mask)', 'distillation_loss')}, {_TOLD} FROM x")
def distillation_topk(spark, d):
    return rounded(distillation.distil(_listed(spark, d), "forward_kl_topk", most=0.4, least=-2.0, unlisted=VOCABULARY - 6))


def _clipped(adv: str, where: str = "") -> str:
    worst = f"greatest(-({adv}) * ratio, -({adv}) * greatest(least(ratio, 1.2), 0.8))"
    return f"sum(CASE WHEN ({adv}) < 0 THEN least(-({adv}) * 3, {worst}) ELSE {worst} END * mask) / sum(mask)"


@query(f"{_TOPK} SELECT {r4(_clipped('-held'), 'distillation_loss')}, {r4(_clipped('advantage'), 'task_loss')}, {r4(_clipped('advantage') + ' + 0.5 * ' + _clipped('-held'), 'loss')}, {_TOLD} FROM x")
def distillation_policy(spark, d):
    made = distillation.distil(_listed(spark, d), "forward_kl_topk", most=0.4, least=-2.0, unlisted=VOCABULARY - 6, policy="vanilla", task_rewards=True, coefficient=0.5)
    names = [c for c in made.columns if not c.startswith(("pg_", "ppo_", "distillation_pg", "distillation_ppo"))]
    return rounded(made.select(*names))

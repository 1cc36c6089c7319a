"""What a user might bring: a reward function, a sampler and a generator of their own."""

from rolloom.operators.sampling import SuccessCurriculum
from rolloom.streaming.growing import Generator


def brevity(data_source, solution_str, ground_truth, extra_info, most=100, bonus=0.0):
    """Half a point for ending as the truth does, and what the length leaves of the rest."""
    text = solution_str or ""
    right = bool(ground_truth) and text.endswith(ground_truth)
    return {"score": 0.5 * right + max(0.0, 0.5 - len(text) / (2 * most)) + bonus, "right": right, "size": len(text)}


async def lengthy(data_source, solution_str, ground_truth, extra_info):
    return len(solution_str or "")


class EvenCurriculum(SuccessCurriculum):
    """Draws all tasks alike."""

    def weighted(self, df):
        return super().weighted(df).withColumn("weight", df[self.row] * 0 + 1.0)


class Echo(Generator):
    """The cheap rows again, at twice the price."""

    def __init__(self, below=0.0):
        self.below = below

    def generate(self, rows):
        return rows.where(rows.price < self.below).withColumn("price", rows.price * 2)

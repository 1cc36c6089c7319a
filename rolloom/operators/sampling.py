"""Which rows a training step takes: in order, shuffled, by weight, or by a curriculum.

Random order is a hash of a row's key, so reruns agree and nothing depends on partitions.
Sampling by weight without replacement gives each row an exponential key, minus the
logarithm of its uniform number by its weight: the rows with the smallest keys are such a
sample, in its order."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.extern import load_extern
from ..sources.stable import stable
from .batch import number_rows

#: So many rows are taken by a bounded heap a task; more are sorted by range.
MOST_HEAP = 100_000


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in (0, 1] by hash of the seed and a key."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / float(1 << 52)


def weighted_sample(df: DataFrame, k: int, weight: Column, seed: int | str = 0, row: str = "row_id") -> DataFrame:
    """``k`` rows without replacement by weight (all that have any, if fewer), and ``place``,
    their order from 0. Rows of no, null or negative weight are never drawn."""
    keyed = df.withColumn("__w", weight.cast("double")).where("__w > 0").withColumn("__k", -F.log(uniform(seed, F.col(row))) / F.col("__w"))
    if k <= MOST_HEAP:
        some = keyed.orderBy("__k", row).limit(k)
    else:
        ranked = number_rows(keyed.select(F.col(row).alias("__row"), "__k"), "__k", "__row").where(F.col("row_id") < k)
        some = keyed.join(ranked.select("__row"), F.col(row) == F.col("__row"), "left_semi")
    placed = number_rows(some.select(F.col(row).alias("__row"), "__k"), "__k", "__row").select("__row", F.col("row_id").alias("place"))
    return some.drop("__w", "__k").join(placed, F.col(row) == F.col("__row")).drop("__row")


class Sampler(ABC):
    """Gives the rows of a dataset their places in an epoch."""

    def __init__(self, seed: int = 0, row: str = "row_id") -> None:
        self.seed, self.row = seed, row

    @abstractmethod
    def order(self, df: DataFrame, epoch: int = 0) -> DataFrame:
        """``df`` with ``place`` from 0; a run that was broken off goes on at a later place."""


class Sequential(Sampler):
    def order(self, df: DataFrame, epoch: int = 0) -> DataFrame:
        return _placed(df, self.row, F.col(self.row))


class Shuffled(Sampler):
    def order(self, df: DataFrame, epoch: int = 0) -> DataFrame:
        return _placed(df, self.row, uniform(f"{self.seed}/{epoch}", F.col(self.row)))


def _placed(df: DataFrame, row: str, key: Column) -> DataFrame:
    placed = number_rows(df.select(F.col(row).alias("__row"), key.alias("__k")), "__k", "__row").select("__row", F.col("row_id").alias("place"))
    return df.join(placed, F.col(row) == F.col("__row")).drop("__row")


class Curriculum(Sampler):
    """A sampler that learns from the batches it has given."""

    @abstractmethod
    def update(self, batch: DataFrame) -> None:
        """Take the outcome of a batch into account."""

    @abstractmethod
    def draw(self, df: DataFrame, k: int, step: int) -> DataFrame:
        """The rows of a step, with ``place``."""


class SuccessCurriculum(Curriculum):
    """Draws tasks that are neither mastered nor hopeless: by ``p * (1 - p)`` of a task's rate
    of success so far, which starts from ``prior`` successes in ``prior_n`` trials, and
    ``floor`` besides. Counts are a table, a row a task, written after each update."""

    def __init__(self, seed: int = 0, row: str = "row_id", task: str = "task_id", success: str = "success", floor: float = 0.02, prior: float = 1.0, prior_n: float = 2.0) -> None:
        super().__init__(seed, row)
        self.task, self.success, self.floor, self.prior, self.prior_n = task, success, floor, prior, prior_n
        self.counts: DataFrame | None = None

    def update(self, batch: DataFrame) -> None:
        hits = F.coalesce(F.col(self.success).cast("double"), F.lit(0.0))
        fresh = batch.groupBy(F.col(self.task).alias("__task")).agg(F.count(F.lit(1)).alias("n"), F.sum(hits).alias("hits"))
        both = fresh if self.counts is None else fresh.unionByName(self.counts).groupBy("__task").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        self.counts = stable(both, "curriculum")

    def weighted(self, df: DataFrame) -> DataFrame:
        """``df`` with the ``weight`` of each row's task."""
        if self.counts is None:
            known = df.withColumns({"__n": F.lit(0), "__hits": F.lit(0.0)})
        else:
            counts = self.counts.select("__task", F.col("n").alias("__n"), F.col("hits").alias("__hits"))
            known = df.join(counts, df[self.task].eqNullSafe(F.col("__task")), "left").drop("__task")
        p = (F.coalesce("__hits", F.lit(0.0)) + self.prior) / (F.coalesce("__n", F.lit(0)) + self.prior_n)
        return known.withColumn("weight", p * (1 - p) + self.floor).drop("__n", "__hits")

    def draw(self, df: DataFrame, k: int, step: int) -> DataFrame:
        return weighted_sample(self.weighted(df), k, F.col("weight"), f"{self.seed}/{step}", self.row)

    def order(self, df: DataFrame, epoch: int = 0) -> DataFrame:
        weighted = self.weighted(df)
        return _placed(weighted.drop("weight"), self.row, F.lit(0)) if weighted.isEmpty() else self._by_weight(weighted, epoch)

    def _by_weight(self, weighted: DataFrame, epoch: int) -> DataFrame:
        keyed = weighted.withColumn("__e", -F.log(uniform(f"{self.seed}/{epoch}", F.col(self.row))) / F.col("weight"))
        return _placed(keyed, self.row, F.col("__e")).drop("__e", "weight")


def create_sampler(shuffle: bool = True, seed: int = 0, path: str | None = None, name: str | None = None, workers: int = 0, **options) -> Sampler:
    """A sampler: the class ``name`` of ``path`` if given, else shuffled or in order. Reading
    ahead (``workers``) would take rows before a curriculum has learned from the last ones."""
    if path is not None:
        kind = load_extern(path, name or "")
        if not (isinstance(kind, type) and issubclass(kind, Sampler)):
            raise TypeError(f"{name} of {path} is no sampler")
        if issubclass(kind, Curriculum) and workers:
            raise ValueError("a curriculum reads nothing ahead")
        return kind(seed=seed, **options)
    return (Shuffled if shuffle else Sequential)(seed=seed, **options)



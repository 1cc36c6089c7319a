"""A bounded sample queue with drop-oldest, as state of a stream, and its plain twin.

The stream has one key for each queue; state holds the waiting samples and the counters.
A row of kind "put" adds a sample, "get" takes ``n`` of them once there are so many (the
count gate of a trainer), "version" moves the model's version on and "close" ends it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "queue string, event string, sample_id string, staleness int, waiting int, produced long, consumed long, dropped long"
STATE = "samples array<string>, versions array<int>, version int, produced long, consumed long, dropped long, wanted int, closed boolean"


class SampleQueue:
    """First in, first out; a full queue drops its oldest sample."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.version, self.closed, self.wanted = capacity, 0, False, 0
        self.waiting: deque[tuple[str, int]] = deque()
        self.produced = self.consumed = self.dropped = 0

    def put(self, sample: str, version: int) -> bool:
        """False if a sample had to go for it."""
        if self.closed:
            return False
        full = len(self.waiting) >= self.capacity
        if full:
            self.waiting.popleft()
            self.dropped += 1
        self.waiting.append((sample, version))
        self.produced += 1
        return not full

    def get(self, n: int) -> list[tuple[str, int]] | None:
        """``n`` samples and how many versions old each is; None until there are so many
        (after the end: whatever is left)."""
        if len(self.waiting) < n and not self.closed:
            return None
        out = [self.waiting.popleft() for _ in range(min(n, len(self.waiting)))]
        self.consumed += len(out)
        return [(s, self.version - v) for s, v in out]

    def statistics(self) -> dict[str, int]:
        return {"waiting": len(self.waiting), "produced": self.produced, "consumed": self.consumed, "dropped": self.dropped}

    def step(self, kind: str, sample: str | None, n: int) -> Iterator[tuple]:
        """Apply one event; yields ``event, sample, staleness``."""
        if kind == "put":
            self.put(sample, n)
        elif kind == "get":
            self.wanted += n
        elif kind == "version":
            self.version = n
        elif kind == "close":
            self.closed = True
        if self.wanted and (got := self.get(self.wanted)) is not None:
            self.wanted = 0
            for s, age in got:
                yield "taken", s, age

    def dump(self) -> tuple:
        return [s for s, _ in self.waiting], [v for _, v in self.waiting], self.version, self.produced, self.consumed, self.dropped, self.wanted, self.closed

    @classmethod
    def load(cls, capacity: int, state: tuple) -> SampleQueue:
        out = cls(capacity)
        samples, versions, out.version, out.produced, out.consumed, out.dropped, out.wanted, out.closed = state
        out.waiting = deque(zip(samples, versions, strict=True))
        return out


def run_queue(events: DataFrame, capacity: int) -> DataFrame:
    """The queue over a stream of ``queue, seq, kind, sample_id, n``: a row for each sample
    that is taken, and one "state" row for each batch with the counters."""

    def work(key, batches: Iterable[pd.DataFrame], state):
        q = SampleQueue.load(capacity, state.get) if state.exists else SampleQueue(capacity)
        rows = []
        events = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        for e in events.itertuples(index=False):
            rows += [(key[0], *told) for told in q.step(e.kind, e.sample_id, int(e.n))]
        rows.append((key[0], "state", None, None))
        state.update(q.dump())
        stats = q.statistics()
        out = pd.DataFrame(rows, columns=["queue", "event", "sample_id", "staleness"])
        out["staleness"] = out["staleness"].astype("Int32")
        yield out.assign(**{k: stats[k] for k in ("waiting", "produced", "consumed", "dropped")})

    return events.groupBy("queue").applyInPandasWithState(work, OUT, STATE, "append", "NoTimeout")


def run_queue_batch(events: DataFrame, capacity: int) -> DataFrame:
    """The same over a finished table (one group of events for each queue)."""

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        q, rows = SampleQueue(capacity), []
        for e in pdf.sort_values("seq", kind="stable").itertuples(index=False):
            rows += [(key[0], *told) for told in q.step(e.kind, e.sample_id, int(e.n))]
        rows.append((key[0], "state", None, None))
        out = pd.DataFrame(rows, columns=["queue", "event", "sample_id", "staleness"])
        out["staleness"] = out["staleness"].astype("Int32")
        return out.assign(**{k: q.statistics()[k] for k in ("waiting", "produced", "consumed", "dropped")})

    work.__annotations__.clear()
    return events.groupBy("queue").applyInPandas(work, OUT)


def capacity(required: int, staleness: float, sync_steps: int) -> int:
    """Samples that may wait for a given staleness budget."""
    return int(required * (1 + staleness) * sync_steps)


def must_pause(waiting: int, most_waiting: int, in_flight: int, budget: int) -> bool:
    """Back-pressure: the queue is full or the staleness budget is spent."""
    return waiting >= most_waiting or in_flight >= budget


def staleness(samples: DataFrame, version: int, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: samples, how many are a version old or
    more, and the largest age."""
    age = F.lit(version) - F.col("min_version")
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.count_if(age >= 1).alias("stale"), F.max(age).alias("oldest"))


def since_reset(events: DataFrame, by: Sequence[str] = ("queue",), order: str = "seq", kind: str = "kind") -> DataFrame:
    """Events with ``stale_samples``, what counts against the staleness budget after each: the
    samples put since the last new version, and those that waited (put and not yet taken) when
    it came. Kinds are put, get, version; also ``waiting`` after each event, and, for a new
    version, ``idle_ratio``: the share of the time since the last one (``ts``, seconds) that
    came after the last sample was put."""
    along = Window.partitionBy(*by).orderBy(order)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    is_put, is_new = F.col(kind) == "put", F.col(kind) == "version"
    out = events.withColumn("waiting", F.sum(F.when(is_put, 1).when(F.col(kind) == "get", -1).otherwise(0)).over(so_far)).withColumn("__puts", F.sum(is_put.cast("int")).over(so_far))
    base = F.last(F.when(is_new, F.col("waiting") - F.col("__puts")), ignorenulls=True).over(so_far)
    out = out.withColumn("stale_samples", F.col("__puts") + F.coalesce(base, F.lit(0)))
    if "ts" in events.columns:
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        began = F.last(F.when(is_new, F.col("ts")), ignorenulls=True).over(earlier)
        last_put = F.last(F.when(is_put, F.col("ts")), ignorenulls=True).over(earlier)
        whole = F.greatest(F.col("ts") - began, F.lit(1e-6))
        ratio = F.when(last_put > began, 1 - (last_put - began) / whole).otherwise(0.0)
        out = out.withColumn("idle_ratio", F.when(is_new & began.isNotNull(), ratio))
    return out.drop("__puts")


def assemble(samples: DataFrame) -> DataFrame:
    """One row on a batch from the stream: percentiles of processing time, the share and
    the span of samples made across versions, and how many versions there are."""
    span = F.col("max_version") - F.col("min_version")
    q = F.percentile("processing_time", [0.5, 0.95, 0.99])
    out = samples.agg(
        F.count(F.lit(1)).alias("samples"), F.avg("processing_time").alias("time_mean"), q.alias("q"), F.avg((span > 0).cast("double")).alias("partial_ratio"), F.max(span).alias("partial_span"), F.count_distinct("max_version").alias("versions")
    )
    return out.select("samples", "time_mean", *[F.get("q", F.lit(i)).alias(f"time_p{p}") for i, p in enumerate((50, 95, 99))], "partial_ratio", "partial_span", "versions")

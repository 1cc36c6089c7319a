"""A replay table of sample tags: versions of ``partition, key, tag, step, version``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.batch import number_rows

KEYS = ("partition", "key")


def latest(log: DataFrame) -> DataFrame:
    """The newest tag of each key; a removed one (tag null) is gone."""
    new = log.groupBy(*KEYS).agg(F.max_by(F.struct("tag", "step"), "version").alias("t"), F.max("version").alias("version"))
    return new.select(*KEYS, "t.tag", "t.step", "version").where("tag is not null")


def remove(tags: DataFrame, keys: DataFrame) -> DataFrame:
    return tags.join(keys, list(KEYS), "left_anti")


def ready(tags: DataFrame, partition: str, step: int | None = None) -> DataFrame:
    """Keys of steps whose samples have all left the state "running": those that succeeded."""
    own = tags.where(F.col("partition") == partition)
    own = own if step is None else own.where(F.col("step") == step)
    done = own.groupBy("step").agg(F.count_if(F.col("tag") == "running").alias("r")).where("r = 0").select("step")
    return own.where("tag = 'success'").join(done, "step", "left_semi")


def fetch(values: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the rows with the given keys."""
    return values.join(keys, list(KEYS), "left_semi").select(*KEYS, *columns)


def _same_key(a, b) -> bool:
    return a == b or (a != a and b != b)


def bucket_delays(requests: DataFrame, rate: float, burst: float, order: str = "seq", at: str = "at", size: str = "tokens", block: int = 65_536) -> DataFrame:
    """``key, delays`` of a token bucket for each client: how long each request waits. A
    request larger than the bucket lets it go below zero; one without a size takes a full
    bucket and leaves a full one.

    Requests are numbered by key and order and cut into blocks of so many rows, so a client
    may have any number. A bucket is known by the time ``now`` up to which requests are
    served and the time ``empty`` at which it would have been empty, and what a run of
    requests does to both is made of sums and maxima: each block tells this of its last
    client (one row a block goes to the driver, which carries states from block to block),
    then all blocks walk their requests from known states."""
    deep, never = burst / rate, float("-inf")
    key_type = requests.schema["key"].dataType
    asked = requests.select("key", F.col(order).alias("order"), F.col(at).cast("double").alias("at"), F.col(size).cast("double").alias("n"))
    rows = number_rows(asked, "key", "order", "at", "n").select("key", "at", "n", "row_id", F.floor(F.col("row_id") / block).alias("block"))

    def runs(table: pa.Table) -> tuple[list[int], list, list, list]:
        """Where each client begins, and keys, times and sizes in order."""
        table = table.sort_by("row_id")
        codes = table["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        begins = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]
        sizes = [None if n is None or n != n else n for n in table["n"].to_pylist()]
        return begins, [table["key"][i].as_py() for i in begins], table["at"].to_pylist(), sizes

    def effect(key: tuple, table: pa.Table) -> pa.Table:
        begins, keys, times, sizes = runs(table)
        # now and empty as they follow from now (a), from empty (b) and from neither (c)
        a_now, a_empty, b_now, b_empty, c_now, c_empty = 0.0, never, never, 0.0, never, never
        for t, n in zip(times[begins[-1] :], sizes[begins[-1] :], strict=True):
            if t is not None and (t > c_now or t != t):
                c_now = t
            need, taken = (deep, never) if n is None else (min(n, burst) / rate, n / rate)
            a_empty, b_empty, c_empty = max(a_empty, a_now - deep), max(b_empty, b_now - deep), max(c_empty, c_now - deep)
            a_now, b_now, c_now = max(a_now, a_empty + need), max(b_now, b_empty + need), max(c_now, c_empty + need)
            a_empty, b_empty, c_empty = a_empty + taken, b_empty + taken, c_empty + taken
        told = {"block": [key[0].as_py()], "first": [keys[0]], "last": [keys[-1]], "one": [len(keys) == 1]}
        return pa.table(told | {"effect": [[a_now, a_empty, b_now, b_empty, c_now, c_empty]]}, to_arrow_schema(effects))

    effects = T.StructType([T.StructField("block", T.LongType()), T.StructField("first", key_type), T.StructField("last", key_type), T.StructField("one", T.BooleanType()), T.StructField("effect", T.ArrayType(T.DoubleType()))])
    fresh = (0.0, -deep)
    starts, before, state = {}, None, fresh
    for e in rows.groupBy("block").applyInArrow(effect, effects).orderBy("block").collect():
        goes_on = before is not None and _same_key(before.last, e.first)
        starts[e.block] = state if goes_on else fresh
        now, empty = starts[e.block] if e.one else fresh
        a_now, a_empty, b_now, b_empty, c_now, c_empty = e.effect
        state = (max(c_now, now + a_now, empty + b_now) if now == now else now), max(c_empty, now + a_empty, empty + b_empty)
        before = e

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        begins, keys, times, sizes = runs(table)
        now, empty = starts[key[0].as_py()]
        have, delays = burst if (now, empty) == fresh else (now - empty) * rate, []
        for begin, end in zip(begins, [*begins[1:], len(times)], strict=True):
            if begin:
                now, have = 0.0, burst
            out = []
            for t, n in zip(times[begin:end], sizes[begin:end], strict=True):
                later = t if t is not None and (t > now or t != t) else now
                have = min(burst, have + (later - now) * rate)
                need = burst if n is None else min(n, burst)
                wait = max(0.0, (need - have) / rate)
                have, now = (float("inf") if n is None else have + wait * rate - n), later + wait
                out.append(None if t is None else now - t)
            delays.append(out)
        return pa.table({"key": keys, "block": [key[0].as_py()] * len(keys), "delays": delays}, to_arrow_schema(walked))

    walked = T.StructType([T.StructField("key", key_type), T.StructField("block", T.LongType()), T.StructField("delays", T.ArrayType(T.DoubleType()))])
    for work in (effect, walk):
        work.__annotations__.clear()
    parts = rows.groupBy("block").applyInArrow(walk, walked).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "delays"))).alias("parts"))
    return parts.select("key", F.flatten("parts.delays").alias("delays"))

"""Shard placement by a permutation-filled lookup table (native).

Every shard has a preference order over the slots of a table of prime size (start
and step from a hash of its name). The shards take turns; at its turn a shard
claims the first slot of its order that is still free. A row's key picks a slot,
and the slot names the shard: one probe of a small broadcast table, no shuffle.
Adding or removing a shard moves few keys besides those it gains or loses.

Edge cases: a null key counts as the empty string; equal keys go to one shard;
an empty table gives an empty result; the table has about ``slots_per_shard``
slots for each shard, so its size is known before it is broadcast. Columns of the
input named as the two new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The broadcast table has no more slots than this (4 MB).
MOST_SLOTS = 1 << 18


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def prime_from(n: int) -> int:
    """The smallest prime that is ``n`` or more."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """The shard (its index) of every slot; ``slots`` is prime."""
    starts = [_number(f"{s}/start") % slots for s in shards]
    steps = [_number(f"{s}/step") % (slots - 1) + 1 for s in shards]
    turn, owner, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[slot := (starts[i] + turn[i] * steps[i]) % slots] >= 0:
                turn[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, shards: Sequence[str], key_col: str = "doc_id", slots_per_shard: int = 100, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with ``slot_col`` and ``shard_col``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    slots = prime_from(max(3, len(shards) * slots_per_shard))
    if slots > MOST_SLOTS:
        raise ValueError(f"{slots} slots; the lookup table may have {MOST_SLOTS}")
    owner = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    # one row of text, split where it runs: the table comes from SQL alone
    free = [n for n in (f"__slot{k}" for k in range(len(df.columns) + 2)) if n not in df.columns]
    own, named = free[:2]
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.concat(F.lit(owner), F.when(F.col("id") < 0, "").otherwise("")), ",")).alias(own, "owner"))
    lookup = lookup.select(own, F.element_at(names, F.col("owner").cast("int") + 1).alias(named))
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")
    keyed = df.withColumn(own, slot).drop(*[c for c in (slot_col, shard_col) if c in df.columns])
    kept = [c for c in df.columns if c not in (slot_col, shard_col)]
    return keyed.join(F.broadcast(lookup), own).select(*kept, F.col(own).alias(slot_col), F.col(named).alias(shard_col))

"""Verbs of a batch. A batch is a DataFrame with a column ``row_id``: 0, 1, 2, ... in
the order that positional verbs refer to. Results have ``row_id`` renumbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stable import stable

ROW = "row_id"


def number_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """Add ``row_id`` by ``order`` without sending all rows through one task: rows are
    sorted by range, counted by partition, and numbered from their partition's start."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id())
    placed = stable(placed, "numbered")  # partition numbers and sequence must not change between the two uses
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # a row for each partition
    return placed.join(F.broadcast(starts), "__part").withColumn(ROW, F.col("__start") + F.col("__seq") - F.col("__first")).drop("__part", "__seq", "__first", "__start")


def size(df: DataFrame) -> int:
    return df.count()


def select(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df if columns is None else df.select(ROW, *columns)


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the batch without them."""
    if missing := set(columns) - set(df.columns):
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.select(ROW, *columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def take(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Rows at ``indices``, in that order, repeats kept; negative ones count from the end."""
    if any(i < 0 for i in indices):
        n = size(df)
        indices = [i % n for i in indices]
    spark = df.sparkSession
    want = spark.createDataFrame([(p, i) for p, i in enumerate(indices)], "__pos long, row_id long")
    return df.join(F.broadcast(want) if len(indices) <= 100_000 else want, ROW).drop(ROW).withColumnRenamed("__pos", ROW)


reorder = take


def where(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask holds. Order is kept, numbers have gaps (see ``number_rows``)."""
    return df.where(mask)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    needs = any(x is not None and x < 0 for x in (start, stop)) or (step or 1) < 0
    if (step or 1) < 0:
        raise ValueError("step must be positive")
    n = size(df) if needs else None
    a = 0 if start is None else (max(0, start + n) if start < 0 else start)
    keep = F.col(ROW) >= a
    if stop is not None:
        keep &= F.col(ROW) < (stop + n if stop < 0 else stop)
    k = step or 1
    return df.where(keep & ((F.col(ROW) - a) % k == 0)).withColumn(ROW, ((F.col(ROW) - a) / k).cast("long"))


def repeat(df: DataFrame, times: int = 2, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: side by side (interleave) or whole batches in turn."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    if interleave:
        return out.withColumn(ROW, F.col(ROW) * times + F.col("rep"))
    return out.withColumn(ROW, F.col("rep") * size(df) + F.col(ROW))


def repeat_by(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says (0: not at all); ``rep`` counts them."""
    return df.withColumn("__n", times.cast("int")).where("__n > 0").withColumn("rep", F.explode(F.expr("sequence(0L, __n - 1L)"))).drop("__n")


def unfold_chunks(df: DataFrame, parts: int, columns: Sequence[str]) -> DataFrame:
    """Split arrays into ``parts`` equal pieces, each a row; other columns are repeated."""
    out = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        width = (F.size(c) / parts).cast("int")
        out = out.withColumn(c, F.slice(c, F.col("part") * width + 1, width))
    return out.withColumn(ROW, F.col(ROW) * parts + F.col("part")).withColumn("part", F.col("part").cast("long"))


def chunk(df: DataFrame, parts: int, padding: bool = False) -> DataFrame:
    """Number of the equal part (``chunk``) of each row; uneven batches need ``padding``."""
    n = size(df)
    if n % parts and not padding:
        raise ValueError(f"{n} rows can't be cut into {parts} equal parts")
    if n % parts:
        df, n = pad_last(df, parts - n % parts), n + parts - n % parts
    return df.withColumn("chunk", F.floor(F.col(ROW) / (n // parts)).cast("long"))


def split(df: DataFrame, rows: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(ROW) / rows).cast("long"))


def pad_last(df: DataFrame, n: int, first: bool = False) -> DataFrame:
    """Append ``n`` copies of the last (or first) row."""
    rows = size(df)
    edge = df.where(F.col(ROW) == (0 if first else rows - 1)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else None
    return df if edge is None else df.unionByName(edge.withColumn(ROW, F.lit(rows) + F.col("__k")).drop("__k"))


def pad_to_divisor(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Append rows from the beginning, again and again if need be, until the number of
    rows is a multiple; also how many were added."""
    n = size(df)
    more = -n % divisor if n else 0
    if not more:
        return df, 0
    copies = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(-(-more // n) - 1)))).withColumn(ROW, F.col(ROW) + F.lit(n) * (F.col("__k") + 1)).drop("__k")
    return df.unionByName(copies.where(F.col(ROW) < n + more)), more


def unpad(df: DataFrame, padded: int) -> DataFrame:
    return df.where(F.col(ROW) < size(df) - padded) if padded else df


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both, row by row. Columns that both have must be equal (nulls and NaN
    equal themselves); a difference or a missing row raises when the result is read."""
    shared = [c for c in right.columns if c in left.columns and c != ROW]
    other = right.select(F.col(ROW), F.lit(True).alias("__r"), *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c != ROW])
    both = left.withColumn("__l", F.lit(True)).join(other, ROW, "full")
    bad = F.col("__l").isNull() | F.col("__r").isNull()
    for c in shared:
        bad |= ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    checked = F.when(bad, F.raise_error(F.lit("batches differ in rows or in a shared column"))).otherwise(F.col(ROW))
    return both.withColumn(ROW, checked).drop("__l", "__r", *[f"__{c}" for c in shared])


def concat(batches: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, in turn."""
    at, out = 0, None
    for b in batches:
        moved = b.withColumn(ROW, F.col(ROW) + at)
        out = moved if out is None else out.unionByName(moved)
        at += size(b)
    if out is None:
        raise ValueError("nothing to concatenate")
    return out


def merge_meta(metas: Sequence[dict]) -> dict:
    """Meta of concatenated batches: ``metrics`` become lists by name, the rest must agree."""
    out: dict = {}
    for m in metas:
        for k, v in m.items():
            if k == "metrics":
                for one in v if isinstance(v, list) else [v]:
                    for name, x in one.items():
                        out.setdefault("metrics", {}).setdefault(name, []).append(x)
            elif k in out and out[k] != v:
                raise ValueError(f"meta {k!r} differs")
            else:
                out[k] = v
    return out


def fold(df: DataFrame, groups: int, into: str = "rows") -> DataFrame:
    """``groups`` rows, each with an equal run of rows as an array of structs."""
    n = size(df)
    if n % groups:
        raise ValueError(f"{n} rows can't be folded into {groups}")
    cols = [c for c in df.columns if c != ROW]
    item = F.struct(F.col(ROW).alias("__o"), *cols)
    folded = df.groupBy(F.floor(F.col(ROW) / (n // groups)).cast("long").alias(ROW)).agg(F.array_sort(F.collect_list(item)).alias(into))
    return folded.withColumn(into, F.transform(into, lambda s: F.struct(*[s[c].alias(c) for c in cols])))


def unfold(df: DataFrame, column: str = "rows") -> DataFrame:
    out = df.select(F.col(ROW).alias("__g"), F.size(column).alias("__w"), F.posexplode(column).alias("__p", "__s"))
    return out.select((F.col("__g") * F.col("__w") + F.col("__p")).alias(ROW), "__s.*")


def minibatches(df: DataFrame, rows: int, epochs: int, seed: int = 0) -> DataFrame:
    """Shuffled batches of equal size for every epoch: columns ``epoch, minibatch``.
    The shuffle orders by a hash of seed, epoch and row, whole batches only."""
    n = size(df)
    if n % rows:
        raise ValueError(f"{n} rows don't make batches of {rows}")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    out = out.withColumn("__key", F.md5(F.concat_ws("/", F.lit(str(seed)), "epoch", ROW))).withColumn("__own", F.col(ROW))
    # every epoch has ``n`` rows, so the place in the order of all gives the place in the epoch
    ranked = number_rows(out.drop(ROW), "epoch", "__key", "__own")
    place = F.col(ROW) - F.col("epoch") * n
    return ranked.withColumn("minibatch", F.floor(place / rows).cast("long")).withColumn(ROW, F.col("__own")).select(*df.columns, "epoch", "minibatch")


def upsample(df: DataFrame, multiple: int, neutral: dict[str, Column], uid: str = "uid") -> DataFrame:
    """Append rows that teach nothing until the number of rows is a multiple: copies of the
    first one with the columns of ``neutral`` put in and a ``uid`` of their own. Adds
    ``is_padding``."""
    n = size(df)
    more = -n % multiple if n else 0
    real = df.withColumn("is_padding", F.lit(False))
    if not more:
        return real
    made = df.where(F.col(ROW) == 0).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(more - 1))))
    made = made.withColumns({**neutral, ROW: F.lit(n) + F.col("__k"), "is_padding": F.lit(True)})
    if uid in df.columns and uid not in neutral:
        made = made.withColumn(uid, F.lit("pad").cast(dict(df.dtypes)[uid]))
    return real.unionByName(made.select(*[F.col(c).cast(k).alias(c) for c, k in real.dtypes]))


def appended(left: DataFrame, right: DataFrame, prefix: str = "") -> DataFrame:
    """One row: the lists of ``left`` (arrays) with the values of ``right`` (one row) at
    their ends; a name that ``left`` lacks begins a list."""
    names = {f"{prefix}{c}": c for c in right.columns}
    told = right.select(*[F.col(c).alias(f"__{n}") for n, c in names.items()])
    both = left.join(F.broadcast(told))  # one row
    grown = [F.array_append(n, F.col(f"__{n}")).alias(n) if n in left.columns else F.array(f"__{n}").alias(n) for n in names]
    return both.select(*[c for c in left.columns if c not in names], *grown)


def same(left: DataFrame, right: DataFrame) -> bool:
    cols = sorted(left.columns)
    if cols != sorted(right.columns):
        return False
    a, b = left.select(cols), right.select(cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def groups_of(df: DataFrame, key: str) -> DataFrame:
    """Rows that share a prompt, as one row each: ``key, row_ids``."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(ROW)).alias("row_ids"))


def run_ordinal(df: DataFrame, key: str) -> DataFrame:
    """``ordinal`` of each row within its run of equal ``key`` values (rows in order).

    Within a key, row number less rank is the same along a run, so no window spans keys."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(ROW))
    runs = df.withColumn("__run", F.col(ROW) - rank)
    return runs.withColumn("ordinal", (F.row_number().over(Window.partitionBy(key, "__run").orderBy(ROW)) - 1).cast("long")).drop("__run")

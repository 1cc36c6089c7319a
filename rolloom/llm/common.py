"""Helpers shared by the training-data operators: shared storage, words, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space: blank and \t \n \v \f \r, as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows that go to Python functions at once, in plans that ``materialize`` runs.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where that setting is absent (local tests) a temporary folder is set; a cluster
    has to name one, as a folder of the driver's own is not seen by its executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rolloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, and later reads don't depend on the executors that wrote it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rolloom/{name}-{uuid.uuid4().hex}"
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, str(min(int(rows), BATCH_ROWS)) if int(rows) > 0 else str(BATCH_ROWS))  # whole texts and sets are wide
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._rolloom_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, rows: int = 64) -> DataFrame:
    """Like ``materialize``, as a table bucketed by ``key``: two of them with the same number
    of buckets join on it without a shuffle. ``rows``: how many go to Python functions at
    once, for rows that are blocks of many."""
    spark = df.sparkSession
    made = f"{name}-{uuid.uuid4().hex}"
    path, called = f"{shared_dir(spark)}/rolloom/{made}", "rolloom_" + made.replace("-", "_")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(called)
    finally:
        spark.conf.set(setting, before)
    out = spark.table(called)
    out._rolloom_path, out._rolloom_table = path, called
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` or ``bucketed`` result that nothing reads any more."""
    if getattr(df, "_rolloom_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._rolloom_table}")
    path = getattr(df, "_rolloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale or script."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Components beyond this would not leave room for squares and products of vectors in a long.
MOST_COMPONENT = 1 << 27


def whole_vectors(df: DataFrame, vector_col: str, scale: int, dims: int | None, extra: Sequence[Column], most: int = MOST_COMPONENT) -> DataFrame:
    """Rows whose vector has ``dims`` components (any number if None), none null, non-finite
    or, times ``scale``, beyond ``most``; ``vector`` holds floor(scale * x), ``extra`` comes along."""
    scaled = F.transform(vector_col, lambda x: x.cast("double") * scale)
    usable = F.coalesce(F.forall(scaled, lambda x: F.coalesce((x > -most) & (x < most), F.lit(False))), F.lit(False))
    chosen = df.select(*extra, scaled.alias("vector"), usable.alias("usable")).where("usable").drop("usable")
    chosen = chosen.where(F.size("vector") == dims) if dims is not None else chosen
    return chosen.withColumn("vector", F.transform("vector", lambda x: F.floor(x).cast("int")))


def fixpoint(step: Callable[[DataFrame], tuple[DataFrame, bool]], start: DataFrame) -> DataFrame:
    """Apply ``step`` until it reports no change."""
    state, changed = start, True
    while changed:
        state, changed = step(state)
    return state


#: Texts are handed to Python functions in pieces of about so many bytes.
PIECE_BYTES = 1 << 20


_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def byte_codes(separators: Sequence[int]) -> np.ndarray:
    """A fixed 64-bit number for each byte, the same for A-Z and a-z; 0 for ``separators``."""
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * _C1)
    codes[65:91] = codes[97:123]
    codes[list(separators)] = 0
    return codes


_PLACES: list[np.ndarray] = []


def _places(n: int) -> np.ndarray:
    """A fixed odd 64-bit number for each place within a word; kept for the task's next texts."""
    if not _PLACES or len(_PLACES[0]) < n:
        _PLACES[:] = [mix64(np.arange(1 << 40, (1 << 40) + max(2 * n, 1 << 12), dtype=np.uint64) * _C3) | np.uint64(1)]
    return _PLACES[0]


def hash_words(texts: list, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text.

    Words are runs of bytes whose code isn't 0. A word's hash is the sum over its bytes of
    the byte's code times the place's number, so it follows no recurrence that a text
    could be made to fit."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begins = np.cumsum([0] + [len(x) + 1 for x in parts])
    codes = codes[raw]
    inside = np.concatenate([[0], (codes != 0).view(np.int8), [0]])
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(start, begins))
    if not len(start):
        return np.empty(0, np.uint64), counts
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    sums = np.add.reduceat(codes[codes != 0] * _places(int(size.max()))[place], first)
    return mix64(sums + size.astype(np.uint64)), counts


def pieces(batch: pa.RecordBatch, texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows whose texts have about ``piece_bytes`` (one row at least)."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + piece_bytes, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
        at = to


def map_texts(df: DataFrame, text_col: str, carry: Sequence[str], fields: str, make: Callable[[], Callable[[list], dict]], piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Apply a function of many texts at once, in Arrow batches.

    ``make()`` runs once a task and gives a function from a list of texts (None for
    null) to the columns of ``fields`` (DDL), each with one value a text. ``carry``:
    columns of ``df`` to keep, under their names with ``__`` before."""
    given = T.StructType.fromDDL(fields)
    chosen = df.select(*[F.col(c).alias(f"__{c}") for c in carry], F.col(text_col).alias("__input"))
    schema = T.StructType([*chosen.schema.fields[:-1], *given.fields])
    arrow = to_arrow_schema(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for rows, texts in pieces(batch, batch.column(batch.num_columns - 1), piece_bytes):
                made = apply(texts)
                kept = rows.columns[:-1]
                new = [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
                names = [*rows.schema.names[:-1], *arrow.names]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=names)

    return chosen.mapInArrow(run, schema)


#: Ids to drop are broadcast up to this number (8 to some 40 bytes each), and joined by
#: shuffle beyond.
MOST_DROPPED_BROADCAST = 1_000_000


def drop_ids(df: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not among ``dropped`` (one column); rows without an id stay."""
    dropped = materialize(dropped.toDF("__dropped").where("__dropped is not null").distinct(), "dropped-ids")
    side = F.broadcast(dropped) if dropped.count() <= MOST_DROPPED_BROADCAST else dropped
    return df.join(side, F.col(id_col) == F.col("__dropped"), "left_anti")

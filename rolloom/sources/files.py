"""Files in and out. Readers are lazy and distributed; formats go by the file's ending.

A seeded sample or the first N rows need an order: samples go by a hash of their place (the
file's name and the row's number in it), heads by that place itself. Neither depends on how
files are split between tasks.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(*endings: str):
    """Register a reader ``(spark, path, schema)`` for file endings."""

    def add(fn):
        for e in endings:
            READERS[e] = fn
        return fn

    return add


@reader("parquet")
def _parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


@reader("jsonl", "ndjson")
def _json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


@reader("json")
def _json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None, most: int | None = None, seed: int | None = None) -> DataFrame:
    """All files, in order; ``most`` keeps the first rows or, with a seed, a sample without
    replacement, the same however the files are split. An unknown ending raises. Columns
    ``source_path`` and ``row_id`` (place in the reading order, with gaps)."""
    out = None
    for n, p in enumerate(paths):
        ending = posixpath.basename(p.rstrip("/")).rpartition(".")[2]
        if ending not in READERS:
            raise ValueError(f"unsupported file format: {p}")
        one = READERS[ending](spark, p, schema)
        one = one.withColumn("__file", F.col("_metadata.file_name"))
        # only a Parquet file tells the number of a row in it; others are numbered within a split
        place = F.col("_metadata.row_index") if ending == "parquet" else F.monotonically_increasing_id()
        one = one.withColumn("__row", place).withColumn("source_path", F.lit(p)).withColumn("row_id", F.monotonically_increasing_id() + F.lit(n << 52)).withColumn("__n", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    hidden = ("__file", "__row", "__n")
    if most is None:
        return out.drop(*hidden)
    place = ["__n", "__file", "__row"]
    order = [F.xxhash64(F.lit(seed), *place), *place] if seed is not None else place
    return out.orderBy(*order).limit(most).drop(*hidden)


def read_records(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Episode files: a JSON object, a list of them, or one in each line; blank lines and
    anything that is no object are passed over. Adds ``source_path, source_index``."""
    whole = spark.read.text(paths, wholetext=True, pathGlobFilter="*.json*", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    lines = F.col("source_path").rlike(r"(?i)\.(jsonl|ndjson)$")
    items = F.when(lines, F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).otherwise(
        F.when(F.ltrim("value").startswith("["), F.transform(F.from_json("value", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array("value"))
    )
    each = whole.select("source_path", F.posexplode(items).alias("source_index", "record"))
    return each.where(F.ltrim("record").startswith("{")).select("source_path", F.col("source_index").cast("long"), F.from_json("record", schema).alias("r")).select("source_path", "source_index", "r.*")


def discover(spark: SparkSession, roots: Sequence[str], endings: Sequence[str] = ("json", "jsonl"), preferred: str = "trajectories") -> list[str]:
    """Files below roots, each once and in order. Where a root holds folders of the
    preferred name, only what is in those counts."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found: dict[str, None] = {}
    for root in roots:
        base = path_of(root)
        fs = base.getFileSystem(conf)
        own: list[str] = []
        for status in fs.globStatus(base) or []:
            it = fs.listFiles(status.getPath(), True)
            while it.hasNext():
                own.append(it.next().getPath().toString())
        own = sorted(p for p in own if p.rpartition(".")[2] in endings)
        inner = [p for p in own if f"/{preferred}/" in p]
        found.update(dict.fromkeys(inner or own))
    return list(found)


def same_tree(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two folders hold files of the same names and sizes."""
    def listing(root: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return files.select(F.expr(f"substring(path, locate('{posixpath.basename(root.rstrip('/'))}/', path))").alias("p"), "length").select(F.regexp_replace("p", "^[^/]+/", "").alias("p"), "length")

    x, y = listing(a), listing(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def write_lines(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines, UTF-8 as it is. One file means one task: for small reports."""
    (df.coalesce(1) if one_file else df).write.mode(mode).json(path)


def write_by_step(df: DataFrame, path: str, step: str = "step", kind: str = "json") -> None:
    """Samples of training steps, a folder a step, so that reading a step reads no other."""
    df.write.mode("append").partitionBy(step).format(kind).save(path)


def read_dump(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """What ``write_by_step`` wrote. ``mask``: a pattern whose matches read as *."""
    out = spark.read.json(path)
    texts = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.withColumns({c: F.regexp_replace(c, mask, "*") for c in texts}) if mask else out


def sorted_by_score(df: DataFrame, descending: bool = True) -> DataFrame:
    names = [c for c in ("score", "score_1") if c in df.columns]
    key: Column = F.coalesce(*[F.col(c) for c in names], F.lit(0.0))
    return df.orderBy(key.desc() if descending else key.asc())


def by_request(df: DataFrame, request: str, column: str = "request_id") -> DataFrame:
    """Rows of a request id, dashes aside."""
    return df.where(F.replace(column, F.lit("-"), F.lit("")) == request.replace("-", ""))


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.contains(column, F.lit(text)))


class StepCache:
    """Generated batches on disk by step: made once, read afterwards."""

    def __init__(self, spark: SparkSession, root: str, key: dict) -> None:
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{hashlib.md5(json.dumps(key, sort_keys=True).encode()).hexdigest()}"

    def get(self, step: int, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/step={step}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def log_metrics(df: DataFrame, path: str) -> None:
    """Append a metric table ``step, name, value`` as ``{step, data}`` lines."""
    df.groupBy("step").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("data")).write.mode("append").json(path)


def short_prompts(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows whose prompt has at most ``most`` tokens; one that can't be measured goes."""
    return df.where(F.coalesce(length, F.lit(most + 1)) <= most)


def typed_parts(text: Column) -> Column:
    """``type, text`` parts of a message with <image> and <video> places."""
    marked = F.regexp_replace(text, "(<image>|<video>)", "\u0000$1\u0000")
    parts = F.filter(F.split(marked, "\u0000"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill what a prompt row may lack: index 0 and empty tool arguments."""
    out = df
    if "extra_info" in df.columns and isinstance(df.schema["extra_info"].dataType, T.StructType):
        inner = df.schema["extra_info"].dataType.fieldNames()
        out = out.withColumn("index", F.coalesce(F.col("extra_info.index"), F.lit(0)) if "index" in inner else F.lit(0))
        out = out.withColumn("tools_kwargs", F.coalesce(F.col("extra_info.tools_kwargs"), F.lit("{}")) if "tools_kwargs" in inner else F.lit("{}"))
    else:
        out = out.withColumns({"index": F.lit(0), "tools_kwargs": F.lit("{}")})
    return out

"""Tables written where every executor sees them, so that later reads don't recompute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows that go to Python functions at once while a table is written; rows may be whole conversations.
BATCH_ROWS = 256
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` into the folder of ``spark.checkpoint.dir`` and read it back.

    What depends on partitions or on the order of rows (partition numbers, sequences) is
    then fixed, even if executors are lost. Local sessions without that setting get a
    temporary folder; on a cluster it has to be set."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rolloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/rolloom/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCHES)
    spark.conf.set(_BATCHES, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCHES, rows)
    return spark.read.schema(df.schema).parquet(path)

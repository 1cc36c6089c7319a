"""A dataset that grows while it is trained on: batches are added once each, by their number,
and readers see whole batches only.

A batch is written to a folder of its own and then committed by a marker. Writing it again,
after a failure or a restart of the stream, replaces the folder while there is no marker and
does nothing once there is; so ``append`` may be the function of ``foreachBatch``. A reader's
snapshot is the batches committed when it was made, or those up to a number."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.extern import load_extern


class Generator(ABC):
    """Makes new rows from those there are."""

    @abstractmethod
    def generate(self, rows: DataFrame) -> DataFrame: ...


def load_generator(path: str, name: str, **options) -> Generator:
    kind = load_extern(path, name)
    if not (isinstance(kind, type) and issubclass(kind, Generator)):
        raise TypeError(f"{name} of {path} is no generator")
    return kind(**options)


class GrowingDataset:
    def __init__(self, spark: SparkSession, root: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """``keep``: a filter that all rows go through, such as that of long prompts."""
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        path, fs = self._path("commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a batch; False if it is there already. Batches have the columns of the first."""
        marker, fs = self._path(f"commits/{batch_id:012d}")
        if fs.exists(marker):
            return False
        kept = self.keep(rows) if self.keep is not None else rows
        if self.committed():
            kept = kept.select(*self.read().columns)
        kept.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch_id:012d}")
        fs.create(marker, False).close()  # fails if another writer has committed it meanwhile
        return True

    def read(self, up_to: int | None = None) -> DataFrame:
        """The rows of all committed batches, or of those up to a number."""
        some = [b for b in self.committed() if up_to is None or b <= up_to]
        if not some:
            raise ValueError("no batch has been committed")
        return self.spark.read.parquet(*[f"{self.root}/data/batch={b:012d}" for b in some])

    def grow(self, generator: Generator, step: int) -> bool:
        """After a training step: rows that the generator makes from what there was before
        it, as batch ``step``. Run again, a step adds nothing and reads the same."""
        before = [b for b in self.committed() if b < step]
        return self.append(generator.generate(self.read(before[-1])), step) if before else False

    def follow(self, stream: DataFrame, checkpoint: str):
        """Append the micro-batches of a stream until its source is read; gives the query."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.foreachBatch(lambda rows, batch_id: self.append(rows, batch_id) and None).start()

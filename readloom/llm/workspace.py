"""Intermediate tables in the folder that driver and executors share, and portions of Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Deletes a plan's shuffle files when it has run.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is named, a local folder in local mode (tests); on a cluster, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "readloom-shared")
    return named.rstrip("/")


class Workspace:
    """Tables of one operator run. A table cuts lineage and survives lost executors.

    ``close`` deletes all but those kept; these, which a lazy result may still read, go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        fs, path = self._file(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, name: str, codec: str = "zstd", mode: str = "overwrite") -> DataFrame:
        """The table, written and read again; the shuffle files that it took are deleted at once."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode(mode).option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        self.paths[name] = path
        return self.read(name, df.schema)

    def write_parts(self, part: Callable[[int], DataFrame], parts: int, name: str, codec: str = "zstd") -> DataFrame:
        """The table made of ``part(0)`` to ``part(parts - 1)``, one after the other, so that the shuffle files of only one of them are there at a time."""
        for k in range(parts):
            out = self.write(part(k), name, codec, "append" if k else "overwrite")
        return out

    def read(self, name: str, schema=None) -> DataFrame:
        r = self.spark.read
        return (r.schema(schema) if schema is not None else r).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for n in names:
            fs, path = self._file(self.paths.pop(n))
            fs.delete(path, True)

    def close(self, *keep: str) -> None:
        self.drop(*[n for n in self.paths if n not in keep])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, at most ``rows`` at a time, and no more than ``size`` bytes unless one row has more.

    Spark bounds its Arrow batches by bytes; these portions bound the Python objects made of them. No setting of the session is changed.
    """
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


__all__ = ["Workspace", "portions", "shared_dir", "table"]

"""The preprocessing chain over a growing folder of Parquet reads: stateless, in append mode, one micro-batch after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..params import TrimParams
from ..plans.preprocess import preprocess
from ..schemas import READS


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def preprocess_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, p: TrimParams, barcodes: DataFrame | None = None, adapters: DataFrame | None = None) -> StreamingQuery:
    """Starts a query that takes all files there are and ends; run it again for those that came since."""
    out = preprocess(read_stream(spark, source), p, barcodes, adapters)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Preprocessing, mapping, deduplication and peak calling in a row, each step's result written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DedupParams, PeakParams, TrimParams
from ..sources.reads import write_table
from .deduplicate import deduplicate
from .peaks import call_peaks
from .preprocess import preprocess


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished result stands at ``path``, in any store Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def step(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The Parquet table at ``path``: made if it isn't there, or with ``overwrite`` made anew."""
    if overwrite or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_info(spark: SparkSession, *params) -> DataFrame:
    """(program, option, value) of every parameter."""
    rows = [(type(p).__name__, k, str(v)) for p in params for k, v in asdict(p).items()]
    return spark.createDataFrame(rows, "program string, option string, value string")


def run(spark: SparkSession, reads: DataFrame, chroms: DataFrame, mapper: Callable[[DataFrame], DataFrame], out: str, trim: TrimParams = TrimParams(), dedup: DedupParams = DedupParams(), peaks: PeakParams = PeakParams(), barcodes: DataFrame | None = None, adapters: DataFrame | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    """``mapper`` turns reads into mapped records (rec_no, qname, chrom, pos0, flag, seq_len, xm): mapping itself is another program's work.

    Steps whose results are there already are read back unless ``overwrite``. Reports are written beside them as tab-separated text.
    """
    clean = step(spark, f"{out}/reads", lambda: preprocess(reads, trim, barcodes, adapters), overwrite)
    mapped = step(spark, f"{out}/mapped", lambda: mapper(clean), overwrite)
    d = deduplicate(mapped, dedup)
    kept = step(spark, f"{out}/deduplicated", lambda: d.kept, overwrite)
    histogram = step(spark, f"{out}/duplication", lambda: d.histogram, overwrite)
    hits = kept.select("chrom", F.when(F.col("strand") == 1, F.col("pos5") - 1).otherwise(F.col("pos5")).alias("pos"), "strand", F.col("seq_len").alias("read_len"))
    called = step(spark, f"{out}/peaks", lambda: call_peaks(hits, chroms, peaks).narrow_peak(), overwrite)
    for name, df in (("statistics", d.statistics), ("duplication", histogram), ("peaks", called), ("runinfo", run_info(spark, trim, dedup, peaks))):
        if overwrite or not exists(spark, f"{out}/reports/{name}"):
            write_table(df, f"{out}/reports/{name}", header=name != "peaks")
    return {"reads": clean, "mapped": mapped, "deduplicated": kept, "duplication": histogram, "peaks": called}

"""Lines, or other pieces, of text files, numbered in file order however the files are split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pieces(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(file, block, at, value): a piece's file, the place in it where the piece's split begins, and a number that grows within the split. ``sep`` stands between pieces, a line's end if not given."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def starts(counts: DataFrame) -> DataFrame:
    """(file, block, n, start) of (file, block, n): how many come before each split, files in order of their paths. One row a split."""
    w = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value), line_no running on over all files of the path, in order of their paths: no number occurs twice.

    Lines are counted by split, and the counts added up in a table of one row a split: no sort of the lines.
    """
    p = pieces(spark, path)
    splits = starts(p.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    return p.join(splits, ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("line_no"), "value")

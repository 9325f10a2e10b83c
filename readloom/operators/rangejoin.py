"""Range joins over positions, by bins: Spark has no strategy of its own for them.

The side that probes goes to every bin its range touches, the other side to the one bin of its position, so each pair
meets in exactly one bin and none has to be removed afterwards. The join is a plain equi-join on (keys, bin): it can
shuffle, spill, and split skewed bins at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, at: str, lo: Column, hi: Column, keys: tuple[str, ...] = ("chrom",), width: int = 256) -> DataFrame:
    """Pairs with equal ``keys`` and ``lo <= right[at] <= hi``; lo and hi are expressions over ``left`` and at most a few bins apart.

    Column names other than the keys must differ between the sides.
    """
    bins = F.sequence(F.floor(lo / width), F.greatest(F.floor(lo / width), F.floor(hi / width)))
    probe = left.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi").withColumn("__bin", F.explode(bins))
    build = right.withColumn("__bin", F.floor(F.col(at) / width))
    joined = probe.join(build, [*keys, "__bin"])
    return joined.where((F.col(at) >= F.col("__lo")) & (F.col(at) <= F.col("__hi"))).drop("__lo", "__hi", "__bin")

"""Pairs of opposite strands, and the fragment length from strand correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import range_join


def strands(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return hits.where("strand = 0").select("chrom", F.col("pos").alias("f_pos")), hits.where("strand = 1").select("chrom", F.col("pos").alias("r_pos"))


def pairs(hits: DataFrame, lo: int, hi: int) -> DataFrame:
    """Forward and later reverse hits of a chromosome with f + lo < r <= f + hi (chrom, f_pos, r_pos). ``lo`` below 0 counts as 0: a pair needs r > f."""
    f, r = strands(hits)
    at = F.col("f_pos")
    return range_join(f, r, "r_pos", at + max(lo, 0) + 1, at + hi, width=max(hi, 64))


def pair_hits(pairs: DataFrame) -> DataFrame:
    """Hits that belong to some pair."""
    ends = pairs.select("chrom", F.explode(F.array(F.struct(F.col("f_pos").alias("pos"), F.lit(0).alias("strand")), F.struct(F.col("r_pos").alias("pos"), F.lit(1).alias("strand")))).alias("e"))
    return ends.select("chrom", "e.pos", "e.strand").distinct()


def shifts(df: DataFrame, steps: int, name: str = "shift") -> DataFrame:
    return df.sparkSession.range(steps).select(F.col("id").alias(name))


def hamming_curve(hits: DataFrame, chroms: DataFrame, steps: int = 1000) -> DataFrame:
    """(shift, hd): how many positions hold a hit of just one strand after the forward strand moved by shift + 1, over all chromosomes.

    No bit vectors are needed: the distance is all forward hits still on the chromosome, plus all reverse ones, less twice the pairs at that offset.
    """
    inside = hits.join(F.broadcast(chroms), "chrom").where("pos < length").select("chrom", "pos", "strand", "length").distinct()
    f, r = strands(inside)
    met = range_join(f, r, "r_pos", F.col("f_pos") + 1, F.col("f_pos") + steps, width=max(steps, 64)).groupBy((F.col("r_pos") - F.col("f_pos") - 1).alias("shift")).agg(F.count("*").alias("met"))
    edge = inside.where((F.col("strand") == 0) & (F.col("pos") + steps >= F.col("length")))
    left = edge.select(F.explode(F.sequence(F.greatest(F.col("length") - F.col("pos") - 1, F.lit(0)), F.lit(steps - 1).cast("long"))).alias("shift")).groupBy("shift").agg(F.count("*").alias("gone"))
    n = inside.agg(F.count("*").alias("n"))
    out = shifts(hits, steps).join(met, "shift", "left").join(left, "shift", "left").join(F.broadcast(n))
    return out.select("shift", (F.col("n") - F.coalesce("gone", F.lit(0)) - 2 * F.coalesce("met", F.lit(0))).alias("hd"))


def fragment_length(curve: DataFrame, read_len: int) -> DataFrame:
    """One row: fragment_length, phantom (the shift of the read-length peak), rsc."""
    body, near = F.col("shift") >= 2 * read_len + 1, F.col("shift") <= 2 * read_len
    best = F.min(F.when(body, F.struct("hd", (-F.col("shift")).alias("s"))))
    phantom = F.min(F.when(near, F.struct("hd", F.col("shift").alias("s"))))
    r = curve.agg(best.alias("b"), phantom.alias("p"), F.max(F.when(body, F.col("hd"))).alias("top"))
    return r.select((1 - F.col("b.s")).alias("fragment_length"), F.col("p.s").alias("phantom"), F.when(F.col("top") != F.col("p.hd"), (F.col("top") - F.col("b.hd")) / (F.col("top") - F.col("p.hd"))).alias("rsc"))


def pair_length_distribution(hits: DataFrame, control: DataFrame, steps: int = 1000) -> DataFrame:
    """(length, chip, ctrl, diff) for lengths 1 to steps + 1: pairs with 0 <= r - f <= steps by r - f + 1, treatment less control."""

    def hist(h: DataFrame, name: str) -> DataFrame:
        f, r = strands(h)
        met = range_join(f, r, "r_pos", F.col("f_pos"), F.col("f_pos") + steps, width=max(steps, 64))
        return met.groupBy((F.col("r_pos") - F.col("f_pos") + 1).alias("length")).agg(F.count("*").alias(name))

    every = hits.sparkSession.range(1, steps + 2).select(F.col("id").alias("length"))
    out = every.join(hist(hits, "chip"), "length", "left").join(hist(control, "ctrl"), "length", "left").na.fill(0, ["chip", "ctrl"])
    return out.withColumn("diff", F.col("chip") - F.col("ctrl"))


def nexus_length(distribution: DataFrame, most: int) -> DataFrame:
    """The length from 2 to ``most`` with the largest difference; the smallest of equals."""
    best = distribution.where(F.col("length").between(2, most)).agg(F.min(F.struct((-F.col("diff")).alias("d"), "length")).alias("b"))
    return best.select(F.col("b.length").alias("fragment_length"), (-F.col("b.d")).alias("diff"))

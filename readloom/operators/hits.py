"""Hits (mapped 5' ends): classification, projection, distinct, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SAM flags of forward and of reverse hits; other records are dropped.
FORWARD = (0, 99, 163, 73, 89, 137, 131, 97, 161, 67, 65, 129)
REVERSE = (16, 147, 83, 121, 153, 185, 115, 179, 81, 145, 113, 177)


def strand_of(flag: Column) -> Column:
    """0 forward, 1 reverse, null for flags of neither."""
    return F.when(flag.isin(*FORWARD), 0).when(flag.isin(*REVERSE), 1)


def from_alignments(sam: DataFrame) -> DataFrame:
    """Hits of SAM records (flag, chrom, pos0, seq_len): a reverse read's 5' end is its last base, whatever its CIGAR."""
    strand = strand_of(F.col("flag"))
    pos = F.when(F.col("strand") == 0, F.col("pos0")).otherwise(F.col("pos0") + F.col("seq_len") - 1)
    return sam.withColumn("strand", strand).where(F.col("strand").isNotNull() & F.col("chrom").isNotNull()).select("chrom", pos.alias("pos"), "strand", F.col("seq_len").alias("read_len"))


def on_known_chroms(hits: DataFrame, chroms: DataFrame) -> DataFrame:
    """Hits on chromosomes that the treatment has, matched by name."""
    return hits.join(chroms.select("chrom"), "chrom", "left_semi")


def chrom_filter(df: DataFrame, pattern: str, kept: bool = True) -> DataFrame:
    """Rows whose whole chromosome name doesn't (or, with ``kept`` false, does) match the expression."""
    hit = F.col("chrom").rlike(f"^(?:{pattern})$")
    return df.where(~hit if kept else hit)


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One hit for each (chrom, pos, strand)."""
    return hits.groupBy("chrom", "pos", "strand").agg(F.max("read_len").alias("read_len"))


def strand_counts(hits: DataFrame, swapped: bool = False) -> DataFrame:
    """Per chromosome: hits, those of either strand and the read length. ``swapped`` gives either strand's count under the other's name, as older tools do after deduplication."""
    if swapped:
        return strand_counts(hits).select("chrom", "n_hits", F.col("n_reverse").alias("n_forward"), F.col("n_forward").alias("n_reverse"), "read_len")
    return hits.groupBy("chrom").agg(F.count("*").alias("n_hits"), F.count_if(F.col("strand") == 0).alias("n_forward"), F.count_if(F.col("strand") == 1).alias("n_reverse"), F.max("read_len").alias("read_len"))


def duplication(hits: DataFrame) -> DataFrame:
    """Per chromosome: hits, those beyond the first at their place, and their share."""
    sites = hits.groupBy("chrom", "pos", "strand").agg(F.count("*").alias("n"))
    c = sites.groupBy("chrom").agg(F.sum("n").alias("n_total"), F.sum(F.col("n") - 1).alias("n_redundant"))
    return c.withColumn("dup_rate", F.when(F.col("n_total") > 0, F.col("n_redundant") / F.col("n_total")).otherwise(0.0))


def pseudo_control(hits: DataFrame, chroms: DataFrame) -> DataFrame:
    """A control made of the treatment: every hit on the other strand, a read length away, clipped to the chromosome."""
    rl = F.col("read_len")
    pos = F.when(F.col("strand") == 0, F.least(F.col("pos") + rl - 1, F.col("length"))).otherwise(F.greatest(F.col("pos") - rl + 1, F.lit(0)))
    return hits.join(F.broadcast(chroms), "chrom").select("chrom", pos.cast("long").alias("pos"), (1 - F.col("strand")).alias("strand"), "read_len")


def one_strand_positions(hits: DataFrame) -> DataFrame:
    """Hits at positions that only one strand hits."""
    both = hits.groupBy("chrom", "pos").agg(F.min("strand").alias("lo"), F.max("strand").alias("hi"), F.count("*").alias("n"))
    return both.where("lo = hi").select("chrom", "pos", F.col("lo").alias("strand"), F.col("n").alias("n_hits"))

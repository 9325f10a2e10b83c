"""Barcode deduplication of mapped records (rec_no, qname, chrom, pos0, flag, seq_len, xm)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def barcode_of(qname) -> F.Column:
    """What stands after the first ``TL:`` up to the next colon."""
    return F.regexp_extract(qname, "TL:([^:]*)", 1)


def keyed(records: DataFrame) -> DataFrame:
    """Mapped records (flags 0 and 16) with strand, barcode and pos5, the 5' end; of a reverse read that is the base after its last."""
    rev = F.col("flag") == 16
    return records.where(F.col("flag").isin(0, 16)).withColumns({"strand": rev.cast("int"), "pos5": F.when(rev, F.col("pos0") + F.col("seq_len")).otherwise(F.col("pos0")), "barcode": barcode_of(F.col("qname"))})


def without_last(records: DataFrame) -> DataFrame:
    """All records but the one with the largest number."""
    last = records.agg(F.max("rec_no").alias("__last"))
    return records.join(F.broadcast(last)).where("rec_no < __last").drop("__last")


KEY = ["chrom", "pos5", "strand", "barcode"]


def split_duplicates(records: DataFrame) -> DataFrame:
    """Keyed records with ``first``: whether it is the first in file order of its place and barcode.

    The first is found by an aggregate that combines before it shuffles, so a place with very many copies makes no large group.
    """
    k = keyed(records)
    low = k.groupBy(*KEY).agg(F.min("rec_no").alias("__first"))
    return k.join(low, KEY).withColumn("first", F.col("rec_no") == F.col("__first")).drop("__first")


def deduplicated(records: DataFrame) -> DataFrame:
    return split_duplicates(records).where("first").drop("first")


def artifacts(records: DataFrame) -> DataFrame:
    """The later copies."""
    return split_duplicates(records).where("not first").drop("first")


def occurrences(records: DataFrame) -> DataFrame:
    """Per place: n_total records and n_unique barcodes."""
    per = keyed(records).groupBy(*KEY).agg(F.count("*").alias("n"))
    return per.groupBy("chrom", "pos5", "strand").agg(F.sum("n").alias("n_total"), F.count("*").alias("n_unique"))


def duplication_histogram(places: DataFrame) -> DataFrame:
    """(rate, unique, non_unique, unique_reads, non_unique_reads) for rates from 1 to the largest. Places are read once: each adds to one rate of either kind."""
    kinds = F.array(F.struct(F.col("n_unique").alias("rate"), F.lit(1).alias("u"), F.lit(0).alias("v")), F.struct((F.col("n_total") - F.col("n_unique")).alias("rate"), F.lit(0).alias("u"), F.lit(1).alias("v")))
    both = places.select(F.explode(kinds).alias("k")).where("k.rate > 0").groupBy("k.rate").agg(F.sum("k.u").alias("unique"), F.sum("k.v").alias("non_unique"))
    # a row for every rate: those up to the next one that occurs follow it
    gap = F.coalesce(F.lag("rate").over(Window.orderBy("rate")), F.lit(0)) + 1
    d = both.withColumn("from", gap).withColumn("at", F.explode(F.sequence("from", "rate"))).select(F.col("at").alias("rate"), *(F.when(F.col("at") == F.col("rate"), F.col(c)).otherwise(0).alias(c) for c in ("unique", "non_unique")))
    return d.withColumns({"unique_reads": F.col("rate") * F.col("unique"), "non_unique_reads": F.col("rate") * F.col("non_unique")})


def artifact_ratio(histogram: DataFrame, most: int = 50) -> DataFrame:
    """(rate, n_places, artifact_ratio) for the first ``most`` rates that occur: places of that rate, and the share of them that counts later copies."""
    n = F.col("unique") + F.col("non_unique")
    return histogram.where((F.col("rate") <= most) & (n > 0)).select("rate", n.alias("n_places"), (F.col("non_unique") / n).alias("artifact_ratio"))


def cluster_filter(records: DataFrame, least: int) -> DataFrame:
    """First copies at places with at least ``least`` barcodes."""
    big = occurrences(records).where(F.col("n_unique") >= least).select("chrom", "pos5", "strand")
    return deduplicated(records).join(big, ["chrom", "pos5", "strand"], "left_semi")


def mapping_classes(records: DataFrame) -> DataFrame:
    """Records by their XM tag: 0 could not be mapped, other values not uniquely; none counts as mapped or, by its flag, as other."""
    kind = F.when(F.col("xm") == 0, "unmapped").when(F.col("xm").isNotNull(), "not_unique").when(F.col("flag").isin(0, 16), "mapped").otherwise("other")
    return records.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def statistics(records: DataFrame, chrom_pattern: str | None = None) -> DataFrame:
    """One row of counters: total, filtered by chromosome, unmapped, not unique, mapped, removed copies, reads that share a place more than twice, and the share removed."""
    hit = F.coalesce(F.col("chrom").rlike(f"^(?:{chrom_pattern})$"), F.lit(False)) if chrom_pattern else F.lit(False)
    tagged = records.withColumn("__f", hit)
    c = tagged.agg(F.count("*").alias("n_total"), F.count_if("__f").alias("n_filtered"), F.count_if(~F.col("__f") & (F.col("xm") == 0)).alias("n_unmapped"), F.count_if(~F.col("__f") & (F.col("xm") != 0)).alias("n_not_unique"))
    o = occurrences(tagged.where("not __f"))
    m = o.agg(F.coalesce(F.sum("n_total"), F.lit(0)).alias("n_mapped"), F.coalesce(F.sum(F.col("n_total") - F.col("n_unique")), F.lit(0)).alias("n_removed"), F.coalesce(F.sum(F.when(F.col("n_total") - F.col("n_unique") > 1, F.col("n_total") - F.col("n_unique"))), F.lit(0)).alias("n_same_position"))
    return c.join(F.broadcast(m)).withColumn("pcr_rate", F.when(F.col("n_mapped") > 0, F.col("n_removed") / F.col("n_mapped")).otherwise(0.0))


def half(records: DataFrame, which: int) -> DataFrame:
    """One of two halves, by the parity of a mix of the record number (number * 7919 + number // 13), so that a repeated run splits alike.

    The mix is odd where one of number and number // 13 is, which their last bits tell: no product runs over 64 bits, and no quotient is a double.
    """
    return records.where(F.expr("(rec_no ^ (rec_no div 13)) & 1") == which)


def strand_track(places: DataFrame) -> DataFrame:
    """One-base intervals with the number of barcodes, negative on the reverse strand."""
    return places.select("chrom", F.col("pos5").alias("start"), (F.col("pos5") + 1).alias("end"), F.when(F.col("strand") == 1, -F.col("n_unique")).otherwise(F.col("n_unique")).alias("value"))

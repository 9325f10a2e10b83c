"""Read preprocessing: pre-trim, uncalled bases, demultiplexing, quality, adapters, final length; in that order.

Every stage is optional and row-wise (barcodes and adapters are small dimensions sent along), so the whole chain is one stage without a shuffle, for batches and streams alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import adapters as A
from ..operators import reads as R
from ..params import TrimParams


def preprocess(reads: DataFrame, p: TrimParams, barcodes: DataFrame | None = None, adapters: DataFrame | None = None, barcode_length: int | None = None, observed: dict[str, Observation] | None = None) -> DataFrame:
    """``observed``, if given, gets an Observation of the rows left after each stage, filled when the result is computed: no pass of its own."""

    def count(d: DataFrame, stage: str) -> DataFrame:
        if observed is None:
            return d
        observed[stage] = Observation(stage)
        return d.observe(observed[stage], F.count(F.lit(1)).alias("reads"))

    d = reads if p.first_reads is None else reads.where(F.col("read_no") < p.first_reads)
    d = count(d, "read")
    if p.trim_left or p.trim_right or p.min_length:
        d = count(R.pre_trim(d, p.trim_left, p.trim_right, p.min_length, p.trim_tag), "pre_trim")
    if p.uncalled is not None:
        d = count(R.uncalled_filter(d, p.uncalled, p.substitute), "uncalled")
    if barcodes is not None:
        n = barcode_length or barcodes.agg(F.max(F.length("barcode"))).first()[0]
        d = R.clip_barcode(R.demultiplex(d, barcodes, n, p.approximate), n, p.hard_clip, p.exclude_unidentified)
        d = count(d, "demultiplex")
    if p.quality is not None:
        d = count(R.quality_trim(d, p.quality, p.quality_mode, p.quality_min_length, p.tag), "quality")
    if adapters is not None:
        d = A.strip(d, adapters, p)
        if "seq_rev" in reads.columns:
            d = A.strip(d.withColumnsRenamed({"matches": "matches_fwd", "removed": "removed_fwd"}), adapters, p, "seq_rev", "qual_rev", "id_rev", reverse=True)
            both = F.concat("matches_fwd", "matches")
            d = d.withColumns({"matches": both, "removed": F.col("removed_fwd") + F.col("removed")}).drop("matches_fwd", "removed_fwd")
        d = count(d, "adapters")
    if p.final_length:
        d = count(R.trim_to(d, p.final_length), "final_length")
    return d


def drop_statistics(reads: DataFrame, p: TrimParams, barcodes: DataFrame | None = None, adapters: DataFrame | None = None) -> DataFrame:
    """(reason, n_reads): how many reads each stage dropped, and ``kept`` for those left. Runs the chain once; one number a stage comes to the driver."""
    seen: dict[str, Observation] = {}
    preprocess(reads, p, barcodes, adapters, observed=seen).write.format("noop").mode("overwrite").save()
    left = [(k, o.get["reads"]) for k, o in seen.items()]
    rows = [(k, before - after) for (_, before), (k, after) in zip(left, left[1:])] + [("kept", left[-1][1])]
    return reads.sparkSession.createDataFrame(rows, "reason string, n_reads long")

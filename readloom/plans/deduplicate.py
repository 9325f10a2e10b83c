"""Barcode deduplication of mapped reads, with its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import dedup as D
from ..operators import hits as H
from ..params import DedupParams


@dataclass
class Deduplicated:
    """What a run gives; all of it lazy."""

    kept: DataFrame
    artifacts: DataFrame
    clusters: DataFrame | None
    halves: tuple[DataFrame, DataFrame] | None
    places: DataFrame
    histogram: DataFrame
    statistics: DataFrame
    track: DataFrame


def deduplicate(records: DataFrame, p: DedupParams = DedupParams()) -> Deduplicated:
    """Records as ``sources.alignments.for_dedup`` makes them."""
    records = D.without_last(records) if p.drop_last else records
    used = H.chrom_filter(records, p.chrom_filter) if p.chrom_filter else records
    kept = D.deduplicated(used)
    places = D.occurrences(used)
    halves = (D.half(kept, 0), D.half(kept, 1)) if p.split else None
    clusters = D.cluster_filter(used, p.min_unique) if p.min_unique else None
    return Deduplicated(kept, D.artifacts(used), clusters, halves, places, D.duplication_histogram(places), D.statistics(records, p.chrom_filter), D.strand_track(places))

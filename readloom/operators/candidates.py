"""Peak candidates from sliding-window scores over single-strand sites.

Definition. A chromosome's sites stand in order of (pos, strand). A site *opens* if its score reaches the limit and is
positive. The *peak* of an opening site is the best of it and the next ``half - 1`` sites, the first of equals; the peak's window is
all sites within ``half`` bases of it. Candidates are the peaks of a chain of opening sites: the first one of the chromosome, then always the
first one behind the last one's window. A candidate's *plateau* begins at the window's first site that scores over nine tenths of
the peak and ends before the first later one that scores less; its centre is the last of its sites nearer to its middle than its begin.

Peaks, windows and plateaus are native windows and joins, tile by tile. Only the chain is a walk: an opening site that no earlier
window reaches starts a stretch of its own, and stretches are walked apart from each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import in_tiles, sliding_score
from .rangejoin import range_join

#: Sites of a tile, where windows go by number of site.
SITES = 1 << 16


def numbered(sites: DataFrame) -> DataFrame:
    """``rn``: a site's number on its chromosome, from 0 on, and ``n``, how many there are. Tiles count on their own and add what lies before them."""
    t = in_tiles(sites, 0)
    counts = t.groupBy("chrom", "__own").agg(F.count("*").alias("__c"))
    along = Window.partitionBy("chrom").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("chrom", "__own", F.coalesce(F.sum("__c").over(along), F.lit(0)).alias("__b"), F.sum("__c").over(Window.partitionBy("chrom")).alias("n"))
    own = F.row_number().over(Window.partitionBy("chrom", "__own").orderBy("pos", "strand"))
    return t.withColumn("rn", own).join(before, ["chrom", "__own"]).withColumn("rn", F.col("__b") + F.col("rn") - 1).drop("__own", "__t", "__b")


def _by_number(df: DataFrame, ahead: int, behind: int) -> DataFrame:
    """In tiles by ``rn``; each tile (``__t``) also sees the next ``ahead`` and the last ``behind`` numbers beside it."""
    size = max(SITES, ahead, behind)
    of = lambda by: F.floor((F.col("rn") + by) / size)
    return df.withColumn("__own", of(0)).withColumn("__t", F.explode(F.array_distinct(F.array(of(-ahead), of(0), of(behind)))))


def openings(sites: DataFrame, half: int, limit: float) -> DataFrame:
    """(chrom, rn, score, at, lo, hi, stretch, whole) of the opening sites among numbered, scored ones: the peak's score, number and window, the stretch, and whether ``half`` more sites follow."""
    w = Window.partitionBy("chrom", "__t").orderBy("pos")
    s = in_tiles(sites, half)
    s = s.withColumn("lo", F.least(F.greatest(F.min("rn").over(w.rangeBetween(-half, 0)), F.lit(1)), F.col("rn"))).withColumn("hi", F.max("rn").over(w.rangeBetween(0, half)))
    s = _by_number(s.where("__t = __own").drop("__t", "__own"), half, 0)
    peak = F.max(F.struct("score", (-F.col("rn")).alias("neg"), "lo", "hi")).over(Window.partitionBy("chrom", "__t").orderBy("rn").rowsBetween(0, half - 1))
    s = s.withColumn("p", peak).where((F.col("__t") == F.col("__own")) & (F.col("score") >= limit) & (F.col("score") > 0))
    s = s.select("chrom", "rn", "p.score", (-F.col("p.neg")).alias("at"), "p.lo", "p.hi", (F.col("rn") + half < F.col("n")).alias("whole"))
    # at most two sites share a position, so a window ends at most that many sites behind its opening
    far = 3 * half + 2
    s = _by_number(s, 0, far)
    reached = F.max("hi").over(Window.partitionBy("chrom", "__t").orderBy("rn").rangeBetween(-far, -1))
    s = s.withColumn("__free", F.coalesce(reached < F.col("rn"), F.lit(True))).where("__t = __own").withColumn("__head", F.when(F.col("__free"), F.col("rn")))
    tiles = s.groupBy("chrom", "__t").agg(F.max("__head").alias("__m"))
    carried = F.max("__m").over(Window.partitionBy("chrom").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    tiles = tiles.select("chrom", "__t", carried.alias("__before"))
    own = F.max("__head").over(Window.partitionBy("chrom", "__t").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return s.join(tiles, ["chrom", "__t"]).withColumn("stretch", F.coalesce(own, F.col("__before"))).select("chrom", "rn", "score", "at", "lo", "hi", "stretch", "whole")


def _chain(t: pa.Table) -> pa.Table:
    """The chain's rows in one stretch."""
    t = t.sort_by("rn")
    rn, hi = (t.column(c).to_numpy() for c in ("rn", "hi"))
    following = np.searchsorted(rn, hi, "right")
    take, i = [], 0
    while i < len(rn):
        take.append(i)
        i = int(following[i])
    return t.take(pa.array(take, pa.int64()))


def forward_candidates(sites: DataFrame, half: int, limit: float, tolerance: float = 0.0) -> DataFrame:
    """Candidates (chrom, pos, strand, score, start, end, width) among sites (chrom, pos, strand, n). Those that open fewer than ``half`` sites before a chromosome's end are not given."""
    s = numbered(sliding_score(sites, half, tolerance))
    opened = openings(s, half, limit)
    chain = opened.groupBy("chrom", "stretch").applyInArrow(_chain, opened.schema).where("whole").select("chrom", F.col("score").alias("top"), "at", "lo", "hi")
    near = range_join(chain, s.select("chrom", "rn", "pos", "strand", "score"), "rn", F.col("lo"), F.col("hi"), width=max(4 * half, 64))
    # a window holds at most two sites a position
    c = near.groupBy("chrom", "at", "top", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("rn", "pos", "strand", "score"))).alias("w"))
    bar = F.lit(0.9) * F.col("top")
    c = c.withColumn("over", F.filter("w", lambda x: (x["rn"] < F.col("hi")) & (x["score"] > bar)))
    c = c.withColumn("first", F.coalesce(F.get("over", F.lit(0))["rn"], F.col("lo")))
    c = c.withColumn("under", F.filter("w", lambda x: (F.size("over") > 0) & (x["rn"] > F.col("first")) & (x["rn"] < F.col("hi")) & (x["score"] < bar)))
    c = c.withColumn("last", F.coalesce(F.get("under", F.lit(0))["rn"] - 1, F.col("hi")))
    site = lambda n: F.get("w", (F.col(n) - F.col("lo")).cast("int"))
    c = c.withColumns({"from": site("first")["pos"], "to": site("last")["pos"]}).withColumn("middle", F.floor((F.col("from") + F.col("to")) / 2))
    inner = F.filter("w", lambda x: (x["rn"] >= F.col("first")) & (x["rn"] < F.col("last")) & (F.abs(F.col("middle") - x["pos"]) < F.col("middle") - F.col("from")))
    c = c.withColumn("centre", F.coalesce(F.get(inner, F.size(inner) - 1), site("first")))
    return c.select("chrom", "centre.pos", "centre.strand", F.col("top").alias("score"), F.get("w", F.lit(0))["pos"].alias("start"), site("hi")["pos"].alias("end"), (F.col("to") - F.col("from")).alias("width"))


def candidates_bed(candidates: DataFrame) -> DataFrame:
    """One-base intervals named by their score."""
    return candidates.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("score").cast("string").alias("name"))


def width_histogram(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("width").agg(F.count("*").alias("n"))


def score_profile(candidates: DataFrame, sites: DataFrame, half: int, most: int, tolerance: float = 0.0) -> DataFrame:
    """(offset, score): sums of site scores by distance from a candidate's centre, up to ``most``, within its window."""
    s = sliding_score(sites, half, tolerance).select("chrom", F.col("pos").alias("at"), F.col("score").alias("v"))
    near = range_join(candidates.select("chrom", "pos", "start", "end"), s, "at", F.greatest(F.col("start"), F.col("pos") - most), F.least(F.col("end"), F.col("pos") + most), width=max(most, 64))
    return near.groupBy((F.col("at") - F.col("pos")).alias("offset")).agg(F.sum("v").alias("score"))


def width_profile(sites: DataFrame, widths: range) -> DataFrame:
    """(half, score): the sum of all sites' scores for each half width."""
    out = None
    for h in widths:
        d = sliding_score(sites, h).agg(F.sum("score").alias("score")).select(F.lit(h).alias("half"), "score")
        out = d if out is None else out.unionByName(d)
    return out


def correlation_length(correlation: DataFrame) -> DataFrame:
    """The row, from 1 on, of a cross-correlation table (row, value) with the largest sum; the first of equals."""
    s = correlation.where("row >= 1").groupBy("row").agg(F.sum("value").alias("v")).where("v > 0")
    return s.agg(F.min(F.struct((-F.col("v")).alias("v"), "row")).alias("b")).select(F.col("b.row").alias("fragment_length"))

"""Coverage by pairs and its local maxima."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(pairs: DataFrame) -> DataFrame:
    """Where the number of pairs over a position changes, and by how much: +1 at a pair's start, -1 after its end. Summed before any sort."""
    ends = pairs.select("chrom", F.explode(F.array(F.struct(F.col("f_pos").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("r_pos") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    return ends.groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")


#: Positions of a tile: windows along a chromosome run tile by tile, so a long or deep chromosome is many tasks' work.
TILE = 1 << 20


def stepped(changes: DataFrame) -> DataFrame:
    """(chrom, pos, d, cov, end, next): the running sum of changes, and where and by how much it changes next (null at the last).

    Tiles hand on their sums and first changes through a table of one row a tile; the join to it and the windows share one shuffle.
    """
    c = changes.withColumn("__t", F.floor(F.col("pos") / TILE))
    tiles = c.groupBy("chrom", "__t").agg(F.sum("d").alias("__s"), F.min(F.struct("pos", "d")).alias("__f"))
    along = Window.partitionBy("chrom").orderBy("__t")
    before = F.coalesce(F.sum("__s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiles = tiles.select("chrom", "__t", before.alias("__b"), F.lead("__f").over(along).alias("__n"))
    w = Window.partitionBy("chrom", "__t").orderBy("pos")
    own = c.join(tiles, ["chrom", "__t"])
    cov = F.col("__b") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("chrom", "pos", "d", cov.alias("cov"), F.coalesce(F.lead("pos").over(w), F.col("__n.pos")).alias("end"), F.coalesce(F.lead("d").over(w), F.col("__n.d")).alias("next"))


def coverage(pairs: DataFrame) -> DataFrame:
    """(chrom, pos, d, cov): the coverage from each change on."""
    return stepped(changes(pairs)).select("chrom", "pos", "d", "cov")


def raw_summits(pairs: DataFrame) -> DataFrame:
    """The middle and height of every plateau that a rise enters and a fall leaves."""
    return stepped(changes(pairs)).where("d > 0 and next < 0 and pos >= 1").select("chrom", F.expr("pos + (end - pos) div 2").alias("pos"), F.col("cov").alias("q_cov"))


def refined_summits(summits: DataFrame, reach: int) -> DataFrame:
    """Summits without a strictly higher one nearer than ``reach``; a chromosome's first summit is never looked at from its right.

    Tiles see the summits that lie nearer than ``reach`` beside them.
    """
    size = max(TILE, 2 * reach)
    first = summits.groupBy("chrom").agg(F.min("pos").alias("__first"))
    tile = F.floor(F.col("pos") / size)
    s = summits.join(F.broadcast(first), "chrom").withColumn("__own", tile)
    s = s.withColumn("__t", F.explode(F.array_distinct(F.array(F.floor((F.col("pos") - reach) / size), "__own", F.floor((F.col("pos") + reach) / size)))))
    w = Window.partitionBy("chrom", "__t").orderBy("pos")
    left = F.max(F.when(F.col("pos") > F.col("__first"), F.col("q_cov"))).over(w.rangeBetween(-(reach - 1), 0))
    right = F.max("q_cov").over(w.rangeBetween(0, reach - 1))
    seen = s.withColumn("l", F.coalesce(left, F.col("q_cov"))).withColumn("r", right)
    return seen.where("__t = __own and q_cov >= l and q_cov >= r").select("chrom", "pos", "q_cov")


def runs(summits: DataFrame, reach: int) -> DataFrame:
    """``run``: where the run begins that a summit belongs to; gaps of at least ``reach`` part runs. Tiles hand on their last summits and run beginnings through tables of one row a tile."""
    s = summits.withColumn("__t", F.floor(F.col("pos") / TILE))
    along = Window.partitionBy("chrom").orderBy("__t")
    own = Window.partitionBy("chrom", "__t").orderBy("pos")
    last = s.groupBy("chrom", "__t").agg(F.max("pos").alias("__m")).select("chrom", "__t", F.lag("__m").over(along).alias("__before"))
    s = s.join(last, ["chrom", "__t"]).withColumn("__prev", F.coalesce(F.lag("pos").over(own), F.col("__before")))
    s = s.withColumn("__head", F.when(F.col("__prev").isNull() | (F.col("pos") - F.col("__prev") >= reach), F.col("pos"))).drop("__before", "__prev")
    heads = s.groupBy("chrom", "__t").agg(F.max("__head").alias("__h")).select("chrom", "__t", F.max("__h").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__run"))
    run = F.coalesce(F.max("__head").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__run"))
    return s.join(heads, ["chrom", "__t"]).withColumn("run", run).drop("__t", "__head", "__run")


def merged_summits(summits: DataFrame, reach: int, drop_last: bool = True) -> DataFrame:
    """Neighbours nearer than ``reach`` to the current summit move it half way and give it their place; its height stays. With ``drop_last``, a chromosome's last one is not given.

    Runs of summits with smaller gaps are independent of each other, so the fold is over one run at a time, in linear time; a run's places and heights are all that a task holds.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        place, height = t.column("pos").to_pylist(), t.column("q_cov").to_pylist()
        at, top = [place[0]], [height[0]]
        for x, q in zip(place[1:], height[1:]):
            if x - at[-1] < reach:
                at[-1] += (x - at[-1]) // 2
            else:
                at.append(x)
                top.append(q)
        return pa.table({"chrom": [t.column("chrom")[0].as_py()] * len(at), "pos": pa.array(at, pa.int64()), "q_cov": pa.array(top, pa.int64())})

    parted = runs(summits, reach).select("chrom", "run", F.col("pos").cast("long").alias("pos"), F.col("q_cov").cast("long").alias("q_cov"))
    out = parted.groupBy("chrom", "run").applyInArrow(fold, "chrom string, pos long, q_cov long")
    if not drop_last:
        return out
    last = out.groupBy("chrom").agg(F.max("pos").alias("last"))
    return out.join(last, "chrom").where("pos < last").drop("last")

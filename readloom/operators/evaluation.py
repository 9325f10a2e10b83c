"""Counts around summits, scores, p- and q-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rangejoin import range_join


def _at(summits: DataFrame) -> DataFrame:
    return summits.select("chrom", F.col("pos").alias("s"))


def pair_coverage(summits: DataFrame, pairs: DataFrame, reach: int, name: str, control: bool = False) -> DataFrame:
    """(chrom, s, name): pairs that span each summit and start less than ``reach`` before it; a control pair must end after it, a treatment pair may end on it."""
    near = range_join(_at(summits), pairs, "f_pos", F.col("s") - reach + 1, F.col("s") - 1, width=reach)
    return near.where("r_pos > s" if control else "r_pos >= s").groupBy("chrom", "s").agg(F.count("*").alias(name))


def saturated_positions(summits: DataFrame, pairs: DataFrame, reach: int, sample: str) -> DataFrame:
    """(chrom, s, q_beg_*, q_end_*): distinct starts and ends of the pairs across a summit that are shorter than ``reach``."""
    near = range_join(_at(summits), pairs, "f_pos", F.col("s") - reach + 1, F.col("s") - 1, width=reach).where(f"r_pos > s and r_pos < f_pos + {reach}")
    return near.groupBy("chrom", "s").agg(F.countDistinct("f_pos").alias(f"q_beg_{sample}"), F.countDistinct("r_pos").alias(f"q_end_{sample}"))


def side_counts(summits: DataFrame, hits: DataFrame, radius: int, sample: str) -> DataFrame:
    """(chrom, s, kfu, kfd, kru, krd): hits nearer than ``radius`` by strand, before (u) and from (d) the summit on."""
    h = hits.select("chrom", "pos", "strand")
    near = range_join(_at(summits), h, "pos", F.col("s") - radius + 1, F.col("s") + radius - 1, width=max(radius, 64))
    n = lambda st, up, name: F.count_if((F.col("strand") == st) & ((F.col("pos") < F.col("s")) if up else (F.col("pos") >= F.col("s")))).alias(f"{name}_{sample}")
    return near.groupBy("chrom", "s").agg(n(0, True, "kfu"), n(0, False, "kfd"), n(1, True, "kru"), n(1, False, "krd"))


def pair_counts(summits: DataFrame, pairs: DataFrame, reach: int, sample: str, name: str, control: bool = False) -> DataFrame:
    """(chrom, s, name, q_beg_*, q_end_*): ``pair_coverage`` and ``saturated_positions`` of one sample in one join. The sets of positions are no larger than a summit's reach."""
    near = range_join(_at(summits), pairs, "f_pos", F.col("s") - reach + 1, F.col("s") - 1, width=reach)
    inside = (F.col("r_pos") > F.col("s")) & (F.col("r_pos") < F.col("f_pos") + reach)
    taken = lambda c, n: F.size(F.collect_set(F.when(inside, F.col(c)))).cast("long").alias(f"{n}_{sample}")
    across = F.col("r_pos") > F.col("s") if control else F.col("r_pos") >= F.col("s")
    return near.groupBy("chrom", "s").agg(F.count_if(across).alias(name), taken("f_pos", "q_beg"), taken("r_pos", "q_end"))


def both_side_counts(summits: DataFrame, chip: DataFrame, ctrl: DataFrame, radius: int) -> DataFrame:
    """``side_counts`` of both samples in one join."""
    h = chip.select("chrom", "pos", "strand", F.lit("chip").alias("sample")).unionByName(ctrl.select("chrom", "pos", "strand", F.lit("ctrl").alias("sample")))
    near = range_join(_at(summits), h, "pos", F.col("s") - radius + 1, F.col("s") + radius - 1, width=max(radius, 64))
    before = F.col("pos") < F.col("s")
    n = lambda st, up, name, sample: F.count_if((F.col("sample") == sample) & (F.col("strand") == st) & (before if up else ~before)).alias(f"{name}_{sample}")
    return near.groupBy("chrom", "s").agg(*(n(st, up, name, sample) for sample in ("chip", "ctrl") for st, up, name in ((0, True, "kfu"), (0, False, "kfd"), (1, True, "kru"), (1, False, "krd"))))


def evaluate(summits: DataFrame, chip_pairs: DataFrame, ctrl_pairs: DataFrame, chip: DataFrame, ctrl: DataFrame, q_max: int) -> DataFrame:
    """All counts of each summit with some treatment pair across it, its saturation score, and q_cov_chip as the hits around it. Three range joins: pairs of either sample, and hits of both."""
    out = summits.select("chrom", F.col("pos").alias("s"), "q_cov").join(pair_counts(summits, chip_pairs, q_max, "chip", "pairs_chip").where("pairs_chip > 0"), ["chrom", "s"])
    for part in (pair_counts(summits, ctrl_pairs, q_max, "ctrl", "q_cov_ctrl", True), both_side_counts(summits, chip, ctrl, q_max)):
        out = out.join(part, ["chrom", "s"], "left")
    out = out.na.fill(0)
    return (
        out.withColumn("q_cov_chip", F.col("kfu_chip") + F.col("kfd_chip") + F.col("kru_chip") + F.col("krd_chip"))
        .withColumn("saturation", F.greatest(F.lit(0), F.col("q_beg_chip") + F.col("q_end_chip") - F.col("q_beg_ctrl") - F.col("q_end_ctrl")) / (2 * q_max))
        .withColumnRenamed("s", "pos")
    )


def most_around(hits: DataFrame, radius: int) -> int:
    """No position has more hits nearer than ``radius`` than this: the largest sum of two neighbouring bins of twice that width. One number to the driver."""
    b = F.floor(F.col("pos") / (2 * radius))
    two = hits.groupBy("chrom", b.alias("b")).agg(F.count("*").alias("n")).select("chrom", F.explode(F.array("b", F.col("b") - 1)).alias("b"), "n")
    return two.groupBy("chrom", "b").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0


def success(hits: DataFrame, genome: int, q_min: int, q_max: int) -> Column | DataFrame:
    """One row, p: the chance that a position of a summit's window is taken by a pair, from genome-wide strand counts."""
    n = hits.agg(F.count_if(F.col("strand") == 0).alias("t_f"), F.count_if(F.col("strand") == 1).alias("t_r"))
    lam = F.lit(float(q_max - q_min)) * F.col("t_r") / F.lit(float(genome))
    rate = F.col("t_f") / F.lit(float(genome)) * (1 - F.exp(-lam))
    return n.select((1 - F.exp(-2 * rate)).alias("p"))


def expected_saturation(evaluated: DataFrame, hits: DataFrame, chroms: DataFrame, q_min: int, q_max: int) -> DataFrame:
    """Evaluated summits with taken starts and ends, together at least as many (``n_expected``) as chance makes in a window, by the strand counts of their chromosome."""
    n = hits.groupBy("chrom").agg(F.count_if(F.col("strand") == 0).alias("f"), F.count_if(F.col("strand") == 1).alias("r")).join(chroms, "chrom")
    size = F.col("length").cast("double")
    p = 1 - F.exp(-2 * (F.col("f") / size * (1 - F.exp(-F.lit(float(q_max - q_min)) * F.col("r") / size))))
    least = n.select("chrom", F.round(2 * q_max * p).cast("long").alias("n_expected"))
    return evaluated.join(least, "chrom").where("q_beg_chip > 0 and q_end_chip > 0 and n_expected <= q_beg_chip + q_end_chip")


def binomial_pmf(p: DataFrame, n: int) -> DataFrame:
    """(k, pmf) for k from 0 to n, in logarithms: running sums of the ratios of neighbours. ``n`` is a window's size, so the table is small."""
    k = p.select("p", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    ratio = F.when(F.col("k") == 0, n * F.log(1 - F.col("p"))).otherwise(F.log((n - F.col("k") + 1) / F.col("k")) + F.log(F.col("p")) - F.log(1 - F.col("p")))
    return k.withColumn("l", F.sum(ratio).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).select("k", F.exp("l").alias("pmf"))


def upper_tail(pmf: DataFrame, at: str = "k") -> DataFrame:
    """(at, p_value): P(X >= at)."""
    w = Window.orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    return pmf.select(at, F.least(F.lit(1.0), F.sum("pmf").over(w)).alias("p_value"))


def difference_tail(chip: DataFrame, ctrl: DataFrame, n: int) -> DataFrame:
    """(d, p_value): P(X - Y >= d) of two independent tables over 0 to n."""
    other = ctrl.agg(F.array_sort(F.collect_list(F.struct("k", "pmf"))).alias("c"))
    both = chip.join(F.broadcast(other)).select("k", F.col("pmf").alias("a"), F.explode("c").alias("c")).groupBy((F.col("k") - F.col("c.k")).alias("d")).agg(F.sum(F.col("a") * F.col("c.pmf")).alias("pmf"))
    return upper_tail(both, "d")


def poisson_tail(rates: DataFrame, most: int) -> DataFrame:
    """(chrom, k, p_value): P(X > k) for each chromosome's rate lambda, for k from 0 to ``most``; exact to the terms up to ``most`` + 200."""
    top = most + 200
    k = rates.select("chrom", "lambda", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k"))
    ratio = F.when(F.col("k") == 0, -F.col("lambda")).otherwise(F.log(F.col("lambda") / F.col("k")))
    w = Window.partitionBy("chrom")
    l = k.withColumn("l", F.sum(ratio).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    t = l.withColumn("p_value", F.sum(F.exp("l")).over(w.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)))
    return t.where(F.col("k") <= most).select("chrom", "k", F.coalesce("p_value", F.lit(0.0)).alias("p_value"))


def rank_by(summits: DataFrame, key: Column) -> DataFrame:
    """``rn``: the rank by ``key`` ascending, then chrom and pos, and ``n``, the number of rows.

    The key takes few values, so ranks come from counts by (key, chrom) and a numbering within each: one task sorts the groups, none sorts all rows.
    """
    s = summits.withColumn("__key", key)
    per = s.groupBy("__key", "chrom").agg(F.count("*").alias("__c"))
    w = Window.orderBy("__key", "chrom").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("__key", "chrom", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__base"), F.sum("__c").over(Window.partitionBy()).alias("n"))
    own = F.row_number().over(Window.partitionBy("__key", "chrom").orderBy("pos"))
    return s.withColumn("__own", own).join(base, ["__key", "chrom"]).withColumn("rn", F.col("__base") + F.col("__own")).drop("__key", "__own", "__base")


def q_values(scored: DataFrame) -> DataFrame:
    """q_value = p * n / rank, neither capped nor made monotone; needs p_value, rn and n."""
    return scored.withColumn("q_value", F.col("p_value") * F.col("n") / F.col("rn"))


def take_while(scored: DataFrame, cutoff: float) -> DataFrame:
    """Rows before the first, in order of rn, whose -log10 q is not above the cutoff."""
    fails = F.coalesce(-F.log10("q_value") <= cutoff, F.lit(True))
    stop = scored.agg(F.min(F.when(fails, F.col("rn"))).alias("__stop"))
    return scored.join(F.broadcast(stop)).where("__stop is null or rn < __stop").drop("__stop")


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """The first n by rank."""
    return scored.where(F.col("rn") <= n)


def hit_distribution(summits: DataFrame, chroms: DataFrame, chip: DataFrame, ctrl: DataFrame, radius: int) -> DataFrame:
    """(offset, four counts) from -radius to radius: hits around summits by strand and sample. Each chromosome's first two summits, and those beyond its end, do not count."""
    s = summits.select("chrom", "pos")
    for _ in range(2):
        s = s.join(s.groupBy("chrom").agg(F.min("pos").alias("__least")), "chrom").where("pos > __least").drop("__least")
    s = s.join(chroms, "chrom").where("pos < length").select("chrom", F.col("pos").alias("s"))
    both = chip.select("chrom", "pos", "strand", F.lit("chip").alias("sample")).unionByName(ctrl.select("chrom", "pos", "strand", F.lit("ctrl").alias("sample")))
    near = range_join(s, both, "pos", F.col("s") - radius, F.col("s") + radius, width=max(radius, 64))
    n = lambda st, sample: F.count_if((F.col("strand") == st) & (F.col("sample") == sample)).alias(f"{'fr'[st]}_{sample}")
    got = near.groupBy((F.col("pos") - F.col("s")).alias("offset")).agg(n(0, "chip"), n(1, "chip"), n(0, "ctrl"), n(1, "ctrl"))
    every = summits.sparkSession.range(-radius, radius + 1).select(F.col("id").alias("offset"))
    return every.join(got, "offset", "left").na.fill(0)


#: Positions of a tile: windows along a chromosome run tile by tile, so a long or deep chromosome is many tasks' work.
TILE = 1 << 20


def in_tiles(sites: DataFrame, reach: int) -> DataFrame:
    """Sites in their tile (``__own``) and in every tile (``__t``) that lies nearer than ``reach`` to them, so that windows of that reach see all they need."""
    size = max(TILE, 2 * reach)
    of = lambda by: F.floor((F.col("pos") + by) / size)
    return sites.withColumn("__own", of(0)).withColumn("__t", F.explode(F.array_distinct(F.array(of(-reach), of(0), of(reach)))))


def sliding_score(sites: DataFrame, half: int, tolerance: float = 0.0) -> DataFrame:
    """For each site (chrom, pos, strand, n): forward counts before less reverse ones, plus the opposite after it, within ``half`` bases.

    Sites are in order of (pos, strand); those first and last on a chromosome score 0, and so do those whose halves differ by more than ``tolerance`` (0: no test).
    """
    place = F.struct("pos", "strand")
    ends = sites.groupBy("chrom").agg(F.min(place).alias("__first"), F.max(place).alias("__last"))
    s = in_tiles(sites.withColumn("v", F.when(F.col("strand") == 1, -F.col("n")).otherwise(F.col("n"))).join(ends, "chrom"), half)
    at = Window.partitionBy("chrom", "__t").orderBy("pos")
    here = Window.partitionBy("chrom", "__t", "pos").orderBy("strand")
    s = s.withColumn("upto", F.sum("v").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("same", F.sum("v").over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("upto"))
    # the walk to the left stops before the chromosome's first site
    inner = F.when(place != F.col("__first"), F.col("v")).otherwise(0)
    s = s.withColumn("left", F.sum(inner).over(at.rangeBetween(-half, 0)) - F.col("same")).withColumn("right", F.col("upto") - F.sum("v").over(at.rangeBetween(0, half)))
    score = F.when((place == F.col("__first")) | (place == F.col("__last")), 0).otherwise(F.col("left") + F.col("right"))
    if tolerance:
        ratio = F.when(F.col("left") != 0, F.col("right") / F.col("left"))
        score = F.when(F.coalesce((ratio < 1 - tolerance) | (ratio > 1 + tolerance), F.lit(True)), 0).otherwise(score)
    return s.where("__t = __own").select("chrom", "pos", "strand", score.cast("long").alias("score"))

"""Columns over read sequences and qualities (Phred + 33 text). No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def insert_after_first_token(id_: Column, token: Column) -> Column:
    """``token`` before the first space of ``id_``, or at its end."""
    head = F.substring_index(id_, " ", 1)
    return F.concat(head, token, F.substring(id_, F.length(head) + 1, F.length(id_)))


def normalise(seq: Column) -> Column:
    """Upper case; anything but A, C, G, T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def scores(qual: Column) -> Column:
    """Phred scores as array<int>; an empty text has none."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def error_probability(score: Column) -> Column:
    return F.pow(F.lit(10.0), -score / 10)


def kept_by_tail(q: Column, cutoff: int) -> Column:
    """Bases kept up to the last with a score of at least ``cutoff``."""
    return F.coalesce(F.array_max(F.filter(F.transform(q, lambda v, i: F.when(v >= cutoff, i + 1).otherwise(0)), lambda x: x > 0)), F.lit(0))


def kept_by_sum(q: Column, cutoff: int) -> Column:
    """Bases kept by the running sum of cutoff - q from the 3' end: up to and with the place of its maximum, until it falls below 0."""
    n = F.size(q)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), n.alias("keep"), F.lit(False).alias("stop"), n.alias("i"))

    def step(a, v):
        s = a["sum"] + cutoff - v
        stop = a["stop"] | (s < 0)
        better = ~stop & (s > a["best"])
        return F.struct(s.alias("sum"), F.when(better, s).otherwise(a["best"]).alias("best"), F.when(better, a["i"]).otherwise(a["keep"]).alias("keep"), stop.alias("stop"), (a["i"] - 1).alias("i"))

    return F.aggregate(F.reverse(q), start, step, lambda a: a["keep"])


def kept_by_window(q: Column, cutoff: int, window: int = 5) -> Column:
    """Bases before the first window whose sum is below window * cutoff; windows at the end are shorter, the sum asked for is not.

    The scores come through a lambda's variable: a column that is named within a lambda is computed again for every element. Zeros behind them complete the last windows.
    """

    def first(p):
        at = F.transform(p, lambda v, i: F.when(sum((F.get(p, i + k) for k in range(1, window)), v) < window * cutoff, i))
        n = F.size(p) - (window - 1)
        return F.least(F.coalesce(F.array_min(at), n), n)

    padded = F.concat(q, F.array_repeat(F.lit(0), window - 1))
    return F.get(F.transform(F.array(padded), first), F.lit(0))


def kept(q: Column, cutoff: int, mode: str = "TAIL") -> Column:
    """Bases kept in one of the modes TAIL, WIN and BWA (the running sum, then TAIL) or SUM (alone)."""
    if mode == "TAIL":
        return kept_by_tail(q, cutoff)
    if mode == "WIN":
        return kept_by_window(q, cutoff)
    n = kept_by_sum(q, cutoff)
    return n if mode == "SUM" else kept_by_tail(F.slice(q, F.lit(1), n), cutoff)


def uncalled(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))

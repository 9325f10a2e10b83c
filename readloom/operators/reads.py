"""Read preprocessing, stage by stage. Reads are (read_no, id, seq, qual) with optional seq_rev, qual_rev, id_rev (mates) and mux (barcode reads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def _mates(df: DataFrame) -> list[tuple[str, str, str]]:
    return [("seq", "qual", "id")] + ([("seq_rev", "qual_rev", "id_rev")] if "seq_rev" in df.columns else [])


def shortest(df: DataFrame) -> Column:
    return F.least(*[F.length(s) for s, _, _ in _mates(df)]) if len(_mates(df)) > 1 else F.length("seq")


def min_length(df: DataFrame, n: int) -> DataFrame:
    """Reads whose shorter mate has at least ``n`` bases."""
    return df.where(shortest(df) >= n)


def pre_trim(df: DataFrame, head: int, tail: int, least: int = 0, tag: bool = False) -> DataFrame:
    """Cut ``head`` and ``tail`` bases off each mate, or all bases if the shorter mate has no more than both; then ``min_length``. With ``tag``, the cut bases go into the id."""
    long = shortest(df) > head + tail
    new = {}
    for s, q, i in _mates(df):
        n = F.length(s) - head - tail
        new[s] = F.when(long, F.substring(F.col(s), F.lit(head + 1), n)).otherwise("")
        new[q] = F.when(long, F.substring(F.col(q), F.lit(head + 1), n)).otherwise("")
        if tag:
            left = F.concat(F.lit(":TL:"), F.substring(s, 1, head)) if head else F.lit("")
            right = F.concat(F.lit(":TR:"), F.substring(F.col(s), F.length(s) - tail + 1, F.lit(tail))) if tail else F.lit("")
            token = F.concat(left, right) if len(_mates(df)) == 1 else F.concat(right, left)  # mates are tagged cut by cut
            new[i] = F.when(long, S.insert_after_first_token(F.col(i), token)).otherwise(F.col(i))
    return min_length(df.withColumns(new), least)


def trim_to(df: DataFrame, n: int) -> DataFrame:
    """All mates cut to ``n`` bases; shorter reads go."""
    return min_length(df, n).withColumns({c: F.substring(c, 1, n) for s, q, _ in _mates(df) for c in (s, q)})


def uncalled_filter(df: DataFrame, allowed: int, substitute: str | None = None) -> DataFrame:
    """Reads of which no part has more than ``allowed`` N; n_uncalled counts theirs, and N are replaced if ``substitute`` is given."""
    parts = [s for s, _, _ in _mates(df)] + (["mux"] if "mux" in df.columns else [])
    n = [S.uncalled(F.col(c)) for c in parts]
    out = df.withColumn("n_uncalled", sum(n[1:], n[0]))
    for x in n:
        out = out.where(x <= allowed)
    return out.withColumns({c: F.translate(c, "N", substitute) for c in parts}) if substitute else out


def quality_trim(df: DataFrame, cutoff: int, mode: str = "TAIL", least: int = 0, tag: bool = False) -> DataFrame:
    """Trim the forward mate by quality; q_trimmed counts the bases that went, and ``:QT`` is added to the ids of trimmed reads. Then ``min_length``."""
    n = S.kept(S.scores(F.col("qual")), cutoff, mode)
    out = df.withColumn("__kept", n).withColumn("q_trimmed", F.length("seq") - F.col("__kept"))
    out = out.withColumns({c: F.substring(F.col(c), F.lit(1), F.col("__kept")) for c in ("seq", "qual")} | ({"id": F.when(F.col("q_trimmed") > 0, F.concat("id", F.lit(":QT"))).otherwise(F.col("id"))} if tag else {}))
    return min_length(out.drop("__kept"), least)


def barcode_variants(barcodes: DataFrame) -> DataFrame:
    """(barcode_id, variant): every barcode with any one base, N included, in any one place."""
    i = F.explode(F.sequence(F.lit(1), F.length("barcode"))).alias("i")
    b = barcodes.select("barcode_id", "barcode", i).select("barcode_id", "barcode", "i", F.explode(F.array(*map(F.lit, "ACGTN"))).alias("base"))
    return b.select("barcode_id", F.concat(F.substring(F.col("barcode"), F.lit(1), F.col("i") - 1), F.col("base"), F.substring(F.col("barcode"), F.col("i") + 1, F.length("barcode"))).alias("variant"))


def demultiplex(df: DataFrame, barcodes: DataFrame, length: int, approximate: bool = False) -> DataFrame:
    """``demux``: the number of the read's barcode (its first ``length`` bases, or its barcode read), 0 if there is none. The first of several barcodes wins.

    Reads no longer than a barcode go, unless it has a read of its own. The barcodes are a dimension of a few rows that is sent to every task.
    """
    inline = "mux" not in df.columns
    names = barcode_variants(barcodes) if approximate else barcodes.select("barcode_id", F.col("barcode").alias("variant"))
    first = names.groupBy("variant").agg(F.min("barcode_id").alias("__b"))
    reads = min_length_over(df, length) if inline else df
    key = F.substring("seq", 1, length) if inline else F.col("mux")
    return reads.withColumn("variant", key).join(F.broadcast(first), "variant", "left").withColumn("demux", F.coalesce("__b", F.lit(0)).cast("int")).drop("variant", "__b")


def min_length_over(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.length("seq") > n)


def clip_barcode(df: DataFrame, length: int, hard: bool = False, exclude: bool = False) -> DataFrame:
    """Cut the inline barcode off: of matched reads, or of all with ``hard``. ``exclude`` drops reads without a match."""
    out = df.where("demux > 0") if exclude else df
    if "mux" in df.columns:
        return out
    cut = F.lit(True) if hard else F.col("demux") > 0
    return out.withColumns({c: F.when(cut, F.substring(F.col(c), F.lit(length + 1), F.length(c))).otherwise(F.col(c)) for c in ("seq", "qual")})


def demux_counts(df: DataFrame) -> DataFrame:
    """Reads per barcode and their share in percent."""
    total = df.agg(F.count("*").alias("__n"))
    return df.groupBy("demux").agg(F.count("*").alias("n_reads")).join(F.broadcast(total)).select("demux", "n_reads", (100.0 * F.col("n_reads") / F.col("__n")).alias("percent"))

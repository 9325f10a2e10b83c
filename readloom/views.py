"""Sequencing-shaped views of the driver's tables, as DataFrames and as DuckDB text with the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROMS, LENGTH = 7, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment hits with repeats: chrom, pos, strand, read_len."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"),
        ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31) % LENGTH).alias("pos"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 2).cast("int").alias("strand"),
        F.lit(36).alias("read_len"),
    )


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control hits with repeats."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % CHROMS + 1).cast("string")).alias("chrom"),
        ((F.col("o_orderkey") * 6151 + F.col("o_custkey") * 389) % LENGTH).alias("pos"),
        (F.col("o_orderkey") % 2).cast("int").alias("strand"),
        F.lit(36).alias("read_len"),
    )


def chroms(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return spark.range(1, CHROMS + 1).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(LENGTH).cast("long").alias("length"))


#: Letters of a read, and what a document's number is multiplied by to number its reads.
READ, PER_DOCUMENT = 60, 1 << 24


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads made of the letters of documents, each whole text cut into successive reads of up to 60 letters (a text without letters is one empty read): read_no, id, seq, qual (Phred + 33)."""
    letters = F.translate(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN")
    # base i scores (read_no * 7 + i * i * 3) % 41, so there are 41 kinds of qualities
    kinds = F.array(*(F.lit("".join(chr((k + i * i * 3) % 41 + 33) for i in range(READ))) for k in range(41)))
    d = table(spark, sf_dir, "documents").select("doc_id", letters.alias("letters"))
    d = d.select("doc_id", "letters", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("letters") - 1) / READ), F.lit(0)).cast("int"))).alias("k"))
    d = d.select((F.col("doc_id") * PER_DOCUMENT + F.col("k")).alias("read_no"), F.concat(F.lit("read"), F.col("doc_id").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(" x")).alias("id"), F.substring(F.col("letters"), F.col("k") * READ + 1, F.lit(READ)).alias("seq"))
    return d.withColumn("qual", F.substring(F.get(kinds, (F.col("read_no") * 7 % 41).cast("int")), F.lit(1), F.length("seq")))


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads with mates: the reverse complement of a read's first 40 bases and ACGTTTGA."""
    mate = F.concat(F.reverse(F.translate(F.substring("seq", 1, 40), "ACGT", "TGCA")), F.lit("ACGTTTGA"))
    return reads(spark, sf_dir).withColumns({"seq_rev": mate, "qual_rev": F.substring(F.concat("qual", F.lit("I" * 48)), F.lit(1), F.length(mate)), "id_rev": F.concat(F.lit("mate "), "id")})


def barcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped reads with a random barcode in their name: rec_no, qname, chrom, pos0, flag, seq_len, xm. rec_no is made of the columns that tell rows apart."""
    letter = lambda k: F.substring(F.lit("ACGT"), (F.floor(F.col("l_partkey") / k) % 4 + 1).cast("int"), F.lit(1))
    number = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey")) * 64 + F.col("l_quantity").cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .select(number.alias("rec_no"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        .select(
            "rec_no",
            F.concat(F.lit("r"), F.col("rec_no").cast("string"), F.lit(":TL:"), letter(16), letter(4), letter(1)).alias("qname"),
            F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"),
            ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31) % 20_000).alias("pos0"),
            F.when(F.col("l_quantity") == 7, 4).otherwise((F.col("l_partkey") + F.col("l_suppkey")) % 2 * 16).cast("int").alias("flag"),
            F.lit(36).alias("seq_len"),
            F.when(F.col("l_quantity") == 7, (F.col("l_orderkey") % 2).cast("int")).alias("xm"),
        )
    )


#: The same views for DuckDB, by name.
SQL = {
    "fx_hits": "SELECT 'chr' || l_linenumber AS chrom, (l_orderkey*7919 + l_partkey*104729 + l_suppkey*31) % 200000 AS pos, CAST((l_partkey + l_suppkey) % 2 AS INTEGER) AS strand, 36 AS read_len FROM lineitem",
    "fx_ctrl": "SELECT 'chr' || (o_custkey % 7 + 1) AS chrom, (o_orderkey*6151 + o_custkey*389) % 200000 AS pos, CAST(o_orderkey % 2 AS INTEGER) AS strand, 36 AS read_len FROM orders",
    "fx_chrom": "SELECT 'chr' || i AS chrom, CAST(200000 AS BIGINT) AS length FROM range(1, 8) t(i)",
    "hits": "SELECT DISTINCT chrom, pos, strand, read_len FROM fx_hits",
    "ctrl": "SELECT DISTINCT chrom, pos, strand, read_len FROM fx_ctrl",
    "fx_reads0": "SELECT doc_id * 16777216 + k AS read_no, 'read' || doc_id || '.' || k || ' x' AS id, substr(letters, CAST(k * 60 + 1 AS INTEGER), 60) AS seq FROM (SELECT doc_id, letters, unnest(range(0, greatest(1, (length(letters) + 59) // 60))) AS k FROM (SELECT doc_id, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN') AS letters FROM documents))",
    "fx_reads": "SELECT read_no, id, seq, coalesce(array_to_string(list_transform(range(0, length(seq)), lambda i: chr(CAST((read_no*7 + i*i*3) % 41 + 33 AS INTEGER))), ''), '') AS qual, list_transform(range(0, length(seq)), lambda i: CAST((read_no*7 + i*i*3) % 41 AS INTEGER)) AS q FROM fx_reads0",
    "fx_pairs": "SELECT *, 'mate ' || id AS id_rev, reverse(translate(substr(seq, 1, 40), 'ACGT', 'TGCA')) || 'ACGTTTGA' AS seq_rev, substr(qual || repeat('I', 48), 1, least(length(seq), 40) + 8) AS qual_rev FROM fx_reads",
    "fx_barcoded": "SELECT rec_no, 'r' || rec_no || ':TL:' || substr('ACGT', CAST(l_partkey // 16 % 4 + 1 AS INTEGER), 1) || substr('ACGT', CAST(l_partkey // 4 % 4 + 1 AS INTEGER), 1) || substr('ACGT', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS qname, 'chr' || l_linenumber AS chrom, (l_orderkey*7919 + l_partkey*104729 + l_suppkey*31) % 20000 AS pos0, CAST(CASE WHEN l_quantity = 7 THEN 4 ELSE (l_partkey + l_suppkey) % 2 * 16 END AS INTEGER) AS flag, 36 AS seq_len, CASE WHEN l_quantity = 7 THEN CAST(l_orderkey % 2 AS INTEGER) END AS xm FROM (SELECT *, ((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 64 + CAST(l_quantity AS BIGINT) AS rec_no FROM lineitem)",
}

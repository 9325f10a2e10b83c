"""FASTQ and FASTA as DataFrames, and read, barcode, adapter and interval files in and out."""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import READS
from .lines import pieces, starts

_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string())


def plain(path: str, raw: bytes) -> bytes:
    """Unpacked by the file's first bytes."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bz2.decompress(raw) if raw[:3] == b"BZh" else raw


def parse(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(id, seq, qual) of FASTQ or FASTA text, told apart by its first character. Bases are upper-cased, others than ACGT read as N; a quality longer than its sequence is cut, a missing one is ''."""
    lines = data.decode("latin-1").replace("\r\n", "\n").split("\n")
    clean = lambda s: "".join(c if c in "ACGT" else "N" for c in s.upper())
    at, n = 0, len(lines)
    while at < n:
        if not lines[at]:
            at += 1
        elif lines[at][0] == ">":
            stop = at + 1
            while stop < n and not lines[stop].startswith(">"):
                stop += 1
            yield lines[at][1:], clean("".join(lines[at + 1 : stop])), ""
            at = stop
        elif lines[at][0] == "@":
            name, seq, at = lines[at][1:], [], at + 1
            while at < n and not lines[at].startswith("+"):
                seq.append(lines[at])
                at += 1
            s, q, at = "".join(seq), "", at + 1
            while at < n and len(q) < len(s):  # an @ may begin a line of qualities
                q += lines[at]
                at += 1
            yield name, clean(s), q[: len(s)]
        else:
            raise ValueError(f"neither FASTQ nor FASTA at line {at + 1}")


def read_reads(spark: SparkSession, path: str, first: int | None = None, wrapped: bool = False) -> DataFrame:
    """(read_no, id, seq, qual) of FASTQ or FASTA files, packed or not; plain text is split over tasks, a packed file is one task's stream. read_no counts over all files, in order of their paths; ``first`` keeps that many.

    FASTQ has four lines a read; files whose sequences go over several lines need ``wrapped``, which reads a whole file at once.
    """
    if wrapped:
        return _whole(spark, path, first)
    head = spark.read.text(path).where("length(trim(value)) > 0").first()
    if head is None:
        return spark.createDataFrame([], READS)
    out = _fasta(spark, path) if head["value"].startswith(">") else _fastq(spark, path)
    return out if first is None else out.where(F.col("read_no") < first)


def _clean(seq):
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records lie between line ends that a > follows."""
    p = pieces(spark, path, "\n>").withColumn("value", F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\r", "")).where("length(trim(value)) > 0")
    p = p.withColumn("at", F.monotonically_increasing_id())
    splits = starts(p.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least")))
    name = F.substring_index("value", "\n", 1)
    return p.join(splits, ["file", "block"]).select((F.col("start") + F.col("at") - F.col("least")).alias("read_no"), name.alias("id"), _clean(F.regexp_replace(F.substring(F.col("value"), F.length(name) + 2, F.length("value")), "\\s", "")).alias("seq"), F.lit("").alias("qual"))


_FASTQ = "file string, block long, kind int, at long, id string, seq string, qual string"


def _fastq_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads of the pieces between line ends that an @ follows.

    Such an @ may also begin a line of qualities: then a piece ends behind its + line, and the next one is the rest of its qualities. ``at`` counts reads
    within a split. Kinds: 0 a read, 1 one whose qualities begin the next split, 2 the rest of such qualities.
    """
    names = ["file", "block", "kind", "at", "id", "seq", "qual"]
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
    where, at, open_ = None, 0, None

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for b in batches:
        rows = []
        for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != where:
                if open_:
                    rows.append((*where, 1, *open_, ""))
                where, at, open_ = (file, block), 0, None
                fresh = True
            lines = value.replace("\r", "").split("\n")
            if len(lines) >= 3 and lines[2].startswith("+"):
                if open_:
                    raise ValueError(f"read {open_[1]} of {file} has no qualities; are its lines wrapped?")
                name = lines[0][1:] if block == 0 and fresh and lines[0].startswith("@") else lines[0]
                read = (at, name, lines[1])
                at += 1
                if len(lines) == 3:
                    open_ = read
                else:
                    rows.append((*where, 0, *read, lines[3]))
            elif open_:
                rows.append((*where, 0, *open_, "@" + lines[0]))
                open_ = None
            elif fresh and block > 0:
                rows.append((*where, 2, 0, "", "", "@" + lines[0]))
            elif any(lines):
                raise ValueError(f"not four lines a read: {lines[0][:50]!r} in {file}")
            fresh = False
        if rows:
            yield pack(rows)
    if open_:
        yield pack([(*where, 1, *open_, "")])


def _fastq(spark: SparkSession, path: str) -> DataFrame:
    d = pieces(spark, path, "\n@").select("file", "block", "value").mapInArrow(_fastq_rows, _FASTQ)
    splits = starts(d.groupBy("file", "block").agg(F.count_if(F.col("kind") < 2).alias("n")))
    d = d.join(splits, ["file", "block"])
    whole = d.where("kind = 0")
    # a read at a split's end and the rest of its qualities: one pair a split at most
    follows = splits.select("file", "block", F.lead("block").over(Window.partitionBy("file").orderBy("block")).alias("after"))
    rest = d.where("kind = 2").select("file", F.col("block").alias("after"), F.col("qual").alias("more"))
    cut = d.where("kind = 1").join(follows, ["file", "block"]).join(rest, ["file", "after"], "left").withColumn("qual", F.coalesce("more", F.lit("")))
    cols = ["start", "at", "id", "seq", "qual"]
    out = whole.select(cols).unionAll(cut.select(cols))
    return out.select((F.col("start") + F.col("at")).alias("read_no"), "id", _clean("seq").alias("seq"), F.substring(F.col("qual"), F.lit(1), F.length("seq")).alias("qual"))


def _whole(spark: SparkSession, path: str, first: int | None) -> DataFrame:
    """One task a file, each file read at once; read_no counts within it, files being numbered apart."""
    files = spark.read.format("binaryFile").load(path)
    order = files.select("path").withColumn("number", F.row_number().over(Window.orderBy("path")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, where, raw in zip(*(b.column(c).to_pylist() for c in ("number", "path", "content"))):
                rows = []
                for i, r in enumerate(parse(plain(where, raw))):
                    if first is not None and i >= first:
                        break
                    rows.append(((number << 40) + i, *r))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=["read_no", "id", "seq", "qual"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=["read_no", "id", "seq", "qual"])

    return files.select("path", "content").join(F.broadcast(order), "path").mapInArrow(run, READS)


def read_pairs(spark: SparkSession, path: str, mates: str, first: int | None = None) -> DataFrame:
    """Two files in lock step."""
    m = read_reads(spark, mates, first).toDF("read_no", "id_rev", "seq_rev", "qual_rev")
    return read_reads(spark, path, first).join(m, "read_no")


def with_barcode_reads(reads: DataFrame, path: str) -> DataFrame:
    """Each read with the read of the same number in a barcode file, as ``mux``."""
    return reads.join(read_reads(reads.sparkSession, path).select("read_no", F.col("seq").alias("mux")), "read_no")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(barcode_id from 1 on, name, barcode) of a FASTA file."""
    return read_reads(spark, path).select((F.col("read_no") + 1).cast("int").alias("barcode_id"), F.col("id").alias("name"), F.col("seq").alias("barcode"))


def read_adapters(spark: SparkSession, path: str, overhang: int = 0) -> DataFrame:
    """Adapters of a FASTA file whose names hold 3' or 5' (others are left out), with the marks :anchored: and :reverse:."""
    three, five = F.col("id").contains("3'"), F.col("id").contains("5'")
    a = read_reads(spark, path).where(three | five)
    return a.select((F.col("read_no") + 1).cast("int").alias("adapter_id"), F.col("seq").alias("adapter"), three.alias("three"), F.col("id").contains(":anchored:").alias("anchored"), F.col("id").contains(":reverse:").alias("reverse"), F.lit(overhang).alias("overhang"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns; blank, comment and malformed lines are left out."""
    f = F.split("value", "\t")
    d = spark.read.text(path).where(~F.col("value").startswith("#")).select(f[0].alias("chrom"), F.try_to_number(F.get(f, 1), F.lit("9999999999999")).cast("bigint").alias("start"), F.try_to_number(F.get(f, 2), F.lit("9999999999999")).cast("bigint").alias("end"))
    return d.where("start is not null and end is not null")


def bed_summits(bed: DataFrame, chroms: DataFrame) -> DataFrame:
    """Middles of intervals on known chromosomes."""
    return bed.join(F.broadcast(chroms.select("chrom")), "chrom", "left_semi").select("chrom", F.expr("start + (end - start) div 2").alias("pos"), F.lit(0).cast("bigint").alias("q_cov"))


def read_lines(reads: DataFrame, seq: str = "seq", qual: str = "qual", id_: str = "id", fasta: bool = False):
    """One text a read."""
    return F.concat(F.lit(">"), id_, F.lit("\n"), seq) if fasta else F.concat(F.lit("@"), id_, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_reads(reads: DataFrame, path: str, barcodes: DataFrame | None = None, fasta: bool = False, ordered: bool = False, compression: str = "none") -> None:
    """Text folders of reads: by barcode name (``unidentified`` for those without) if ``demux`` is there, else ``result``; mates under ``mate=1`` and ``mate=2``.

    ``ordered`` keeps the order of read_no over all files of a name; without it, tasks write what they hold.
    """
    d = reads
    if "demux" in reads.columns:
        names = barcodes.select(F.col("barcode_id").alias("demux"), F.col("name").alias("sample")) if barcodes is not None else None
        d = d.join(F.broadcast(names), "demux", "left") if names is not None else d.withColumn("sample", F.when(F.col("demux") > 0, F.col("demux").cast("string")))
        d = d.withColumn("sample", F.coalesce("sample", F.lit("unidentified")))
    else:
        d = d.withColumn("sample", F.lit("result"))
    out = d.select("read_no", "sample", F.lit(1).alias("mate"), read_lines(d, fasta=fasta).alias("value"))
    if "seq_rev" in reads.columns:
        out = out.unionByName(d.select("read_no", "sample", F.lit(2).alias("mate"), read_lines(d, "seq_rev", "qual_rev", "id_rev", fasta).alias("value")))
    if ordered:
        out = out.sort("sample", "mate", "read_no")
    out.select("sample", "mate", "value").write.mode("overwrite").partitionBy("sample", "mate").option("compression", compression).text(path)


def write_table(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated text."""
    df.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="NA")

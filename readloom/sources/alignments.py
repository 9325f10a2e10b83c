"""SAM text and BAM files as DataFrames of alignments (``schemas.ALIGNMENTS``), and SAM text and BAM out."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ALIGNMENTS, CHROM_SIZES
from .lines import numbered_lines

_NAMES = [x.split()[0] for x in ALIGNMENTS.split(", ")]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, split over tasks; rec_no grows in file order, over all files of the path, pos0 is 0-based, ``*`` references and missing positions are null."""
    body = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = F.split("value", "\t")
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))
    ref, pos = f[2], f[3].cast("bigint") - 1
    return body.select(
        F.col("line_no").alias("rec_no"),
        f[0].alias("qname"),
        f[1].cast("int").alias("flag"),
        F.when(ref != "*", ref).alias("chrom"),
        F.when(pos >= 0, pos).alias("pos0"),
        f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"),
        F.when(f[9] == "*", "").otherwise(f[9]).alias("seq"),
        F.when(f[10] == "*", "").otherwise(f[10]).alias("qual"),
        F.map_from_entries(F.transform(F.array_distinct(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0)))), tag)).alias("tags"),
    )


def read_sam_chroms(spark: SparkSession, path: str) -> DataFrame:
    """Chromosomes of the header, in its order (``schemas.CHROM_SIZES``)."""
    h = numbered_lines(spark, path).where(F.col("value").startswith("@SQ"))
    sq = h.select("line_no", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"))
    return sq.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("int").alias("chrom_id"), "chrom", "length")


_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def inflate(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The members of a blocked gzip file, unpacked a step at a time."""
    view, at = memoryview(raw), 0
    d = zlib.decompressobj(31)
    while at < len(raw):
        part = bytes(view[at : at + step])
        out = d.decompress(part)
        at += len(part) - len(d.unused_data)
        if out:
            yield out
        if d.eof:
            d = zlib.decompressobj(31)
        elif at >= len(raw) and (out := d.flush()):
            yield out


class Stream:
    """Bytes that come in steps, taken in any amounts; what was taken is not kept."""

    def __init__(self, steps: Iterator[bytes]):
        self.steps, self.held = steps, b""

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        parts, got = [self.held], len(self.held)
        while got < n and (x := next(self.steps, None)) is not None:
            parts.append(x)
            got += len(x)
        held = b"".join(parts)
        self.held = held[n:]
        return held[:n]


def bam_header(stream: Stream) -> list[tuple[str, int]]:
    """References with their lengths; the stream goes on with the records."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    stream.take(number())
    refs = []
    for _ in range(number()):
        name = stream.take(number())[:-1].decode()
        refs.append((name, number()))
    return refs


_SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(data: bytes, at: int, end: int) -> list[tuple[str, str]]:
    out = []
    while at < end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            stop = data.index(b"\0", at)
            value, at = data[at:stop].decode(), stop + 1
        elif kind == "B":
            sub, (n,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            items = struct.unpack_from(f"<{n}{_SIZES[sub]}", data, at + 5)
            value, at = ",".join([sub, *map(str, items)]), at + 5 + n * struct.calcsize(_SIZES[sub])
        else:
            (v,) = struct.unpack_from("<" + _SIZES[kind], data, at)
            value, at = str(v), at + struct.calcsize(_SIZES[kind])
        out.append((name, value))
    return out


def bam_records(stream: Stream) -> Iterator[tuple]:
    """Records in file order, as tuples of ``schemas.ALIGNMENTS``."""
    refs, n = bam_header(stream), 0
    while len(head := stream.take(4)) == 4:
        data = stream.take(struct.unpack("<i", head)[0])
        rid, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
        p = 32
        name = data[p : p + l_name - 1].decode()
        p += l_name
        cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, p)) or "*"
        p += 4 * n_cigar
        half = (l_seq + 1) // 2
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in data[p : p + half])[:l_seq]
        p += half
        qual = "" if l_seq and data[p] == 255 else "".join(chr(q + 33) for q in data[p : p + l_seq])
        p += l_seq
        yield n, name, flag, refs[rid][0] if rid >= 0 else None, pos if pos >= 0 else None, mapq, cigar, seq, qual, _tags(data, p, len(data))
        n += 1


def _typed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)


#: Records of a file at most, which keeps numbers of several files apart.
FILE = 1 << 40


def _bam_files(spark: SparkSession, path: str) -> DataFrame:
    """(number, content) of the files, numbered in order of their paths."""
    files = spark.read.format("binaryFile").load(path)
    order = files.select("path").withColumn("number", F.row_number().over(Window.orderBy("path")) - 1)
    return files.select("path", "content").join(F.broadcast(order), "path").select("number", "content")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files, each unpacked and parsed a step at a time; rec_no grows in file order, over all files of the path.

    One task reads one file, packed as it is (up to 2 GB, what a value may have): larger ones are to be split by chromosome or read as SAM text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                base, rows = b.column("number")[i].as_py() * FILE, []
                for n, *r in bam_records(Stream(inflate(b.column("content")[i].as_py()))):
                    rows.append((base + n, *r))
                    if len(rows) == 10_000:
                        yield _typed(rows)
                        rows = []
                if rows:
                    yield _typed(rows)

    return _bam_files(spark, path).mapInArrow(run, ALIGNMENTS)


def read_bam_chroms(spark: SparkSession, path: str) -> DataFrame:
    """Chromosomes of the headers; files of one path are taken to have the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                refs = bam_header(Stream(inflate(raw)))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(refs)), pa.int32()), pa.array([r for r, _ in refs], pa.string()), pa.array([n for _, n in refs], pa.int64())], names=["chrom_id", "chrom", "length"])

    return _bam_files(spark, path).where("number = 0").mapInArrow(run, CHROM_SIZES)


def bam_bytes(rows: Iterator[tuple], refs: list[tuple[str, int]]) -> Iterator[bytes]:
    """A BAM file's blocks: header, records (as tuples of ``schemas.ALIGNMENTS``) and the empty last block. Tags of whole numbers are written as such, others as text."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs).encode()
    names = {n: i for i, (n, _) in enumerate(refs)}
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(refs))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs]
    held = b"".join(out)
    for _, name, flag, chrom, pos, mapq, cigar, seq, qual, tags in rows:
        ops = [(int(n) << 4) | _OPS.index(c) for n, c in re.findall(rf"(\d+)([{_OPS}])", cigar or "")]
        packed = bytes(_BASES.index(seq[i]) << 4 | (_BASES.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        scores = bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)
        extra = b"".join(k.encode() + (b"i" + struct.pack("<i", int(v)) if re.fullmatch(r"-?\d{1,9}", v) else b"Z" + v.encode() + b"\0") for k, v in sorted(dict(tags or ()).items()))
        body = struct.pack("<iiBBHHHiiii", names.get(chrom, -1), -1 if pos is None else pos, len(name.encode()) + 1, mapq or 0, 4680, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + scores + extra
        held += struct.pack("<i", len(body)) + body
        while len(held) >= 0xFF00:
            yield _block(held[:0xFF00])
            held = held[0xFF00:]
    if held:
        yield _block(held)
    yield _block(b"")


def _block(data: bytes) -> bytes:
    """One member of a blocked gzip file: its size stands in its header."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(alignments: DataFrame, chroms: DataFrame, path: str, ordered: bool = True) -> DataFrame:
    """A table (part, content) in Parquet, one BAM file a row: by place (references in header order, unplaced records last) over all parts if ``ordered``, else as the rows stand.

    Each part is a whole file with header and end; parts hold what a task does. Returns the table as read again.
    """
    refs = [(r["chrom"], r["length"]) for r in chroms.orderBy("chrom_id").select("chrom", "length").collect()]
    d = alignments
    if ordered:
        d = d.join(chroms.select("chrom", "chrom_id"), "chrom", "left").sort(F.col("chrom_id").asc_nulls_last(), F.col("pos0").asc_nulls_last(), "rec_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        first = next(rows, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b"".join(bam_bytes(chain([first], rows), refs))], pa.binary())], names=["part", "content"])

    d.select(*_NAMES).mapInArrow(run, "part int, content binary").write.mode("overwrite").parquet(path)
    return alignments.sparkSession.read.parquet(path)


def for_hits(alignments: DataFrame) -> DataFrame:
    """With seq_len, as ``operators.hits`` takes them."""
    return alignments.withColumn("seq_len", F.length("seq"))


def for_dedup(alignments: DataFrame) -> DataFrame:
    """With seq_len and xm, as ``operators.dedup`` takes them."""
    return for_hits(alignments).withColumn("xm", F.col("tags")["XM"].cast("int"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """(rec_no, value): records as SAM text; mates and template lengths are not kept, tags come as text."""
    star = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "*").otherwise(F.col(c))
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(F.lit("\t"), e["key"], F.when(e["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), e["value"])), "")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), star("chrom"), (F.coalesce("pos0", F.lit(-1)) + 1).cast("string"), F.col("mapq").cast("string"), star("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), star("qual"))
    return alignments.select("rec_no", F.concat(line, F.coalesce(tags, F.lit(""))).alias("value"))


def write_sam(alignments: DataFrame, chroms: DataFrame, path: str) -> None:
    """A folder of SAM text in file order: the header (one line a chromosome) in its first part."""
    head = chroms.select((F.col("chrom_id").cast("bigint") - (1 << 40)).alias("rec_no"), F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    head.unionByName(sam_lines(alignments)).sort("rec_no").select("value").write.mode("overwrite").text(path)

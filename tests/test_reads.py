"""Unit cases for read operators, files in and out, whole jobs and the stream."""

import bz2
import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from readloom import catalog, views
from readloom.functions import sequence as S
from readloom.operators import adapters as A
from readloom.operators import dedup as D
from readloom.operators import reads as R
from readloom.params import DedupParams, PeakParams, TrimParams
from readloom.plans.deduplicate import deduplicate
from readloom.plans.peaks import call_peaks
from readloom.plans.preprocess import preprocess
from readloom.sources import alignments as AL
from readloom.sources import reads as SR
from readloom.streaming.reads import preprocess_stream

ADAPTER = "adapter_id int, adapter string, three boolean, anchored boolean, reverse boolean, overhang int"


def reads(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", s, q or "I" * len(s)) for i, (s, q) in enumerate(rows)], "read_no long, id string, seq string, qual string")


def literal_kept(q, cutoff, mode):
    if mode == "TAIL":
        return max((i + 1 for i, v in enumerate(q) if v >= cutoff), default=0)
    if mode == "SUM":
        keep, total, top = len(q), 0, 0
        for i in range(len(q) - 1, -1, -1):
            total += cutoff - q[i]
            if total < 0:
                break
            if total > top:
                top, keep = total, i + 1
        return keep
    for i in range(len(q)):
        if sum(q[i : i + 5]) < 5 * cutoff:
            return i
    return len(q)


@pytest.mark.parametrize("mode", ["TAIL", "SUM", "WIN", "BWA"])
def test_quality_modes(spark, mode):
    import random

    rng = random.Random(1)
    qs = [[rng.choice([2, 10, 19, 20, 21, 30, 40]) for _ in range(rng.randint(0, 40))] for _ in range(200)] + [[]]
    df = spark.createDataFrame([(i, "".join(chr(33 + v) for v in q)) for i, q in enumerate(qs)], "i int, qual string")
    got = {r["i"]: r["k"] for r in df.select("i", S.kept(S.scores(F.col("qual")), 20, mode).alias("k")).collect()}
    for i, q in enumerate(qs):
        want = literal_kept(q, 20, mode) if mode != "BWA" else literal_kept(q[: literal_kept(q, 20, "SUM")], 20, "TAIL")
        assert got[i] == want, (q, mode)


def test_windows_split_a_quality_once(spark):
    """Not once for every base, which takes the square of a read's length."""
    q = [40] * 12_000 + [20, 20, 20, 19, 20] + [40] * 3
    df = spark.createDataFrame([("".join(chr(33 + v) for v in q),)], "qual string").select(S.kept(S.scores(F.col("qual")), 20, "WIN").alias("k"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(qual") == 1
    assert df.first()["k"] == literal_kept(q, 20, "WIN") == 12_000


@pytest.mark.parametrize(
    "read,adapter,three,anchored,left",
    [
        ("AAAAACGTACGT", "ACGTACGT", True, False, "AAAA"),
        ("ACGTACGTTTTT", "ACGTACGT", False, False, "TTTT"),
        ("ACGTACGTTTTT", "ACGTACGT", False, True, "TTTT"),
        ("TACGTACGTTTT", "ACGTACGT", False, True, "TACGTACGTTTT"),
        ("CCCCCCACGTA", "ACGTACGT", True, False, "CCCCCC"),
        ("CCCCCCCCACG", "ACGTACGT", True, False, "CCCCCCCCACG"),
        ("CCCCCCACGNACGT", "ACGTACGT", True, False, "CCCCCC"),
        ("CCCCCCACGTAGGT", "ACGTACGT", True, False, "CCCCCC"),
        ("", "ACGTACGT", True, False, ""),
    ],
)
def test_adapters(spark, read, adapter, three, anchored, left):
    a = spark.createDataFrame([(1, adapter, three, anchored, False, 0)], ADAPTER)
    r = A.strip(reads(spark, [(read, None)]), a, TrimParams()).first()
    assert (r["seq"], len(r["qual"]), r["removed"]) == (left, len(left), len(read) - len(left))
    assert r["id"] == ("r0:AdapterRemoved" if len(left) < len(read) else "r0")


def test_adapter_rounds_and_top_down(spark):
    a = spark.createDataFrame([(1, "ACGTACGT", True, False, False, 0), (2, "TTGGTTGG", True, False, False, 0), (3, "CCCC", True, False, True, 0)], ADAPTER)
    r = reads(spark, [("AAAAAAAATTGGTTGGACGTACGT", None), ("GATTACAGATTACA", None)])
    once, twice = (A.strip(r, a, TrimParams(times=n)).orderBy("read_no").collect() for n in (1, 3))
    assert once[0]["seq"] in ("AAAAAAAATTGGTTGG", "AAAAAAAA") and twice[0]["seq"] == "AAAAAAAA" and twice[1]["removed"] == 0
    down = A.strip(r, a, TrimParams(top_down=True)).orderBy("read_no").collect()
    assert down[0]["seq"] == "AAAAAAAA" and len(down[0]["matches"]) == 2 and down[0]["removed"] == 16


def test_pairs_are_cut_to_their_insert(spark):
    insert = "ACGGTTCAGTCCATGACCGTAGCA"
    rc = insert[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(0, insert + "AGATCGG", rc + "CTTGACA", "I" * 31, "I" * 31), (1, "A" * 30, "C" * 30, "I" * 30, "I" * 30)], "read_no long, seq string, seq_rev string, qual string, qual_rev string")
    got = A.strip_pair(df).orderBy("read_no").collect()
    assert (got[0]["seq"], got[0]["seq_rev"], got[0]["insert"]) == (insert, rc, 24) or got[0]["insert"] is not None
    assert got[1]["insert"] is None and got[1]["seq"] == "A" * 30


def test_filters_and_trims(spark):
    r = reads(spark, [("ACGTNN", None), ("ACGT.", None), ("A", None), ("", None), ("ACGTACGTAC", None)])
    assert [x["seq"] for x in R.pre_trim(r, 2, 1, 1, True).orderBy("read_no").collect()] == ["GTN", "GT", "GTACGTA"]
    assert R.pre_trim(r, 2, 1, 1, True).orderBy("read_no").first()["id"] == "r0:TL:AC:TR:N"
    assert {x["seq"] for x in R.uncalled_filter(r, 1).collect()} == {"ACGT.", "A", "", "ACGTACGTAC"}
    assert R.uncalled_filter(r, 2, "A").orderBy("read_no").first()["seq"] == "ACGTAA"
    assert [x["seq"] for x in R.trim_to(r, 5).orderBy("read_no").collect()] == ["ACGTN", "ACGT.", "ACGTA"]
    mates = r.withColumns({"seq_rev": F.lit("AC"), "qual_rev": F.lit("II"), "id_rev": F.lit("m x")})
    assert R.min_length(mates, 2).count() == 3 and R.min_length(mates, 3).count() == 0
    assert {x["id_rev"] for x in R.pre_trim(mates, 1, 0, 1, True).collect()} == {"m:TL:A x"}


def test_demultiplexing(spark):
    b = spark.createDataFrame([(1, "one", "AAA"), (2, "two", "AAC"), (3, "three", "GGG")], "barcode_id int, name string, barcode string")
    r = reads(spark, [("AAACC", None), ("AACCC", None), ("GGTCC", None), ("TTTCC", None), ("AAA", None), ("NGGAA", None)])
    exact = {x["read_no"]: x["demux"] for x in R.demultiplex(r, b, 3).collect()}
    near = {x["read_no"]: x["demux"] for x in R.demultiplex(r, b, 3, True).collect()}
    assert exact == {0: 1, 1: 2, 2: 0, 3: 0, 5: 0} and near == {0: 1, 1: 1, 2: 3, 3: 0, 5: 3}
    assert {x["seq"] for x in R.clip_barcode(R.demultiplex(r, b, 3), 3, exclude=True).collect()} == {"CC"}
    assert R.clip_barcode(R.demultiplex(r, b, 3), 3, hard=True).where("length(seq) > 2").count() == 0
    mux = r.withColumn("mux", F.lit("GGG"))
    assert {x["demux"] for x in R.demultiplex(mux, b, 3).collect()} == {3} and R.demultiplex(mux, b, 3).count() == 6


FASTQ = "@a x\nACGTn\n+\n@IIII\n@b\nAC\n+\nIIIIIII\n@c\n\n+\n\n"


@pytest.mark.parametrize("pack", ["", "gz", "bz2"])
def test_fastq_in_and_out(spark, tmp_path, pack):
    raw = FASTQ.encode()
    p = tmp_path / f"x.fq.{pack}"
    p.write_bytes(gzip.compress(raw) if pack == "gz" else bz2.compress(raw) if pack == "bz2" else raw)
    d = SR.read_reads(spark, str(p))
    assert [tuple(x) for x in d.orderBy("read_no").collect()] == [(0, "a x", "ACGTN", "@IIII"), (1, "b", "AC", "II"), (2, "c", "", "")]
    assert SR.read_reads(spark, str(p), 1).count() == 1 and SR.read_pairs(spark, str(p), str(p)).where("seq = seq_rev").count() == 3
    SR.write_reads(d.withColumn("demux", F.col("read_no").cast("int")), str(tmp_path / "out"), spark.createDataFrame([(1, "one"), (2, "two")], "barcode_id int, name string"), ordered=True)
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"sample=one", "sample=two", "sample=unidentified"}
    SR.write_reads(d, str(tmp_path / "plain"))
    back = SR.read_reads(spark, str(tmp_path / "plain/sample=result/mate=1"))
    assert {(x["id"], x["seq"]) for x in back.collect()} == {("a x", "ACGTN"), ("b", "AC"), ("c", "")}


def test_files_split_over_tasks_and_several_files(spark, tmp_path):
    """Splits of a few bytes, qualities that begin with @, and numbers that run on over files."""
    import random

    rng = random.Random(6)
    want, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "fq").mkdir()
    (tmp_path / "sam").mkdir()
    names = []
    for f in range(3):
        out = []
        for i in range(150):
            n = rng.randint(0, 9)
            seq, qual = "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@@+>I!") for _ in range(n))
            want.append((len(want), f"f{f} r{i}", seq, qual))
            out.append(f"@f{f} r{i}\n{seq}\n+\n{qual}\n")
        data = "".join(out).encode()
        (tmp_path / "fq" / f"{f}.fq{'.gz' if f == 1 else ''}").write_bytes(gzip.compress(data) if f == 1 else data)
        recs = [f"q{f}.{i}\t0\tchr1\t{i + 1}\t30\t5M\t*\t0\t0\tACGTA\tIIIII" for i in range(40 + 30 * f)]
        names += [r.split("\t")[0] for r in recs]
        (tmp_path / "sam" / f"{f}.sam").write_text("@SQ\tSN:chr1\tLN:1000\n" + "\n".join(recs) + "\n")
    try:
        for size in ("64b", "1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            d = SR.read_reads(spark, str(tmp_path / "fq"))
            assert sorted(map(tuple, d.collect())) == want
            got = AL.read_sam(spark, str(tmp_path / "sam")).orderBy("rec_no").collect()
            assert [r["qname"] for r in got] == names and len({r["rec_no"] for r in got}) == len(names)
        assert SR.read_reads(spark, str(tmp_path / "fq"), 200).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bam_out_and_two_files(spark, tmp_path):
    from readloom.operators import dedup as D

    (tmp_path / "x.sam").write_text(SAM)
    s, chroms = AL.read_sam(spark, str(tmp_path / "x.sam")), AL.read_sam_chroms(spark, str(tmp_path / "x.sam"))
    many = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3000)))).withColumns({"qname": F.concat("qname", F.lit("k"), "k"), "pos0": F.col("pos0") + F.lit(4000) - F.col("k"), "rec_no": F.col("rec_no") * 10000 + F.col("k")}).drop("k")
    parts = AL.write_bam(many, chroms, str(tmp_path / "bam")).orderBy("part").collect()
    (tmp_path / "files").mkdir()
    for r in parts:
        assert gzip.decompress(bytes(r["content"]))[:4] == b"BAM\1"
        (tmp_path / "files" / f"{r['part']:04d}.bam").write_bytes(bytes(r["content"]))
    back = AL.read_bam(spark, str(tmp_path / "files"))
    key = ["qname", "flag", "chrom", "pos0", "mapq", "cigar", "seq", "qual"]
    rows = back.orderBy("rec_no").select("rec_no", *key).collect()
    assert sorted(map(str, (tuple(r)[1:] for r in rows))) == sorted(map(str, map(tuple, many.select(key).collect())))
    places = [(r["chrom"] or "~", r["pos0"] or 0) for r in rows]
    assert places[:6000] == sorted(places[:6000]) and len({r["rec_no"] for r in rows}) == 9000
    (tmp_path / "two").mkdir()
    for n in ("a", "b"):  # the same reads in two files: one of each place and barcode stays
        (tmp_path / "two" / f"{n}.bam").write_bytes(bam_bytes())
    two = AL.for_dedup(AL.read_bam(spark, str(tmp_path / "two")))
    assert two.count() == 6 and D.deduplicated(two).count() == 2 and D.artifacts(two).count() == 2


def test_fasta_dimensions(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x:3':\nACGT\nAC\n>y:5':anchored:\nGG\n>none\nTT\n>z:3'::reverse:\nCC\n")
    a = SR.read_adapters(spark, str(tmp_path / "a.fa")).orderBy("adapter_id").collect()
    assert [(x["adapter"], x["three"], x["anchored"], x["reverse"]) for x in a] == [("ACGTAC", True, False, False), ("GG", False, True, False), ("CC", True, False, True)]
    assert SR.read_barcodes(spark, str(tmp_path / "a.fa")).count() == 4
    (tmp_path / "b.bed").write_text("chr1\t10\t21\tname\nchr2\t5\t9\n\nchrX\t1\t2\n")
    assert {(x["chrom"], x["pos"]) for x in SR.bed_summits(SR.read_bed(spark, str(tmp_path / "b.bed")), views.chroms(spark)).collect()} == {("chr1", 15), ("chr2", 7)}


SAM = "@HD\tVN:1.0\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\nr1:TL:AC:x\t0\tchr1\t11\t30\t5M\t*\t0\t0\tACGTA\tIIIII\tXM:i:1\nr2:TL:AC\t16\tchr1\t20\t30\t5M\t*\t0\t0\tACGTA\tIIIII\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tXM:i:0\n"


def bam_bytes():
    def record(name, flag, rid, pos, seq, tags=b""):
        codes = "=ACMGRSVTWYHKDBN"
        packed = bytes(codes.index(seq[i]) << 4 | (codes.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        cigar = struct.pack("<I", len(seq) << 4) if rid >= 0 else b""
        body = struct.pack("<iiBBHHHiiii", rid, pos, len(name) + 1, 30, 0, len(cigar) // 4, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + cigar + packed + bytes([40] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for n, k in (("chr1", 1000), ("chr2", 500)):
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    data = head + record("r1:TL:AC:x", 0, 0, 10, "ACGTA", b"XMC\1XZZab\0XBBs" + struct.pack("<ihh", 2, 3, -4)) + record("r2:TL:AC", 16, 0, 19, "ACGTA") + record("r3", 4, -1, -1, "AC", b"XMi\0\0\0\0")
    half = len(data) // 2
    return b"".join(gzip.compress(x) for x in (data[:half], data[half:], b""))


def test_sam_and_bam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "x.bam").write_bytes(bam_bytes())
    s, b = AL.read_sam(spark, str(tmp_path / "x.sam")), AL.read_bam(spark, str(tmp_path / "x.bam"))
    assert s.columns == b.columns
    a = [(r["qname"], r["flag"], r["chrom"], r["pos0"], r["cigar"], r["seq"], r["qual"], r["tags"].get("XM")) for r in s.orderBy("rec_no").collect()]
    assert a == [(r["qname"], r["flag"], r["chrom"], r["pos0"], r["cigar"], r["seq"], r["qual"], r["tags"].get("XM")) for r in b.orderBy("rec_no").collect()]
    assert b.orderBy("rec_no").first()["tags"] == {"XM": "1", "XZ": "ab", "XB": "s,3,-4"}
    assert [tuple(r) for r in AL.read_sam_chroms(spark, str(tmp_path / "x.sam")).collect()] == [tuple(r) for r in AL.read_bam_chroms(spark, str(tmp_path / "x.bam")).collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]
    from readloom.operators import hits as H

    assert [tuple(r) for r in H.from_alignments(AL.for_hits(b)).orderBy("pos").collect()] == [("chr1", 10, 0, 5), ("chr1", 23, 1, 5)]
    AL.write_sam(s, AL.read_sam_chroms(spark, str(tmp_path / "x.sam")), str(tmp_path / "out"))
    again = AL.read_sam(spark, str(tmp_path / "out"))
    assert {(r["qname"], r["chrom"], r["pos0"], r["seq"], str(r["tags"])) for r in again.collect()} == {(r["qname"], r["chrom"], r["pos0"], r["seq"], str(r["tags"])) for r in s.collect()}
    assert {r["kind"]: r["n"] for r in D.mapping_classes(AL.for_dedup(s)).collect()} == {"not_unique": 1, "mapped": 1, "unmapped": 1}


def test_dedup_job(spark, sf):
    d = deduplicate(views.barcoded(spark, sf), DedupParams(min_unique=2, chrom_filter="chr7", split=True))
    kept = d.kept.count()
    s = d.statistics.first()
    assert kept + d.artifacts.count() == s["n_mapped"] and s["n_removed"] == d.artifacts.count()
    assert d.histogram.agg(F.sum("unique_reads"), F.sum("non_unique_reads")).first()[:] == (kept, s["n_removed"])
    assert sum(h.count() for h in d.halves) == kept and d.clusters.count() <= kept and d.track.count() == d.places.count()


def test_halves_of_large_and_negative_numbers(spark):
    """Products beyond 64 bits, quotients that a double can't tell apart, and numbers below zero, whose remainders are negative too."""
    numbers = [0, 1, 12, 13, 26, -1, -13, -14, -27, 2**53 + 1, 13 * (2**52 + 1) - 1, 8_999_999 * 2**29 + 77, 2**62 + 12345, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in numbers], "rec_no long")
    quotient = lambda n: abs(n) // 13 * (1 if n >= 0 else -1)
    for which in (0, 1):
        want = sorted(n for n in numbers if (n * 7919 + quotient(n)) % 2 == which)
        assert want and sorted(r[0] for r in D.half(df, which).collect()) == want


def test_compatible_options(spark, sf):
    from readloom.operators import hits as H

    r = views.barcoded(spark, sf)
    last = r.agg(F.max("rec_no")).first()[0]
    assert D.without_last(r).count() == r.count() - 1 and D.without_last(r).where(F.col("rec_no") == last).isEmpty()
    a, b = (sorted(map(tuple, H.strand_counts(views.hits(spark, sf), s).select("chrom", "n_forward", "n_reverse").collect())) for s in (False, True))
    assert a != b and [(c, f, r) for c, f, r in a] == [(c, f, r) for c, r, f in b]
    assert deduplicate(r, DedupParams(drop_last=True)).statistics.first()["n_total"] == r.count() - 1


@pytest.mark.parametrize("kind", ["control", "alone", "pseudo", "nexus", "estimated"])
def test_peak_caller(spark, sf, kind):
    h, c, chroms = views.hits(spark, sf), views.control(spark, sf), views.chroms(spark)
    p = PeakParams(fragment_length=None if kind == "estimated" else 100, pseudo_control=kind == "pseudo", nexus=kind == "nexus", shift_steps=200, top_n=50)
    run = call_peaks(h, chroms, p, c if kind in ("control", "nexus") else None)
    rows = run.scored.select("rn", "n", "p_value", "q_value", "chrom", "pos").orderBy("rn").collect()
    if kind != "estimated":
        assert rows
    assert [r["rn"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["n"] == len(rows) for r in rows)
    assert all(a["p_value"] <= b["p_value"] for a, b in zip(rows, rows[1:])) and all(abs(r["q_value"] - r["p_value"] * r["n"] / r["rn"]) < 1e-9 for r in rows)
    assert run.narrow_peak().count() == min(50, len(rows))


def test_whole_chain_and_stream(spark, sf, tmp_path):
    p = TrimParams(trim_left=1, min_length=5, uncalled=3, quality=20, quality_min_length=5, min_overlap=4, final_length=0)
    r, seen = views.reads(spark, sf), {}
    out = preprocess(r, p, catalog.barcodes(spark), catalog.adapters(spark), observed=seen)
    n = out.count()
    counts = [o.get["reads"] for o in seen.values()]
    assert list(seen) == ["read", "pre_trim", "uncalled", "demultiplex", "quality", "adapters"] and counts == sorted(counts, reverse=True) and counts[-1] == n
    r.repartition(3).write.parquet(str(tmp_path / "in"))
    preprocess_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), p, catalog.barcodes(spark), catalog.adapters(spark)).awaitTermination()
    key = ["read_no", "id", "seq", "qual", "demux"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(key).collect())) == sorted(map(tuple, out.select(key).collect()))


@pytest.mark.parametrize("tile", [1 << 20, 50])
def test_summits_against_literal_loops(spark, monkeypatch, tile):
    import random

    from readloom.operators import evaluation as E
    from readloom.operators import fragments as G
    from readloom.operators import summits as M

    monkeypatch.setattr(M, "TILE", tile)
    rng = random.Random(11)
    lo, hi, size = 5, 40, 600
    hits = {(rng.randrange(size), rng.randrange(2)) for _ in range(150)}
    df = spark.createDataFrame([("c", p, s, 10) for p, s in hits], "chrom string, pos long, strand int, read_len int")
    pairs = [(f, r) for f, s in hits if s == 0 for r, t in hits if t == 1 and f + lo < r <= f + hi]
    cov = [sum(f <= x <= r for f, r in pairs) for x in range(size + hi + 2)]
    raw, x = [], 1
    while x < len(cov):
        if cov[x] > cov[x - 1]:
            y = x
            while y < len(cov) and cov[y] == cov[x]:
                y += 1
            if y < len(cov) and cov[y] < cov[x]:
                raw.append((x + (y - x) // 2, cov[x]))
            x = y
        else:
            x += 1
    p = G.pairs(df, lo, hi)
    assert sorted((r["pos"], r["q_cov"]) for r in M.raw_summits(p).collect()) == raw
    fine = [s for i, s in enumerate(raw) if not any(abs(t[0] - s[0]) < hi and t[1] > s[1] and not (j == 0 and j < i) for j, t in enumerate(raw))]
    assert sorted((r["pos"], r["q_cov"]) for r in M.refined_summits(M.raw_summits(p), hi).collect()) == fine
    merged, cur = [], None
    for s in fine:
        if cur and s[0] - cur[0] < hi:
            cur = (cur[0] + (s[0] - cur[0]) // 2, cur[1])
        else:
            if cur:
                merged.append(cur)
            cur = s
    got = M.merged_summits(M.refined_summits(M.raw_summits(p), hi), hi)
    assert sorted((r["pos"], r["q_cov"]) for r in got.collect()) == merged
    curve = {r["shift"]: r["hd"] for r in G.hamming_curve(df, spark.createDataFrame([("c", size)], "chrom string, length long"), 50).collect()}
    fwd, rev = {q for q, s in hits if s == 0}, {q for q, s in hits if s == 1}
    assert all(curve[s] == len({q + s + 1 for q in fwd if q + s + 1 < size} ^ rev) for s in range(50))
    side = {r["s"]: (r["kfu_x"], r["kfd_x"], r["kru_x"], r["krd_x"]) for r in E.side_counts(got, df, hi, "x").collect()}
    for q, _ in merged:
        near = [(h, s) for h, s in hits if q - hi < h < q + hi]
        assert side.get(q, (0,) * 4) == tuple(sum(s == st and (h < q) == up for h, s in near) for st, up in ((0, True), (0, False), (1, True), (1, False)))


@pytest.mark.parametrize("tile", [1 << 20, 25])
def test_candidates_against_literal_loops(spark, monkeypatch, tile):
    import random

    from readloom.operators import candidates as C
    from readloom.operators import evaluation as E

    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(C, "SITES", tile)
    rng = random.Random(4)
    for tolerance in (0.0, 0.6):
        sites = sorted({(rng.randrange(400), rng.randrange(2)) for _ in range(160)})
        rows = [("c", p, s, rng.randint(1, 4)) for p, s in sites]
        half, limit = 9, 4

        def score(i):
            """Score and window of one site, as a walk to both sides."""
            lo = hi = i
            if i == 0 or i == len(rows) - 1:
                return 0, lo, hi
            sign = lambda r: -r[3] if r[2] else r[3]
            left, k = 0, i
            while k > 0 and rows[i][1] - rows[k][1] <= half:
                left, lo, k = left + sign(rows[k]), k, k - 1
            right, k = 0, i + 1
            while k < len(rows) and rows[k][1] - rows[i][1] <= half:
                right, hi, k = right - sign(rows[k]), k, k + 1
            if tolerance and (left == 0 or not 1 - tolerance <= right / left <= 1 + tolerance):
                return 0, lo, hi
            return left + right, lo, hi

        df = spark.createDataFrame(rows, "chrom string, pos long, strand int, n long")
        got = {(r["pos"], r["strand"]): r["score"] for r in E.sliding_score(df, half, tolerance).collect()}
        assert got == {(rows[i][1], rows[i][2]): score(i)[0] for i in range(len(rows))}
        every = [score(i) for i in range(len(rows))]
        value, at, opens = [s for s, *_ in every], [p for _, p, *_ in rows], [i for i, (s, *_) in enumerate(every) if s >= limit]
        want, start = [], 0
        while (left := [i for i in opens if i >= start]) and left[0] + half < len(rows):
            peak = max(range(left[0], left[0] + half), key=lambda i: (value[i], -i))
            lo = min(max(1, next(i for i in range(len(rows)) if at[i] >= at[peak] - half)), peak)
            hi = max(i for i in range(len(rows)) if at[i] <= at[peak] + half)
            over = [k for k in range(lo, hi) if value[k] > 0.9 * value[peak]]
            first = over[0] if over else lo
            under = [k for k in range(first + 1, hi) if over and value[k] < 0.9 * value[peak]]
            last = under[0] - 1 if under else hi
            mid = (at[first] + at[last]) // 2
            centre = [first, *(k for k in range(first, last) if abs(mid - at[k]) < mid - at[first])][-1]
            want.append((rows[centre][1], rows[centre][2], value[peak], at[last] - at[first]))
            start = hi + 1
        found = C.forward_candidates(df, half, limit, tolerance)
        assert [(r["pos"], r["strand"], r["score"], r["width"]) for r in found.orderBy("start").collect()] == want and want
        assert C.candidates_bed(found).count() == C.width_histogram(found).agg(F.sum("n")).first()[0] == len(want)

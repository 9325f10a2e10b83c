"""Adapter removal. Adapters are (adapter_id, adapter, three, anchored, reverse, overhang): a dimension of a few rows.

Batches of reads are aligned as byte matrices, all rounds where the reads stand: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import alignment as G
from ..functions import sequence as S
from ..params import TrimParams

#: Adapters at most: they go to every task.
MOST = 10_000
#: Reads compared at a time, which bounds a task's matrices.
TOGETHER = 4096

_CUT = [("adapter_id", pa.int32()), ("removed", pa.int32()), ("overlap", pa.int32()), ("mismatches", pa.int32())]
MATCHES = ArrayType(StructType([StructField(n, IntegerType()) for n, _ in _CUT]))


def adapter_rows(adapters: DataFrame, reverse: bool = False) -> list[dict]:
    """The adapters of one direction, in order of number."""
    rows = adapters.where((F.col("reverse") == reverse) & (F.length("adapter") > 0)).select("adapter_id", "adapter", "three", "anchored", "overhang").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} adapters")
    return [{**r.asDict(), "bytes": G.matrix([r["adapter"]])[0]} for r in sorted(rows)]


class Round:
    """Reads of one batch with what is left of each."""

    def __init__(self, seqs: list[str], quals: list[str], p: TrimParams):
        self.seqs, self.quals, self.p = seqs, quals, p
        self.cuts: list[list] = [[] for _ in seqs]

    def best(self, adapter: dict, at: np.ndarray) -> tuple[G.Alignments, np.ndarray]:
        """Best alignments of the reads at ``at`` with an adapter, and which of them the rule takes for matches."""
        p = self.p
        mat, lens = G.matrix([self.seqs[i] for i in at])
        m = len(adapter["adapter"])
        opposite = m - lens if adapter["anchored"] else np.full(len(at), adapter["overhang"] or 0)
        same = np.full(len(at), 0 if adapter["anchored"] else m - p.min_overlap)
        left, right = (opposite, same) if adapter["three"] else (same, opposite)
        quals = None
        if p.by_quality:  # a read without qualities, or with too few, has the best ones
            quals = np.full(mat.shape, 126, np.uint8)
            q, k = G.matrix([self.quals[i][: len(self.seqs[i])] for i in at])
            quals[:, : q.shape[1]][np.arange(q.shape[1]) < k[:, None]] = q[np.arange(q.shape[1]) < k[:, None]]
        x = G.align(mat, lens, adapter["bytes"], np.full(len(at), m), -left, lens - m + right, quals)
        return x, (x.overlap >= p.min_overlap) & (x.matches > 0) & (x.mismatches <= G.allowed(x.overlap, p.error_rate, p.errors, p.non_linear))

    def erase(self, i: int, adapter: dict, shift: int, overlap: int, mismatches: int) -> None:
        """From the match on (3'), or up to its end (5')."""
        n = len(self.seqs[i])
        part = slice(0, max(shift, 0)) if adapter["three"] else slice(min(n, shift + len(adapter["adapter"])), n)
        self.seqs[i], self.quals[i] = self.seqs[i][part], self.quals[i][part]
        self.cuts[i].append((adapter["adapter_id"], n - len(self.seqs[i]), overlap, mismatches))

    def cut_best(self, adapters: list[dict], at: np.ndarray) -> None:
        """The match with the highest score is cut, the first of equals."""
        top, which = np.full(len(at), np.iinfo(np.int64).min), np.full(len(at), -1)
        found = []
        for k, a in enumerate(adapters):
            x, ok = self.best(a, at)
            found.append(x)
            take = ok & (x.score > top)
            top[take], which[take] = x.score[take], k
        for j in np.flatnonzero(which >= 0).tolist():
            x = found[which[j]]
            self.erase(int(at[j]), adapters[which[j]], int(x.shift[j]), int(x.overlap[j]), int(x.mismatches[j]))

    def cut_all(self, adapters: list[dict], at: np.ndarray) -> None:
        """Every adapter that matches is cut, in order."""
        for a in adapters:
            x, ok = self.best(a, at)
            for j in np.flatnonzero(ok).tolist():
                self.erase(int(at[j]), a, int(x.shift[j]), int(x.overlap[j]), int(x.mismatches[j]))

    def run(self, adapters: list[dict]) -> None:
        """Up to ``times`` rounds; a read that a round leaves as it was, or with fewer than ``min_overlap`` bases, is done."""
        at = np.array([i for i, s in enumerate(self.seqs) if s], np.int64)
        for _ in range(self.p.times if adapters else 0):
            before = [len(self.seqs[i]) for i in at]
            (self.cut_all if self.p.top_down else self.cut_best)(adapters, at)
            at = np.array([i for i, n in zip(at.tolist(), before) if self.p.min_overlap <= len(self.seqs[i]) < n], np.int64)


def strip(reads: DataFrame, adapters: DataFrame, p: TrimParams, seq: str = "seq", qual: str = "qual", id_: str = "id", reverse: bool = False) -> DataFrame:
    """Up to ``p.times`` rounds; ``removed`` sums the bases and ``matches`` lists (adapter_id, removed, overlap, mismatches) of every cut. ``:AdapterRemoved`` goes into changed ids with ``p.tag``.

    A read that a round leaves as it was, or with fewer than ``p.min_overlap`` bases, is done. A null read stays null. With
    ``p.by_quality``, mismatches of likely wrong bases count as ambiguous. Columns named ``removed`` and ``matches`` are replaced.
    """
    rows = adapter_rows(adapters, reverse)
    reads = reads.drop("removed", "matches")
    at = [reads.columns.index(c) for c in (seq, qual)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct(_CUT))
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(start, TOGETHER)
                seqs, quals = (b.column(i).to_pylist() for i in at)
                work = Round([s or "" for s in seqs], [q or "" for q in quals], p)
                work.run(rows)
                cols = list(b.columns)
                for i, was, now in ((at[0], seqs, work.seqs), (at[1], quals, work.quals)):
                    cols[i] = pa.array([None if w is None else x for w, x in zip(was, now)], pa.string())
                removed = pa.array([None if s is None else sum(c[1] for c in cs) for s, cs in zip(seqs, work.cuts)], pa.int32())
                cuts = pa.array([[dict(zip(("adapter_id", "removed", "overlap", "mismatches"), c)) for c in cs] for cs in work.cuts], kind)
                yield pa.RecordBatch.from_arrays([*cols, cuts, removed], names=[*b.schema.names, "matches", "removed"])

    d = reads.mapInArrow(run, StructType([*reads.schema.fields, StructField("matches", MATCHES), StructField("removed", IntegerType())]))
    if p.tag:
        d = d.withColumn(id_, F.when(F.col("removed") > 0, S.insert_after_first_token(F.col(id_), F.lit(":AdapterRemoved"))).otherwise(F.col(id_)))
    return d


def align_all(reads: DataFrame, adapters: DataFrame, p: TrimParams, seq: str = "seq", qual: str = "qual", reverse: bool = False) -> DataFrame:
    """(read_no, adapter_id, shift, overlap, matches, ambiguous): the best alignment of every read with every adapter; none where no shift overlaps."""
    rows = adapter_rows(adapters, reverse)
    names = ["read_no", "adapter_id", "shift", "overlap", "matches", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(start, TOGETHER)
                work = Round([s or "" for s in b.column("s").to_pylist()], [q or "" for q in b.column("q").to_pylist()], p)
                at = np.array([i for i, s in enumerate(work.seqs) if s], np.int64)
                for a in rows if len(at) else ():
                    x, _ = work.best(a, at)
                    ok = np.flatnonzero(x.overlap > 0)
                    yield pa.RecordBatch.from_arrays([b.column("read_no").take(pa.array(at[ok])), pa.array(np.full(len(ok), a["adapter_id"]), pa.int32()), *(pa.array(v[ok], pa.int32()) for v in (x.shift, x.overlap, x.matches, x.ambiguous))], names=names)

    return reads.select("read_no", F.col(seq).alias("s"), F.col(qual).alias("q")).mapInArrow(run, "read_no long, adapter_id int, shift int, overlap int, matches int, ambiguous int")


def strip_pair(reads: DataFrame) -> DataFrame:
    """Mates whose overlap (over 5 bases, at most 15 % wrong) shows how long the insert is are cut to it; ``insert`` is null for others.

    The overlap is the forward read's against the reverse complement of its mate, without gaps, by the highest score; N neither match nor mismatch.
    """
    at = [reads.columns.index(c) for c in ("seq", "seq_rev")]
    reads = reads.drop("insert")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = str.maketrans("ACGT", "TGCA")
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(start, TOGETHER)
                fwd, rev = (b.column(i).to_pylist() for i in at)
                x, n = G.matrix([s or "" for s in fwd])
                y, m = G.matrix([(s or "").translate(turn)[::-1] for s in rev])
                a = G.align(x, n, y, m, 1 - m, n - 1, by_score=True)
                wrong = (a.overlap - a.score) // 2
                ok = (a.overlap > 5) & (wrong <= a.overlap * 0.15)
                yield b.append_column("insert", pa.array([int(v) if good else None for v, good in zip(2 * n - a.overlap, ok)], pa.int32()))

    d = reads.mapInArrow(run, StructType([*reads.schema.fields, StructField("insert", IntegerType())]))
    cut = lambda c: F.when(F.col("insert").isNull(), F.col(c)).otherwise(F.substring(F.col(c), F.lit(1), F.col("insert")))
    return d.withColumns({c: cut(c) for c in ("seq", "qual", "seq_rev", "qual_rev")})


def adapter_stats(stripped: DataFrame) -> DataFrame:
    """Per adapter: cuts, least, mean (whole) and largest overlap."""
    m = stripped.select(F.explode("matches").alias("m")).select("m.*")
    return m.groupBy("adapter_id").agg(F.count("*").alias("n_removed"), F.min("overlap").alias("min_overlap"), F.floor(F.avg("overlap")).alias("mean_overlap"), F.max("overlap").alias("max_overlap"))


def removed_lengths(stripped: DataFrame) -> DataFrame:
    """Cuts by removed length and mismatches."""
    return stripped.select(F.explode("matches").alias("m")).groupBy(F.col("m.removed").alias("length"), F.col("m.mismatches").alias("mismatches")).agg(F.count("*").alias("n"))

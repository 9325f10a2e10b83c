"""Exact top-k by inner product: the three-phase uniform-threshold algorithm.

A vector's components are cut into ``SLICES`` lists of equal width; a row's inner product over one of them is its entry
in that list. Rows stand in blocks of ``BLOCK``, queries in blocks of ``QUERIES``.

1. Gather: every row block computes one list (blocks take turns, so all lists are gathered), follows its leaders through
   the other lists and sends, per query, exact scores of k of them. The k-th best of all scores sent is a safe cutoff.
2. Broadcast and collect: by the lengths of its parts a row's score has an upper bound, and bound less cutoff is the slack
   that its entries may lose to theirs. List after list is computed, and rows that lost more than their slack are dropped,
   until half of the entries are left. Leaders met on the way are resolved at once and raise the block's cutoff.
3. Resolve: the lists still missing are computed for the rows left alone; the block sends its best k at or above the cutoff.

Fewer components are multiplied than all scores take (``Work`` counts them). Cutoffs travel with the query blocks, so nothing that grows
with the data is sent to every executor. Blocks meet in a grid of cells, each ``GRID`` blocks high and wide, so a block
is sent once a cell and not once for each block it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, portions

BLOCK, QUERIES, SLICES, GRID = 8192, 1024, 16, 16
SCALE = 256
#: Share of entries below which the missing lists are computed for single rows.
FEW = 0.5

def _usable(v: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, good)


def _pack(t: pa.Table) -> pa.Table:
    """One row for a block: ids, and components floor(SCALE * x) as doubles, which hold them exactly."""
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ids = t.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    m = np.floor(SCALE * flat).reshape(len(ids), -1)[order]
    return pa.table({"d": [m.shape[1]], "b": [t.column("b")[0].as_py()], "ids": [ids[order].astype(np.int64).tobytes()], "m": [m.tobytes()]}, schema=pa.schema([("d", pa.int32()), ("b", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())]))


def _load(ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.float64).reshape(len(i), -1)


def _dot(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q r^T without rounding: doubles where every sum stays below 2^53, else Python integers."""
    if not _whole(q, r):
        return q @ r.T
    integer = np.frompyfunc(int, 1, 1)
    return integer(q).astype(object) @ integer(r).astype(object).T


def _slices(d: int) -> list[slice]:
    cuts = np.linspace(0, d, min(SLICES, d) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


class Work:
    """How many components were multiplied."""

    def __init__(self):
        self.products = 0

    def dot(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        self.products += q.size * len(r)
        return _dot(q, r)

    def pairs(self, q: np.ndarray, r: np.ndarray, at_q: np.ndarray, at_r: np.ndarray, whole: bool) -> np.ndarray:
        """Inner products of single rows, exact as those of ``dot``."""
        self.products += len(at_q) * q.shape[1]
        out = []
        for i in range(0, len(at_q), 1 << 15):
            a, b = q[at_q[i : i + (1 << 15)]], r[at_r[i : i + (1 << 15)]]
            if whole:
                integer = np.frompyfunc(int, 1, 1)
                out.append((integer(a).astype(object) * integer(b).astype(object)).sum(axis=1))
            else:
                out.append(np.einsum("ij,ij->i", a, b))
        return np.concatenate(out) if out else np.zeros(0, object if whole else np.float64)


def _whole(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether scores may exceed what doubles hold exactly, so that Python integers are needed."""
    return not np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * max(1, q.shape[1]) < 2.0**53


def _gather(turn: int, qi: np.ndarray, q: np.ndarray, ri: np.ndarray, r: np.ndarray, k: int, work: Work) -> np.ndarray:
    """Phase 1 in one block: exact scores of k leaders, best first (-inf where there are fewer).

    The leaders of one list go on to the next one, the better quarter at a time, until ``4 * k`` are left.
    """
    parts = _slices(q.shape[1])
    parts = parts[turn % len(parts) :] + parts[: turn % len(parts)]
    entries = work.dot(q[:, parts[0]], r[:, parts[0]]).astype(np.float64)
    entries[qi[:, None] == ri[None, :]] = -np.inf
    n, whole = min(4 * k, len(ri)), _whole(q, r)
    lead = np.empty((len(qi), n), np.int64)
    for a in range(0, len(qi), 64):
        sums = entries[a : a + 64]
        at = np.broadcast_to(np.arange(len(ri)), sums.shape)
        for part in parts[1:]:
            width = max(n, sums.shape[1] // 4)
            if sums.shape[1] > width:
                keep = np.argpartition(-sums, width - 1, axis=1)[:, :width]
                at, sums = np.take_along_axis(at, keep, axis=1), np.take_along_axis(sums, keep, axis=1)
            if width == n:
                break
            work.products += at.size * (part.stop - part.start)
            sums = sums + np.einsum("ijk,ik->ij", r[:, part][at], q[a : a + 64, part])
        lead[a : a + 64] = np.take_along_axis(at, np.argpartition(-sums, n - 1, axis=1)[:, :n], axis=1)
    at_q, at_r = np.repeat(np.arange(len(qi)), n), lead.ravel()
    score = work.pairs(q, r, at_q, at_r, whole).astype(np.float64)
    if whole:
        score = np.nextafter(score, -np.inf)  # rounding may not raise the cutoff
    score[qi[at_q] == ri[at_r]] = -np.inf
    best = np.full((len(qi), k), -np.inf)
    n = min(k, n)
    best[:, :n] = -np.sort(-score.reshape(len(qi), -1), axis=1)[:, :n]
    return best


def _lengths(m: np.ndarray) -> np.ndarray:
    """Lengths of each row's components from each list on (the last column is 0)."""
    squares = np.stack([np.square(m[:, s]).sum(axis=1) for s in _slices(m.shape[1])], axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([rest, np.zeros((len(m), 1))], axis=1)) * (1 + 1e-9)


def _leaders(sums: np.ndarray, alive: np.ndarray, known: np.ndarray, q: np.ndarray, r: np.ndarray, missing: list[slice], k: int, work: Work) -> np.ndarray:
    """The k-th best exact score among each query's ``4 * k`` leaders by the lists known so far; -inf where there are fewer."""
    n = min(4 * k, sums.shape[1])
    if n < k:
        return np.full(len(q), -np.inf)
    lead = np.argpartition(np.where(alive, -sums, np.inf), n - 1, axis=1)[:, :n]
    at_q, at_r = np.repeat(np.arange(len(q)), n), lead.ravel()
    score = known[at_q, at_r]
    for part in missing:
        score = score + work.pairs(q[:, part], r[:, part], at_q, at_r, known.dtype == object)
    score = score.astype(np.float64)
    if known.dtype == object:
        score = np.nextafter(score, -np.inf)
    score[~alive[at_q, at_r]] = -np.inf
    return -np.sort(-score.reshape(len(q), n), axis=1)[:, k - 1]


def _resolve(qi: np.ndarray, q: np.ndarray, ri: np.ndarray, r: np.ndarray, cut: np.ndarray, k: int, work: Work):
    """Phases 2 and 3 in one block: (query number, row, exact score) of its best k rows per query that reach the cutoff."""
    parts, whole = _slices(q.shape[1]), _whole(q, r)
    long_q, long_r = _lengths(q), _lengths(r)
    spare = 1 + 1e-12 * long_q[:, 0] * long_r[:, 0].max(initial=0)  # for rounding
    known = np.zeros((len(qi), len(ri)), object if whole else np.float64)
    alive = qi[:, None] != ri[None, :]
    for t, s in enumerate(parts):
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
        known += work.dot(q[:, s], r[:, s])
        if 2 * t + 2 < len(parts) and t + 1 != len(parts) // 4:  # bounds at a quarter of the lists, and from half of them on
            continue
        sums = known.astype(np.float64)
        if t <= len(parts) // 2:
            cut = np.maximum(cut, _leaders(sums, alive, known, q, r, parts[t + 1 :], k, work))
        work.products += alive.size
        alive &= sums + long_q[:, t + 1, None] * long_r[:, t + 1] >= (cut - spare)[:, None]
    else:
        t = len(parts)
    at_q, at_r = np.nonzero(alive)
    score = known[at_q, at_r]
    for j in range(t, len(parts)):
        score = score + work.pairs(q[:, parts[j]], r[:, parts[j]], at_q, at_r, whole)
        work.products += len(at_q)
        left = score.astype(np.float64) + long_q[at_q, j + 1] * long_r[at_r, j + 1] >= (cut - spare)[at_q]
        at_q, at_r, score = at_q[left], at_r[left], score[left]
    reach = score.astype(np.float64) >= cut[at_q]
    at_q, at_r, score = at_q[reach], at_r[reach], score[reach]
    order = np.lexsort((at_r, -score.astype(np.float64), at_q)) if not whole else np.array(sorted(range(len(at_q)), key=lambda i: (at_q[i], -score[i], at_r[i])), np.int64)
    at_q, at_r, score = at_q[order], at_r[order], score[order]  # rows stand in order of id
    first = np.searchsorted(at_q, at_q)
    keep = np.arange(len(at_q)) - first < k
    return at_q[keep], ri[at_r[keep]], np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score[keep]], np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec: str = "embedding") -> DataFrame:
    """Each query's ``k`` best rows by integer inner product: query_id, rank int, vec_id, score long.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id and as
    many components. Components count as floor(256 * x). Ties go to the smaller vec_id. A query with fewer than ``k``
    candidates gets them all. Rows whose id or vector is null, empty or has a null or non-finite component take no
    part; a repeated row is a candidate as often as it occurs, and a repeated query is answered once. Scores beyond
    64 bits are clipped after ranking. Other columns are not read.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("d", F.size("v"))
    sizes = {r["d"]: (r["n"], r["q"]) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    ends = {d: (-(-n // BLOCK), -(-q // QUERIES)) for d, (n, q) in sizes.items()}
    schema = "query_id long, rank int, vec_id long, score long"
    if not ends:
        return spark.createDataFrame([], schema)
    blocks_of = spark.createDataFrame([(d, r, q) for d, (r, q) in ends.items()], "d int, n_r int, n_q int")
    # one row per length of vector, so its size is bounded by the lengths that occur
    rows = rows.join(F.broadcast(blocks_of), "d")
    # a row's place in the table is part of its hash: repeated rows spread over the blocks
    spread = F.xxhash64("vec_id", "v", F.monotonically_increasing_id())
    packed = "d int, b int, ids binary, m binary"
    r_blocks = ws.write(rows.withColumn("b", F.pmod(spread, "n_r").cast("int")).groupBy("d", "b").applyInArrow(_pack, packed), "rows", "none")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    q_blocks = ws.write(asked.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), "n_q").cast("int")).groupBy("d", "b").applyInArrow(_pack, packed), "queries", "none")

    def meet(q: DataFrame) -> DataFrame:
        """Query blocks (kind 0) and then row blocks (kind 1) of each cell, cell after cell."""
        cut = F.col("cut") if "cut" in q.columns else F.lit(None).cast("binary").alias("cut")
        cells = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / GRID).cast("int")))
        own = F.floor(F.col("b") / GRID).cast("int")
        ask = q.join(F.broadcast(blocks_of), "d").select("d", cells("n_r").alias("i"), own.alias("j"), F.lit(0).alias("kind"), "b", "ids", "m", cut)
        row = r_blocks.join(F.broadcast(blocks_of), "d").where("n_q > 0").select("d", own.alias("i"), cells("n_q").alias("j"), F.lit(1).alias("kind"), "b", "ids", "m", F.lit(None).cast("binary").alias("cut"))
        return ask.unionAll(row).repartition("d", "i", "j").sortWithinPartitions("d", "i", "j", "kind", "b")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(d, query block's number, its ids, vectors and cutoffs, row block's number, ids and vectors); a cell's query blocks are held while its row blocks pass."""
        at, held = None, []
        for b in portions(batches, 1):
            x = b.to_pylist()[0]
            if (x["d"], x["i"], x["j"]) != at:
                at, held = (x["d"], x["i"], x["j"]), []
            block = _load(x["ids"], x["m"])
            if x["kind"] == 0:
                held.append((x["b"], *block, None if x["cut"] is None else np.frombuffer(x["cut"], np.float64)))
            else:
                for q in held:
                    yield x["d"], *q, x["b"], *block

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Work()
        for d, qb, qi, q, _, rb, ri, r in cells(batches):
            yield pa.RecordBatch.from_pylist([{"d": d, "b": qb, "best": _gather(rb, qi, q, ri, r, k, work).tobytes()}], pa.schema([("d", pa.int32()), ("b", pa.int32()), ("best", pa.binary())]))

    def lower(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge the scores that all row blocks sent, a few at a time."""
        best = None
        for b in portions(groups, 16):
            for x in b.to_pylist():
                more = np.frombuffer(x["best"], np.float64).reshape(-1, k)
                key = (x["d"], x["b"])
                best = more if best is None else -np.sort(-np.concatenate([best, more], axis=1), axis=1)[:, :k]
        yield pa.RecordBatch.from_pylist([{"d": key[0], "b": key[1], "cut": best[:, k - 1].tobytes()}], pa.schema([("d", pa.int32()), ("b", pa.int32()), ("cut", pa.binary())]))

    sent = meet(q_blocks).mapInArrow(gather, "d int, b int, best binary")
    cutoffs = ws.write(sent.groupBy("d", "b").applyInArrow(lower, "d int, b int, cut binary"), "cutoffs", "none")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Work()
        for d, qb, qi, q, cut, _, ri, r in cells(batches):
            at, ids, score = _resolve(qi, q, ri, r, cut, k, work)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qb), pa.int32()), pa.array(at, pa.int32()), pa.array(np.full(len(at), d), pa.int32()), pa.array(qi[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["qb", "at", "d", "query_id", "vec_id", "score"])

    near = meet(q_blocks.join(cutoffs, ["d", "b"])).mapInArrow(collect, "qb int, at int, d int, query_id long, vec_id long, score long")
    order = Window.partitionBy("d", "qb", "at").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = ws.write(best, "result")
    ws.close("result")
    return out

"""Benchmark passages in documents, paraphrases included, by latent semantic retrieval.

1. Documents become sequences of benchmark-word numbers (0 for other words), and passages of ``WIDTH`` words, one
   every half of it. Words weigh by the inverse of the number of items that hold them, always above 0: how often a word stands in
   the documents does not count, since an item that leaked widely makes its own words frequent.
2. A distributed randomised SVD of the TF-IDF matrix (all passages and the benchmark's items as rows):
   each pass multiplies A^T A by a thin matrix, one batch of passages at a time; a Rayleigh-Ritz step gives the latent axes.
3. Passages and items are folded onto the axes; passages near an item by cosine there are candidates, and so are those whose
   latent product with an item is as large as wherever the whole item stands. A candidate is confirmed by the longest common
   subsequence with the item's words around the passage: most of the item, or, so that paraphrases are found, two fifths of it and of its telling words (and some more
   of these unless the item's answer, its last sentence or its last words, is there too).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, portions

WIDTH, COMMON = 64, 0.005
#: Axes at most, for which a larger benchmark is searched in groups of items; and those of them that are latent in the passages.
AXES, BEYOND = 512, 32
#: Cosine of a candidate, by the length of its passage on the axes, or by the whole length; share of the item's words in order that confirm it alone; share of its telling words in order that confirm it without its answer,
#: or with it; telling words at least. Telling are those in at most COMMON of all passages, or else the rarer half of the item's words.
CLOSE, NEAR, MOST, HALF, SOME, TERMS = 0.45, 0.3, 0.7, 0.45, 0.4, 3
#: Bytes of benchmark that one search holds; a larger benchmark is searched part by part.
PART = 4 << 20
SLICES = 8

#: ASCII bytes that are no letters or digits end a word.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: So do other characters that are no letters, digits or marks upon them.
_WIDE = re.compile(r"[^\w\x00-\x7f]")


def _parted(m: re.Match) -> str:
    return m[0] if unicodedata.category(m[0])[0] == "M" else " "


def words_of(text: str) -> list[bytes]:
    """Words in lower case, in order."""
    if not text.isascii():
        text = _WIDE.sub(_parted, text)
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split()


def numbers(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words' numbers in the vocabulary, 0 for others."""
    w = words_of(text) if text else ()
    return np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w))


class Benchmark:
    """Items as word numbers, their vocabulary (from 1 on) and the place where each item's answer begins."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.items, self.answers = [], [], []
        for i, text in sorted({(i, t) for i, t in rows if i is not None and t}):
            of = words_of(text)
            if not of:
                continue
            seq = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in of], np.int32)
            n = len(words_of(re.split(r"(?<=[.?!:])\s+", text.strip())[-1]))
            self.ids.append(i)
            self.items.append(seq)
            self.answers.append(len(seq) - (n if 3 <= n <= len(seq) // 2 else max(1, len(seq) // 5)))
        self.size = len(self.vocabulary) + 1


def passages(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with their counts by passage: passage number, word, count; and where each document's passages begin."""
    half = WIDTH // 2
    lens = np.array([len(x) for x in ids], np.int64)
    n_passages = np.maximum(1, -(-lens // half) - 1) * (lens > 0)
    begin = np.concatenate([[0], np.cumsum(n_passages)])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    hit = np.flatnonzero(flat)
    word = flat[hit].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    doc = np.searchsorted(starts, hit, "right") - 1
    j = (hit - starts[doc]) // half
    last = n_passages[doc] - 1
    own, before = begin[doc] + np.minimum(j, last), begin[doc] + j - 1
    two = (j >= 1) & (j <= last)
    size = int(flat.max(initial=0)) + 1
    key, n = np.unique(np.concatenate([own, before[two]]) * size + np.concatenate([word, word[two]]), return_counts=True)
    p, w = np.divmod(key, size)
    return p, w, n, begin


def _rows(of: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)


def _chunks(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole rows, about 8192 entries at a time."""
    cuts = _rows(of)
    cuts = np.append(cuts[np.flatnonzero(np.diff(cuts // 8192, prepend=-1))], len(of))
    return zip(cuts.tolist(), cuts[1:].tolist())


def gram(p: np.ndarray, w: np.ndarray, v: np.ndarray, thin: np.ndarray, out: np.ndarray) -> None:
    """Adds A^T (A thin) to ``out`` for the sparse rows p of A."""
    for a, b in _chunks(p):
        starts = _rows(p[a:b])
        z = np.add.reduceat(v[a:b, None] * thin[w[a:b]], starts, axis=0)
        back = v[a:b, None] * np.repeat(z, np.diff(np.append(starts, b - a)), axis=0)
        order = np.argsort(w[a:b], kind="stable")
        ws = w[a:b][order]
        first = _rows(ws)
        out[ws[first]] += np.add.reduceat(back[order], first, axis=0)


def lcs(item: np.ndarray, seq: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item; 0s in ``seq`` match nothing."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in seq.tolist():
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _sum(df: DataFrame, width: int) -> np.ndarray:
    """The sum of (slice, part, data) rows of doubles, added up on the executors."""

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = at = None
        for b in groups:
            for at, d in zip(b.column("slice").to_pylist(), b.column("data").to_pylist()):
                x = np.frombuffer(d, np.float64)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "data"])

    once = df.groupBy("slice", "part").applyInArrow(add, "slice int, data binary")
    parts = {r["slice"]: np.frombuffer(r["data"], np.float64) for r in once.groupBy("slice").applyInArrow(add, "slice int, data binary").collect()}
    return np.concatenate([parts[s] for s in sorted(parts)]).reshape(-1, width) if parts else np.zeros((0, width))


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = np.array_split(total, SLICES)
    part = TaskContext.get().partitionId() // 32
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([np.ascontiguousarray(x, np.float64).tobytes() for x in parts], pa.binary())], names=["slice", "part", "data"])


def _sequences(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16 if wide == 2 else np.int32).astype(np.int32) for x, wide in zip(b.column("seq").to_pylist(), b.column("wide").to_pylist())]


MATCHES = "doc_id long, item_id long, similarity double, lcs int, item_words int, start int, answered boolean"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """A row per document and benchmark item that it holds, verbatim or rephrased: doc_id, item_id, similarity double (latent
    cosine of the best passage), lcs and item_words int, start int (the passage's first word), answered boolean.

    What goes to every executor is the benchmark, or one part of it after the other if it has over PART bytes. Null and empty texts and items hold nothing; repeated
    items of one id count each; repeated rows of a document give one row per item; null doc_ids are one document of their own, with a null id. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    parts = -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART)
    if parts <= 1:
        return _find(docs, named, text)
    ws, found = Workspace(spark, "decontaminate-parts"), []
    for k in range(parts):
        some = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        found.append(ws.write(_find(docs, some, text), f"part{k}"))
    return _best(reduce(DataFrame.unionAll, found))


def _best(found: DataFrame) -> DataFrame:
    """One row per document and item."""
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "lcs", "item_words", "start", "answered")).alias("r")).select("doc_id", "item_id", "r.*")


def _find(docs: DataFrame, benchmark: DataFrame, text: str) -> DataFrame:
    """``find_benchmark`` for a benchmark that the driver can hold."""
    spark: SparkSession = docs.sparkSession
    bench = Benchmark([(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").collect()])
    if not bench.items:
        return spark.createDataFrame([], MATCHES)
    ws = Workspace(spark, "decontaminate")
    vocabulary, size = bench.vocabulary, bench.size
    wide = 2 if size <= 0xFFFF else 4

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, total = np.zeros(size), 0
        names = ["doc_id", "seq", "wide", "slice", "part", "data"]
        for b in portions(batches):
            ids = [numbers(t.as_py(), vocabulary) for t in b.column("text")]
            _, w, _, begin = passages(ids)
            frequency += np.bincount(w, minlength=size)
            total += int(begin[-1])
            n = b.num_rows
            seq = [x.astype(np.uint16).tobytes() if wide == 2 else x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(seq, pa.binary()), pa.array([wide] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        frequency[0] = total
        for x in _slices(frequency[:, None]):
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.int32()), *x.columns], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbered = ws.write(plain.mapInArrow(number, "doc_id long, seq binary, wide int, slice int, part int, data binary"), "numbered")
    frequency = _sum(numbered.where("data is not null").select("slice", "part", "data"), 1)[:, 0]
    sequences = numbered.where("seq is not null").select("doc_id", "seq", "wide")
    if not len(frequency) or not frequency[0]:
        return spark.createDataFrame([], MATCHES)
    within = np.bincount(np.concatenate([np.unique(x) for x in bench.items]), minlength=size)
    weight = np.log(1 + len(bench.items) / np.maximum(within, 1))
    weight[0] = 0.0
    rare = [telling(x, frequency) for x in bench.items]

    ip, iw, ic = passages_of_items(bench)
    iv = weight[iw] * (1 + np.log(ic))
    rng = np.random.default_rng(7)
    rank = min(size, BEYOND)
    thin = rng.normal(size=(size, rank))

    def times(thin: np.ndarray) -> np.ndarray:
        sent = thin.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(sent.shape)
            for b in portions(batches):
                p, w, c, _ = passages(_sequences(b))
                gram(p, w, (weight[w] * (1 + np.log(c))).astype(np.float32), sent, out)
            yield from _slices(out)

        total = _sum(sequences.mapInArrow(run, "slice int, part int, data binary"), rank)
        gram(ip, iw, iv, thin, total)
        return total

    basis = np.linalg.qr(times(thin))[0]
    image = times(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    latent = basis @ turn[:, ::-1][:, values[::-1] > 1e-9 * max(values[-1], 1e-30)]

    def group(lo: int, hi: int) -> DataFrame:
        """Matches of the items from lo on, before hi: all of them on axes of their own, with the latent ones. Passages consist of these items' words alone."""
        items, answers, telling_words, numbers_of = bench.items[lo:hi], bench.answers[lo:hi], rare[lo:hi], bench.ids[lo:hi]
        words = np.unique(np.concatenate([[0], *items]))
        own = np.zeros(size, np.int32)
        own[words] = np.arange(len(words))
        heavy = weight[words]
        targets = np.zeros((hi - lo, len(words)))
        at = (ip >= lo) & (ip < hi)
        targets[ip[at] - lo, own[iw[at]]] = iv[at]
        targets /= np.linalg.norm(targets, axis=1)[:, None]
        axes = np.linalg.qr(np.hstack([targets.T, latent[words]]))[0]
        fold, folded = axes.astype(np.float32), (axes.T @ targets.T).astype(np.float32)
        bars = np.array([bar(x) for x in items], np.float32)
        products, distinct = zip(*(reach(own[x], heavy) for x in items))
        whole = np.array(products, np.float32) * np.float32(0.999)
        least = min(TERMS, *map(len, telling_words), *distinct)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches):
                ids, seqs = b.column("doc_id").to_pylist(), _sequences(b)
                p, w, c, begin = passages([own[x] for x in seqs])
                v = (heavy[w] * (1 + np.log(c))).astype(np.float32)
                found: dict[tuple[int, int], tuple] = {}

                def check(at: int, d: int, k: int, cosine: float) -> None:
                    first = (at - int(begin[d])) * (WIDTH // 2)
                    got = confirm(items[k], answers[k], telling_words[k], seqs[d], first, cosine)
                    if got and ((d, k) not in found or found[d, k][0] < got[0]):
                        found[d, k] = (*got, first)

                take = np.bincount(p, minlength=int(begin[-1]) + 1)[p] >= least
                tp, tw, tv = p[take], w[take], v[take]
                for s, e in _chunks(tp):
                    at, product, latent, length = cosines(tp[s:e], tw[s:e], tv[s:e], fold, folded)
                    asked = np.minimum(CLOSE * latent, NEAR * length)[:, None] * bars
                    for i, k in zip(*(x.tolist() for x in np.nonzero(product >= np.minimum(asked, whole)))):
                        check(int(at[i]), int(np.searchsorted(begin, at[i], "right")) - 1, k, float(product[i, k] / latent[i]))
                rows = [(ids[d], numbers_of[k], sim, n, len(items[k]), first, ok) for (d, k), (sim, n, ok, first) in found.items()]
                c = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], names=["doc_id", "item_id", "similarity", "lcs", "item_words", "start", "answered"])

        return sequences.mapInArrow(search, MATCHES)

    per = AXES - BEYOND
    groups = [(lo, min(lo + per, len(bench.items))) for lo in range(0, len(bench.items), per)]
    if len(groups) == 1:
        found = group(*groups[0])
    else:  # one at a time: the driver holds the axes of one group
        found = reduce(DataFrame.unionAll, [ws.write(group(lo, hi), f"found{lo}") for lo, hi in groups])
    out = ws.write(_best(found), "result")
    ws.close("result")
    return out


def passages_of_items(bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each whole item as one passage."""
    word = np.concatenate(bench.items).astype(np.int64)
    of = np.repeat(np.arange(len(bench.items)), [len(x) for x in bench.items])
    key, n = np.unique(of * bench.size + word, return_counts=True)
    p, w = np.divmod(key, bench.size)
    return p, w, n


def telling(item: np.ndarray, frequency: np.ndarray) -> frozenset:
    """The item's words in at most COMMON of all passages, or the rarer half of its words if those are more."""
    words = np.unique(item)
    words = words[np.argsort(frequency[words], kind="stable")]
    few = int(np.count_nonzero(frequency[words] <= COMMON * frequency[0]))
    return frozenset(words[: max(few, -(-len(words) // 2))].tolist())


def cosines(p: np.ndarray, w: np.ndarray, v: np.ndarray, fold: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage numbers, their products with the folded items when they are folded onto the axes as well, and by what these are divided for cosines: their lengths on the axes, and whole."""
    starts = _rows(p)
    on = np.add.reduceat(v[:, None] * fold[w], starts, axis=0)
    latent = np.maximum(np.sqrt(np.einsum("ij,ij->i", on, on)), np.float32(1e-12))
    return p[starts], on @ folded, latent, np.sqrt(np.add.reduceat(v * v, starts))


def _windows(item: np.ndarray) -> Iterator[list[np.ndarray]]:
    """For each place of an item's first word in half a passage, the item's words in each passage that it meets."""
    half = WIDTH // 2
    for r in range(half):
        yield [item[max(0, at - r) : at - r + WIDTH] for at in range(0, r + len(item), half)]


def reach(item: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """What some passage has wherever the whole item stands: the inner product with the item, of length 1, and distinct words. Other words only add to them, and the axes hold the item."""

    def of(some: np.ndarray) -> tuple[float, int]:
        words, n = np.unique(some, return_counts=True)
        return float((weight[words] * (1 + np.log(n)) * v[words]).sum()), len(words)

    words, n = np.unique(item, return_counts=True)
    v = np.zeros(len(weight))
    v[words] = weight[words] * (1 + np.log(n))
    best = [max(map(of, passages)) for passages in _windows(item)] if len(item) > WIDTH // 2 + 1 else [of(item)]
    return min(x for x, _ in best) / float(np.linalg.norm(v)), min(n for _, n in best)


def bar(item: np.ndarray) -> float:
    """The share of a cosine asked of a candidate: less for an item too long for a passage to hold."""
    return min(1.0, (WIDTH / 2 / len(item)) ** 0.5)


def confirm(item: np.ndarray, answer: int, rare: frozenset, seq: np.ndarray, first: int, cosine: float):
    """(cosine, common words in order, whether the answer is there) if the item stands around the passage; else None.

    The item's words must stand together: in stretches of half as many words again. Telling words must stand in order as well.
    """
    region = seq[max(0, first - max(WIDTH // 2, len(item))) : first + WIDTH + max(WIDTH // 2, len(item))]
    if len(rare & set(region.tolist())) < max(min(TERMS, len(rare)), SOME * len(rare)):
        return None
    told = item[np.isin(item, list(rare))]
    span, best = len(item) + len(item) // 2 + 2, None
    for s in range(0, max(1, len(region) - span + 1 + len(item) // 4), max(1, len(item) // 4)):
        around = region[s : s + span]
        n = lcs(item, around)
        if n < SOME * len(item) or (best and n <= best[0]):
            continue
        if n < MOST * len(item):
            words = set(around.tolist())
            tail = item[answer:]
            ends = [w for w in tail.tolist() if w in rare] or tail.tolist()
            answered = sum(w in words for w in ends) >= 0.6 * len(ends)
            if lcs(told, around) < max(TERMS + 1 - answered, (SOME if answered else HALF) * len(told)):
                continue
        best = (n,)
    if best is None:
        return None
    around = set(region.tolist())
    ends = [w for w in item[answer:].tolist() if w in rare] or item[answer:].tolist()
    return cosine, best[0], sum(w in around for w in ends) >= 0.6 * len(ends)

"""Passages that repeat across or within documents, removed but for their first occurrence, by repeated-phrase automata.

1. Confirm recurring phrases. Of every window of ``window`` words, the phrase of six words with the least hash is its
   mark; equal windows have equal marks. Marks are counted in shards of their value; those met twice recur.
2. Compile and stream. Documents are dealt into blocks; each block gets an Aho-Corasick automaton (pyahocorasick) of the
   recurring phrases marked in it, over an alphabet of word symbols, and its documents are streamed through it one by one, which
   finds every occurrence. Only windows around an occurrence can repeat; they are hashed.
3. Decide. A window repeats if it starts earlier in its own document, or in a document of smaller id. Their words go.

Word symbols have 10 bits, so a phrase is one 64-bit number and its own pattern; that two words may share a symbol only
adds candidates. Windows are compared by 96 bits of hash: among 10^13 distinct ones a wrong match has a chance below 1 in 1000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import grams, mix, word_memo, words
from .workspace import Workspace, portions

#: Documents of a block, marks of a shard on average; documents beyond which a mark's occurrences are combined by block in several tasks first.
BLOCK, SHARD, COMBINED = 1000, 400_000, 2_000_000
_BASE = 0x10000  # symbols as characters, beyond the surrogates


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        x, span = least(x[:-span], x[span:]), 2 * span
    return least(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def shape(window: int) -> tuple[int, int]:
    """Words of a phrase, and bits of a word's symbol."""
    n = min(6, window)
    return n, min(20, 60 // n)


def phrases(h: np.ndarray, window: int) -> np.ndarray:
    """All phrases, in order, as numbers."""
    n, bits = shape(window)
    s = h & np.uint64((1 << bits) - 1)
    out = np.zeros(max(0, len(s) - n + 1), np.uint64)
    for k in range(n):
        out = out << np.uint64(bits) | s[k : k + len(out)]
    return out


def marks(p: np.ndarray, window: int) -> np.ndarray:
    """Distinct marks of a document's windows, from its phrases."""
    width = window - shape(window)[0] + 1
    if len(p) < width:
        return np.zeros(0, np.uint64)
    m = mix(p)
    least = _slide(m, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.unique(p[_slide(np.concatenate([pad, least, pad]), width, np.maximum) == m])


def automaton(keys: np.ndarray, window: int) -> ahocorasick.Automaton:
    """Of phrases given as numbers."""
    n, bits = shape(window)
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    symbols = np.stack([(keys >> np.uint64(bits * (n - 1 - k))) & np.uint64((1 << bits) - 1) for k in range(n)], axis=1).astype("<u4") + np.uint32(_BASE)
    text = symbols.tobytes().decode("utf-32-le")
    for i in range(0, len(text), n):
        a.add_word(text[i : i + n])
    a.make_automaton()
    return a


def candidates(h: np.ndarray, a: ahocorasick.Automaton, window: int) -> np.ndarray:
    """Starts of a document's windows whose mark the automaton finds."""
    n, bits = shape(window)
    text = ((h & np.uint64((1 << bits) - 1)).astype("<u4") + np.uint32(_BASE)).tobytes().decode("utf-32-le")
    ends = [e for e, _ in a.iter(text)]
    if not ends:
        return np.zeros(0, np.int64)
    m = mix(phrases(h, window))
    met = np.full(len(m), np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.array(ends) - n + 1
    met[at] = m[at]
    width = window - n + 1
    return np.flatnonzero(_slide(met, width, np.minimum) == _slide(m, width, np.minimum))


_MARKS = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("blocks", pa.binary())])


def _packed(k: np.ndarray, o: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Marks with their blocks, a row a shard."""
    order = np.argsort(shard, kind="stable")
    k, o, shard = k[order], o[order], shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int64()), pa.array([k[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()), pa.array([o[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], schema=_MARKS)


def _twice(k: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks by block, at most two of a kind: more tell no more."""
    order = np.lexsort((o, k))
    k, o = k[order], o[order]
    third = np.zeros(len(k), bool)
    third[2:] = (k[2:] == k[:-2]) & (o[2:] == o[:-2])
    return k[~third], o[~third]


def _marked(window: int, blocks: int, shards: int, parts: int):
    """Per portion and shard (numbered with its part), its marks with their blocks; a mark that a block has twice or more comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for b in portions(batches):
            keys, of = [], []
            for t, block in zip(b.column("text").to_pylist(), b.column("block").to_pylist()):
                w = words(t, False) if t else ()
                if len(w) < window:
                    continue
                h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
                p = phrases(h, window)
                m = marks(p, window)
                again = np.unique(p[np.isin(p, m)], return_counts=True)
                m = np.concatenate([m, again[0][again[1] > 1]])  # met twice in one document
                keys.append(m)
                of.append(np.full(len(m), block, np.uint32))
            if keys:
                k, o = _twice(np.concatenate(keys), np.concatenate(of))
                yield _packed(k, o, (mix(k, 1) % np.uint64(shards)).astype(np.int64) * parts + o % parts)

    return run


def _unpacked(groups: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All marks of a group with their blocks, combined as they come."""
    k, o = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    for b in groups:
        k = np.concatenate([k, *(np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist())])
        o = np.concatenate([o, *(np.frombuffer(x, np.uint32) for x in b.column("blocks").to_pylist())])
        k, o = _twice(k, o)
    return k, o


def _combined(parts: int):
    """A part of a shard, combined by mark and block; numbered as its shard."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(groups)
        shard = first.column("shard")[0].as_py() // parts
        k, o = _unpacked(chain([first], groups))
        yield _packed(k, o, np.full(len(k), shard, np.int64))

    return run


def _recurring(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's marks that occur twice, by block."""
    k, o = _unpacked(groups)
    same = k[1:] == k[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(k) else np.zeros(0, bool)
    k, o = k[twice], o[twice]
    order = np.lexsort((k, o))
    k, o = k[order], o[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, bool)
    k, o = k[first], o[first]
    cuts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(o[cuts[:-1]].astype(np.int32), pa.int32()), pa.array([k[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["block", "keys"])


_ODD = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def second(h: np.ndarray, width: int) -> np.ndarray:
    """32 more bits of all runs of ``width`` words, by differences of running sums."""
    n = len(h)
    if not _powers or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers.clear()
        _powers.extend(np.cumprod(np.full(size, x, np.uint64)) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    up, down = _powers
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, 5) * up[:n])])
    return (mix((total[width:] - total[:-width]) * down[: n - width + 1], 6) >> np.uint64(32)).astype(np.uint32).view(np.int32)


STREAMED = "doc_id long, row long, n_words long, kept string, starts array<int>, hashes array<long>, more array<int>, again array<int>, text string, n_removed long"
_STREAMED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("starts", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("more", pa.list_(pa.int32())), ("again", pa.list_(pa.int32())), ("text", pa.string()), ("n_removed", pa.int64())])


def _kept(w: list[bytes], starts: np.ndarray, window: int, digest: bool) -> tuple[int, str]:
    """Words removed, and the kept ones joined (or their SHA-256)."""
    if len(starts):
        step = np.zeros(len(w) + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        stay = np.cumsum(step)[: len(w)] == 0
        w = [x for x, s in zip(w, stay.tolist()) if s]
        gone = int((~stay).sum())
    else:
        gone = 0
    out = b" ".join(w)
    return gone, hashlib.sha256(out).hexdigest() if digest else out.decode()


def _streamed(window: int, digest: bool):
    """Documents through the automaton of their block, which comes before them. Documents without candidates are done; of the others come their
    distinct windows, the starts of those met earlier in the document itself, and the text."""

    def done(i, r, w, gone) -> tuple:
        return i, r, len(w), _kept([] if gone else w, np.zeros(0, np.int64), window, digest)[1], None, None, None, None, None, len(w) if gone else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, block, keys, copies, a = word_memo(), None, [], set(), None
        for b in portions(batches, 512, 4 << 20):
            rows = []
            for at, kind, i, r, t, k in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "doc_id", "row", "text", "keys"))):
                if at != block:
                    block, keys, copies, a = at, [], set(), None
                if kind == 0:
                    keys.append(np.frombuffer(k, np.uint64))
                    continue
                if kind == 1:
                    copies.add((i, r))
                    continue
                if keys:
                    a, keys = automaton(np.unique(np.concatenate(keys)), window), []
                w = words(t, False) if t else []
                starts = np.zeros(0, np.int64)
                if len(w) >= window and (i, r) in copies:  # an earlier document has the same text
                    rows.append(done(i, r, w, True))
                    continue
                if len(w) >= window and a is not None:
                    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
                    starts = candidates(h, a, window)
                if not len(starts):
                    rows.append(done(i, r, w, False))
                    continue
                hashed = grams(h, window)[starts]
                more = second(h, window)[starts]
                order = np.argsort(hashed, kind="stable")
                again = np.zeros(len(starts), bool)
                again[order[1:]] = (hashed[order[1:]] == hashed[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
                rows.append((i, r, len(w), None, starts[~again].astype(np.int32), hashed[~again].view(np.int64), more[~again], starts[again].astype(np.int32), t, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STREAMED)], schema=_STREAMED)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed long, and ``kept``: the kept words joined by one space, or with ``digest`` their SHA-256 (lowercase hex).

    Words are maximal runs of characters other than space and U+0009 to U+000D, unchanged. Every word goes that a window of
    ``window`` words covers whose words also start earlier: in a document of smaller id, or before in the same document; all windows
    are judged on the input. A null or empty text has no words; a shorter text than a window loses none. Rows that share an
    id are documents of their own, neither of them earlier; a null id is smaller than any other. Other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "passages")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("text"))
    n = docs.select("doc_id").count()
    if not n:
        return spark.createDataFrame([], "doc_id long, n_words long, n_removed long, kept string")
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int").alias("block")
    shards, parts = max(16, -(-n * 60 // SHARD)), -(-n // COMBINED)
    marked = docs.select("text", block).mapInArrow(_marked(window, blocks, shards, parts), "shard long, keys binary, blocks binary")
    if parts > 1:  # a mark of very many documents is combined by block in several tasks
        marked = marked.groupBy("shard").applyInArrow(_combined(parts), "shard long, keys binary, blocks binary")
    found = ws.write(marked.groupBy("shard").applyInArrow(_recurring, "block int, keys binary"), "marks", "none")
    # later documents with the text of an earlier one: all their windows repeat. A null id is smaller than any other
    texts = docs.where("text is not null").select("doc_id", "row", F.xxhash64(F.lit(1), "text").alias("other"))
    firsts = _firsts(texts, "row", "other")
    copies = ws.write(texts.join(firsts, ["row", "other"]).where("unnamed or doc_id > first").select(block, "doc_id", "row").where("doc_id is not null").distinct(), "copies")

    none = lambda t: F.lit(None).cast(t)
    given = found.select("block", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("long").alias("row"), none("string").alias("text"), "keys")
    given = given.unionAll(copies.select("block", F.lit(1), "doc_id", "row", none("string"), none("binary")))
    left = docs.select(block, F.lit(2), "doc_id", "row", "text", none("binary"))
    dealt = given.unionAll(left).repartition("block").sortWithinPartitions("block", "kind")
    streamed = ws.write(dealt.mapInArrow(_streamed(window, digest), STREAMED), "streamed")
    ws.drop("marks", "copies")

    seen = streamed.where("starts is not null").select("doc_id", "row", F.explode(F.arrays_zip("starts", "hashes", "more")).alias("w")).select("doc_id", "row", F.col("w.starts").alias("start"), F.col("w.hashes").alias("h"), F.col("w.more").alias("g"))
    gone = seen.join(_firsts(seen, "h", "g"), ["h", "g"]).where("doc_id is not null and (unnamed or doc_id > first)").groupBy("doc_id", "row").agg(F.collect_set("start").alias("gone"))
    gone = ws.write(gone, "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            out = []
            for t, again, more in zip(b.column("text").to_pylist(), b.column("again").to_pylist(), b.column("gone").to_pylist()):
                out.append(_kept(words(t, False), np.unique(np.array([*again, *(more or ())], np.int64)), window, digest))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array([g for g, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rest = streamed.where("starts is not null").select("doc_id", "row", "n_words", "text", "again")
    ends = rest.join(gone, ["doc_id", "row"], "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
    return streamed.where("starts is null").select("doc_id", "n_words", "n_removed", "kept").unionByName(ends)


def _firsts(of: DataFrame, *key: str) -> DataFrame:
    """Keys of several documents' values: the smallest id that has it, and whether a document without an id (which precedes all others) does."""
    k = of.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    return k.where("first < last or (unnamed and last is not null)").select(*key, "first", "unnamed")

"""Token-id files: canonical, length-limited Huffman codes of ids, decoded by table in independent blocks.

File format (version 1). A data set is a folder with

* ``code``: one row, ``lengths``: the code length of each id as one byte (0: the id does not occur). The code is
  canonical: codes of equal length are consecutive numbers in order of id, shorter codes come first.
* ``blocks``: Parquet rows (shard int, first long, doc_id array<long>, n_tokens array<long>, n_ids long, payload
  binary, checkpoints binary). Shards are in ascending order of doc_id and so are the rows of one. ``first`` is the
  number of the shard's ids before the block. ``payload`` holds the codes, most significant bit first, padded to
  bytes; ``checkpoints`` holds, as little-endian unsigned 32-bit integers, the bit offset of every ``EVERY``-th id.
  A block decodes without any other, and from any checkpoint.

Parquet rows carry the blocks so that writes are atomic and repeatable on any store Spark can write to.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, portions

#: Longest code (for up to 2^17 ids in use, more for more), ids between two checkpoints, and ids after which a block ends (with its document).
LONGEST, EVERY, BLOCK = 18, 512, 1 << 17
#: Bytes of a text beyond which it goes to the library whole.
LARGE = 1 << 28


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for ids that do not occur."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    longest = max(longest, len(used).bit_length() + 1)
    if longest > 25:
        raise ValueError("the decoder reads codes of at most 25 bits")
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order]
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([w, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(w))
        s = both[by]
        packages = s[0 : len(s) // 2 * 2 : 2] + s[1::2]
    take, depth = 2 * len(w) - 2, np.zeros(len(w) + 1, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    out[order] = np.cumsum(depth)[:-1]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, in its ``lengths[id]`` low bits."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    runs, at = np.unique(lengths[ids], return_counts=True)
    i = 0
    for n, k in zip(runs.tolist(), at.tolist()):
        code <<= n - last
        codes[ids[i : i + k]] = np.arange(code, code + k, dtype=np.uint64)
        code, last, i = code + k, n, i + k
    return codes


def high(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes in the high bits of 64."""
    return canonical(lengths) << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64))


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of every ``EVERY``-th one; ``codes`` stand in the high bits (``high``)."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1]
    bits = codes[ids] >> (starts & 31).view(np.uint64)
    word = starts >> 5
    heads = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    joined = np.bitwise_or.reduceat(bits, heads)
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    at = word[heads]
    words[at] = joined >> np.uint64(32)
    words[at + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], starts[::EVERY].astype("<u4")


def id_type(size: int) -> type:
    """The numbers that hold ids below ``size``."""
    return np.uint16 if size <= 1 << 16 else np.uint32


class Decoder:
    """A table from the next ``longest`` bits to an id and its code length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        codes = canonical(lengths)
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(codes[ids] << (np.uint64(64) - lengths[ids].astype(np.uint64)), kind="stable")]
        span = np.int64(1) << (self.bits - lengths[ids].astype(np.int64))
        self.kind = id_type(len(lengths))
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.table[: int(span.sum())] = np.repeat(ids.astype(np.uint32) << np.uint32(5) | lengths[ids].astype(np.uint32), span)

    def decode(self, blocks: list[tuple[int, bytes, np.ndarray]]) -> list[np.ndarray]:
        """Ids of (n_ids, payload, checkpoints) blocks; all stretches between checkpoints advance side by side."""
        parts, starts, sizes, base = [], [], [], 0
        for n, payload, marks in blocks:
            parts += [payload, b"\0" * 8]
            starts.append(marks.astype(np.int64) + 8 * base)
            sizes.append(np.minimum(EVERY, n - EVERY * np.arange(len(marks))))
            base += len(payload) + 8
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if not len(raw):
            return [np.zeros(0, self.kind) for _ in blocks]
        wide = raw[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            wide = wide << np.uint32(8) | raw[k : len(raw) - 3 + k]
        at, left = np.concatenate(starts), np.concatenate(sizes)
        order = np.argsort(-left, kind="stable")
        lane_at, lane_left = at[order], left[order]
        out = np.zeros((int(lane_left[0]) if len(order) else 0, len(order)), self.kind)
        drop, table = np.uint32(32 - self.bits), self.table
        for i in range(len(out)):
            if lane_left[len(lane_at) - 1] <= i:
                lane_at = lane_at[: np.searchsorted(-lane_left[: len(lane_at)], -i, "left")]
            got = table[(wide[lane_at >> 3] << (lane_at & 7).astype(np.uint32)) >> drop]
            out[i, : len(lane_at)] = got >> np.uint32(5)
            lane_at = lane_at + (got & np.uint32(31))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        columns = out.T
        result, lane = [], 0
        for n, _, marks in blocks:
            rows = columns[back[lane : lane + len(marks)]]
            result.append(rows.reshape(-1) if n % EVERY == 0 or not len(marks) else np.concatenate([rows[:-1].reshape(-1), rows[-1, : n % EVERY]]))
            if len(marks) and len(out) < EVERY:
                result[-1] = np.concatenate([rows[k, : min(EVERY, n - EVERY * k)] for k in range(len(marks))])
            lane += len(marks)
        return result


class FileTokenizer:
    """The tokenizers library over chunks that begin at a space, each distinct one once while it is held.

    A space before a non-white character always starts a pre-token, so ids of chunks, joined, are those of the text. Chunks
    are told apart by two 64-bit universal hashes, computed for a whole batch at once; about ``limit`` of them are held, and the
    half not met for longest goes when there are more. Texts with other white space beside a space go to the library whole, and so
    do texts that hold one of the file's added tokens (the library cuts them out first, across any border) and very long ones.
    """

    WEIGHTS = 1 << 16  # bytes of a chunk that have weights of their own; texts with longer ones go to the library whole

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"]
        self.added = [t["content"] for t in made.get("added_tokens") or () if t["content"]]
        self.size = max([*vocab.values(), *(t["id"] for t in made.get("added_tokens") or ())]) + 1
        self.kind = id_type(self.size)
        self.width = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # the vocabulary has one character for each byte
        self.letter = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
        rng = np.random.default_rng(11)
        self.w1, self.w2 = (rng.integers(0, 1 << 64, self.WEIGHTS, np.uint64) | np.uint64(1) for _ in range(2))
        self.limit, self.batch = limit, 0
        self._hold(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind))

    def _hold(self, keys, checks, starts, sizes, used, pool) -> None:
        """Entries in order of key: where a chunk's ids stand in the pool and how many they are (-1: not to be cut there)."""
        self.keys, self.checks, self.starts, self.sizes, self.used, self.pool = keys, checks, starts, sizes, used, pool

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, each after a space, and how many each has: encoded joined, and cut where the bytes of each chunk end."""
        ids, sizes = [], []
        for k in range(0, len(chunks), 8192):
            text = " " + " ".join(chunks[k : k + 8192])
            got = self._ids(text)
            coded = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            ends = np.append(np.flatnonzero(coded == 32)[1:], len(coded))  # no chunk has a space
            cut = np.searchsorted(np.cumsum(self.width[got]), ends) + 1
            ids.append(got)
            sizes.append(np.diff(cut, prepend=0))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, self.kind), np.zeros(0, np.int64))

    def _add(self, keys: np.ndarray, checks: np.ndarray, chunks: list[str], heads: np.ndarray) -> None:
        """Encode new chunks and hold them. ``heads`` begin a text and so have no space before them."""
        ok = np.array([len(c) < self.WEIGHTS // 4 and (h or (c != "" and not c[0].isspace())) for c, h in zip(chunks, heads.tolist())], bool)
        after = np.flatnonzero(ok & ~heads)
        first = np.flatnonzero(ok & heads)
        ids, n = self._learn([chunks[i] for i in after.tolist()])
        begin = [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast([chunks[i] for i in first.tolist()], add_special_tokens=False)]
        sizes = np.full(len(keys), -1, np.int32)
        sizes[after], sizes[first] = n, [len(x) for x in begin]
        pool = np.concatenate([ids, *begin]) if len(begin) or len(ids) else np.zeros(0, self.kind)
        starts = np.zeros(len(keys), np.int64)
        order = np.concatenate([after, first])
        starts[order] = len(self.pool) + np.concatenate([[0], np.cumsum(sizes[order])[:-1]]) if len(order) else 0
        self._merge(keys, checks, starts, sizes, np.concatenate([self.pool, pool]))

    def _merge(self, keys, checks, starts, sizes, pool) -> None:
        every = [np.concatenate(x) for x in ((self.keys, keys), (self.checks, checks), (self.starts, starts), (self.sizes, sizes), (self.used, np.full(len(keys), self.batch, np.int32)))]
        order = np.argsort(every[0], kind="stable")
        every = [x[order] for x in every]
        if len(order) > self.limit:
            keep = every[4] >= np.partition(every[4], len(order) // 2)[len(order) // 2]
            every = [x[keep] for x in every]
            size = np.maximum(every[3], 0).astype(np.int64)
            pool = pool[_spread(every[2], size)]
            every[2] = np.cumsum(size) - size
        self._hold(*every, pool)

    def _cut(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start, and which of them have no space before them.

        Besides spaces, two borders are sure: between an ASCII letter and a stop that a space or a line's end follows, and
        behind such a line's end if an ASCII letter comes next.
        """
        starts = np.concatenate([[0], np.flatnonzero(raw == 32)[:-1] + 1])
        at = np.flatnonzero((raw == 46) | (raw == 44))
        at = at[(at > 0) & (at + 2 < len(raw))]
        at = at[self.letter[raw[at - 1]]]
        line = (raw[at + 1] == 10) & self.letter[raw[at + 2]]
        at, line = at[line | (raw[at + 1] == 32)], at[line] + 2
        more = np.concatenate([at, line])
        where = np.concatenate([starts, more])
        order = np.argsort(where, kind="stable")
        return where[order], np.repeat([False, True], [len(starts), len(more)])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        apart = [i for i, t in enumerate(texts) if len(t) > LARGE // 4 or any(a in t for a in self.added)]
        if apart:
            given, texts = texts, list(texts)
            for i in apart:
                texts[i] = ""
        self.batch += 1
        coded = [t.encode("utf-8", "replace") for t in texts]
        buffer = b" ".join(coded) + b" "
        raw = np.frombuffer(buffer, np.uint8)
        starts, bare = self._cut(raw)
        ends = np.append(starts[1:], len(raw))
        ends -= raw[ends - 1] == 32
        text_at = np.cumsum([0] + [len(c) + 1 for c in coded[:-1]])
        first = np.searchsorted(starts, text_at)
        bare[first] = True
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
        place &= self.WEIGHTS - 1
        wide = (raw.astype(np.uint64) + np.uint64(1)) * (raw != 32)
        h1, h2 = np.add.reduceat(wide * self.w1[place], starts), np.add.reduceat(wide * self.w2[place], starts)
        h1[bare] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        keys, some, back = np.unique(h1, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = some[~known]
        if len(new):
            chunks = [buffer[i:j].decode() for i, j in zip(starts[new].tolist(), ends[new].tolist())]
            if known.any():
                self.used[at[known]] = self.batch
            self._add(keys[~known], h2[new], chunks, bare[new])
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.batch
        entry = at[back]
        size = self.sizes[entry].astype(np.int64)
        size[(self.checks[entry] != h2) | (ends - starts >= self.WEIGHTS)] = -1
        whole = np.minimum.reduceat(size, first) < 0
        n = np.add.reduceat(np.maximum(size, 0), first)
        ids = self.pool[_spread(self.starts[entry], np.maximum(size, 0))]
        if whole.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(whole).tolist():
                parts[i] = self._ids(texts[i])
                n[i] = len(parts[i])
            ids = np.concatenate(parts)
        if apart:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in apart:
                parts[i] = self._ids(given[i])
                n[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, n


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of every run, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_tokenizers: dict[str, FileTokenizer] = {}


def tokenizer(path: str) -> FileTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = FileTokenizer(path)
    return _tokenizers[path]


RAW = "shard int, first long, doc_id array<long>, n_tokens array<long>, ids binary, counts binary"
BLOCKS = "shard int, first long, doc_id array<long>, n_tokens array<long>, n_ids long, payload binary, checkpoints binary"


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        size = max(tok.size, end_id + 1)
        kind, shard, first, counts = id_type(size), TaskContext.get().partitionId(), 0, np.zeros(size, np.int64)
        for b in portions(batches, 1024):
            coded, n = tok.encode([t or "" for t in b.column("__text").to_pylist()])
            flat = np.insert(coded.astype(kind, copy=False), np.cumsum(n), kind(end_id))  # the end id after each document
            n = (n + 1).tolist()
            ids = b.column("doc_id").to_pylist()
            cuts, held = [0], 0
            for i, k in enumerate(n, 1):  # blocks small enough to stay in a core's cache
                held += k
                if held >= BLOCK or i == len(n):
                    cuts.append(i)
                    held = 0
            counts += np.bincount(flat, minlength=size)
            at = np.cumsum([0, *n])[cuts].tolist()
            parts = [flat[i:j].tobytes() for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int32()), pa.array([first + i for i in at[:-1]], pa.int64()), pa.array([ids[i:j] for i, j in zip(cuts, cuts[1:])], pa.list_(pa.int64())), pa.array([n[i:j] for i, j in zip(cuts, cuts[1:])], pa.list_(pa.int64())), pa.array(parts, pa.binary()), pa.nulls(len(parts), pa.binary())], names=["shard", "first", "doc_id", "n_tokens", "ids", "counts"])
            first += at[-1]
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["shard", "first", "doc_id", "n_tokens", "ids", "counts"])

    return run


def _histogram(raw: DataFrame) -> np.ndarray:
    """How often each id occurs: shards' counts, added up on the executors in two steps. Its size is the vocabulary's."""

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in portions(groups, 16):
            for c in b.column("counts").to_pylist():
                x = np.frombuffer(zlib.decompress(c), np.int64)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    once = raw.where("counts is not null").groupBy(F.floor(F.col("shard") / 64).alias("part")).applyInArrow(add, "part int, counts binary")
    got = once.groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    return np.frombuffer(zlib.decompress(got[0]["counts"]), np.int64) if got else np.zeros(0, np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, text: str = "text", shards: int | None = None) -> dict[str, int]:
    """Encode every whole text, append ``end_id`` to each document and write the files described above, in ascending order of doc_id.

    A text is encoded as the library does by default, so an added token that stands in it becomes its id.
    A null text counts as empty (only the end id); null ids come first; repeated
    ids stand side by side, in an order that depends on their texts alone; other columns are not read. An empty table makes files without rows.
    Rows are range-partitioned by doc_id, then by text and place, so neither a source, a group of copies, a repeated or a null id
    lands in one shard as a whole. To the driver come one histogram of ids and one length per shard. Returns {"ids": their number}.
    """
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "token-files")
    n = shards or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"), F.monotonically_increasing_id().alias("__place"))
    ranged = keyed.repartitionByRange(n, "doc_id", "__hash", "__place").sortWithinPartitions("doc_id", "__hash").select("doc_id", "__text")
    raw = ws.write(ranged.mapInArrow(_tokenize(tokenizer_file, end_id), RAW), "raw", "lz4")
    sizes = {r["shard"]: r["first"] for r in raw.where("counts is not null").select("shard", "first").collect()}
    lengths = code_lengths(_histogram(raw))
    codes, kept, kind = high(lengths), lengths.tobytes(), id_type(len(lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2):
            packed = [(len(i) // kind().itemsize, *pack(np.frombuffer(i, kind), lengths, codes)) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("shard", "first", "doc_id", "n_tokens")] + [pa.array([p[0] for p in packed], pa.int64()), pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2].tobytes() for p in packed], pa.binary())], names=["shard", "first", "doc_id", "n_tokens", "n_ids", "payload", "checkpoints"])

    raw.where("counts is null").drop("counts").mapInArrow(encode, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    base, at = [], 0
    for s in sorted(sizes):
        base.append((s, at))
        at += sizes[s]
    spark.createDataFrame([(kept, [s for s, _ in base], [a for _, a in base])], "lengths binary, shards array<int>, starts array<long>").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    ws.close()
    return {"ids": at}


def read_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """The blocks, the code lengths and the number of ids before each shard."""
    head = spark.read.parquet(f"{path}/code").first()
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), np.frombuffer(head["lengths"], np.uint8), dict(zip(head["shards"], head["starts"]))


def decode_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document's ids, from the files: doc_id, start long (ids of all documents before it), token_ids array<int>."""
    return _decoded(spark, path, "token_ids array<int>", lambda parts: [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], ["token_ids"])


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    return _decoded(spark, path, "n_tokens long, ids_crc32 long", lambda parts: [pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())], ["n_tokens", "ids_crc32"])


def _decoded(spark: SparkSession, path: str, schema: str, columns, names: list[str]) -> DataFrame:
    blocks, lengths, base = read_token_files(spark, path)
    kept = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(np.frombuffer(kept, np.uint8))
        for b in portions(batches, 2):
            shard, first = b.column("shard").to_pylist(), b.column("first").to_pylist()
            got = decoder.decode([(n, p, np.frombuffer(c, "<u4")) for n, p, c in zip(b.column("n_ids").to_pylist(), b.column("payload").to_pylist(), b.column("checkpoints").to_pylist())])
            docs, starts, parts = [], [], []
            for s, f, ids, d, n in zip(shard, first, got, b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist()):
                ends = np.cumsum(n)
                docs += d
                starts.append(base[s] + f + ends - np.array(n))
                parts += np.split(ids, ends[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.concatenate(starts) if starts else [], pa.int64()), *columns(parts)], names=["doc_id", "start", *names])

    return blocks.mapInArrow(run, f"doc_id long, start long, {schema}")

"""Token counts that follow edits.

A document keeps its pre-tokens in blocks, and a segment tree over the blocks
whose nodes hold the characters and tokens below them. An edit descends to the
block where it starts, cuts and encodes again from the last pre-token border
that the edit can't move (one that lies two characters before it) until a new
border falls on an old one, and updates the sums above the blocks it touched.
All other pre-tokens keep their counts.

Trees can be stored (``count_trees``) and later edits applied to the stored ones (``edit_trees``), so that texts are encoded as a whole only once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .workspace import portions

#: Pre-tokens in a block after a rebuild; a block that has grown to four times this is split by a rebuild of the tree.
BLOCK = 128

EDITS = "array<struct<start:int,end:int,new:string>>"


class CountTree:
    """Pre-tokens of one text with a segment tree of (characters, tokens) over blocks of them."""

    def __init__(self, text: str, pattern, count):
        self.pattern, self.count = pattern, count
        self.reencoded = 0
        pieces = pattern.findall(text)
        self._build([len(p) for p in pieces], [count(p) for p in pieces], text)

    def _build(self, lens: list[int], counts: list[int], text: str) -> None:
        ends = [0, *accumulate(lens)]
        self.blocks = []
        for i in range(0, len(lens), BLOCK) or (0,):
            j = min(i + BLOCK, len(lens))
            self.blocks.append([text[ends[i] : ends[j]], lens[i:j], counts[i:j]])
        self.leaves = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for k, (t, _, c) in enumerate(self.blocks, self.leaves):
            self.chars[k], self.tokens[k] = len(t), sum(c)
        for sums in (self.chars, self.tokens):
            for k in range(self.leaves - 1, 0, -1):
                sums[k] = sums[2 * k] + sums[2 * k + 1]

    def pack(self) -> bytes:
        """The tree as bytes: the number of pre-tokens, their lengths and counts, and the text."""
        lens, counts = ([x for b in self.blocks for x in b[k]] for k in (1, 2))
        return b"".join((len(lens).to_bytes(8, "little"), np.array([*lens, *counts], "<u4").tobytes(), self.text().encode("utf-8", "surrogatepass")))

    @classmethod
    def unpack(cls, raw: bytes, pattern, count) -> CountTree:
        """The tree that ``pack`` stored; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.pattern, tree.count, tree.reencoded = pattern, count, 0
        n = int.from_bytes(raw[:8], "little")
        lens, counts = np.frombuffer(raw, "<u4", 2 * n, 8).reshape(2, n).tolist()
        tree._build(lens, counts, raw[8 + 8 * n :].decode("utf-8", "surrogatepass"))
        return tree

    def apply(self, edits) -> None:
        """A list of (start, end, new), each applied to the result of those before it; null ones mean nothing, a null ``new`` deletes."""
        for e in edits or ():
            if e is not None:
                at = e["start"] or 0
                self.edit(at, at if e["end"] is None else e["end"], e["new"] or "")

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(len(b[1]) for b in self.blocks)

    def text(self) -> str:
        return "".join(b[0] for b in self.blocks)

    def _set(self, k: int) -> None:
        t, _, c = self.blocks[k]
        k += self.leaves
        chars, tokens = len(t) - self.chars[k], sum(c) - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k >>= 1

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one at the end), and the characters before that block."""
        k, before = 1, 0
        while k < self.leaves:
            k *= 2
            if at - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        k -= self.leaves
        if k >= len(self.blocks) or (at >= self.n_chars and self.n_chars):
            k = len(self.blocks) - 1
            before = self.n_chars - len(self.blocks[k][0])
        return k, before

    def tokens_before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``."""
        k, before = self.find(at)
        total, node = 0, k + self.leaves
        while node > 1:
            if node & 1:
                total += self.tokens[node - 1]
            node >>= 1
        for n, c in zip(self.blocks[k][1], self.blocks[k][2]):
            if before + n > at:
                break
            before, total = before + n, total + c
        return total

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end), clipped to the text, by ``new``; returns the pre-tokens encoded again."""
        n = self.n_chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        k, before = self.find(max(0, start - 2))
        lens = self.blocks[k][1]
        keep = 0
        for w in lens:  # pre-tokens that end two characters before the edit stay
            if before + w + 2 > start:
                break
            before, keep = before + w, keep + 1
        first = sum(lens[:keep])
        last, upto = self.find(max(end - 1, start, 0)) if n else (0, 0)
        last = max(last, k)
        shift = len(new) - (end - start)
        while True:
            old = "".join(self.blocks[b][0] for b in range(k, last + 1))[first:]
            olds = [w for b in range(k, last + 1) for w in self.blocks[b][1]][keep:]
            whole = last == len(self.blocks) - 1
            text = old[: start - before] + new + old[end - before :]
            borders = {x: i for i, x in enumerate(accumulate(olds), 1)}
            borders[0] = 0
            pieces, at, resume = [], 0, None
            for m in self.pattern.finditer(text):
                at = m.end()
                if not whole and at + 2 > len(text):  # the next block may move this border
                    break
                pieces.append(m.group())
                i = borders.get(at - shift) if at >= start - before + len(new) else None
                if i is not None and at - shift >= end - before:
                    resume = i
                    break
            if resume is not None or whole:
                break
            last += 1
        if resume is None:
            resume = len(olds)
        done = len(pieces)
        counts = [c for b in range(k, last + 1) for c in self.blocks[b][2]]
        lens = [w for b in range(k, last + 1) for w in self.blocks[b][1]]
        head = self.blocks[k][0][:first]
        lens = lens[:keep] + [len(p) for p in pieces] + lens[keep + resume :]
        counts = counts[:keep] + [self.count(p) for p in pieces] + counts[keep + resume :]
        self.reencoded += done
        self.blocks[k] = [head + text, lens, counts]
        for b in range(k + 1, last + 1):
            self.blocks[b] = ["", [], []]
        if len(lens) > 4 * BLOCK:
            self._build([w for b in self.blocks for w in b[1]], [c for b in self.blocks for c in b[2]], self.text())
        else:
            for b in range(k, last + 1):
                self._set(b)
        return done


class CountMemo(dict):
    """Pre-token -> its number of tokens; emptied when ``limit`` entries are held."""

    def __init__(self, encode, limit: int = 500_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


_memos: dict[tuple[str, str], CountMemo] = {}


def counter(rank_file: str, pattern: str):
    """The worker's pre-token pattern and count function for a rank file."""
    bpe, pieces, _ = codec(rank_file, pattern)
    memo = _memos.setdefault((rank_file, pattern), CountMemo(bpe.encode_piece))
    return pieces.pattern, memo.__getitem__


def edit_token_counts(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", edits: str = "edits", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token counts of whole texts before and after a list of edits, without encoding the edited texts again.

    ``edits`` holds an array of (start, end, new) in code points, applied one after
    another, each to the result of those before it; positions outside the text
    are clipped to it, a null array or edit means none, a null ``new`` deletes.
    A null text counts as empty. Returns ``keep`` columns, n_tokens, n_pieces,
    n_tokens_edited and n_reencoded (pre-tokens encoded again), all long, one row per input row. A kept column named as a new one is replaced.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "n_pieces", "n_tokens_edited", "n_reencoded"))
    fields = [(c, docs.schema[c].dataType.simpleString()) for c in keep] + [(c, "long") for c in ("n_tokens", "n_pieces", "n_tokens_edited", "n_reencoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_by, count = counter(rank_file, pattern)
        for b in portions(batches):
            out = []
            for t, todo in zip(b.column("__text"), b.column("__edits")):
                tree = CountTree(t.as_py() or "", split_by, count)
                row = [tree.n_tokens, tree.n_pieces]
                tree.apply(todo.as_py())
                out.append((*row, tree.n_tokens, tree.reencoded))
            cols = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in cols], names=[n for n, _ in fields])

    return docs.select(*keep, F.col(text).alias("__text"), F.col(edits).cast(EDITS).alias("__edits")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def _keep(docs: DataFrame, keep: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(c, docs.schema[c].dataType.simpleString()) for c in keep]


def count_trees(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens long and tree binary: each whole text's tree, to be written and edited later. A null text counts as empty; one row per input row."""
    fields = [*_keep(docs, keep), ("n_tokens", "long"), ("tree", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_by, count = counter(rank_file, pattern)
        for b in portions(batches):
            trees = [CountTree(t or "", split_by, count) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([t.pack() for t in trees], pa.binary())], names=[n for n, _ in fields])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def edit_trees(trees: DataFrame, rank_file: str, pattern: str, edits: str = "edits", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stored trees (``tree`` of ``count_trees`` or of this function) after ``edits``: ``keep`` columns, n_tokens, n_reencoded long and the new tree.

    Only pre-tokens that edits touch are encoded. A null tree counts as that of an empty text; one row per input row.
    """
    fields = [*_keep(trees, keep), ("n_tokens", "long"), ("n_reencoded", "long"), ("tree", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_by, count = counter(rank_file, pattern)
        for b in portions(batches):
            done = []
            for raw, todo in zip(b.column("__tree").to_pylist(), b.column("__edits").to_pylist()):
                tree = CountTree.unpack(raw, split_by, count) if raw else CountTree("", split_by, count)
                tree.apply(todo)
                done.append(tree)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([t.n_tokens for t in done], pa.int64()), pa.array([t.reencoded for t in done], pa.int64()), pa.array([t.pack() for t in done], pa.binary())], names=[n for n, _ in fields])

    return trees.select(*keep, F.col("tree").alias("__tree"), F.col(edits).cast(EDITS).alias("__edits")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))

"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a pre-token has exactly one valid encoding, hence one
valid last token. ``PrefixState`` stores that token for each prefix: the
longest vocabulary entry ending there whose predecessor (the last token of the
prefix before it) may stand beside it. Two tokens may stand side by side if no
merge of lower rank crosses their border. Appends extend the table; an edit
recomputes from its start until as many entries as the longest token has bytes
agree with the old table.

Results equal those of the tiktoken library for the same ranks and pattern.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces
from .workspace import portions


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBpe:
    """The vocabulary, how each token splits into the two it was merged from, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.longest = max(map(len, ranks))
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.vocab))]
        self.merged: dict[tuple[int, int], int] = {}
        self.beside: dict[int, bool] = {}
        for i, token in enumerate(self.vocab):
            if len(token) < 2:
                continue
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < i and b < i and self._allowed(a, b):
                    self.merged[a, b] = i
                    self.halves[i] = (a, b)
                    break
            else:
                raise ValueError(f"token {i} cannot be merged from earlier ones")
        self.beside.clear()
        self.width = [len(t) for t in self.vocab]
        self.prefixes = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self.names: list[bytes] = [b""]
        self.number = {b"": 0}
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        self.step: dict[int, int] = {}

    def next_state(self, state: int, byte: int) -> int:
        """The automaton of the vocabulary: a state is the longest suffix read so far that begins some token. Built as it is met."""
        s = self.names[state] + bytes((byte,))
        while s not in self.prefixes:
            s = s[1:]
        to = self.number.get(s)
        if to is None:
            to = self.number[s] = len(self.names)
            self.names.append(s)
            self.ending.append(tuple((len(s) - k, self.ranks[s[k:]]) for k in range(len(s)) if s[k:] in self.ranks))
        self.step[state << 8 | byte] = to
        return to

    def _allowed(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side: undo their merges, latest first, and look for an earlier one across the border."""
        merged, halves, limit = self.merged, self.halves, 1 << 60
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def allowed(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            got = self.beside[key] = self._allowed(left, right)
        return got

    def state(self, piece: bytes = b"") -> PrefixState:
        return PrefixState(self, piece)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else self.state(raw).ids()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class PrefixState:
    """One pre-token with the last token of each of its byte prefixes."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.raw, self.last = bpe, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self._extend(more, len(self.raw))
        self.raw += more

    def _extend(self, more: bytes, at: int, old: tuple[list[int], int, int] | None = None) -> int:
        """Entries for the prefixes that end within ``more``, which starts at ``at``; returns how many were computed.

        With ``old`` (the table before an edit, the edit's end in it, the shift), entries from the first stretch that agrees are taken over.
        """
        bpe, last = self.bpe, self.last
        step, ending, beside = bpe.step.get, bpe.ending, bpe.beside.get
        state = 0
        for byte in self.raw[max(0, at - bpe.longest) : at]:
            got = step(state << 8 | byte)
            state = bpe.next_state(state, byte) if got is None else got
        i = same = 0
        for i, byte in enumerate(more, at + 1):
            got = step(state << 8 | byte)
            state = bpe.next_state(state, byte) if got is None else got
            for width, t in ending[state]:
                left = last[i - width]
                if left < 0 or ((ok := beside(left << 32 | t)) is None and bpe.allowed(left, t)) or ok:
                    last.append(t)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            if old is not None:
                before = i - old[2]
                same = same + 1 if before > old[1] and old[0][before] == last[i] else 0
                if same > bpe.longest:
                    last.extend(old[0][before + 1 :])
                    break
        return i - at if more else 0

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace raw[start:end] by ``new``; returns the number of prefixes recomputed."""
        old, tail = self.last, self.raw[end:]
        self.raw, self.last = self.raw[:start], old[: start + 1]
        done = self._extend(new + tail, start, (old, end, len(new) - (end - start)))
        self.raw += new + tail
        return done

    def ids(self) -> tuple[int, ...]:
        out, i, width = [], len(self.raw), self.bpe.width
        while i:
            t = self.last[i]
            out.append(t)
            i -= width[t]
        return tuple(reversed(out))


_loaded: dict[tuple[str, str], tuple[PrefixBpe, Pieces, list[str]]] = {}


def codec(rank_file: str, pattern: str) -> tuple[PrefixBpe, Pieces, list[str]]:
    """The worker's own codec for a rank file: built once, kept while the worker lives."""
    key = (rank_file, pattern)
    if key not in _loaded:
        bpe = PrefixBpe(load_ranks(rank_file))
        _loaded[key] = (bpe, Pieces(bpe.encode_piece, pattern), [str(i) for i in range(len(bpe.vocab))])
    return _loaded[key]


def verified(texts: list[str | None], decoded: list[bytes]) -> None:
    """Fails where ids decode to other bytes than their text's."""
    for t, d in zip(texts, decoded, strict=True):
        if d != (t or "").encode():
            raise ValueError(f"ids decode to other bytes than their text of {len(t or '')} characters")


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, decoded: bool = True, verify: bool = False) -> DataFrame:
    """Token ids of every whole ``text``, and the bytes they decode to.

    Returns ``keep`` columns, n_tokens long, token_ids array<int> and
    decoded binary (each of the two if asked for), one row per input row. A null text counts as empty,
    an empty text has no tokens, repeated rows give repeated results, other columns are not read.
    With ``verify``, all ids are decoded and compared with the text, and the job fails where they differ.
    ``rank_file`` must be readable under that path on every executor. A kept column named as a new one is replaced.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", *["token_ids"] * ids, *["decoded"] * decoded))
    fields = [(c, docs.schema[c].dataType.simpleString()) for c in keep] + [("n_tokens", "long")] + [("token_ids", "array<int>")] * ids + [("decoded", "binary")] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces, _ = codec(rank_file, pattern)
        for b in portions(batches):
            texts = b.column("__text").to_pylist()
            coded = [pieces.encode(t or "") for t in texts]
            cols = [b.column(c) for c in keep] + [pa.array(map(len, coded), pa.int64())]
            back = [bpe.decode(x) for x in coded] if decoded or verify else []
            if verify:
                verified(texts, back)
            if ids:
                cols.append(pa.array(coded, pa.list_(pa.int32())))
            if decoded:
                cols.append(pa.array(back, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in fields])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests (lowercase hex) in place of ids and bytes, made where the ids are, so neither leaves the worker.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded bytes.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256"))
    fields = [(c, docs.schema[c].dataType.simpleString()) for c in keep] + [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces, names = codec(rank_file, pattern)
        sha = hashlib.sha256
        for b in portions(batches):
            n, of_ids, of_text = [], [], []
            for t in b.column("__text"):
                ids = pieces.encode(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[x for x, _ in fields])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))

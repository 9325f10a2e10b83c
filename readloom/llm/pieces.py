"""Pre-tokens of byte-level BPE, and bounded memos of what their encoders return.

A space that a non-white character follows always starts a pre-token, whatever
stands before it. So a text can be cut there, each chunk be encoded alone, and
equal chunks be encoded once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import regex


class Unsafe(Exception):
    """The text has white space beside a single space; cut it with the full pattern instead."""


class ChunkMemo(dict):
    """Chunk after a space -> what ``encode(" " + chunk)`` returned. Emptied when ``limit`` entries are held."""

    def __init__(self, encode: Callable[[str], object], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str):
        if not chunk or chunk[0].isspace():
            raise Unsafe
        got = self.encode(" " + chunk)
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = got
        return got


class Pieces:
    """Encodes whole texts through memos of chunks and pre-tokens.

    ``encode_piece`` maps one pre-token to a tuple of ids; chunk and piece
    memos hold at most ``limit`` entries each, so a worker's memory is bounded.
    """

    def __init__(self, encode_piece: Callable[[str], tuple], pattern: str, limit: int = 250_000):
        self.pattern = regex.compile(pattern)
        self.encode_piece, self.limit = encode_piece, limit
        self.piece_memo: dict[str, tuple] = {}
        self.chunks = ChunkMemo(self.by_pieces, limit)

    def piece(self, p: str) -> tuple:
        got = self.piece_memo.get(p)
        if got is None:
            got = self.encode_piece(p)
            if len(self.piece_memo) >= self.limit:
                self.piece_memo.clear()
            self.piece_memo[p] = got
        return got

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def by_pieces(self, text: str) -> tuple:
        return tuple(chain.from_iterable(map(self.piece, self.pattern.findall(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        first, *rest = text.split(" ")
        try:
            return [*self.by_pieces(first), *chain.from_iterable(map(self.chunks.__getitem__, rest))]
        except Unsafe:
            return list(self.by_pieces(text))

"""Personal data replaced by format-preserving pseudonyms.

Validated numbers, dates and addresses are mapped by a keyed permutation of all
valid values of their format: a Feistel network over the values' ranks, walked
until it lands on a valid rank. So a pseudonym is valid where the value was
(check digits included), keeps the value's length and punctuation, differs
between keys, and equal values get equal pseudonyms in every document, however they are punctuated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import date
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .workspace import portions

ROUNDS = 10
KINDS = ("email", "phone", "card", "ip", "iban", "ssn", "date")


class Permutation:
    """A keyed permutation of range(size): an alternating Feistel network over two digits of base ``b`` (b * b >= size), walked until the result is below ``size``."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        b = 1
        while b * b < size:
            b <<= 1
        low = b >> 1
        while low + 1 < b:  # the least base, so that walks stay short
            mid = (low + b) // 2
            low, b = (low, mid) if mid * mid >= size else (mid, b)
        self.base = b
        self.width = (b.bit_length() + 7) // 8 + 1
        self.seed = hashlib.blake2b(f"{tweak}/{size}".encode(), key=hashlib.sha256(key).digest(), digest_size=32)

    def _round(self, i: int, half: int) -> int:
        h = self.seed.copy()
        h.update(bytes((i,)) + half.to_bytes(self.width, "big"))
        return int.from_bytes(h.digest(), "big") % self.base

    def __call__(self, x: int) -> int:
        return self._walk(x, range(ROUNDS), 1)

    def inverse(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1), -1)

    def _walk(self, x: int, rounds: range, sign: int) -> int:
        b = self.base
        while True:
            left, right = divmod(x, b)
            for i in rounds:
                if i % 2:
                    right = (right + sign * self._round(i, left)) % b
                else:
                    left = (left + sign * self._round(i, right)) % b
            x = left * b + right
            if x < self.size:
                return x


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + it valid."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else sum(divmod(2 * d, 10))
    return -total % 10


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def refill(template: str, chars: str) -> str:
    """``template`` with its letters and digits replaced, one by one, by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in template)


#: Digits before the hyphens that no social security number has; assigned area codes and exchanges start at 200.
_SSN_AREAS = [a for a in range(1, 900) if a != 666]
#: Years that dates of our time have; all others are permuted among themselves.
_NEAR = range(1900, 2100)
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Characters of an address before the @, and how many of them are permuted together.
_LOCAL, _TOGETHER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), 64

#: Date formats: pattern, positions of year, month and day.
_DATES = (
    (re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})"), (1, 3, 4)),
    (re.compile(r"(\d{2})([./-])(\d{2})\2(\d{4})"), (4, 3, 1)),
)


@cache
def _days(near: bool, late: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Months (year, month) of a period, and before each the number of its days up to the twelfth, or (``late``) after it."""
    months = [(y, m) for y in (_NEAR if near else [*range(1, _NEAR.start), *range(_NEAR.stop, 10_000)]) for m in range(1, 13)]
    length = lambda y, m: (date(y + m // 12, m % 12 + 1, 1) - date(y, m, 1)).days if (y, m) != (9999, 12) else 31
    return months, [0, *accumulate((length(y, m) - 12 if late else 12) for y, m in months)]


class Pseudonyms:
    """Finds the kinds above in a text and maps each value under one key."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.made = key, {}

    def permute(self, tweak: str, size: int, x: int) -> int:
        p = self.made.get((tweak, size))
        if p is None:
            if len(self.made) > 10_000:
                self.made.clear()
            p = self.made[tweak, size] = Permutation(self.key, tweak, size)
        return p(x)

    def characters(self, tweak: str, s: str) -> str:
        """Each ASCII letter and digit stays in its class; all of them are permuted together. Other characters stay."""
        rank, size, places = 0, 1, []
        for c in s:
            of = next((k for k in _CLASSES if c in k), None)
            places.append(of)
            if of:
                rank, size = rank * len(of) + of.index(c), size * len(of)
        if size == 1:
            return s
        x, out = self.permute(f"{tweak}/{[p and p[0] for p in places]}", size, rank), []
        for c, of in zip(reversed(s), reversed(places)):
            if of:
                x, k = divmod(x, len(of))
                c = of[k]
            out.append(c)
        return "".join(reversed(out))

    def email(self, s: str) -> str:
        """The local part, the host's name and nothing of its last part; a local part beyond 64 characters piece by piece."""
        local, _, host = s.rpartition("@")
        name, _, top = host.rpartition(".")
        pieces = [self.characters("local" if not i else f"local{i}", local[i : i + _TOGETHER]) for i in range(0, len(local), _TOGETHER)]
        return f"{''.join(pieces)}@{self.characters('host', name)}.{top}"

    def phone(self, s: str) -> str | None:
        """North American numbers: those with area code and exchange from 200 on, and all others of the format, each permuted among themselves."""
        d = "".join(c for c in s if c.isdigit())
        lead, d = d[:-10], d[-10:]
        area, exchange, line = int(d[:3]) - 200, int(d[3:6]) - 200, int(d[6:])
        if lead not in ("", "1"):
            return None
        if area < 0 or exchange < 0:
            # ranks: areas below 200 with any exchange, then the others with exchanges below 200
            x = int(d[:6]) if area < 0 else 200_000 + area * 200 + exchange + 200
            x, line = divmod(self.permute("phone below 200", 360_000 * 10_000, x * 10_000 + line), 10_000)
            front = x if x < 200_000 else (x - 200_000) // 200 * 1000 + 200_000 + (x - 200_000) % 200
            return refill(s, f"{lead}{front:06d}{line:04d}")
        x, line = divmod(self.permute("phone", 800 * 800 * 10_000, (area * 800 + exchange) * 10_000 + line), 10_000)
        return refill(s, f"{lead}{x // 800 + 200}{x % 800 + 200}{line:04d}")

    def abroad(self, s: str) -> str | None:
        """International numbers of other countries, with a plus: the first two digits stay, the others are permuted together."""
        d = "".join(c for c in s if c.isdigit())
        if not 8 <= len(d) <= 15:
            return None
        return refill(s, d[:2] + str(self.permute(f"phone +{d[:2]}", 10 ** (len(d) - 2), int(d[2:]))).zfill(len(d) - 2))

    def card(self, s: str) -> str | None:
        """Payment cards with a valid check digit; the first digit (the network) and the length stay."""
        d = "".join(c for c in s if c.isdigit())
        if not 13 <= len(d) <= 19 or d[0] == "0" or luhn(d[:-1]) != int(d[-1]):
            return None
        n = len(d) - 2
        body = d[0] + str(self.permute(f"card{d[0]}", 10**n, int(d[1:-1]))).zfill(n)
        return refill(s, body + str(luhn(body)))

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        return ".".join(map(str, self.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big")).to_bytes(4, "big")))

    def iban(self, s: str) -> str | None:
        d = "".join(c for c in s if c.isalnum())
        if not 15 <= len(d) <= 34 or iban_check(d[:2], d[4:]) != int(d[2:4]):
            return None
        rest = self.characters(f"iban{d[:2]}", d[4:])
        return refill(s, f"{d[:2]}{iban_check(d[:2], rest):02d}{rest}")

    def ssn(self, s: str) -> str | None:
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x, serial = divmod(self.permute("ssn", len(_SSN_AREAS) * 99 * 9999, (_SSN_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1), 9999)
        return f"{_SSN_AREAS[x // 99]:03d}-{x % 99 + 1:02d}-{serial + 1:04d}"

    def day(self, year: int, month: int, day: int) -> tuple[int, int, int]:
        """Days up to the twelfth and those after it are permuted each among themselves, so a date reads in the same order of
        its parts as before, and is the same one in every format; so are years of our time and others."""
        near, late = year in _NEAR, day > 12
        months, before = _days(near, late)
        index = (year - (_NEAR.start if near else 1 if year < _NEAR.start else 1 + len(_NEAR))) * 12 + month - 1
        x = self.permute(f"date {near} {late}", before[-1], before[index] + day - (13 if late else 1))
        at = bisect_right(before, x) - 1
        return *months[at], x - before[at] + (13 if late else 1)

    def date(self, s: str) -> str | None:
        """Year first or day first; a day-first date whose second number is no month is read month first."""
        for x, (y, m, d) in _DATES:
            if got := x.fullmatch(s):
                year, month, day = (int(got[i]) for i in (y, m, d))
                if y == 4 and month > 12:
                    m, d, month, day = d, m, day, month
                try:
                    date(year, month, day)
                except ValueError:
                    return None
                year, month, day = self.day(year, month, day)
                values = {y: f"{year:04d}", m: f"{month:02d}", d: f"{day:02d}"}
                return got[2].join(values[i] for i in sorted(values))
        return None

    _right = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
    _bank = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
    _run = re.compile(r"\d[\d ().\-/]{5,}\d")
    _number = re.compile(
        r"(?<![\w.@-])(?:(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?!\w|\.\d)|(?P<date>\d{4}(?P<a>[-/.])\d{2}(?P=a)\d{2}|\d{2}(?P<b>[./-])\d{2}(?P=b)\d{4})(?![\w-]|[./]\d)|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
        r"|(?P<abroad>\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,12}\)?){1,6}(?<=\d))(?![\w-])"
        r"|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])|(?P<card>\d{4}(?:(?P<c>[ -])\d{4}(?:(?P=c)\d{4}){2}|[ -]\d{6}[ -]\d{5})|\d{13,19})(?![\w-]))",
        re.ASCII,
    )

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), in order, without overlaps."""
        found: list[tuple[int, int, str, str]] = []
        at, before = text.find("@"), 0
        while at >= 0:
            if right := self._right.match(text, at):
                start = at
                while start > before and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    found.append((start, right.end(), "email", self.email(text[start : right.end()])))
            before, at = at + 1, text.find("@", at + 1)
        m = self._bank.search(text)
        while m:
            # what follows may look like its next group: shorter ends are tried, but none within a group
            ends = [m.end(), *(i for i in range(m.end() - 1, m.start() + 14, -1) if text[i] == " ")]
            on = m.start() + 1
            for end in ends:
                if (to := self.iban(text[m.start() : end])) is not None:
                    found.append((m.start(), end, "iban", to))
                    on = end
                    break
            m = self._bank.search(text, on)
        done = 0
        for run in self._run.finditer(text):
            if done > run.start():
                continue
            # a match lies within its run, but for a sign or bracket before it; what may not follow has two characters
            for m in self._number.finditer(text, max(done, run.start() - 3), run.end() + 2):
                if m.start() >= run.end():
                    break
                done = m.end()
                kind = next(k for k in ("ip", "date", "ssn", "abroad", "phone", "card") if m[k])
                if (to := getattr(self, kind)(m.group())) is not None:
                    found.append((m.start(), m.end(), "phone" if kind == "abroad" else kind, to))
        found.sort()
        out, end = [], 0
        for f in found:
            if f[0] >= end:
                out.append(f)
                end = f[1]
        return out

    def replace(self, text: str) -> tuple[str, list[str]]:
        parts, at, kinds = [], 0, []
        for start, end, kind, to in self.find(text):
            parts += [text[at:start], to]
            at = end
            kinds.append(kind)
        return ("".join([*parts, text[at:]]), kinds) if kinds else (text, kinds)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with personal data in ``text`` replaced, and a count per kind: n_email, n_phone, n_card, n_ip, n_iban, n_ssn, n_date (long; columns of those names are replaced).

    Numbers that fail their check (card, bank account) or are no valid value of their format stay as they are. Time is linear in a text's length. A
    null or empty text stays as it is, with counts of 0; repeated rows give repeated results. Rows are handled where they stand, without a shuffle.
    """
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*[c for c in counts if c != text])
    schema = StructType([*(StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields), *(StructField(c, LongType()) for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for b in portions(batches):
            i = b.schema.get_field_index(text)
            done = [(None, []) if t is None else p.replace(t) for t in b.column(i).to_pylist()]
            cols = list(b.columns)
            cols[i] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([ks.count(k) for _, ks in done], pa.int64()) for k in KINDS)], names=[*b.schema.names, *counts])

    return docs.mapInArrow(run, schema)


def with_personal_data(done: DataFrame) -> DataFrame:
    """The rows of ``pseudonymise`` in which something was replaced."""
    return done.where(sum(F.col(f"n_{k}") for k in KINDS) > 0)

"""Operator 4 against planted values whose validity, linkage and surroundings are checked by other code than its own."""

import random
import re
import time
from datetime import date, timedelta

import pytest

from readloom.llm import pii

FILL = "the quick 12 brown-fox 3.5 jumps (over) 1,234 lazy v1.2 dogs # x=7; 99% ok".split()


def luhn_valid(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0


def iban_valid(s):
    s = re.sub(" ", "", s)
    return int("".join(str(ord(c) - 55) if c.isalpha() else c for c in s[4:] + s[:4])) % 97 == 1


def card(rng):
    body = str(rng.randint(3, 6)) + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if luhn_valid(body + c))


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    return next(f"DE{c:02d}{body}" for c in range(2, 99) if iban_valid(f"DE{c:02d}{body}"))


def made(rng):
    """(kind, canonical value, as written)"""
    kind = rng.choice(["card", "iban", "ssn", "phone", "abroad", "ip", "date", "email"])
    if kind == "card":
        v = card(rng)
        return kind, v, rng.choice([v, " ".join(re.findall("....", v)), "-".join(re.findall("....", v))])
    if kind == "iban":
        v = iban(rng)
        return kind, v, rng.choice([v, " ".join(re.findall(".{1,4}", v))])
    if kind == "ssn":
        v = f"{rng.choice([1, 99, 345, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        return kind, v, v
    if kind == "phone":
        a, e, n = f"{rng.randint(0, 999):03d}", f"{rng.randint(0, 999):03d}", f"{rng.randint(0, 9999):04d}"
        return kind, a + e + n, rng.choice([f"({a}) {e}-{n}", f"{a}-{e}-{n}", f"+1 ({a}) {e}-{n}", f"{a}.{e}.{n}"])
    if kind == "abroad":
        d = rng.choice(["44", "49", "33"]) + "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 10)))
        return kind, d, rng.choice([f"+{d}", f"+{d[:2]} {d[2:5]} {d[5:]}", f"+{d[:2]} ({d[2:5]}) {d[5:]}"])
    if kind == "ip":
        v = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return kind, v, v
    if kind == "email":
        v = "".join(rng.choice("abcxyz.019") for _ in range(rng.choice([1, 8, 64, 65, 200]))).strip(".").replace("..", "_") or "q"
        return kind, (v := f"{v}@host{rng.randint(0, 99)}.example.com"), v
    day = date(rng.choice([1, 1850, 1900, 1999, 2024, 2099, 2100, 9990]), 1, 1) + timedelta(rng.randint(0, 364))
    forms = [f"{day:%Y}".zfill(4) + f"{x}{day:%m}{x}{day:%d}" for x in "-/."] + [f"{day:%d}{x}{day:%m}{x}" + f"{day:%Y}".zfill(4) for x in "/."]
    if day.day > 12:
        forms.append(f"{day:%m/%d/}" + f"{day:%Y}".zfill(4))
    return kind, day.toordinal(), rng.choice(forms)


def canonical(kind, s):
    if kind == "date":
        a, b, c = map(int, re.split("[-/.]", s))
        if len(re.split("[-/.]", s)[0]) == 4:
            return date(a, b, c).toordinal()
        return (date(c, b, a) if b <= 12 else date(c, a, b)).toordinal()
    if kind in ("card", "abroad", "iban"):
        return re.sub("[^0-9A-Z]", "", s)
    if kind == "phone":
        return re.sub("[^0-9]", "", s)[-10:]
    return s


def valid(kind, s):
    c = canonical(kind, s)
    if kind == "card":
        return luhn_valid(c)
    if kind == "iban":
        return iban_valid(c)
    if kind == "ssn":
        a, b, d = map(int, s.split("-"))
        return a not in (0, 666) and a < 900 and b and d
    return kind != "ip" or all(0 <= int(x) <= 255 and x == str(int(x)) for x in s.split("."))


def test_planted_values_are_linked_valid_and_alone_changed(spark):
    rng = random.Random(11)
    pool = [made(rng) for _ in range(400)]
    pool += [(k, v, w) for k, v, _ in pool if k == "date" for w in [f"{date.fromordinal(v).year:04d}-{date.fromordinal(v):%m-%d}", f"{date.fromordinal(v):%d.%m.}{date.fromordinal(v).year:04d}"]]
    docs = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts += [(None, None, w) for w in rng.choices(FILL, k=rng.randint(1, 5))] + [rng.choice(pool)]
            parts.append((None, None, "and"))
        docs.append(parts)
    df = spark.createDataFrame([(i, "  ".join(w for *_, w in parts)) for i, parts in enumerate(docs)], "doc_id long, text string")
    to, back = {}, {}
    for r in pii.pseudonymise(df, b"some key").collect():
        parts = docs[r["doc_id"]]
        got = r["text"].split("  ") if parts else []
        assert len(got) == len(parts)
        for (kind, value, written), new in zip(parts, got):
            if kind is None:
                assert new == written
                continue
            assert valid(kind, new) and [c.isalnum() for c in new] == [c.isalnum() for c in written] or kind in ("ip", "email")
            assert to.setdefault((kind, value), canonical(kind, new)) == canonical(kind, new)  # equal values stay linked
            assert back.setdefault((kind, canonical(kind, new)), value) == value  # and others apart
            assert kind in ("email", "ip") or len(new) == len(written)
        assert r["n_phone"] == sum(k in ("phone", "abroad") for k, *_ in parts) and r["n_email"] == sum(k == "email" for k, *_ in parts)
    assert sum(v != c for (_, v), c in to.items()) > 0.97 * len(to)


def test_whole_local_parts_are_replaced():
    p = pii.Pseudonyms(b"key")
    for n in (1, 64, 65, 70, 5000):
        s = "a" * n + "@mail.example.com"
        new, kinds = p.replace(f"to {s}.")
        assert kinds == ["email"] and len(new) == len(s) + 4 and sum(a == b for a, b in zip(new[3:], s[:n])) <= max(1, n // 8)


@pytest.mark.parametrize("unit", ["12345678x", "7", "1-2-3", "a@a.", "GB82 ", "+12 34 ", "123-45-6789 ", "1 ", "@a.b"])
def test_time_is_linear_in_a_text(unit):
    p, took = pii.Pseudonyms(b"key"), []
    for n in (50_000, 400_000):
        t = time.process_time()
        p.find(unit * (n // len(unit)))
        took.append(time.process_time() - t)
    assert took[1] < 24 * max(took[0], 0.02)  # eight times the text

"""Operators 4 and 9: permutations, round trips of validity, planted values and held-out accuracy."""

import zlib

import numpy as np
import pytest

from readloom.llm import boosting, pii, registry, toxicity
from readloom.llm.workspace import table


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    p = pii.Permutation(b"k", "t", size)
    assert sorted(map(p, range(size))) == list(range(size)) and all(p.inverse(p(i)) == i for i in range(size))
    q = pii.Permutation(b"other", "t", size)
    assert size < 90 or any(p(i) != q(i) for i in range(size))


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("call +1 (988) 555-2485 or 988-555-2485 now", ["phone", "phone"]),
        ("card 4041894974608795, 4041 8949 7460 8795", ["card", "card"]),
        ("at 39.197.112.39. Then 1.2.3.4.5 and 999.1.1.1", ["ip"]),
        ("a.b@mail7.example.com. x@y @ ", ["email"]),
        ("GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", ["iban"]),
        ("078-05-1120 and 000-12-1234", ["ssn"]),
        ("1984-02-30 1984-02-28 28.02.1984 02/28/1984 29/02/2023", ["date"] * 3),
        ("4041894974608796 version 1.2.3 12345 123-45-678", []),
        ("", []),
    ],
)
def test_kinds_and_validity(text, kinds):
    p = pii.Pseudonyms(b"key")
    new, got = p.replace(text)
    assert got == kinds and [f[2] for f in p.find(new)] == kinds  # pseudonyms are valid in the same format
    assert all(a.isalnum() == b.isalnum() for a, b in zip(text, new)) or "ip" in kinds
    assert p.replace(text)[0] == new and (not kinds or pii.Pseudonyms(b"two").replace(text)[0] != new)


def test_equal_values_stay_linked_whatever_their_punctuation():
    p = pii.Pseudonyms(b"key")
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(p.card("4041894974608795")) == digits(p.card("4041 8949 7460 8795"))
    assert digits(p.phone("988-555-2485")) == digits(p.phone("(988) 555-2485"))
    a, b = p.date("2001-12-25"), p.date("25.12.2001")
    assert a.split("-") == b.split(".")[::-1]
    month_first = {p.date(f"05/{d}/1999") for d in range(13, 32)}
    assert len(month_first) == 19


def test_phones_below_200_and_accounts_before_other_words():
    p = pii.Pseudonyms(b"key")
    numbers = ["+1 (017) 555-7713", "(988) 155-2485", "199-999-0000", "200-199-9999", "999-000-0000", "000-000-0000"]
    for s in numbers:
        new, kinds = p.replace(s)
        assert kinds == ["phone"] and new != s and [f[2] for f in p.find(new)] == ["phone"]
        d = "".join(c for c in new if c.isdigit())[-10:]
        assert int(d[:3]) < 200 or int(d[3:6]) < 200  # permuted among themselves
    fronts = [f"{a:03d}-{e:03d}" for a in range(0, 1000, 7) for e in range(0, 1000, 3) if a < 200 or e < 200]
    made = {p.phone(f"{x}-1234") for x in fronts}
    assert len(made) == len(fronts)
    for tail in (" 2024-01-02", " A", " I 5 x"):
        new, kinds = p.replace("IBAN DE89370400440532013000" + tail)
        assert kinds[0] == "iban" and "DE89370400440532013000" not in new
    assert p.replace("GB82 WEST 1234 5698 7654 32 A B DE89370400440532013000")[1] == ["iban"] * 2


def test_op4_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    p = pii.Pseudonyms(registry.DEMO_KEY)
    want = {i: p.replace(t) for i, t in docs.items()}
    got = {r["doc_id"]: r for r in registry.op4_pii(spark, sf).collect()}
    assert got.keys() == {i for i, (_, k) in want.items() if k} and got
    for i, r in got.items():
        assert r["text"] == want[i][0] and r["n_card"] == want[i][1].count("card")


def test_op4_odd_inputs(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "4041894974608795 " * 5000, None), (3, "a@b.example.com", None), (3, "a@b.example.com", None), (None, "no data", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_card string")
    got = pii.pseudonymise(docs, b"k").collect()
    assert len(got) == len(rows) and sorted(r["n_card"] for r in got) == [0, 0, 0, 0, 0, 5000]
    assert pii.pseudonymise(docs.limit(0), b"k").count() == 0 and pii.with_personal_data(pii.pseudonymise(docs, b"k")).count() == 3


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.Boosted().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    s = m.score(x[2500:])
    assert ((s >= 0.5) == y[2500:]).mean() > 0.95 and s.min() >= 0 and s.max() <= 1
    raw = np.sort(m.raw(x))
    assert (np.diff(np.interp(raw, *m.steps)) >= 0).all()
    for labels in ([], [0.0] * 20, [1.0] * 20):
        m = boosting.Boosted().fit(np.ones((len(labels), 2)), np.array(labels))
        assert (m.score(np.ones((1, 2))) >= 0.5) == bool(labels and labels[0])


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in registry.op9_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    test = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    hit = sum(a and b for a, b in test)
    assert hit / sum(a for a, _ in test) > 0.8 and hit / sum(b for _, b in test) > 0.9  # labels hold some noise


def test_op9_odd_inputs(spark):
    rows = [(i, ("you idiot loser moron " if i % 3 == 0 else "the fine day of ") * (1 + i % 5), "clash") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, None), (1001, "", None), (None, "text", None), (5, "again", None), (5, "again", None), (1002, "word " * 40000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(400)] + [(None, 1, 1), (7, None, 1), (9, 1, 1), (9, 0, 1)], "doc_id long, toxic int, text int")
    got = toxicity.predict(docs, labels).collect()
    assert len(got) == 406 and {r["predicted"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["text"] != "again"} == {0, 1}
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["text"] != "again")
    none = toxicity.predict(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.predict(docs.limit(0), labels).count() == 0

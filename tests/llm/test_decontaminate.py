"""Operator 7 where a benchmark leaked widely and where it is large."""

import random

import numpy as np
import pytest

from readloom.llm import decontaminate
from readloom.llm.workspace import table

SYLLABLES = ["bar", "del", "fin", "gon", "kat", "lir", "mos", "nuv", "pex", "rag", "sul", "tem"]
VOCABULARY = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("the of and to in is".split()) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(n)]


def test_widely_leaked_items_are_found(spark):
    rng = random.Random(5)
    items = [words(rng, 30) for _ in range(20)] + ["the of and to in is the of and to".split()]
    docs, want = [], set()
    for d in range(6000):
        parts = [words(rng, rng.randint(40, 120)), words(rng, rng.randint(10, 90))]
        middle = []
        for k, leaks in ((0, d % 20 == 0), (1, d % 3 == 0), (20, d % 500 == 0)):
            if leaks:
                middle += items[k]
                want.add((d, k))
        if d % 3 == 1:  # the second item again, with words left out
            middle += [w for i, w in enumerate(items[1]) if i % 6 != 2]
            want.add((d, 1))
        docs.append((d, " ".join([*parts[0], *middle, *parts[1]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark(df, bench).collect()}
    assert want <= got
    assert {k for _, k in got - want} <= {20}  # an item of the most frequent words alone may stand elsewhere too


def test_large_benchmarks_lose_no_item(spark):
    rng = random.Random(6)
    items = [[rng.choice(SYLLABLES) + w for w in words(rng, rng.randint(15, 59))] for _ in range(1200)]
    items[1100] = items[7]  # the same words under another number, in another group
    other = lambda n: ["x" + w for w in words(rng, n)]
    docs = [(k, " ".join(x)) for k, x in enumerate(items)]
    docs += [(10_000 + k, " ".join([*other(40), *(w for i, w in enumerate(x) if i % 8 != 3), *other(40)])) for k, x in enumerate(items)]  # words left out
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_benchmark(df, bench).collect()}
    want = {(d + k, k) for k in range(1200) for d in (0, 10_000)} | {(d + a, b) for d in (0, 10_000) for a, b in ((7, 1100), (1100, 7))}
    assert set(got) == want
    assert all(s > 0.999 for (d, _), s in got.items() if d < 10_000)


def test_words_end_at_any_white_space_and_punctuation():
    plain = [b"one", b"two", b"three", b"four"]
    for text in ("One two, three-four.", "\u201cOne\u201d two\u2014three \u00bffour?", "One\u00a0two\u3000three\u2003four\u2026", "\u00abOne\u00bb \u2018two\u2019 three\u2013four\u3002"):
        assert decontaminate.words_of(text) == plain
    assert decontaminate.words_of("ci\u00f3n e\u0301t\u00e9") == ["ci\u00f3n".encode(), "e\u0301t\u00e9".encode()]


@pytest.mark.parametrize("part", [4 << 20, 15_000])
def test_paraphrase_recall(spark, monkeypatch, part):
    """Items with two fifths of their words replaced by words of other documents."""
    monkeypatch.setattr(decontaminate, "PART", part)
    sf, rng = "/root/testdata/sf0.01", random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = {d for d, t in docs if not any(q in t for _, q in items)}
    pool = [w for _, t in docs for w in t.split()[:500]]
    changed = []
    for i, t in items:
        w = t.split()
        for j in rng.sample(range(len(w)), round(0.4 * len(w))):
            w[j] = rng.choice(pool)
        changed.append((10**6 + i, " ".join(rng.choices(pool, k=rng.randint(40, 120)) + w + rng.choices(pool, k=rng.randint(40, 120)))))
    df = spark.createDataFrame(docs + changed, "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark(df, table(spark, sf, "benchmark")).collect()}
    assert sum((10**6 + i, i) in got for i, _ in items) >= 0.9 * len(items)
    assert not [(d, i) for d, i in got if d >= 10**6 and d - 10**6 != i]
    assert len({d for d, _ in got} & clean) <= 0.002 * len(clean)


def leaks():
    """Items, and documents that hold one of them each, verbatim and with words left out, among words of other items."""
    rng = random.Random(8)
    items = [words(rng, rng.randint(15, 59)) for _ in range(60)]
    docs = []
    for d in range(240):
        x = items[d % 60] if d < 60 else [w for i, w in enumerate(items[d % 60]) if i % 6 != 2]
        docs.append((d, " ".join([*rng.choices(items[(d + 7) % 60], k=rng.randint(10, 60)), *x, *rng.choices(items[(d + 9) % 60], k=rng.randint(10, 60))])))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)]


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_benchmark(df, bench).collect()}


def test_matches_come_by_latent_products_alone(spark, monkeypatch):
    docs, items = leaks()
    got = set(found(spark, docs, items))
    assert {(d, d) for d in range(60)} <= got and len({(d, d % 60) for d in range(240)} - got) <= 1
    monkeypatch.setattr(decontaminate, "bar", lambda item: 1e9)
    assert {(d, d) for d in range(60)} <= set(found(spark, docs, items))  # whole items, by their products
    monkeypatch.setattr(decontaminate, "reach", lambda item, weight: (1e9, 1), raising=False)
    assert not found(spark, docs, items)


def test_axes_of_the_decomposition_count(spark, monkeypatch):
    docs, items = leaks()
    docs, items = docs[:60], items[:20]
    many = found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BEYOND", 1)
    few = found(spark, docs, items)
    assert set(few) >= {(d, d) for d in range(20)}
    differ = [few[k] - many[k] for k in set(few) & set(many)]
    assert min(differ) > -1e-4 and max(differ) > 0.01  # fewer axes hold less of a passage


def test_reach_holds_wherever_an_item_stands():
    rng = np.random.default_rng(5)
    weight = np.concatenate([[0], rng.uniform(0.7, 5, 80)])
    for n in (1, 5, 33, 34, 50, 64, 65, 96, 150):
        for _ in range(40):
            item = rng.integers(1, rng.integers(2, 81), n).astype(np.int32)
            seq = np.concatenate([rng.integers(0, 81, rng.integers(0, 120)), item, rng.integers(0, 81, rng.integers(0, 120))]).astype(np.int32)
            p, w, c, _ = decontaminate.passages([seq])
            at, m = np.unique(item, return_counts=True)
            own = np.zeros(81)
            own[at] = weight[at] * (1 + np.log(m))
            own /= np.linalg.norm(own)
            product, distinct = decontaminate.reach(item, weight)
            got = [((weight[w[p == k]] * (1 + np.log(c[p == k])) * own[w[p == k]]).sum(), (p == k).sum()) for k in np.unique(p)]
            assert any(x >= product * (1 - 1e-9) and k >= distinct for x, k in got)

"""Operator 3 against all pairs."""

import random
import re

import pytest

from readloom.llm import jaccard, registry
from readloom.llm.components import components
from readloom.llm.workspace import Workspace, table


def shingles(text, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, percent=75):
    """{row number: (set size, component's smallest id)}"""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for group in {tuple(g) for g in by.values() if len(g) > 1}:
        for k, i in enumerate(group):
            for j in group[k + 1 :]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **kw).collect()), key=str)


def test_op3_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = sorted((tuple(r) for r in registry.op3_jaccard(spark, sf).collect()), key=str)
    assert got == brute(rows) and any(d != c for d, _, c in got)


@pytest.mark.parametrize("small,rounds", [(8, 2), (1, 0), (2, 1)])
def test_op3_chains_and_large_groups(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "TOGETHER", 16)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(120):  # copies drift, so links form chains and groups that a pivot doesn't cover
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(w))
    for k in range(40):
        i = rng.randrange(60)
        texts.append(" ".join(base[i:] + base[:i]))
    texts += ["a b c d e f g", "A B C d e f G", "a b c", "a  b\tc", "a b", None, "", "   ", "word " * 5000, "word " * 4000, "é ü ñ ß ø", "é ü ñ ß ø", "x\x1cy z w v u", "x y z w v u"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (4, "own words for a repeated id"), (None, texts[5]), (None, "nobody else has these words here"), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as node", "2 as component_id")
    assert run(df) == brute(rows)


def test_op3_empty_and_one_of_each(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "other words in this text now"), (5, "other words in this text now"), (7, None), (None, "z z z"), (None, "a b c d e f")], "doc_id long, text string")
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect()), key=str) == sorted([(1, "a b c d e f"), (5, "other words in this text now"), (7, None), (None, "z z z"), (None, "a b c d e f")], key=str)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))


def test_op3_compares_open_blocks_in_portions(spark, monkeypatch):
    """Near copies that stay open to the end, in many blocks: no one step shuffles them all to all blocks, and the result is the same."""
    limit = 400_000
    monkeypatch.setattr(jaccard, "PORTION", limit, raising=False)
    monkeypatch.setattr(jaccard, "SHARE", 0, raising=False)
    monkeypatch.setattr(jaccard, "TOGETHER", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    store, sent, write = spark.sparkContext._jsc.sc().statusStore(), [], Workspace.write

    def spied(self, df, name, *args, **kw):
        before = store.executorSummary("driver").totalShuffleWrite()
        out = write(self, df, name, *args, **kw)
        if name == "links-left":
            sent.append(store.executorSummary("driver").totalShuffleWrite() - before)
        return out

    monkeypatch.setattr(Workspace, "write", spied)
    rng, rows = random.Random(4), []
    for i in range(160):
        w = [f"w{j}" for j in range(100)]
        for j in rng.sample(range(100), 5):
            w[j] = f"x{rng.randrange(20)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert run(df) == brute(rows)
    assert sent and max(sent) <= 1.5 * limit

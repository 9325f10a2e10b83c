"""Operator 6 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from readloom.llm import passages, registry
from readloom.llm.workspace import table


def brute(rows, window=20):
    docs = [(-(2**63) - 1 if d is None else d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, w), (real, _) in zip(docs, rows):
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first[k] < d or k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        out.append((real, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_op6_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    want = brute(rows)
    got = sorted((tuple(r) for r in registry.op6_passages(spark, sf).collect()), key=str)
    assert got == sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in want), key=str)
    assert sum(g for _, _, g, _ in want) > 1000


@pytest.mark.parametrize("window,block", [(20, 7), (5, 1000), (6, 50), (1, 30)])
def test_op6_odd_inputs(spark, monkeypatch, window, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    monkeypatch.setattr(passages, "COMBINED", 20 if block < 20 else 10**6)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(8)]
    passage = [rng.choice(common) if i % 3 else f"p{i}" for i in range(70)]
    texts = []
    for k in range(60):
        w = [rng.choice(common) if rng.random() < 0.6 else f"u{rng.randrange(2000)}" for _ in range(rng.randint(0, 60))]
        i = rng.randrange(len(w) + 1)
        j = rng.randrange(40)
        texts.append(" ".join(w[:i] + passage[j : j + rng.randint(0, 45)] + w[i:]))
    texts += ["a b " * 40, "a b " * 40, "x " * 100, None, "", " \t\n", "same " * 19, " ".join(passage), " ".join(passage), "  ".join(passage), "é ü\x1c ñ " * 30, "Word word " * 3000]
    rows = [(i // 1, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[40]), (None, texts[5]), (None, " ".join(passage)), (None, None), (-(2**63), " ".join(passage)), (2**63 - 1, texts[5])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "'x' as kept", "2 as block")
    got = sorted((tuple(r) for r in passages.remove_repeats(df, window).collect()), key=str)
    assert got == brute(rows, window)
    assert passages.remove_repeats(df.limit(0), window).count() == 0


def test_marks_of_equal_windows_are_equal():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    inner = set(passages.marks(passages.phrases(h[100:120], 20), 20).tolist())
    assert inner and inner <= set(passages.marks(passages.phrases(h, 20), 20).tolist())
    assert passages._slide(np.array([5, 1, 4, 2, 8, 9, 3]), 3, np.minimum).tolist() == [1, 1, 2, 2, 3]

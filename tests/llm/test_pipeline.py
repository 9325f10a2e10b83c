"""The pipeline against a plain version of each stage, and operator 7 against full searches."""

import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from readloom.llm import bpe, decontaminate, registry, toxicity
from readloom.llm.workspace import table
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets_topk import brute as secrets_of


def test_op7_finds_every_verbatim_passage(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, sf, "benchmark").collect()}
    want = {(d, i) for d, t in docs.items() for i, q in items.items() if q in t}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op7_decontamination(spark, sf).collect()}
    assert want and want <= got
    norm = lambda t: re.findall(r"\w+", t.lower())
    for d, i in got - want:  # anything else holds most of the item's words
        held = set(norm(docs[d]))
        assert sum(w in held for w in norm(items[i])) > 0.6 * len(norm(items[i]))


def test_op7_paraphrases_and_odd_inputs(spark):
    rng = random.Random(3)
    syllables = ["bar", "del", "fin", "gon", "kat", "lir", "mos", "nuv", "pex", "rag", "sul", "tem"]
    vocabulary = [a + b + c for a in syllables for b in syllables for c in syllables]
    common = "the of and to in is".split()
    text = lambda n, v=vocabulary: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(v) for _ in range(n))
    items = [(i, text(30).capitalize() + ".") for i in range(8)]
    docs = [(i, text(rng.randint(5, 400))) for i in range(150)]
    docs.append((1000, text(100) + "\n" + items[2][1] + " " + text(70)))
    w = items[5][1].split()
    docs.append((1001, text(90) + " " + " ".join(x for k, x in enumerate(w) if k % 6 != 2).upper() + " " + text(90)))  # words left out
    docs.append((1002, items[3][1]))
    docs += [(1003, None), (1004, ""), (1002, items[3][1]), (None, items[1][1]), (1005, ("filler " * 30000) + items[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id", "2 as seq")
    bench = spark.createDataFrame([*items, (None, "none"), (99, None), (98, ""), (97, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark(df, bench).collect()}
    assert {(1000, 2), (1001, 5), (1002, 3), (None, 1), (1005, 7)} <= got
    assert len(got) == 5
    assert decontaminate.find_benchmark(df.limit(0), bench).count() == 0 and decontaminate.find_benchmark(df, bench.limit(0)).count() == 0


def test_lcs():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 25))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.01"
    source = table(spark, sf, "documents")
    docs = {r["doc_id"]: r["text"] for r in source.collect()}
    toxic = {r["doc_id"] for r in toxicity.predict(source, table(spark, sf, "labels")).where("predicted = 1").select("doc_id").collect()}
    clean = [(d, t) for d, t in docs.items() if d not in toxic]
    keep = {d for d, _, c in brute(clean) if d == c}
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    leaked = {d for d in keep if any(q in docs[d] for q in items)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert leaked and not leaked & set(out) and set(out) <= keep - leaked and len(keep - leaked - set(out)) <= 2
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(registry.RANKS), special_tokens={})
    for d, r in out.items():
        spans = secrets_of(docs[d])[0]
        if not spans:
            assert r["token_ids"] == tk.encode_ordinary(docs[d]) and r["n_chars"] == len(docs[d])
        else:
            text = tk.decode(r["token_ids"])
            assert "[SECRET]" in text and not secrets_of(text)[0] and r["n_chars"] == len(text)
    assert set(source.columns) - {"text"} <= set(next(iter(out.values())).asDict())


def test_pipeline_long_texts_repeats_and_ties(spark, tmp_path):
    """Very long texts, repeated rows, equal texts and rows without an id or a text, with the tables' own labels and benchmark."""
    sf = "/root/testdata/sf0.001"
    for t in ("labels", "benchmark"):
        table(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    tie, long, leak = text(60), text(200_000), table(spark, sf, "benchmark").first()["text"]
    rows = [(1, tie), (2, tie), (2, tie), (3, tie), (4, long), (5, long + " more"), (6, text(80)), (6, text(90)), (7, "token=abcdef123456 " * 3000), (8, long + " " + leak), (9, ""), (9, ""), (10, None), (None, "only one of its kind"), (None, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    # of equal and nearly equal texts the first stays; 8 is near 4; of the rows of 6 at least one
    assert set(ids) == {1, 4, 6, 7, 9, 10, None} and ids.count(1) == ids.count(4) == ids.count(7) == 1 and ids.count(None) == 2
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(registry.RANKS), special_tokens={})
    by = {r["doc_id"]: tk.decode(r["token_ids"]) for r in got}
    assert by[4] == long and by[7] == "[SECRET] " * 3000 and by[1] == tie


def test_pipeline_empty_tables_and_extra_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("labels", "benchmark"):
        table(spark, sf, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    odd = table(spark, sf, "documents").limit(40).selectExpr("*", "1 as n", "'x' as node", "2.0 as score", "array(1) as spans", "5 as n_tokens")
    null = spark.createDataFrame([(None, None), (None, "text without id"), (5000, ""), (5001, None)], "doc_id long, text string")
    odd.unionByName(null, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r["score"], tuple(r["spans"]), r["node"]) for r in got.where("doc_id < 5000").collect()} == {(2.0, (1,), "x")}
    assert got.count() >= 30 and {5000, 5001} <= {r["doc_id"] for r in got.select("doc_id").collect()}
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Operators 1, 2 and 8 against the libraries, on every document of the smallest tables and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from readloom.llm import bpe, registry, token_counts, token_files
from readloom.llm.workspace import Workspace, table

ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\n a\t\tb ", "don't 're it's", "漢字 かな 😀🏽‍🚀", "x\x1cy \x85z  w", "é" * 5000, "word " * 30000, "<|endoftext|> is text", "a <|endoftext|><|endoftext|>\n x <|endof text|> ", "tail<|endoftext|>", "Ab. ab, ab., ab.\n c d1. ²., x. x,", "a" * 3000]


@pytest.fixture(scope="module")
def tk():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(registry.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(registry.TOKENIZER)


def odd_docs(spark):
    rows = [(i, t, None, "s", 7, "clash") for i, t in enumerate(ODD)] + [(3, "tie", "x", None, None, "c"), (3, "tie", "x", None, None, "c"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op2_equals_the_library(spark, sf, tk):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = registry.op2_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tk.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))


def test_op2_odd_inputs(spark, tk):
    docs = odd_docs(spark)
    got = {(r["doc_id"], r["text"]): r for r in bpe.encode_decode(docs, registry.RANKS, registry.PATTERN, keep=("doc_id", "text")).collect()}
    assert {k[1] for k in got} >= {t for t in ODD}
    for (_, text), r in got.items():
        assert r["token_ids"] == tk.encode_ordinary(text or "") and bytes(r["decoded"]).decode() == (text or "")
    assert bpe.encode_digests(docs, registry.RANKS, registry.PATTERN).count() == len(ODD) + 3
    for clash in (bpe.encode_digests, bpe.encode_decode):  # n_tokens is a column of the table too
        d = clash(docs, registry.RANKS, registry.PATTERN, keep=("doc_id", "n_tokens"))
        assert d.columns.count("n_tokens") == 1 and {type(r["n_tokens"]) for r in d.select("n_tokens").collect()} == {int}
    assert bpe.encode_digests(docs.limit(0), registry.RANKS, registry.PATTERN).count() == 0


def test_prefix_table_appends_and_edits():
    b = bpe.PrefixBpe(bpe.load_ranks(registry.RANKS))
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.choice(b"thein aabre\xc3\xa9\xff") for _ in range(rng.randint(0, 300)))
        st = b.state()
        for k in range(0, len(raw), 7):
            st.append(raw[k : k + 7])
        assert st.last == b.state(raw).last
        i = rng.randint(0, len(raw))
        j = rng.randint(i, len(raw))
        done = st.edit(i, j, b"zq")
        assert st.last == b.state(raw[:i] + b"zq" + raw[j:]).last and done <= len(raw) - j + 2
    long = b"the thing " * 2000
    st = b.state(long)
    assert st.edit(500, 503, b"ab") < 1000


def test_op1_equals_full_recounts(spark, sf, tk):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = registry.op1_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(tk.encode_ordinary(t))
        n = len(t)
        a = n // 3
        t = t[:a] + " edited " + t[a + 5 :]
        t = t[: 2 * a] + t[2 * a + 7 :] + " End of file."
        assert r["n_tokens_edited"] == len(tk.encode_ordinary(t)) and r["n_reencoded"] <= 60


def test_op1_random_edits(tk, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    pattern, count = token_counts.counter(registry.RANKS, registry.PATTERN)
    rng = random.Random(2)
    letters = "abc the's're \n\t  01é漢.,!?"
    for _ in range(400):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        tree = token_counts.CountTree(s, pattern, count)
        for _ in range(5):
            i = rng.randint(0, len(s) + 2)
            j = rng.randint(i, i + rng.choice([0, 1, 3, 40]))
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 60])))
            s = s[:i] + new + s[j:]
            tree.edit(i, j, new)
            assert tree.text() == s and tree.n_tokens == len(tk.encode_ordinary(s)) and tree.n_pieces == len(pattern.findall(s))


def test_op1_stored_trees_take_later_edits(spark, tk, tmp_path):
    """Two runs of edits over trees that were written; no text is encoded as a whole again."""
    rows = [(i, t) for i, t in enumerate([*ODD, "some words " * 4000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_counts.count_trees(docs, registry.RANKS, registry.PATTERN).write.parquet(f"{tmp_path}/0")
    first = {r["doc_id"]: r["n_tokens"] for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    assert first == {i: len(tk.encode_ordinary(t or "")) for i, t in rows}
    texts = {i: t or "" for i, t in rows}
    for k in range(2):
        todo = {i: [(len(t) // 3, len(t) // 3 + 4, f" new{k}"), (0, 0, "é"), (10**6, 10**6, "end")] for i, t in texts.items()}
        edits = spark.createDataFrame([(i, [dict(zip(("start", "end", "new"), e)) for e in x]) for i, x in todo.items()], f"doc_id long, edits {token_counts.EDITS}")
        token_counts.edit_trees(spark.read.parquet(f"{tmp_path}/{k}").join(edits, "doc_id"), registry.RANKS, registry.PATTERN).write.parquet(f"{tmp_path}/{k + 1}")
        for i, x in todo.items():
            for a, b, new in x:
                t = texts[i]
                texts[i] = t[: min(a, len(t))] + new + t[min(b, len(t)) :]
        got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/{k + 1}").collect()}
        assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(tk.encode_ordinary(t)) for i, t in texts.items()}
        assert got[len(ODD)]["n_reencoded"] <= 40


def test_op1_odd_inputs(spark, tk):
    docs = odd_docs(spark).selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then array(named_struct('start', 1, 'end', 1, 'new', 'x y'), null, named_struct('start', -4, 'end', 999999999, 'new', null)) end as edits")
    got = token_counts.edit_token_counts(docs, registry.RANKS, registry.PATTERN, keep=("doc_id", "text")).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        n = len(tk.encode_ordinary(r["text"] or ""))
        assert (r["n_tokens"], r["n_tokens_edited"]) == (n, 0 if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else n)


def test_op8_equals_the_library(spark, sf, lib):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r for r in registry.op8_token_files(spark, sf).collect()}
    assert got.keys() == texts.keys()
    start = 0
    for i in sorted(texts):
        ids = np.array([*lib.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op8_odd_inputs(spark, lib):
    docs, path = odd_docs(spark), Workspace(spark, "t").root
    token_files.write_token_files(docs, path, registry.TOKENIZER, shards=3)
    got = token_files.decode_documents(spark, path).collect()
    want = sorted([*enumerate(ODD), (3, "tie"), (3, "tie"), (-1, "no id")], key=lambda x: x[0])
    rows = sorted(got, key=lambda r: r["start"])
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in rows] == [i for i, _ in want]
    assert sorted(map(tuple, (r["token_ids"] for r in rows))) == sorted((*lib.encode(t or "", add_special_tokens=False).ids, 0) for _, t in want)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["token_ids"])
    path = Workspace(spark, "t").root
    token_files.write_token_files(docs.limit(0), path, registry.TOKENIZER)
    assert token_files.document_digests(spark, path).count() == 0


def test_op8_spreads_repeated_and_null_ids(spark, lib, monkeypatch):
    rows = [(None, "no id at all")] * 300 + [(5, "the same row")] * 300 + [(5, "other text"), (9, "<|endoftext|>")]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Workspace(spark, "t").root
    token_files.write_token_files(docs, path, registry.TOKENIZER, shards=6)
    blocks = token_files.read_token_files(spark, path)[0]
    sizes = [r["n"] for r in blocks.selectExpr("shard", "size(doc_id) n").groupBy("shard").sum("n").toDF("shard", "n").collect()]
    assert len(sizes) >= 5 and max(sizes) < 250
    got = sorted(token_files.decode_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + [5] * 301 + [9] and got[-1]["token_ids"] == [50256, 0]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 50000).astype(np.uint16)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=1 << 16))
    assert lengths.max(initial=0) <= token_files.LONGEST
    wide = token_files.Decoder(np.concatenate([lengths, np.zeros(9, np.uint8)]))
    assert wide.kind is np.uint32
    payload, marks = token_files.pack(ids, lengths, token_files.high(lengths))
    a, b = token_files.Decoder(lengths).decode([(n, payload, marks)] * 2)
    assert (a == ids).all() and (b == ids).all() and len(a) == n

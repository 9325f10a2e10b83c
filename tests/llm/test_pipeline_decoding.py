"""The pipeline's last stage decodes its ids again."""

import pytest

import corpus_pipeline
from readloom.llm import bpe


def test_ids_that_decode_to_other_bytes_fail():
    bpe.verified(["a b", None, "", "\u00e9"], [b"a b", b"", b"", b"\xc3\xa9"])
    with pytest.raises(ValueError):
        bpe.verified(["a b", "\u00e9"], [b"a b", b"\xe9"])


def test_tokenise_verifies_every_text(spark, monkeypatch):
    seen, whole = [], bpe.encode_decode
    monkeypatch.setattr(bpe, "encode_decode", lambda *a, **b: seen.append(b) or whole(*a, **b))
    docs = spark.createDataFrame([(1, "Some text, \u00e9\u4e2d \n\n twice"), (2, None), (3, "")], "doc_id long, text string")
    out = corpus_pipeline.tokenise(spark, docs, "")
    assert seen[0]["verify"] and out.columns == ["doc_id", "n_tokens", "token_ids"] and out.count() == 3
    assert [r["n_tokens"] > 0 for r in out.orderBy("doc_id").collect()] == [True, False, False]

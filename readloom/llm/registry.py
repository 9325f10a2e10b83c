"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, passages, pii, secrets, token_counts, token_files, topk, toxicity
from .workspace import Workspace, table

#: Vocabulary files are parameters; these are the ones the queries use.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, before and after three edits: a replacement at a third, a deletion at two thirds, an addition at the end."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("int")
    third = F.floor(n / 3).cast("int")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("new"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(edit(third, third + 5, " edited "), edit(2 * third, 2 * third + 7, ""), edit(n + 8, n + 8, " End of file.")).alias("edits"))
    return token_counts.edit_token_counts(docs, RANKS, PATTERN)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component's smallest id."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


#: The key of the query's pseudonyms; a real one comes from the caller.
DEMO_KEY = b"readloom demonstration key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that held personal data, with pseudonyms in its place and counts by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_personal_data(pii.pseudonymise(docs, DEMO_KEY))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with counts and a digest of its base spans, and all its spans as text."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, kinds), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those removed as repeats of 20-word windows, and a digest of the others."""
    return passages.remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they hold, verbatim or rephrased."""
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the token files."""
    path = Workspace(spark, "op8").root
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.document_digests(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction by a model that never saw held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out")
    return toxicity.predict(docs, table(spark, sf_dir, "labels")).select("doc_id", held, "score", "predicted")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe, op3_jaccard, op4_pii, op5_secrets, op6_passages, op7_decontamination, op8_token_files, op9_toxicity, op10_top_k)}
ORACLES: dict[str, str] = {"op10_top_k": TOP_K_SQL}

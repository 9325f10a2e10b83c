"""A corpus pipeline: toxic documents go, one of each group of near copies stays, documents with benchmark passages go, secrets are masked, and what is left is tokenised.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, decontaminate, jaccard, registry, secrets, toxicity
from readloom.llm.workspace import Workspace, table


def beside(docs: DataFrame, names: tuple[str, ...], stage) -> DataFrame:
    """``stage`` over ``docs``, columns whose names the stage uses itself set aside and given back as they were."""
    away = {c: f"__own_{c}" for c in names if c in docs.columns}
    back = {v: k for k, v in away.items()}
    return stage(docs.withColumnsRenamed(away)).drop(*away).withColumnsRenamed(back).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on these documents' labels, does not predict to be toxic. Null and empty texts stay."""
    return beside(docs, ("score", "predicted"), lambda d: toxicity.predict(d, table(spark, sf_dir, "labels")).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id; of rows that repeat an id, one. Null and empty texts link with nothing and stay, and so do rows without an id."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts hold none and stay; all rows of an id go if one of them holds a passage; an empty benchmark drops nothing."""
    keyed = docs.withColumn("__key", F.coalesce("doc_id", F.xxhash64("text")))  # rows without an id are told apart by their text
    found = decontaminate.find_benchmark(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    ids = found.select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(jaccard.small_side(ids, ids.count()), "__key", "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, secrets in their texts replaced by a mark, n_chars as it is then. A null text stays null and keeps its n_chars."""
    done = beside(docs, ("spans",), secrets.redact)
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in done.columns else done


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with their token ids in place of the text, which the ids decode to: each text is decoded again and compared, and the stage fails where it differs. Null and empty texts have no ids; columns named as the new ones are replaced."""
    keep = tuple(c for c in docs.columns if c not in ("text", "n_tokens", "token_ids"))
    return bpe.encode_decode(docs, registry.RANKS, registry.PATTERN, keep=keep, decoded=False, verify=True)


#: In order.
STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("bpe", tokenise),
]

#: SQL can express neither the model nor the tokens; the tests compare the pipeline with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws, docs, last = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if last:
            ws.drop(last)
        last = name
    return docs

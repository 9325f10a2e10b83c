"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities and counts of two lexicons (a fixed one, and one of words and word beginnings that labelled
rows show to mark toxic texts), second-person words near lexicon words, capitals, punctuation, digits,
repetition and obfuscation rates, and length. Scores never see labels, language, source or id.

The labelled rows used are at most ``SAMPLE``, those with the least hash of doc_id, in three parts: one makes the
lexicon, one fits the trees, one calibrates. All counts over documents cover every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosting import Boosted
from .workspace import Workspace, portions

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 24_000

#: Insults, and words for the second person, in four languages.
INSULTS = frozenset("idiot stupid moron loser pathetic worthless disgusting scum trash clown dumb fool hate ugly liar jerk bastard crap idiota estúpido imbécil basura asqueroso inútil tonto mierda idiote stupide imbécile nul ordure dégoûtant connard débile dumm blöd trottel abschaum ekelhaft wertlos versager arschloch".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
#: Characters written for letters.
LEET = str.maketrans("013457@$!€", "oieastasie")

FEATURES = ("words", "learnt_sum", "learnt_density", "learnt_max", "learnt_hits", "fixed_hits", "fixed_density", "hidden_hits", "second_person", "near_second", "capitals", "punctuation", "exclamations", "digits", "repeats", "odd_words", "wide")

_edge = re.compile(r"^[\W_]+|[\W_]+$")
_letters = re.compile(r"[^\W\d_]+")


def bare(chunk: str) -> str:
    """A chunk in lower case without punctuation at its ends."""
    w = chunk.lower()
    return w if w.isalpha() else _edge.sub("", w)


def keys_of(w: str) -> list[str]:
    """A word as itself and by its beginnings of four to six letters (marked by a trailing ~)."""
    return [w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) >= n)]


class WordCodes(dict):
    """Chunk -> (code): 0 plain, 1 second person, 2 odd, from 4 on lexicon words. Emptied at ``limit``."""

    def __init__(self, lexicon: dict[str, float], limit: int = 400_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit
        self.weights, self.fixed, self.hidden, self.made = [0.0] * 4, [0] * 4, [0] * 4, {}

    def _weigh(self, w: str) -> tuple[float, int]:
        return max((self.lexicon.get(k, 0.0) for k in keys_of(w)), default=0.0), int(w in INSULTS)

    def __missing__(self, chunk: str) -> int:
        w = bare(chunk)
        weight, fixed, hidden = *self._weigh(w), 0
        odd = not w.isalpha() and bool(w) and any(c.isalpha() for c in w)
        parts = _letters.findall(w) if odd else ()
        if odd and not weight and not fixed:
            if len(parts) > 1 and min(map(len, parts)) > 1:  # joined words, such as at a line's end
                weight, fixed = max((self._weigh(p) for p in parts), default=(0.0, 0))
                odd = False
            else:
                plain = re.sub(r"[\W_]", "", w.translate(LEET))
                weight, fixed = self._weigh(plain)
                hidden = int(bool(weight or fixed))
        if not weight and not fixed and w.isalpha() and re.search(r"(.)\1\1", w):
            weight, fixed = max(self._weigh(re.sub(r"(.)\1\1+", r"\1", w)), self._weigh(re.sub(r"(.)\1\1+", r"\1\1", w)))
            hidden, odd = int(bool(weight or fixed)), True
        if weight or fixed:
            key = (weight, fixed, hidden)
            code = self.made.get(key)
            if code is None:
                code = self.made[key] = len(self.weights)
                self.weights.append(weight)
                self.fixed.append(fixed)
                self.hidden.append(hidden)
        else:
            code = 1 if w in SECOND or not SECOND.isdisjoint(parts) else 2 if odd else 0
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = code
        return code


_CAPS = np.zeros(256)
_CAPS[65:91] = 1
_PUNCT = np.zeros(256)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_LETTER = np.zeros(256)
_LETTER[[i for i in range(256) if chr(i).isalpha() and i < 128]] = 1
_CONTINUED = np.zeros(256)
_CONTINUED[128:192] = 1


def features(text: str, codes: WordCodes) -> list[float]:
    """Dense features of one text, in the order of FEATURES. An empty text has zeros."""
    chunks = text.split()
    n = len(chunks)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.fromiter(map(codes.__getitem__, chunks), np.int32, n)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    byte = np.bincount(raw, minlength=256)
    hit = np.flatnonzero(c >= 4)
    you = np.flatnonzero(c == 1)
    odd = int((c == 2).sum())
    total = best = fixed = hidden = near = learnt = 0.0
    if len(hit):
        w = np.array(codes.weights)[c[hit]]
        total, best, learnt = float(w.sum()), float(w.max()), float((w > 0).sum())
        fixed, hidden = float(np.array(codes.fixed)[c[hit]].sum()), float(np.array(codes.hidden)[c[hit]].sum())
        if len(you):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(hit - you[np.minimum(at, len(you) - 1)]), np.abs(hit - you[np.maximum(at - 1, 0)]))
            near = float((gap <= 5).sum()) / n
    size = len(raw)
    letters = max(1.0, float(byte @ _LETTER))
    repeats = float(((raw[1:] == raw[:-1])[1:] & (raw[2:] == raw[:-2])).sum()) / size if size > 2 else 0.0
    return [math.log1p(n), total, total / n, best, learnt, fixed, fixed / n, hidden, len(you) / n, near, float(byte @ _CAPS) / letters, float(byte @ _PUNCT) / size, float(byte[33]) / size, float(byte @ _DIGIT) / size, repeats, odd / n, float(byte @ _CONTINUED) / size]


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """Rows (key, toxic, plain): in how many distinct texts of either label a word or beginning occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in portions(batches):
            for t, y in zip(b.column(text).to_pylist(), b.column("toxic").to_pylist()):
                found[y].update({k for w in set(map(bare, (t or "").split())) for k in keys_of(w) if w})
        keys = [k for k in found[1]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=["key", "toxic", "plain"])
        rest = [k for k in found[0] if k not in found[1]]
        for i in range(0, len(rest), 100_000):
            some = rest[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(np.zeros(len(some), np.int64)), pa.array([found[0][k] for k in some], pa.int64())], names=["key", "toxic", "plain"])

    return docs.mapInArrow(run, "key string, toxic long, plain long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def learn_lexicon(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Words and beginnings at least eight times likelier in toxic texts, with their log ratio. Equal texts count once; there are no more of them than words in the sample."""
    docs = docs.groupBy(text).agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    ratio = F.log(((F.col("toxic") + 0.5) / (n[1] + 1)) / ((F.col("plain") + 0.5) / (n[0] + 1)))
    best = _counts(docs, text).where(F.col("toxic") >= 6).withColumn("w", ratio).where(F.col("w") >= math.log(8))
    return {r["key"]: float(r["w"]) for r in best.select("key", "w").collect()}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", held_out: int | None = 0) -> tuple[dict[str, float], Boosted]:
    """A lexicon and a calibrated model from labelled documents.

    Labels are those with a 0/1 ``toxic`` (a doc labelled twice counts as toxic if either says so); with ``held_out``,
    those whose remainder it is are never read. Without labels of both kinds the model scores every text by their one value, or 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if held_out is not None:
        known = known.where(remainder(F.col("doc_id")) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE)
    ws = Workspace(docs.sparkSession, "toxicity")
    known = ws.write(known, "labels")
    # at most SAMPLE rows of ids and labels; of rows that repeat an id, one text counts
    labelled = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    seen = ws.write(labelled.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")).withColumn("part", F.pmod(F.col("h"), F.lit(8))), "seen")
    lexicon = learn_lexicon(seen.where("part < 3").select("text", "toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(lexicon)
        for b in portions(batches):
            x = np.array([features(t or "", codes) for t in b.column("text").to_pylist()], np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["part", "toxic", "x"])

    rows = seen.where("part >= 3").select("part", "toxic", "text").mapInArrow(run, "part long, toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    y, part = np.array([r["toxic"] for r in rows], np.float64), np.array([r["part"] for r in rows])
    ws.close()
    return lexicon, Boosted().fit(x[part < 6], y[part < 6]).calibrate(x[part >= 6], y[part >= 6])


def score(docs: DataFrame, lexicon: dict[str, float], model: Boosted, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` double from 0 to 1 (replaced if there): the likelihood of label 1 for the whole text.

    Null and empty texts get the score of an empty text. Rows are scored where they stand, without a shuffle; the model sent along is of a fixed size.
    """
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(lexicon)
        for b in portions(batches):
            x = np.array([features(t or "", codes) for t in b.column(b.schema.get_field_index(text)).to_pylist()], np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, text: str = "text", held_out: int | None = 0) -> DataFrame:
    """``score`` by a model fitted on ``labels``, with predicted int (1 if score >= 0.5)."""
    return score(docs.drop("predicted"), *fit(docs, labels, text, held_out), text).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

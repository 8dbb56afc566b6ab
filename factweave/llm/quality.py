"""Quality classifier: hashed word n-grams, logistic regression with follow-the-regularised-leader updates.

A word counts once as itself (lower case) and once as its shape, so that unseen words still say whether they are
shouted, decorated or plain; bigrams are taken over both, and mark a word that repeats the one before. A text's
vector has sqrt(count / n) for each hashed feature and so has length 1 for each kind, at any number of words.

Training: labelled rows are dealt over ``SHARDS`` shards; each shard is learned by FTRL-proximal in one pass after
another, and the shards' weights are averaged. Scoring is a sparse dot product with a broadcast vector of
2**``BITS`` floats, whatever the size of the data.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from .arrow import arrow_batches
from .rows import ids_are_unique, without
from .worker import forget

BITS = 18
#: Shards whose weights are averaged, and passes over each.
SHARDS, PASSES = 4, 4
#: At most about this many labelled rows are learned from (a documented bound; each is learned whole).
SAMPLE_ROWS = 8_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.2
CUTOFF = 0.3
#: The scale of the feature that says how often a word repeats the one before it.
REPEAT_WEIGHT = 3.0
_CACHE_WORDS = 1 << 16
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), [np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)]

_SHAPE = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([a-zß-öø-ÿ]+)|([0-9]+)|(.)", re.S)


def shape(word: str) -> str:
    """``Thing,`` -> ``Xx,``; runs of a class count once, other signs stay (once a run)."""
    out: list[str] = []
    for upper, lower, digit, other in _SHAPE.findall(word):
        sign = "X" if upper else "x" if lower else "9" if digit else other
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


class Words:
    """Hashes of words and of their shapes, remembered for the words met lately."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        return _hash("w " + word.lower()) << 32 | _hash("s " + shape(word))

    def arrays(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = self.__missing__(w)
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)


def features(text: str | None, words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values. No words (or null): none, so that the score is the bias alone."""
    tokens = (text or "").split()
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    w, s = words.arrays(tokens)
    kinds = [w * _MIX, s * _MIX + _ODD[0], (w[:-1] * _ODD[1] + w[1:]) * _MIX, (s[:-1] * _ODD[2] + s[1:]) * _MIX + _ODD[3]]
    ids = ((np.concatenate(kinds) >> np.uint64(32)) % np.uint64((1 << bits) - 1)).astype(np.uint32)
    ids.sort()
    at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    counts = np.diff(at, append=len(ids))
    again = np.count_nonzero(w[1:] == w[:-1])  # has the last number before the bias to itself, and weighs more
    found = np.append(ids[at].astype(np.int64), (1 << bits) - 1)
    return found, np.append(np.sqrt(counts / len(tokens)), REPEAT_WEIGHT * math.sqrt(again / len(tokens)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = 2) -> np.ndarray:
    """Weights (the last is the bias) after ``passes`` over ``rows``, in their order."""
    z, n, w = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(passes):
        for ids, x, y in rows:
            i, v = np.append(ids, 1 << bits), np.append(x, 1.0)
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[i] @ v))))) - y) * v
            step = np.sqrt(n[i] + g * g)
            z[i] += g - (step - np.sqrt(n[i])) / ALPHA * w[i]
            n[i] += g * g
            pull = np.where(i < 1 << bits, L1, 0.0)
            w[i] = np.where(np.abs(z[i]) <= pull, 0.0, -(z[i] - np.sign(z[i]) * pull) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    return w


def remainder(id_col: Column, of: int = 5) -> Column:
    """crc32 of the id as text, by which rows are held out; a null id counts as the text ``null``."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % of).cast("int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, passes: int = PASSES) -> np.ndarray:
    """Learns from labelled rows that are not held out. Rows whose label is null or whose id repeats in ``labels`` with
    another label are left out; without any labelled row all weights are zero."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("y is not null and id is not null").groupBy("id").agg(F.min("y").cast("int").alias("y"), F.max("y").cast("int").alias("y2")).filter("y = y2").filter(remainder(F.col("id")) != 0)
    total = known.count()
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20))
    known = cut(known.filter(part < min(1.0, sample_rows / max(total, 1)) * (1 << 20)).select("id", "y"), "quality-labels")
    rows = known.count()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = texts.join(F.broadcast(known) if rows <= 2 * sample_rows else known, "id").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = Words()
        for batch in batches:
            found = [features(t, words) for t in batch.column("text").to_pylist()]
            at = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]), pa.int32())
            i, v = (np.concatenate([np.empty(0), *(f[k] for f in found)]) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(at, pa.array(i.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(v))]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("id"), batch.column("y"), *lists], names=["shard", "id", "y", "i", "v"])

    def learn(pdf):
        import pandas as pd

        pdf = pdf.iloc[np.argsort([_hash(str(x)) for x in pdf["id"]], kind="stable")]
        w = ftrl([(np.asarray(i), np.asarray(v), y) for i, v, y in zip(pdf["i"], pdf["v"], pdf["y"])], passes=passes)
        at = np.flatnonzero(w)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "i": at, "w": w[at]})

    arrow_batches(spark)
    learned = chosen.mapInArrow(vectors, f"shard int, id {texts.schema['id'].dataType.simpleString()}, y int, i array<int>, v array<double>").groupBy("shard").applyInPandas(learn, "shard int, i long, w double")
    learned = cut(learned, "quality-weights")
    used = max(1, learned.select("shard").distinct().count())  # small label sets leave shards empty
    found = learned.groupBy("i").agg((F.sum("w") / used).alias("w")).toPandas()  # at most 2**BITS + 1 rows
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[found["i"].to_numpy(np.int64)] = found["w"].to_numpy(np.float32)
    return weights


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cutoff: float = CUTOFF, carry: list[str] | None = None, **settings) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, held_out, score (0 to 1), predicted (1 if score >= cutoff), and ``carry``
    as the struct ``row``. Only the text enters the score; null, empty and blank texts get the bias, very long ones are read whole, repeated
    rows are scored alike. An empty table gives no rows. ``settings`` (sample_rows, shards, passes) go to ``train``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, **settings))
    held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words, w = Words(), shared.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                i, v = features(text, words)
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[i] @ v) + float(w[-1]))))))
            arrays = [batch.column("id"), pa.array(out, pa.float64()), *([batch.column("row")] if carry else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "score", *(["row"] if carry else [])])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    arrow_batches(spark)
    scored = rows.mapInArrow(score, schema)
    return scored.select(F.col("id").alias(id_col), (remainder(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), *(["row"] if carry else []))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns. Where ids are unique, rows go by id and no text is copied."""
    if ids_are_unique(docs, id_col):
        return without(docs, id_col, quality_scores(docs, labels, id_col, **settings).filter("predicted = 0").select(F.col(id_col).alias("id")), "quality-gone")
    return quality_scores(docs, labels, id_col, carry=docs.columns, **settings).filter("predicted = 1").select("row.*")

"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its hashed character n-grams.  On a bounded sample of
labelled rows the ratio of smoothed counts between the classes gives each n-gram
a factor; a logistic regression on the factored features gives the weights.
Only n-grams that occur in enough documents and tell the classes apart keep a
weight, so scoring is one table lookup for each n-gram of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: Labelled rows of each class that are fitted on, at most (in expectation).
TRAIN_DOCS = 3000
#: An n-gram counts only if so many sampled documents have it.
LEAST_DOCS = 4
#: Features that keep a weight: those whose counts differ most between the classes.
FEATURES = 1 << 13
THRESHOLD = 0.3
#: Code points that are hashed at a time, so that any length fits in memory.
BLOCK = 1 << 20
ROUNDS, RIDGE = 200, 1e-5


def grams(part: str) -> np.ndarray:
    """Hashed n-grams of a part of a lower-cased text, with repeats; letters as they are, anything else as a space."""
    points = common.code_points(part)
    points = np.where(common.categories()[points] == ord("L"), points, np.uint32(0x20))
    out, h = [], points.copy()
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ points[n - 1 :] * np.uint32(0x9E3779B1)
        if len(h) == 0:
            break
        if n in SIZES:
            mixed = h ^ (h >> np.uint32(16))
            mixed = mixed * np.uint32(0x85EBCA6B)
            out.append((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def parts(text: str) -> list[str]:
    """Overlapping parts of the lower-cased text between two spaces; every n-gram lies in one, and each part's n-grams in the text."""
    whole = f" {text.lower()} "
    if len(whole) <= BLOCK:
        return [whole]
    return [whole[i : i + BLOCK + max(SIZES) - 1] for i in range(0, len(whole), BLOCK)]


def features_of(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(grams(x)) for x in parts(text)]))


def training_rows(docs: DataFrame, labels: DataFrame, cap: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id``, ``text``, ``toxic``, ``share``: labelled rows that are not held out, at most about ``cap`` of each class."""
    known = labels.where(F.col("toxic").isin(0, 1) & (common.remainder("doc_id", 4) != 2)).select("doc_id", "toxic").distinct()
    chosen = common.sampled(known, "toxic", "doc_id", cap, 7)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the sample's size is bounded by cap


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights by bucket (0 for most) and the bias, from columns ``text``, ``toxic``, ``share``."""

    def counted(batches):
        """Documents of either class by n-gram, summed within the task."""
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, toxic in zip(common.as_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                sums[toxic, features_of(text)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0, at]), pa.array(sums[1, at])], ["gram", "clean", "toxic"])

    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"), "share")
    sizes = {r["toxic"]: (r["n"], r["share"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.min("share").alias("share")).collect()}
    weights = np.zeros(BUCKETS, np.float32)
    if len(sizes) < 2:
        rate = 0.98 if 1 in sizes else 0.02
        return weights, float(np.log(rate / (1 - rate)))
    counts = common.map_batches(rows.select("text", "toxic"), counted, "gram int, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).toPandas()  # BUCKETS rows at most
    p, q = (counts["toxic"].to_numpy() + 1.0) / (sizes[1][0] + 2.0), (counts["clean"].to_numpy() + 1.0) / (sizes[0][0] + 2.0)
    ratio = np.log(p / q)
    gain = np.abs(p - q) * np.abs(ratio)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen, ratio = counts["gram"].to_numpy()[best], ratio[best]
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def sparse(batches):
        for b in batches:
            found = [(x := place[features_of(text)])[x >= 0] for text in common.as_texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2)], ["grams", "toxic", "share"])

    sample = common.map_batches(rows, sparse, "grams array<int>, toxic int, share double").toPandas()
    y = sample["toxic"].to_numpy(float)
    length = sample["grams"].map(len).to_numpy()
    flat, row = np.concatenate(sample["grams"].to_list()).astype(np.int32), np.repeat(np.arange(len(y), dtype=np.int32), length)
    ratio = ratio.astype(np.float32)
    del sample
    scale = np.sqrt(max(1.0, (ratio[flat] ** 2).sum() / len(y)))  # mean square length 1: the step size is then safe
    w, bias = logistic(row, flat, ratio[flat] / scale, y, len(chosen))
    weights[chosen] = w * ratio / scale
    # the sample takes the classes at different rates; the prior goes back to that of all labelled rows
    return weights, float(bias + np.log(sizes[0][1] / sizes[1][1]))


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Nesterov's accelerated gradient."""
    n = len(y)
    w, bias, past, past_bias, rate = np.zeros(width), 0.0, np.zeros(width), 0.0, 2.0
    for t in range(ROUNDS):
        m = t / (t + 3)
        at, at_bias = w + m * (w - past), bias + m * (bias - past_bias)
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * at[column], n) + at_bias, -30, 30))) - y
        past, past_bias = w, bias
        w = at - rate * (np.bincount(column, value * error[row], width) / n + RIDGE * at)
        bias = at_bias - rate * error.mean()
    return w, bias


def table(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights by bucket."""
    out = np.zeros(BUCKETS, np.float32)
    out[at] = w
    return out


def probabilities(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    used, out = weight != 0, []
    for text in texts:
        hits = np.unique(np.concatenate([g[used[g]] for g in map(grams, parts(text))]))
        out.append(weight[hits].sum(dtype=np.float64))
    return 1 / (1 + np.exp(-np.clip(np.array(out, float) + bias, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for each row; null and empty texts get the score of no n-gram."""
    weights, bias = model
    kept = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), weights[kept]))

    def run(batches):
        weight = table(*shared.value)
        for b in batches:
            out = probabilities(common.as_texts(b.column(1)), weight, bias)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array((out >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def op7_toxicity_nbsvm(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    out = score(docs, fit(training_rows(docs, common.read(spark, sf_dir, "labels"))))
    return out.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    weights, bias = model
    kept = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), weights[kept]))

    def run(batches):
        weight = table(*shared.value)
        for b in batches:
            yield b.filter(pa.array(probabilities(common.as_texts(b.column(b.schema.get_field_index("text"))), weight, bias) < THRESHOLD))

    return common.map_batches(docs, run, docs.schema)

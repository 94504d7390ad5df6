"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams.  A document is
a mixture of languages: expectation-maximisation estimates the proportions from
the trigram likelihoods, and the set of languages grows only while the gain in
log likelihood exceeds a penalty for one more proportion (half the logarithm of
the number of trigrams, times ``PENALTY``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Hashed trigrams that a language model tells apart.
BUCKETS = 1 << 16
#: Labelled documents of each language that the models are fitted on, at most (in expectation).
TRAIN_DOCS = 3000
PENALTY = 2.0
SMOOTHING = 0.05
#: Code points that are counted at a time, so that any length fits in memory.
BLOCK = 1 << 20
MAX_ROUNDS = 40
UNKNOWN = "und"


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts by bucket over the whole lower-cased text, runs of non-letters folded to one space; None without a letter."""
    total, carry = None, np.zeros(1, np.uint32)
    for start in range(0, len(text), BLOCK):
        points = common.code_points(text[start : start + BLOCK].lower())
        letter = common.categories()[points] == ord("L")
        if total is None and not letter.any():
            continue
        points = np.where(letter, points, np.uint32(0))
        points = np.concatenate([carry, points])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
        points = points[keep]
        if start + BLOCK >= len(text) and points[-1]:
            points = np.append(points, np.uint32(0))
        if len(points) >= 3:
            mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
            mixed ^= mixed >> np.uint32(15)
            found = np.bincount(mixed % np.uint32(BUCKETS), minlength=BUCKETS)
            total = found if total is None else total + found
        carry = points[-2:]
    return total


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities by bucket, from columns ``lang`` and ``text``."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), common.as_texts(b.column("text")), strict=True):
                if (found := trigram_counts(text)) is not None:
                    sums[lang] = sums[lang] + found if lang in sums else found
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])

    counts = common.map_batches(labelled.select("lang", "text"), run, "lang string, gram int, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[i, own["gram"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def proportions(counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """The mixture's proportions by language; languages outside the selected set have 0."""
    at = np.flatnonzero(counts)
    n, logs = counts[at].astype(float), log_p[:, at]
    likely = np.exp(logs - logs.max(axis=0))
    size = n.sum()
    chosen = [int(np.argmax(logs @ n))]
    pi = np.ones(1)
    best = float(n @ np.log(likely[chosen[0]] + 1e-300))
    while len(chosen) < len(log_p):
        mix = pi @ likely[chosen] + 1e-300
        slope = (likely / mix) @ n / size
        slope[chosen] = 0
        new = int(np.argmax(slope))
        if slope[new] <= 1:  # no proportion of any other language raises the likelihood
            break
        trial, p = [*chosen, new], likely[[*chosen, new]]
        share = np.append(pi * 0.9, 0.1)
        for _ in range(MAX_ROUNDS):
            parts = share[:, None] * p
            parts /= parts.sum(axis=0) + 1e-300
            updated = parts @ n / size
            done = np.abs(updated - share).max() < 1e-4
            share = updated
            if done:
                break
        gained = float(n @ np.log(share @ p + 1e-300))
        if gained - best <= PENALTY * 0.5 * np.log(size + 1):
            break
        chosen, pi, best = trial, share, gained
    out = np.zeros(len(log_p))
    out[chosen] = pi
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``mixture`` for each row of ``docs``.

    Null text, and text without a letter: ``und`` with score 0.  Ties go to the
    language that sorts first.  Without any learned language all rows are
    ``und``.  Repeated rows are scored alike; other columns are ignored.
    """
    langs, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p.astype(np.float32))

    def run(batches):
        table = shared.value
        for b in batches:
            names, scores, mixtures = [], [], []
            for text in common.as_texts(b.column(1)):
                counts = trigram_counts(text) if langs else None
                if counts is None:
                    found = (UNKNOWN, 0.0, "")
                else:
                    pi = proportions(counts, table)
                    i = int(np.argmax(pi))
                    found = (langs[i], min(1.0, float(pi[i])), " ".join(f"{langs[k]}:{pi[k]:.3f}" for k in np.argsort(-pi, kind="stable") if pi[k] > 0))
                for into, x in zip((names, scores, mixtures), found, strict=True):
                    into.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.string())], ["doc_id", "lang_pred", "score", "mixture"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, mixture string")


def training_rows(docs: DataFrame, cap: int = TRAIN_DOCS) -> DataFrame:
    """The labelled rows that are not held out, at most about ``cap`` of each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.remainder("doc_id", 5) != 0)).select("doc_id", "lang", "text")
    return common.sampled(rows, "lang", "doc_id", cap, 1)


def op1_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "mixture")

"""Quality scores: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

Features of a text are its single words and pairs, and the shapes of single
words and of neighbours, with a mark where a word repeats its neighbour.  Each
is hashed to one of 2**18 places.  A feature's value is its share of the text
times :data:`SCALE`, so a score is a sparse dot product that does not depend on
length.  The learner keeps two sums for each place and sets small weights to 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.labelled import held_out, rate, sample
from archivolt.llm.tables import filter_texts, map_batches
from archivolt.llm.words import Words, mix, n_grams, shapes, stretches

BITS, SCALE = 18, 10.0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Place of every feature, and the text that it is in, sorted by text."""
    owner = words.owner()
    shape = shapes(words)
    two, at = n_grams(words, 2)
    same = (words.hash[at] == words.hash[at + 1]).astype(np.uint64) if len(at) else at.astype(np.uint64)
    parts = [
        (mix(words.hash + np.uint64(1)), owner), (two, owner[at]), (mix(shape + np.uint64(2)), owner),
        (mix(mix(shape[at] + same) + shape[at + 1] if len(at) else two), owner[at]),
    ]
    place = np.concatenate([p for p, _ in parts]) >> np.uint64(64 - BITS)
    owners = np.concatenate([o for _, o in parts])
    order = np.argsort(owners, kind="stable")
    return place[order].astype(np.int64), owners[order]


def learn(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> np.ndarray:
    """Weights, the bias last, from sparse rows ``(places, values)`` taken in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for (at, x), y in zip(texts, labels):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, per_class: int = 3000) -> np.ndarray:
    """Weights learnt in one task from a sample of at most ``per_class`` rows of either label; see :func:`labelled.sample`.

    The bias is moved from the sample's odds to those of all labels.  Without
    labelled rows all weights are 0.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            places, ys = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, words in stretches(batch.column(1)):
                at, owner = features(words)
                edges = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own, count = np.unique(at[edges[i]:edges[i + 1]], return_counts=True)
                    x = np.append(SCALE * count / max(1, count.sum()), 1.0)
                    rows.append((places[lo + i], ys[lo + i], np.append(own, 1 << BITS), x.astype(np.float32)))
        rows.sort(key=lambda r: r[:2])
        y = np.array([r[1] for r in rows], float)
        w = learn([r[2:] for r in rows], y)
        if len(y):
            w[-1] -= np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()])], ["w"])

    rows = sample(docs, labels, label, folds, fold, per_class)
    found, share = rows.repartition(1).mapInArrow(work, "w binary").collect(), rate(labels, label, folds, fold)
    w = np.frombuffer(found[0][0], np.float32).copy() if found else np.zeros((1 << BITS) + 1, np.float32)
    w[-1] += np.log(share / (1 - share))
    return w


def chances(w: np.ndarray, words: Words) -> np.ndarray:
    """The chance of label 1 of each text."""
    at, owner = features(words)
    texts = len(words.first) - 1
    total = np.bincount(owner, w[at], texts) / np.maximum(1, np.bincount(owner, minlength=texts))
    return 1 / (1 + np.exp(-np.clip(SCALE * total + w[-1], -30, 30)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every text: the chance of label 1.

    A text that is null, empty or blank has the bias' chance.  Repeated rows
    and equal texts score alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(1)):
            chance = chances(shared.value, words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(chance)], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a row without an id is held out."""
    found = score(docs, fit(docs, labels, label, folds, fold))
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return filter_texts(docs, lambda words: chances(shared.value, words) >= 0.5)

"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over overlapping windows.

A word's input is the vector of its hashed form beside the mean of the vectors
of its character features: its runs of three bytes, its first four and six and
its last four.  A window of :data:`WINDOW` words is read forwards and backwards
by gated recurrent units, attention pools the states, and a line gives the
window's logit.  A text's logit is a soft maximum over all its windows, so a few
words decide in a long text, and the label of a whole text is enough to learn
from.  Everything is numpy, learnt by Adam with gradients written out below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.labelled import held_out, sample
from archivolt.llm.tables import filter_texts, map_batches
from archivolt.llm.words import _BYTE, LOWER, Words, mix, ranges, span_hashes, stretches

WINDOW, STRIDE = 32, 24
WORDS, CHARS, WIDE, STATE = 1 << 13, 1 << 14, 8, 8
#: Sharpness of the soft maximum over windows.
SHARP = 2.0


@dataclass
class Inputs:
    """Table places of a run of words: one each for the word, several for its characters."""

    word: np.ndarray
    chars: np.ndarray
    first: np.ndarray  # chars[first[i]:first[i + 1]] belong to word i


def inputs(words: Words) -> Iterator[Inputs]:
    """The words' inputs, range by range."""
    for lo, hi in ranges(words):
        at = words.start[lo]
        raw = LOWER[words.raw[at:words.end[hi - 1]]]
        start, end = words.start[lo:hi] - at, words.end[lo:hi] - at
        values = _BYTE[raw]
        grams = mix(values[:-2] * np.uint64(3) + values[1:-1] * np.uint64(5) + values[2:] * np.uint64(7)) if len(raw) > 2 else values[:0]
        count = np.maximum(0, end - start - 2)
        edges = [span_hashes(values, a, b) + np.uint64(k) for k, (a, b) in enumerate((
            (start, np.minimum(start + 4, end)), (start, np.minimum(start + 6, end)), (np.maximum(end - 4, start), end)), 1)]
        first = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count + len(edges), out=first[1:])
        chars = np.empty(first[-1], np.uint64)
        for k, e in enumerate(edges):
            chars[first[:-1] + k] = mix(e)
        owner = np.repeat(np.arange(len(start)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        chars[first[owner] + len(edges) + inside] = grams[start[owner] + inside]
        yield Inputs((words.hash[lo:hi] % np.uint64(WORDS)).astype(np.int64), (chars % np.uint64(CHARS)).astype(np.int64), first)


def joined(parts: list[Inputs]) -> Inputs:
    """Inputs of consecutive ranges as those of one."""
    before = np.cumsum([0, *(p.first[-1] for p in parts)])
    first = np.concatenate([np.zeros(1, np.int64), *(p.first[1:] + n for p, n in zip(parts, before))])
    return Inputs(np.concatenate([p.word for p in parts]), np.concatenate([p.chars for p in parts]), first)


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before learning.  ``U`` and ``in`` hold update, reset and new state side by side."""
    draw = np.random.default_rng(seed)
    near = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
    gates = 3 * STATE
    return {
        "word": near(WORDS, WIDE) * 0.3, "char": near(CHARS, WIDE), "in": near(2 * WIDE, 2 * gates), "b": np.zeros(2 * gates, np.float32),
        "U0": near(STATE, gates), "U1": near(STATE, gates), "attend": near(2 * STATE), "out": near(2 * STATE), "bias": np.full(1, -2, np.float32),
    }


def project(p: dict[str, np.ndarray], x: Inputs) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all gates in both directions for each word, and the vectors before."""
    vectors = np.empty((len(x.word), 2 * WIDE), np.float32)
    vectors[:, :WIDE] = p["word"][x.word]
    if len(x.word):
        vectors[:, WIDE:] = np.add.reduceat(p["char"][x.chars], x.first[:-1]) / np.diff(x.first)[:, None].astype(np.float32)
    return vectors @ p["in"] + p["b"], vectors


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of all windows of the texts with words ``first[i]:first[i + 1]``, and their texts.

    Windows overlap by ``WINDOW - STRIDE`` words; the last ends with the text.
    A text without words has none.
    """
    n = np.diff(first)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), many)
    start = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return start, np.minimum(WINDOW, first[text + 1] - start), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(p: dict[str, np.ndarray], gates: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logits of windows of the projected words ``gates``; with ``keep`` also what learning needs."""
    many, wide = len(start), int(length.max())
    at = start + np.minimum(np.arange(wide)[:, None], length - 1)
    on = (np.arange(wide)[:, None] < length).astype(np.float32)[:, :, None]
    states = np.zeros((wide, many, 2 * STATE), np.float32)
    kept = []
    for way, order in enumerate((range(wide), range(wide - 1, -1, -1))):
        u, h, s = p[f"U{way}"], np.zeros((many, STATE), np.float32), slice(way * STATE, way * STATE + STATE)
        for t in order:
            x = gates[at[t], 3 * STATE * way:3 * STATE * (way + 1)]
            hu = h @ u
            zr = _sigmoid(np.clip(x[:, :2 * STATE] + hu[:, :2 * STATE], -15, 15))
            z, r = zr[:, :STATE], zr[:, STATE:]
            new = np.tanh(x[:, 2 * STATE:] + r * hu[:, 2 * STATE:])
            step = (1 - z) * (new - h) * on[t]
            if keep:
                kept.append((way, t, h, hu, z, r, new))
            h = h + step
            states[t, :, s] = h
    e = states @ p["attend"]
    e[on[:, :, 0] == 0] = -np.inf
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, states)
    logit = pooled @ p["out"] + p["bias"]
    return (logit, (at, on, states, kept, a, pooled)) if keep else logit


def backward(p: dict[str, np.ndarray], saved, d: np.ndarray, size: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters, and of the projected words, from those of the logits."""
    at, on, states, kept, a, pooled = saved
    grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    dc = d[:, None] * p["out"]
    da = np.einsum("bh,tbh->tb", dc, states)
    de = a * (da - (a * da).sum(axis=0))
    grad["attend"] = np.einsum("tb,tbh->h", de, states)
    ds = a[:, :, None] * dc + de[:, :, None] * p["attend"]
    dgates = np.zeros((size, 6 * STATE), np.float32)
    carry = [np.zeros((len(d), STATE), np.float32) for _ in range(2)]
    grad["U0"], grad["U1"] = np.zeros_like(p["U0"]), np.zeros_like(p["U1"])
    for way, t, h, hu, z, r, new in reversed(kept):
        dh = carry[way] + ds[t, :, way * STATE:(way + 1) * STATE]
        step = dh * on[t]
        dnew = step * (1 - z) * (1 - new * new)
        dz = -step * (new - h) * z * (1 - z)
        dr = dnew * hu[:, 2 * STATE:] * r * (1 - r)
        dx = np.concatenate((dz, dr, dnew), axis=1)
        dhu = np.concatenate((dz, dr, dnew * r), axis=1)
        grad[f"U{way}"] += h.T @ dhu
        carry[way] = dh - step * (1 - z) + dhu @ p[f"U{way}"].T
        np.add.at(dgates, (at[t], slice(3 * STATE * way, 3 * STATE * (way + 1))), dx)
    return grad, dgates


def soft_max(logit: np.ndarray, text: np.ndarray, texts: int, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of the windows' logits of each text, and each window's share of it."""
    high = np.full(texts, -np.inf)
    np.maximum.at(high, text, logit)
    part = np.exp(SHARP * (logit - high[text]))
    total = np.bincount(text, part, texts)
    none = total == 0
    return np.where(none, empty, high + np.log(np.where(none, 1, total)) / SHARP), part / total[text]


def learn(rows: list[tuple[Inputs, int]], steps: int = 1000, batch: int = 24, rate: float = 0.01, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters learnt from texts with labels, in an order that the seed fixes.

    Whole passes over the rows, as many as make up ``steps`` steps.
    """
    p, passes = fresh(), -(-steps // max(1, -(-len(rows) // batch)))
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    draw, step = np.random.default_rng(seed), 0
    for epoch in range(passes):
        order = draw.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = [rows[i] for i in order[lo:lo + batch]]
            y = np.array([r[1] for r in some], np.float32)
            chars = [r[0].first for r in some]
            shift = np.cumsum([0] + [f[-1] for f in chars])
            x = Inputs(
                np.concatenate([r[0].word for r in some]), np.concatenate([r[0].chars for r in some]),
                np.concatenate([f[:-1] + s for f, s in zip(chars, shift)] + [shift[-1:]]),
            )
            start, length, text = windows(np.cumsum([0] + [len(r[0].word) for r in some]))
            gates, vectors = project(p, x)
            logit, saved = forward(p, gates, start, length, keep=True)
            whole, share = soft_max(logit, text, len(some), 0.0)
            d = ((1 / (1 + np.exp(-whole)) - y)[text] * share / len(some)).astype(np.float32)
            grad, dgates = backward(p, saved, d, len(gates))
            grad["in"], grad["b"] = vectors.T @ dgates, dgates.sum(axis=0)
            dv = dgates @ p["in"].T
            grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(grad["word"], x.word, dv[:, :WIDE])
            count = np.diff(x.first)
            np.add.at(grad["char"], x.chars, np.repeat(dv[:, WIDE:] / count[:, None].astype(np.float32), count, axis=0))
            step += 1
            size = rate * min(1.0, 2 * (1 - epoch / passes)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in p:
                first_moment[k] += 0.1 * (grad[k] - first_moment[k])
                second_moment[k] += 0.001 * (grad[k] * grad[k] - second_moment[k])
                p[k] -= (size * first_moment[k] / (np.sqrt(second_moment[k]) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = 1000, longest: int = 1500) -> dict[str, np.ndarray]:
    """Parameters learnt in one task from a sample of at most ``per_class`` rows of either label.

    Texts of the sample with no words or more than ``longest`` are not learnt
    from; texts of any length are scored.  Without labelled rows the parameters
    stay as they begin.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            places, ys = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(1)):
                for _, _, words in stretches(pa.array([text.as_py()], pa.large_string())):
                    if 0 < len(words.hash) <= longest:
                        rows.append((places[i], ys[i], joined(list(inputs(words)))))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2].word)))
        p = learn([(x, y) for _, y, x in rows]) if rows else fresh()
        yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([v.tobytes() for v in p.values()], pa.binary())], ["name", "value"])

    rows = sample(docs, labels, label, folds, fold, per_class).repartition(1).mapInArrow(work, "name string, value binary").collect()
    shapes = {k: v.shape for k, v in fresh().items()}
    return {name: np.frombuffer(value, np.float32).reshape(shapes[name]) for name, value in rows} or fresh()


def text_logits(p: dict[str, np.ndarray], words: Words, at_once: int = 1024) -> np.ndarray:
    """The logit of each text: the soft maximum over all its windows."""
    texts = len(words.first) - 1
    start, length, text = windows(words.first)
    logit = np.empty(len(start))
    gates, base, lo = [], 0, 0
    # Windows are read as soon as their words are projected; a long text never lies projected in whole.
    done = 0
    held = np.empty((0, 6 * STATE), np.float32)
    for x in inputs(words):
        new, _ = project(p, x)
        held = np.concatenate((held, new)) if len(held) else new
        done += len(new)
        ready = np.searchsorted(start + length, done, "right") if done < len(words.hash) else len(start)
        while lo < ready:
            hi = min(lo + at_once, int(ready))
            logit[lo:hi] = forward(p, held, start[lo:hi] - base, length[lo:hi])
            lo = hi
        keep = int(start[lo]) if lo < len(start) else done
        held, base = held[keep - base:], keep
    return soft_max(logit, text, texts, float(p["bias"][0]))[0]


def chances(p: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """The chance of label 1 of each text."""
    return 1 / (1 + np.exp(-np.clip(text_logits(p, words).astype(float), -30, 30)))


def score(docs: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, score`` of every text: the chance of label 1.

    A text that is null, empty or blank has the chance of the bias alone.
    Repeated rows and equal texts score alike up to the rounding of single
    precision; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(chances(shared.value, words))], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a row without an id is held out."""
    found = score(docs, fit(docs, labels, label, folds, fold))
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return filter_texts(docs, lambda words: chances(shared.value, words) < 0.5)

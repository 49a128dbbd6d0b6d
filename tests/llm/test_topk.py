import math
import random

import numpy as np
import pytest

from archivolt.llm import topk


def _brute(rows, k, asks):
    whole = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(whole):
        if asks(i):
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(whole) if b != a)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def _rows(seed, n, dim, spread):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("block, questions", [(1 << 15, 1 << 10), (64, 8)])
def test_nearest_matches_brute_force(monkeypatch, frame, block, questions):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUESTIONS", questions)
    rows = _rows(1, 300, 12, 0.2) + [(i, [0.5] * 12) for i in range(300, 330)] + [(5, [0.5] * 12), (20, [0.1] * 12), (20, [0.1] * 12)]
    rows += [(400, None), (420, [None] * 12), (421, [float("nan")] * 12), (440, [float("inf")] + [0.0] * 11), (None, [0.5] * 12), (460, []), (480, [0.5]), (481, [1.0] * 14)]
    df = frame(rows, "vec_id long, embedding array<float>", extra=("row", "values", "score", "rank"))
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    got = topk.nearest(df, lambda v: v % 20 == 0, 7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _brute(rows, 7, lambda i: i % 20 == 0)


def test_few_and_no_candidates(frame):
    schema = "vec_id long, embedding array<float>"
    assert topk.nearest(frame([], schema, extra=()), lambda v: v % 20 == 0).collect() == []
    assert topk.nearest(frame([(20, [1.0])], schema, extra=()), lambda v: v % 20 == 0).collect() == []
    assert [tuple(r) for r in topk.nearest(frame([(20, [1.0]), (1, [-1.0])], schema, extra=()), lambda v: v % 20 == 0).collect()] == [(20, 1, 1, -4096)]


@pytest.mark.parametrize("high, levels", [(3, 64), (40, 64), (40, 4), (10**6, 64), (10**8, 8)])
def test_the_index_is_exact(high, levels):
    draw = np.random.default_rng(high)
    values = draw.integers(-high, high, (400, 9))
    values[::7] = values[0]
    index = topk.Index(np.arange(400)[::-1].copy(), values, levels)
    for i in (0, 1, 7, 399):
        for k in (1, 5, 500):
            rows, score = index.search(values[i], k, i, enough=2)
            exact = values @ values[i]
            want = sorted((-int(exact[j]), 399 - j) for j in range(400) if j != i)[:k]
            assert [(-int(s), int(index.ids[r])) for r, s in zip(rows, score)] == want


def test_many_queries_are_answered_together(monkeypatch):
    monkeypatch.setattr(topk, "BATCH", 16)
    values = np.random.default_rng(5).integers(-30, 30, (600, 8))
    values[::9] = values[0]
    index, own = topk.Index(np.arange(600), values), np.append(np.arange(0, 600, 20), -1)
    asks = values[own]
    got = {q: (rows.tolist(), score.tolist()) for q, rows, score in index.answers(asks, 5, own)}
    assert sorted(got) == list(range(len(own)))
    for q, skip in enumerate(own):
        best = sorted((-int(values[j] @ asks[q]), j) for j in range(600) if j != skip)[:5]
        assert got[q] == ([j for _, j in best], [-s for s, _ in best])


def test_a_query_far_larger_than_its_block_is_exact():
    values = np.array([[2**20 - i, i] for i in range(40)])
    rows, score = topk.Index(np.arange(40), values).search(np.array([2**41 + 1, 2**41]), 3)
    assert rows.tolist() == [0, 1, 2]
    assert score.tolist() == [(2**41 + 1) * (2**20 - i) + 2**41 * i for i in range(3)]


def test_vectors_are_not_copied_for_each_block_of_questions(monkeypatch, frame):
    for vectors in (10**5, 10**6, 10**8):
        blocks, parts = topk.layout(vectors, vectors // 20, 12)
        sheets = -(-vectors // 20 // topk.QUESTIONS)
        assert blocks * parts >= 12 or parts == sheets
        assert parts <= max(-(-sheets // topk.SHEETS), -(-12 * topk.WAVES // blocks))
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUESTIONS", 1)
    monkeypatch.setattr(topk, "WAVES", 0)
    df = frame(_rows(2, 300, 6, 0.2), "vec_id long, embedding array<float>", extra=())
    found = topk.nearest(df, lambda v: v % 20 == 0, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Each tile is dealt to a task by its number, and dealt once.
    assert plan.count("Exchange ") == 2 and plan.count("shufflepartitionidpassthrough(") == 1
    assert found.count() == 45

import math
import random

import numpy as np
import pytest

from archivolt.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"
NAMES = ("n", "component", "c", "deviation", "i", "line")


def _plain(rows, k):
    """Whitening by numpy's own eigenvectors, deviations in Python's whole numbers."""
    whole = [(i, [0.0 if x is None else float(np.float32(x)) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = max(len(e) for _, e in whole)
    x = [[math.floor(64 * c) + 1_000_000 for c in e + [0.0] * (width - len(e))] for _, e in whole]
    n, sums = len(x), [sum(v) for v in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    far = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    cov = far.T @ far / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, [i for i, _ in whole], deviation, far @ vectors / np.sqrt(values), values / np.trace(cov)


def _vectors(seed, n, dim):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 0.1 * (1 + d % 5)) + 3.0 for d in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("dim, k", [(1, 4), (2, 2), (12, 5), (40, 32)])
def test_matches_numpy(frame, dim, k):
    rows = _vectors(dim, 300, dim) + [(None, [0.5] * dim), (7, [0.25] * dim), (7, [0.25] * dim)]
    rows += [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] * dim)]
    got = whitening.whiten(frame(rows, SCHEMA, extra=NAMES), k).collect()
    n, ids, deviation, white, explained = _plain(rows, k)
    kept = min(k, dim)
    assert len(got) == n * kept and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert sorted({(r.component, round(r.explained, 9)) for r in got}) == [(j + 1, round(float(e), 9)) for j, e in enumerate(explained)]
    # Rows in any order, components up to their sign.
    key = lambda i: (i is None, i or 0)
    order = sorted(range(n), key=lambda r: (key(ids[r]), deviation[r]))
    table = {}
    for r in got:
        table.setdefault((key(r.vec_id), r.deviation), []).append((r.component, r.whitened))
    for j in range(kept):
        mine = [v for at in sorted(table) for c, v in sorted(table[at], key=lambda cv: (cv[0], round(cv[1], 6))) if c == j + 1]
        want = np.array([white[r][j] for r in order])
        sign = np.sign(np.dot(mine, want))
        assert np.allclose(np.array(mine) * sign, want, atol=1e-8)


def test_clusters_of_equal_eigenvalues():
    draw = np.random.default_rng(5)
    q, _ = np.linalg.qr(draw.normal(size=(30, 30)))
    values = np.array([5.0] * 6 + [5.0 - 1e-9] * 3 + [2.0] * 8 + [1.0] * 13)
    matrix = (q * values) @ q.T
    got, vectors = whitening.leading_components((matrix + matrix.T) / 2, 20)
    assert np.allclose(got, values[:20], atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-13)
    assert np.allclose(matrix @ vectors, vectors * got, atol=1e-12)


@pytest.mark.parametrize("matrix", [np.eye(7), np.diag([3.0, 1.0, 2.0, 0.0]), np.full((5, 5), 2.0), np.array([[2.0, 1.0], [1.0, 2.0]])])
def test_matrices_that_fall_apart(matrix):
    values, vectors = whitening.leading_components(matrix, len(matrix))
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(len(matrix)), atol=1e-13)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12)


def test_sturm_counts():
    draw = np.random.default_rng(1)
    d, e = draw.normal(size=20), draw.normal(size=19)
    e[7] = 0.0
    full = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 41)
    assert whitening.count_below(d, e, at).tolist() == [int((full < x).sum()) for x in at]


def test_flat_and_empty_tables(frame):
    assert whitening.whiten(frame([], SCHEMA, extra=NAMES)).collect() == []
    assert whitening.whiten(frame([(1, None), (2, [None])], SCHEMA, extra=NAMES)).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0])] * 5, SCHEMA, extra=NAMES)).collect() == []
    assert whitening.whiten(frame([(1, []), (2, [])], SCHEMA, extra=NAMES)).collect() == []
    # All vectors on one line: one component.
    got = whitening.whiten(frame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], SCHEMA, extra=NAMES)).collect()
    assert len(got) == 10 and all(r.component == 1 and abs(r.explained - 1) < 1e-9 for r in got)


def test_shorter_vectors_and_huge_entries(frame):
    rows = [(i, [float(i), float(i * i)]) for i in range(20)] + [(100, [5.0]), (101, [])]
    got = whitening.whiten(frame(rows, SCHEMA, extra=NAMES), 2).collect()
    n, _, deviation, _, _ = _plain(rows, 2)
    assert n == 22 and sorted({r.deviation for r in got}) == sorted(set(deviation))
    huge = rows + [(102, [3e38, 0.0]), (103, [1e15, 1.0])]
    got = whitening.whiten(frame(huge, SCHEMA, extra=NAMES), 2).collect()
    # 3e38 is no long and dropped; 1e15 is one, but its squares are none.
    assert {r.vec_id for r in got} == set(range(20)) | {100, 101, 103}
    assert all(r.deviation is None for r in got if r.vec_id == 103) and got[0].n == 23

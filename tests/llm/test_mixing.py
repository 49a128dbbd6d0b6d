import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.llm import mixing as m


def _targets(sizes):
    """Plain water filling: sources above three times their size are fixed until none is above."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(keys)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in keys if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    sources = [None, "", "a", "b", "é", "z", "Z", "tiny", "none"]
    out = [(i, "w " * draw.randrange(0, 400), sources[i % 7]) for i in range(400)]
    return out + [(500, "x y z", "tiny"), (501, None, "none"), (502, " \n", "none"), (3, out[3][1], out[3][2]), (3, out[3][1], out[3][2]), (None, "q " * 50, "a"), (None, "r " * 5000, "a")]


def test_targets_and_takings(docs, rows):
    got = m.taken(m.mix_sources(docs(rows))).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        size[s], taken[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = _targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1 + 0.002 * want[s]
    again = m.taken(m.mix_sources(docs(rows).repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_pieces_are_disjoint_parts_of_the_text(docs, rows):
    mixed = m.mix_sources(docs(rows), shards=5)
    for r in mixed.collect():
        by_turn = {}
        for p in r.pieces:
            by_turn.setdefault(p.turn, []).append((p.start, p.start + p["words"]))
            assert 0 <= p.shard < 5 and p["words"] > 0
        for spans in by_turn.values():
            spans.sort()
            assert spans[0][0] >= 0 and spans[-1][1] <= r["size"] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    rows_ = m.shard_rows(mixed).collect()
    words = np.bincount([r.shard for r in rows_], [r["words"] for r in rows_], 5)
    assert words.max() < 1.3 * words.min()


def test_mixed_documents(docs, rows):
    table = docs(rows)
    out = m.mixed_documents(table)
    assert out.columns == [c for c in table.columns if c != "size"] + ["size", "source_size", "target", "taken", "pieces"]
    taken = sorted((r.doc_id, r.taken) for r in m.taken(m.mix_sources(table)).collect() if r.taken and r.doc_id is not None)
    assert sorted((r.doc_id, r.taken) for r in out.collect() if r.doc_id is not None) == taken
    assert all(len(r.text.split()) == r["size"] for r in out.collect())


def test_users_columns_and_repeated_rows(frame):
    """Columns of the names used inside stay as they are; rows of one id and text have parts of their own."""
    text = lambda i, n: " ".join(f"w{i}_{k}" for k in range(n))
    rows = [(None, text(i, 20 + i % 7), "a") for i in range(150)] + [(7, text(999, 30), "a")] * 150 + [(i, text(i, 10), "b") for i in range(100, 140)]
    names = ("_key", "_number", "_own_key", "_own_number", "_row", "row", "begin", "order", "copies", "size")
    table = frame(rows, "doc_id long, text string, source string", extra=names)
    out = m.mixed_documents(table)
    assert out.columns == [c for c in table.columns if c != "size"] + ["size", "source_size", "target", "taken", "pieces"]
    got = out.collect()
    assert all(r[c] == "x" for r in got for c in names if c != "size")
    assert all(r["size"] == len(r.text.split()) and r.taken <= 3 * r["size"] for r in got)
    mixed = m.mix_sources(table)
    assert sorted(r.taken for r in got) == sorted(r.taken for r in m.taken(mixed).collect() if r.taken)
    # Each source's words come near its target, copies and rows without an id included.
    sums = {r.source_key: (r.t, r.target) for r in mixed.withColumn("t0", m._taken()).groupBy("source_key", "target").agg(F.sum("t0").alias("t")).collect()}
    assert all(abs(t - target) <= 2 for t, target in sums.values())


def test_empty_tables(docs):
    assert m.mix_sources(docs([])).collect() == []
    got = m.taken(m.mix_sources(docs([(1, None), (2, "")]))).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 5001])
def test_permutations(n):
    at = m.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
    assert sorted(at) == list(range(n))
    other = m.permuted(np.arange(n), np.full(n, n), np.full(n, 98, np.uint64))
    assert n < 10 or (at != other).any()


def test_the_tree_deals_out_every_draw():
    quotas = np.array([1000, 10, 0, 371])
    tree = m.Tree(quotas, 7, 3)
    leaves = [tree.leaf(s) for s in range(7)]
    ends = np.zeros(4, np.int64)
    for first, have in leaves:
        assert (first == ends).all() and (have >= 0).all()
        ends = first + have
    assert (ends == quotas).all()
    sizes = [have.sum() for _, have in leaves]
    assert max(sizes) - min(sizes) <= 3
    assert (m.Tree(quotas, 7, 3).edges() == tree.edges()).all() and (m.Tree(quotas, 7, 4).edges() != tree.edges()).any()

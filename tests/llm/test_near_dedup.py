import random

import numpy as np
import pytest

from archivolt.llm import near_dedup as nd
from archivolt.llm.components import components

VOCABULARY = ["w%d" % i for i in range(500)]


def _set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def _brute(rows, n, percent):
    sets = [_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        low = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), low, doc_id == low))
    return sorted(out, key=repr)


def _corpus(seed, bases, copies, words, edits):
    draw = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [draw.choice(VOCABULARY) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randrange(edits)):
                text[draw.randrange(words)] = draw.choice(VOCABULARY)
            rows.append(" ".join(text))
    ids = list(range(1000, 1000 + len(rows)))
    draw.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("n, percent, side", [(3, 85, 1 << 16), (5, 80, 1 << 16), (3, 85, 300)])
def test_groups_match_brute_force(monkeypatch, docs, n, percent, side):
    monkeypatch.setattr(nd, "SIDE", side)
    monkeypatch.setattr(nd, "PACK", min(side, nd.PACK))
    monkeypatch.setattr(nd, "BUNDLE", 64 * side)
    rows = _corpus(n, 3, 40, 60, 9) + _corpus(n + 1, 20, 2, 12, 3) + [
        (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a"), (7, "a b c"), (8, "a b c"), (8, "a b c"), (None, "a b c"), (9, "long " * 3000), (10, "long " * 2000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.groups(docs(rows), n, percent).collect()), key=repr)
    assert got == _brute(rows, n, percent)


def test_empty_table(docs):
    assert nd.groups(docs([]), 3, 85).collect() == []
    assert nd.without_copies(docs([])).collect() == []


def test_one_of_each_group_stays_with_all_columns(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "q r s t u v"), (5, "q r s t u v w x y z " * 3)]
    table = docs(rows)
    out = nd.without_copies(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [1, 3, 4, 5, None]


def test_each_row_stays_or_goes_with_its_own_group(docs):
    draw = random.Random(8)
    text = lambda: " ".join(draw.choice(VOCABULARY) for _ in range(30))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, text()) for _ in range(20)] + [(5, text()), (5, text())]
    # Row (7, a) goes and (7, b) stays; of the rows without an id one of d stays, and c's go.
    rows += [(1, a), (7, a), (7, b), (8, b.upper()), (None, c), (None, c), (3, c), (None, d), (None, d), (None, d + " end")]
    rows += [(4, None), (4, ""), (4, ""), (None, None), (None, " \n"), (None, "")]
    out = [(r.doc_id, r.text) for r in nd.without_copies(docs(rows)).collect()]
    want = rows[:22] + [(1, a), (7, b), (3, c)] + rows[-6:]
    extra = list(out)
    for row in want:
        extra.remove(row)
    assert len(extra) == 1 and extra[0] in [(None, d), (None, d + " end")]


def test_signatures_estimate_similarity_with_less_variance():
    draw = np.random.default_rng(3)
    agree = []
    for _ in range(300):
        x = draw.integers(0, 1 << 63, 330).astype(np.uint64)
        s = nd.super_minhash(np.concatenate((x[:300], x[30:])), np.array([0, 300, 600]), nd.PLACES)
        agree.append(np.mean(s[0] == s[1]))
    similarity = 270 / 330
    assert abs(np.mean(agree) - similarity) < 0.01
    assert np.std(agree) < np.sqrt(similarity * (1 - similarity) / nd.PLACES) * 1.02


@pytest.mark.parametrize("similarity, missed", [(0.85, 3e-9), (0.8, 4e-7)])
def test_bands_miss_few_pairs(similarity, missed):
    assert nd.PLACES % nd.ROWS == 0
    assert (1 - similarity**nd.ROWS) ** (nd.PLACES // nd.ROWS) < missed


def test_ranks_of_one_element_are_a_permutation():
    s = nd.super_minhash(np.array([12345], np.uint64), np.array([0, 1, 1]), nd.PLACES)
    assert sorted(np.floor(s[0])) == list(range(nd.PLACES)) and np.isinf(s[1]).all()


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame([(str(a).zfill(5), str(b).zfill(5)) for a, b in pairs] + [(None, "x"), ("y", "y")], "a string, b string").repartition(7)
    got = {r.node: r.root for r in components(df).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(str(a).zfill(5)), root(str(b).zfill(5))
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (str(a).zfill(5), str(b).zfill(5))}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from archivolt.llm import periodic_runs as pr


def _smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def _plain(words, least=24, copies=3):
    """All runs (start, period, length) by comparing every pair of places."""
    out, n = [], len(words)
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - i + q >= max(least, copies * q) and _smallest_period(words[i:e + q]) == q:
                out.append((i, q, e - i + q))
            i = e
    return sorted(out)


def _stitched(found, least=24, copies=3):
    out = {}
    for q, a, b in sorted(found):
        spans = out.setdefault(q, [])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return sorted((a, q, b - a + q) for q, spans in out.items() for a, b in spans if b - a + q >= max(least, copies * q))


def _texts(seed):
    """Word lists with runs inside runs, of many periods, beside noise."""
    draw = random.Random(seed)
    few = lambda n, k: [draw.randrange(k) for _ in range(n)]
    out = [few(draw.randrange(0, 400), draw.choice([1, 2, 3, 50])) for _ in range(12)]
    for _ in range(12):
        text = few(draw.randrange(30), 9)
        for _ in range(draw.randrange(1, 5)):
            unit = few(draw.randrange(1, 70), draw.choice([1, 2, 9]))
            text += unit * draw.randrange(1, 8) + unit[:draw.randrange(len(unit))] + few(draw.randrange(4), 9)
        out.append(text)
    inner = [1] * 30 + [2]
    out += [inner * 5, [3] * 700, ([1, 2] * 15 + [3]) * 6, list(range(300)) * 3, list(range(300)) * 3 + [299], [7] * 24, [7] * 23, list(range(8)) * 3, list(range(7)) * 3]
    return out


@pytest.mark.parametrize("tile", [16, 64, 1 << 12])
def test_tiles_and_stitching_match_plain_search(monkeypatch, tile):
    monkeypatch.setattr(pr, "TILE", tile)
    for seed in range(4):
        for words in _texts(seed):
            hashes = pr.mix(np.array(words, np.uint64) + np.uint64(1))
            assert _stitched(pr.fragments(hashes, 24, 3)) == _plain(words), (seed, words)


def test_tiles_see_their_own_words_only(monkeypatch):
    monkeypatch.setattr(pr, "TILE", 32)
    words = np.arange(500) % 37
    for m, periods, low, high, first, last in pr.tiles(500):
        assert high - low <= max(32, 4 * m) + 5 * m and low <= first < last <= high


def test_a_word_said_very_often_takes_linear_work():
    assert pr.fragments(np.ones(300_000, np.uint64), 24, 3).__len__() < 300
    assert _stitched(pr.fragments(np.ones(300_000, np.uint64), 24, 3)) == [(0, 1, 300_000)]


def _answer(doc, text, order=None):
    words = (text or "").encode().split()
    if order is not None and (moved := order(doc, len(words))) is not None:
        words = [words[i] for i in moved]
    runs = _plain(words)
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _rows(df):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def _wanted(rows, order=None):
    return sorted((_answer(*r, order) for r in rows), key=lambda r: tuple((v is None, v) for v in r))


EXTRA = ("start", "period", "length", "runs", "fragments", "plain", "doc_key", "best")


def test_documents_match_plain_search(frame):
    draw = random.Random(3)
    rows = [(i, draw.choice(["", "\t", " \n "]).join(["" if draw.random() < 0.1 else "", " ".join(f"w{w}" for w in words)])) for i, words in enumerate(_texts(9))]
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, "a b " * 40), (None, None), (503, "é ö " * 30), (503, "é ö " * 30), (503, "x " * 30), (504, "A a " * 30), (505, "x\x0by\x0c" * 20)]
    df = frame(rows, "doc_id long, text string", extra=EXTRA)
    assert _rows(pr.periodic_runs(df)) == _wanted(rows)


def test_the_planted_rule(frame):
    rows = [(i, " ".join(f"w{(j * j + i) % 97}" for j in range(30 + 5 * i))) for i in range(60)] + [(None, "a b c"), (7, "")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[:60])
    assert _rows(pr.periodic_runs(frame(rows, "doc_id long, text string", extra=EXTRA), order=pr.planted)) == _wanted(rows, pr.planted)


def test_long_documents_are_stitched(frame):
    unit = [f"u{i}" for i in range(1800)]
    rows = [(1, "a " * 30_000), (2, " ".join(unit * 9 + ["end"] + ["b", "c", "d"] * 4000)), (3, "x y " + " ".join(unit * 3))]
    got = {r.doc_id: r for r in pr.periodic_runs(frame(rows, "doc_id long, text string", extra=EXTRA)).collect()}
    runs = {i: [tuple(x) for x in r.runs] for i, r in got.items()}
    assert runs == {1: [(0, 1, 30_000)], 2: [(0, 1800, 16_200), (16_201, 3, 12_000)], 3: [(2, 1800, 5400)]}
    assert got[1].collapsed_sha256 == hashlib.sha256(b"a").hexdigest()


def test_empty_table_and_limits(frame):
    assert pr.periodic_runs(frame([], "doc_id long, text string", extra=EXTRA)).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(frame([], "doc_id long, text string"), least=10)

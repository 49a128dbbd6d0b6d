import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from archivolt.llm import language as lg

SCHEMA = "doc_id long, text string, lang string"
NAMES = ("score", "lang_pred", "bundle", "held_out", "source")


def _runs(text):
    """Runs of three letters or gaps of a text, by plain Python."""
    out, gap = [], True
    for c in " " + text.lower() + " ":
        if c.isalpha():
            out.append(ord(c))
            gap = False
        elif not gap or not out:
            out.append(0)
            gap = True
    return Counter(zip(out, out[1:], out[2:]))


def _vector(runs):
    total = np.zeros(lg.PLACES, np.int64)
    for run, n in runs.items():
        a, b, c = (lg.letter_vectors(np.array([x]))[0].astype(np.int64) for x in run)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


def _plain(rows):
    """The language of each row: profiles and cosines text by text."""
    out, bundles = [], defaultdict(lambda: np.zeros(lg.PLACES, np.int64))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 4 == 2
    for i, text, lang in rows:
        if not held(i) and text is not None and lang is not None:
            bundles[lang] += _vector(_runs(text))
    bundles = {k: v for k, v in bundles.items() if v.any()}
    for i, text, _ in rows:
        v = _vector(_runs(text or "")).astype(float)
        if not any(c.isalpha() for c in text or "") or not bundles:
            out.append((i, held(i), "und", 0.0))
            continue
        near = {k: round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u.astype(float))), 9) for k, u in bundles.items()}
        best = min(near, key=lambda k: (-near[k], k))
        out.append((i, held(i), best, min(1.0, max(0.0, near[best]))))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in lg.classify(df).collect()), key=str)


def _same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


WORDS = {"en": "the and of that with this house", "de": "der und das nicht über straße haus", "fr": "le la été maison où ça naïve", "ja": "日本語の文章です 東京"}


def _rows(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lang = draw.choice(list(WORDS))
        out.append((i, " ".join(draw.choice(WORDS[lang].split()) for _ in range(draw.randrange(1, 30))), lang))
    return out


ODD = [
    (1000, None, "en"), (1001, "", "en"), (1002, " \n\t", None), (1003, "123 -- 456!", "de"), (1004, "a", None), (None, "the house", "en"), (None, None, None),
    (1005, "the of", None), (1006, "İSTANBUL the house of the And", "en"), (3, "the house", "fr"), (1007, "x" * 50, ""), (1007, "x" * 50, ""),
]


def test_matches_plain_profiles(frame):
    rows = _rows(1, 60) + ODD
    _same(_got(frame(rows, SCHEMA, extra=NAMES)), _plain(rows))


def test_equal_profiles_go_by_code_point(frame):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[0], "one text", "zz"), (ids[1], "one text", "aa"), (ids[2], "one text", "ba"), (ids[3], "one", None)]
    assert {r[2] for r in _got(frame(rows, SCHEMA, extra=NAMES))} == {"aa"}


def test_nothing_to_learn(frame):
    assert _got(frame([], SCHEMA, extra=NAMES)) == []
    assert {r[2:] for r in _got(frame([(i, "the house", None) for i in range(8)], SCHEMA, extra=NAMES))} == {("und", 0.0)}


def test_long_texts_are_read_whole(frame):
    # The language shows in the last piece only; a text of one letter run has no gap to be cut at.
    tail = "der und das nicht über straße haus " * 60_000
    rows = _rows(2, 60) + [(2000, "1 " * 300_000 + "der und das", None), (2001, tail, None), (2002, "q" * (lg.BLOCK * 2 + 5), None)]
    got = {r[0]: r for r in _got(frame(rows, SCHEMA, extra=NAMES))}
    assert got[2000][2] == "de" and got[2001][2] == "de" and got[2002][2] != "und"
    one = _plain(rows[:60] + [(2001, tail[:35 * 100], None)])
    assert abs(got[2001][3] - next(r[3] for r in one if r[0] == 2001)) < 1e-2


@pytest.mark.parametrize("texts", [["abc", "", "--", "été déjà", "a" * 9], ["日本 語"], [""]])
def test_bundles_match_plain_sums(texts):
    got = lg.bundles(texts, np.arange(len(texts)), len(texts))
    assert np.array_equal(got, np.array([_vector(_runs(t)) for t in texts]))


def test_given_languages(spark):
    """Held-out texts of the given table are told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lg.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98

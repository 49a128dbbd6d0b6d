import random
import re

import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm import words as w

TEXTS = ["", None, " \t\n", "a", "A a", "é É x\x0by\x0cz", "ab " * 30, "x" * 5000 + " y", "漢 字 b", "..."]


def _plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


@pytest.mark.parametrize("stretch", [8, 64, 1 << 19])
def test_words_and_hashes(monkeypatch, stretch):
    monkeypatch.setattr(w, "STRETCH", stretch)
    hashes, seen, rows = {}, [], 0
    for lo, hi, words in w.stretches(pa.array(TEXTS * 2)):
        rows += hi - lo
        for i in range(hi - lo):
            a, b = words.first[i], words.first[i + 1]
            got = [bytes(words.raw[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])]
            assert got == _plain((TEXTS * 2)[lo + i])
            for word, h in zip(got, words.hash[a:b]):
                assert hashes.setdefault(_lower(word), h) == h
    assert rows == 2 * len(TEXTS) and len(set(hashes.values())) == len(hashes)


def test_a_slice_of_a_column():
    column = pa.array(["one two", "three", None, "four five six"]).slice(1, 3)
    assert [list(np.diff(words.first)) for _, _, words in w.stretches(column)] == [[1, 0, 3]]
    assert list(w.stretches(pa.array([], pa.string()))) == []


def test_n_grams_stay_inside_a_text():
    (_, _, words), = w.stretches(pa.array(["a b c", "b c", "", "c"]))
    grams, at = w.n_grams(words, 2)
    assert list(at) == [0, 1, 3] and grams[1] == grams[2] and grams[0] != grams[1]


def test_shapes():
    (_, _, words), = w.stretches(pa.array(["Abc Xyz abc A1 B22 a-b c-d a--b é"]))
    s = w.shapes(words)
    assert s[0] == s[1] != s[2] and s[3] == s[4] and s[5] == s[6] == s[7] and len(set(s)) == 5


def test_no_collisions_among_many():
    draw = random.Random(5)
    some = sorted({"".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9))) for _ in range(60000)})
    hashes = np.concatenate([words.hash for _, _, words in w.stretches(pa.array([" ".join(some)]))])
    assert len(np.unique(hashes)) == len(some)

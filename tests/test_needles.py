import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.operators import dialogue as dl, needles as nd


def _plain(texts, needles):
    return sorted((i, n) for i, t in texts if t for n in {n for n in needles if n} if n in t)


def _tables(spark, texts, needles):
    return spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")


def _got(df):
    return sorted((r.id, r.needle) for r in df.collect())


TEXTS = [(1, "the quick brown fox"), (2, "ñandú y 日本語 text"), (3, ""), (4, None), (5, "aaaaaaaaaaaa"), (6, "a"), (7, "the quick brown fox"), (8, "𝄞 clef and words 𝄞")]
NEEDLES = ["quick", "q", "the quick brown fox", "ñandú", "日本", "語", "aaa", "aaaaaaaaa", "a", "", None, "absent", "zzzzzzzzzzzz", "quick", "𝄞 c", "x f", "fox"]


def test_joined_needles_match_plain_search(spark):
    texts, needles = _tables(spark, TEXTS, NEEDLES)
    assert _got(nd.joined_needles(texts, needles, "id", "text", "needle")) == _plain(TEXTS, NEEDLES)
    assert _got(dl.holds_word(texts, needles, "id", "text", "needle")) == _plain(TEXTS, NEEDLES)
    assert _got(nd.joined_needles(texts, needles.limit(0), "id", "text", "needle")) == []
    assert _got(nd.joined_needles(texts.limit(0), needles, "id", "text", "needle")) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_and_frequent_pieces(spark, monkeypatch, seed):
    monkeypatch.setattr(nd, "HOT", 8)  # pieces of more than eight texts are divided
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abc ") for _ in range(n))
    texts = [(i, word(draw.randrange(40))) for i in range(200)]
    needles = [word(draw.randrange(1, 12)) for _ in range(300)]
    a, b = _tables(spark, texts, needles)
    assert _got(nd.joined_needles(a, b, "id", "text", "needle")) == _plain(texts, needles)


def test_a_million_needles(spark):
    """The answer is the automaton's; no needle is collected."""
    needles = spark.range(1_000_000).select(F.concat(F.lit("key"), F.conv(F.xxhash64("id").cast("string"), 10, 36)).alias("needle"))
    held = needles.filter(F.pmod(F.xxhash64("needle"), F.lit(5000)) == 0)
    texts = held.select(F.xxhash64("needle").alias("id"), F.concat(F.lit("so <"), "needle", F.lit("> key")).alias("text"))
    got = nd.joined_needles(texts, needles, "id", "text", "needle")
    want = dl.holds_word(texts, needles, "id", "text", "needle", most=1 << 40)
    assert _got(got) == _got(want) and len(_got(got)) >= held.count() > 100


def test_pieces_are_the_same_wherever_they_stand():
    a, b = nd.pieces_of("xxabcdyy", 4), nd.pieces_of("abcd", 4)
    assert b[0] in a and len(a) == 5 and len(np.unique(a)) == 5
    assert len(nd.pieces_of("abc", 4)) == 0


def test_pieces_of_many_texts_are_those_of_each(spark):
    texts = ["the quick brown fox", "", "a", "𝄞 clef", "aaaaaaaaaaaa", "the quick"]
    for length, own, of in nd._pieces(texts):
        assert sorted(zip(of.tolist(), own.tolist())) == sorted((i, h) for i, t in enumerate(texts) for h in nd.pieces_of(t, length).tolist())
        assert np.bincount(of, minlength=len(texts)).tolist() == [max(0, len(t) - length + 1) for t in texts]

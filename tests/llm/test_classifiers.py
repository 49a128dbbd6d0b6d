import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm import labelled, quality, toxicity
from archivolt.llm.words import stretches, words_of

DRAW = random.Random(11)
WORDS = ["".join(DRAW.choice("abcdefghij") for _ in range(DRAW.randrange(2, 7))) for _ in range(300)]
BAD = ["zorkel", "zorkify", "quux"]


def _text(n, bad=(), sign=""):
    words = [DRAW.choice(WORDS) + sign for _ in range(n)]
    for b in bad:
        words.insert(DRAW.randrange(n), b)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    docs, labels = [], []
    for i in range(300):
        toxic, good = i % 3 == 0, i % 4 != 0
        docs.append((i, _text(DRAW.randrange(20, 120), [DRAW.choice(BAD)] * 2 if toxic else (), "" if good else DRAW.choice(["***", "###"]))))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None), (901, ""), (902, " \n\t"), (903, "zorkel " + _text(9000)), (904, _text(9000)), (905, docs[3][1]), (3, docs[3][1]), (None, docs[3][1])]
    labels += [(3, 1, 1), (None, 1, 1), (4, None, None), (5, 7, -1), (77777, 1, 0)]
    return docs, labels


@pytest.fixture()
def labels(spark, rows):
    return spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, folds, fold", [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_accuracy_and_odd_rows(docs, rows, labels, module, label, folds, fold):
    got = module.classify(docs(rows[0]), labels).collect()
    assert len(got) == len(rows[0])
    truth = {i: (g, t)[label == "toxic"] for i, g, t in rows[1][:300]}
    held = [r for r in got if r.doc_id is not None and r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    score = {}
    for r in got:
        score.setdefault(r.doc_id, set()).add(round(r.score, 4))
    # Equal texts score alike, also without an id; texts without words too.
    assert score[905] == score[3] == score[None] and len(score[3]) == 1
    assert score[900] == score[901] == score[902]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_and_no_rows(spark, docs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.classify(docs([]), none).collect() == []
    assert len(module.classify(docs([(1, "a b"), (2, None)]), none).collect()) == 2


def test_filters_keep_columns(docs, rows, labels):
    table = docs(rows[0])
    kept = quality.good_only(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.classify(table, labels).collect() if r.predicted == 1}


def test_a_sparse_dot_product_is_the_mean_of_weights():
    w = np.random.default_rng(0).standard_normal((1 << quality.BITS) + 1).astype(np.float32)
    (_, _, words), = stretches(pa.array(["a b a", "", "c"]))
    at, owner = quality.features(words)
    plain = [quality.SCALE * np.mean(w[at[owner == i]]) + w[-1] if (owner == i).any() else w[-1] for i in range(3)]
    assert np.allclose(quality.chances(w, words), 1 / (1 + np.exp(-np.array(plain))), atol=1e-6)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        start, length, text = toxicity.windows(np.array([0, n]))
        covered = {k for s, m in zip(start, length) for k in range(s, s + m)}
        assert covered == set(range(n)) and all(m <= toxicity.WINDOW for m in length)
        assert all(b == a + toxicity.STRIDE for a, b in zip(start, start[1:])) and (n > 0) == (len(start) > 0)


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    gates = draw.standard_normal((12, 6 * toxicity.STATE))
    start, length, d = np.array([0, 4, 7]), np.array([5, 6, 2]), np.array([0.3, -1.0, 0.5])
    f = lambda: float(toxicity.forward(p, gates, start, length) @ d)
    _, saved = toxicity.forward(p, gates, start, length, keep=True)
    grad, dgates = toxicity.backward(p, saved, d, len(gates))
    for name, at in [("U0", (1, 2)), ("U1", (3, 17)), ("attend", 5), ("out", 9), ("bias", 0), (None, (5, 3)), (None, (8, 40))]:
        where, own = (gates, dgates[at]) if name is None else (p[name], grad[name][at])
        old = where[at]
        where[at] = old + 1e-4
        high = f()
        where[at] = old - 1e-4
        low = f()
        where[at] = old
        assert abs((high - low) / 2e-4 - own) < 2e-3


def test_a_long_text_scores_as_in_one_piece(monkeypatch):
    from archivolt.llm import words as w

    p = toxicity.fresh()
    texts = pa.array([_text(700, ["quux"]), "", _text(3)])
    (_, _, words), = stretches(texts)
    whole = toxicity.text_logits(p, words)
    monkeypatch.setattr(w, "STRETCH", 300)
    assert np.allclose(whole, toxicity.text_logits(p, words, at_once=5), atol=1e-5)


def test_an_id_that_repeats_is_one_row_of_the_sample(docs, frame):
    """The sample is bounded by rows: of the texts of one id the smallest is learnt from."""
    rows = [(4, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(10, 40)] + [(41, None)]
    labels = frame([(4, 1, 1)] + [(i, i % 2, i % 2) for i in range(10, 42)], "doc_id long, quality int, toxic int", extra=("text",))
    got = labelled.sample(docs(rows), labels, "quality", 10_000, 9_999, 10).collect()
    assert len(got) <= 20 and len({(r.doc_id, r.label) for r in got}) == len(got)
    every = labelled.sample(docs(rows), labels, "quality", 10_000, 9_999, 1000).collect()
    assert sorted((r.doc_id, r.text) for r in every if r.doc_id in (4, 41)) == [(4, "text 0"), (41, None)]


def test_texts_of_several_ranges_are_learnt_from():
    """Words longer than a range give the inputs that they give in one piece."""
    text = " ".join(["a" * 300_000, "bc", "d" * 400_000, "efg hij"]).encode()
    words = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    parts = list(toxicity.inputs(words))
    whole = toxicity.joined(parts)
    assert len(parts) > 1 and len(whole.word) == len(words.hash) == 5 and whole.first[-1] == len(whole.chars)
    at = 0
    for p in parts:
        for i in range(len(p.word)):
            assert whole.word[at] == p.word[i] and (whole.chars[whole.first[at]:whole.first[at + 1]] == p.chars[p.first[i]:p.first[i + 1]]).all()
            at += 1

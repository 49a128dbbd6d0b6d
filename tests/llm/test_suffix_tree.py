import collections
import math
import random
import zlib

import numpy as np
import pytest

from archivolt.llm import suffix_tree as st


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    follow = {w: [draw.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    out = []
    for i in range(500):
        w, words = draw.choice("abcdefghij"), []
        for _ in range(draw.randrange(0, 60)):
            words.append(w if draw.random() < 0.9 else w.upper())
            # The next word hangs on this one, at times on the one before.
            w = follow[w][len(words) % 2] if draw.random() < 0.8 else draw.choice("abcdefghij")
        if draw.random() < 0.2:
            words.append("rare%d" % i)
        out.append((i, " ".join(words)))
    return out + [(900, None), (901, ""), (902, " \n"), (7, out[7][1]), (7, out[7][1]), (None, "a b never seen"), (903, "a b " * 20000)]


def _tokens(text):
    return (text or "").lower().split() + [None]


def test_base_scores_and_gain(docs, rows):
    got = st.scored(docs(rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in _tokens(t))
    n, v = sum(count.values()), len(count)
    text = {i: t for i, t in rows}
    for r in got:
        tokens = _tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)  # log probabilities are negative
    assert len({(r.doc_id, r.score) for r in got if r.doc_id == 7}) == 1


def test_distributions_sum_to_one_and_match_a_plain_reading(spark, docs, rows):
    table = docs(rows)
    counts = st.counted(table, lambda words: st.with_ends(words)[0])
    model, candidates = st.fit(table.select("text"), counts)
    assert len(model.contexts[0]) > 3 and len(model.contexts[1]) > 3
    known = np.arange(len(model.words))
    unseen = 1 / (model.tokens + model.kinds + 1)
    for state in range(len(model.parent)):
        own = np.exp(st._log_p(model, np.full(len(known), state), known)).sum()
        rest, at = unseen, state
        while at:
            rest, at = rest * 10 ** model.rest[at], model.parent[at]
        # Words too rare for the table share what is left.
        other = model.kinds - len(known)
        assert own + rest <= 1 + 1e-9 and (other or own + rest == pytest.approx(1))
    assert (model.parent[1:] < np.arange(1, len(model.parent))).all()


def test_scores_follow_the_longest_state():
    model = st.Model(8, 2, np.array([1, 2], np.uint64), np.array([5, 3]))
    st.grow(model, np.zeros(2, np.int64), np.array([50.0, 40.0]), np.array([0, 1, (1 << 32) + 0]), np.array([1, 49, 40]), np.arange(2))
    candidates = [np.array([0, 1])]
    word, first = np.array([0, 1, 0, -1]), np.array([0, 4])
    got = model.score(word, first, candidates)
    base = np.log10((model.counts + 1) / 11)
    assert got[0] == pytest.approx(base[0])
    assert got[1] == pytest.approx(np.log10((49 + 3 * 10 ** base[1]) / 53))
    assert got[2] == pytest.approx(np.log10((40 + 2 * 10 ** base[0]) / 42))
    assert got[3] == pytest.approx(np.log10(3 / 53))


def test_empty_table_and_no_training(docs):
    assert st.scored(docs([])).collect() == []
    (row,) = st.scored(docs([(None, "a b")])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_counts_of_many_tasks_and_small_stores(monkeypatch, docs, rows):
    table = docs(rows)
    keys = lambda words: st.with_ends(words)[0]
    whole = {tuple(r) for r in st.counted(table, keys).collect()}
    monkeypatch.setattr(st, "HELD", 8)
    assert {tuple(r) for r in st.counted(table, keys).collect()} == whole


def _plain_scores(rows, least=2, depth=st.DEPTH):
    """Score of each row by a plain reading of the module's rule."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    texts = [_tokens(t) for _, t in rows]
    train = [t for (i, _), t in zip(rows, texts) if not held(i)]
    count = collections.Counter(w for t in train for w in t)
    total = sum(count.values()) + len(count) + 1
    runs = collections.Counter(tuple(t[i - k:i + 1]) for t in train for i in range(len(t)) for k in range(depth + 1) if i >= k)
    follow = collections.defaultdict(dict)
    for run, n in runs.items():
        if len(run) > 1 and n >= least:
            follow[run[:-1]][run[-1]] = n
    states = {}

    def p(s, w):
        while s and s not in states:
            s = s[1:]
        if not s:
            return (count[w] + 1) / total
        m, rest, c = states[s]
        return (follow[s].get(w, 0) + (m + rest) * p(s[1:], w)) / (c + m)

    for s in sorted(follow, key=len):
        c, kept, seen = runs[s], len(follow[s]), sum(follow[s].values())
        q = {w: p(s[1:], w) for w in follow[s]}
        divergence = sum(n / c * math.log(n / c / q[w]) for w, n in follow[s].items())
        other_p, other_q = 1 - seen / c, 1 - sum(q.values())
        if other_p > 1e-12 and other_q > 1e-12:
            divergence += other_p * math.log(other_p / other_q)
        if 2 * c * divergence > kept + 4 * math.sqrt(2 * kept):
            states[s] = (kept + 1, c - seen, c)
    return [sum(math.log10(p(tuple(t[max(0, i - depth):i]), w)) for i, w in enumerate(t)) for t in texts], states


@pytest.mark.parametrize("size", [1 << 22, 2000])
def test_rare_contexts_count_in_a_corpus_of_any_size(monkeypatch, docs, rows, size):
    # Contexts that occur a few times among 50,000 tokens, and a word that only two words before foretell.
    table = rows + [(2000 + i, "x y z " + "a" * i) for i in range(5)] + [(3000 + i, "m n o" if i % 2 else "r n s") for i in range(20)]
    monkeypatch.setattr(st, "RANGE", size)
    want, states = _plain_scores(table)
    assert ("x",) in states and ("m", "n") in states and ("r", "n") in states
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in st.scored(docs(table)).collect()))
    plain = sorted((i is None, i or 0, len(_tokens(t)), s) for (i, t), s in zip(table, want))
    assert [g[:3] for g in got] == [w[:3] for w in plain]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in plain], rel=1e-9)

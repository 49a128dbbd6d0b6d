import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from archivolt.llm import token_counts as tc

SMALL = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.0), ("ba", -1.5), ("abab", -4.0), ("é", -2.0)]
FLOAT = [("<unk>", 0.0), ("▁", -2.3), *[(x, -0.1 * len(x) - 1.7) for x in ("a", "b", "ab", "ba", "aba", "bb", "▁b", "é漢")]]


def _library(pieces, byte_fallback):
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def _texts():
    draw = random.Random(1)
    signs = "ab é漢▁ \n<0x>A語𝕏\t'"
    return ["".join(draw.choice(signs) for _ in range(draw.randrange(30))) for _ in range(1500)] + ["", " ", "\n", "▁▁", "<0x0A>", "ab" * 3000]


@pytest.mark.parametrize("pieces, byte_fallback", [(SMALL, False), (FLOAT, False), (None, True)])
def test_counts_match_the_library(pieces, byte_fallback):
    pieces = pieces or tc.vocabulary()
    counter, library = tc.Counter(pieces), _library(pieces, byte_fallback)
    assert [t for t in _texts() if counter.text(t) != library(t)] == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    counter, other = tc.Counter(SMALL), tc.Counter(SMALL)
    for text in _texts()[:200]:
        assert counter.text(text) == other.text(text) and len(counter.known) <= 3


def test_rows(docs):
    library = _library(tc.vocabulary(), True)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello world"), (4, "Hello world"), (None, "x"), (5, "long text " * 20000)]
    got = sorted(((r.doc_id, r.n_tokens) for r in tc.token_counts(docs(rows), tc.vocabulary()).collect()), key=repr)
    assert got == sorted(((i, library(t)) for i, t in rows), key=repr)
    assert tc.token_counts(docs([]), tc.vocabulary()).collect() == []

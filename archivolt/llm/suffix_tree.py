"""Language model scores by a probabilistic suffix tree over words.

A state of the tree is a context: the last one or more words.  Contexts that
occur :data:`LEAST` times or more in the training texts are candidates; one is
retained if its next-word distribution diverges from that of its longest
retained suffix by more than chance explains.  A state keeps the counts of next
words that follow it :data:`LEAST` times or more; what else follows is left to
its suffix.  A token is scored by the longest suffix of what stands before it
that is a state:

    P(w | s) = (c(s w) + (m + rest(s)) P(w | suffix of s)) / (c(s) + m)

with c(s w) 0 where it is not kept, rest(s) the tokens after s that are not
kept, m one more than the number of kept words; without a suffix the base
distribution (c(w) + 1) / (N + V + 1).  Each P sums to 1 over the V known words
and the unknown.

Both limits are counts, the same for a corpus of any size, so the tree grows
with the corpus and no task holds it.  Texts are put in parts of about
:data:`PART` tokens.  Level by level, a part asks for the counts of its distinct
runs of words and for what the tree knows of its contexts; questions are dealt
by ranges of hashes, added up there, and answered to the parts that asked
(:func:`_answered`).  A run is asked for only where the two runs one word
shorter occur often enough, so nothing that counts is passed over.  :func:`fit`
makes the same tree in memory, of tables that fit there.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.labelled import held_out
from archivolt.llm.near_dedup import checkpoint
from archivolt.llm.tables import as_long
from archivolt.llm.words import Words, mix, stretches

#: How often a context, and a word after it, must occur; words of the longest context.
LEAST, DEPTH = 2, 2
#: The end of a text as a token.
END = np.uint64(0x5851F42D4C957F2D)
#: Distinct keys that a task holds before it passes its counts on.
HELD = 1 << 21
#: Tokens of a part; a longer text is a part of its own.
PART = 1 << 21
#: Tokens of the corpus for each range of hashes.
RANGE = 1 << 22


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts: their words and an end each; and where each text's begin."""
    texts = len(words.first) - 1
    first = words.first + np.arange(texts + 1)
    tokens = np.full(first[-1], END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[first[1:] - 1] = False
    tokens[inner] = words.hash
    return tokens, first


def counted(docs: DataFrame, keys) -> DataFrame:
    """``key, n``: how often each number that ``keys`` makes of a stretch's words occurs; counted in each task, then added up."""
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts))
        key, place = np.unique(key, return_inverse=True)
        return key, np.bincount(place, n, len(key)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, words in stretches(batch.column(0)):
                parts.append(np.unique(keys(words), return_counts=True))
                size += len(parts[-1][0])
                if size > HELD:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([as_long(parts[0][0]), pa.array(parts[0][1])], ["key", "n"])
                        parts, size = [], 0
        if size:
            key, n = merged(parts)
            yield pa.RecordBatch.from_arrays([as_long(key), pa.array(n)], ["key", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of keys and counts, sorted by key as unsigned numbers."""
    table = counts.select("key", "n").toArrow()
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], table.column("n").to_numpy()[order]


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where it lacks them."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    """Words, states and kept counts, as sorted arrays.

    State 0 is the root.  ``contexts[d]`` holds the sorted keys of the retained
    contexts of ``d + 1`` words, ``states[d]`` their numbers.  A context's key is
    its suffix context's number among the candidates of its level times 2**32,
    plus the place of its earliest word.
    """

    tokens: int
    kinds: int
    words: np.ndarray
    counts: np.ndarray
    contexts: list[np.ndarray] = field(default_factory=list)
    states: list[np.ndarray] = field(default_factory=list)
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(1))  # log10 of the part left to the suffix
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # state * 2**32 + word
    logs: np.ndarray = field(default_factory=lambda: np.empty(0))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.kinds + 1.0))

    def contexts_of(self, word: np.ndarray, first: np.ndarray, tables: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """For each depth, the place of what precedes each token among that depth's contexts, -1 where it is none."""
        out, key = [], None
        start = np.repeat(first[:-1], np.diff(first))
        for d, table in enumerate(self.contexts if tables is None else tables):
            earlier = np.full(len(word), -1)
            earlier[d + 1:] = word[:len(word) - d - 1]
            earlier[np.arange(len(word)) - d - 1 < start] = -1
            key = earlier if d == 0 else np.where((out[-1] >= 0) & (earlier >= 0), (out[-1] << 32) + earlier, -1)
            found = np.full(len(word), -1)
            some = np.flatnonzero(key >= 0)
            found[some] = find(table, key[some])
            out.append(found)
        return out

    def score(self, word: np.ndarray, first: np.ndarray, candidates: list[np.ndarray]) -> np.ndarray:
        """log10 P of each token; of a word that is not in the table only what its states leave to the base."""
        state = np.zeros(len(word), np.int64)
        for d, place in enumerate(self.contexts_of(word, first, candidates)):
            some = np.flatnonzero(place >= 0)
            own = find(self.contexts[d], place[some])
            state[some[own >= 0]] = self.states[d][own[own >= 0]]
        out = np.zeros(len(word))
        left = np.flatnonzero(state)
        while len(left):
            at = find(self.keys, (state[left] << 32) + np.where(word[left] >= 0, word[left], (1 << 32) - 1))
            hit = at >= 0
            out[left[hit]] += self.logs[at[hit]]
            state[left[hit]] = -1
            left = left[~hit]
            out[left] += self.rest[state[left]]
            state[left] = self.parent[state[left]]
            left = left[state[left] > 0]
        open_ = np.flatnonzero((state == 0) & (word >= 0))
        out[open_] += self.base(self.counts[word[open_]])
        return out


def _log_p(model: Model, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log of P(word | state) for known words."""
    out, state = np.zeros(len(word)), state.copy()
    left = np.arange(len(word))
    while len(left):
        inner = left[state[left] > 0]
        root = left[state[left] == 0]
        out[root] += model.base(model.counts[word[root]])
        at = find(model.keys, (state[inner] << 32) + word[inner])
        out[inner[at >= 0]] += model.logs[at[at >= 0]]
        left = inner[at < 0]
        out[left] += model.rest[state[left]]
        state[left] = model.parent[state[left]]
    return out * np.log(10)


def grow(model: Model, suffix: np.ndarray, context_count: np.ndarray, keys: np.ndarray, n: np.ndarray, context_keys: np.ndarray) -> None:
    """Adds the retained contexts of one level to the model.

    ``suffix[i]`` is the state that candidate ``i`` would leave its tokens to;
    ``keys`` hold a candidate's place times 2**32 plus a next word, ``n`` how often.
    """
    context, word = keys >> 32, keys & ((1 << 32) - 1)
    size = len(suffix)
    kept = np.bincount(context, minlength=size)
    seen = np.bincount(context, n, size)
    q = np.exp(_log_p(model, suffix[context], word)) if len(keys) else np.empty(0)
    p = n / context_count[context]
    other_p, other_q = 1 - seen / np.maximum(1, context_count), 1 - np.bincount(context, q, size)
    other = np.where((other_p > 1e-12) & (other_q > 1e-12), other_p * np.log(np.maximum(other_p, 1e-300) / np.maximum(other_q, 1e-300)), 0.0)
    divergence = np.bincount(context, p * np.log(p / q) if len(p) else p, size) + other
    # Twice the count times the divergence is chi-squared with one degree for each kept word where nothing diverges.
    retained = (kept > 0) & (2 * context_count * divergence > kept + 4 * np.sqrt(2 * kept))
    number = np.cumsum(retained) + len(model.parent) - 1
    m = kept + 1.0
    rest = (m + context_count - seen) / (context_count + m)
    some = retained[context]
    c, w = context[some], word[some]
    log_p = np.log10((n[some] + rest[c] * (context_count[c] + m[c]) * q[some]) / (context_count[c] + m[c]))
    new = (number[c] << 32) + w
    order = np.argsort(new)
    model.parent = np.concatenate((model.parent, suffix[retained]))
    model.rest = np.concatenate((model.rest, np.log10(rest[retained])))
    model.keys, model.logs = np.concatenate((model.keys, new[order])), np.concatenate((model.logs, log_p[order]))
    model.contexts.append(np.flatnonzero(retained))
    model.states.append(number[retained])


def fit(train: DataFrame, counts: DataFrame, depth: int = DEPTH) -> tuple[Model, list[np.ndarray]]:
    """The tree learnt from all of ``train``'s texts with their word ``counts``, and the candidates of each level.

    It is held in memory, so this is for small corpora; :func:`scored` holds a
    tree of any size in parts and gives the same scores.
    """
    spark = train.sparkSession
    tokens, kinds = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    words, count = _table(counts.where((F.col("n") >= LEAST) | (F.col("key") == int(END.view(np.int64)))))
    model, candidates = Model(tokens, kinds, words, count), []
    place = np.flatnonzero(count >= LEAST)
    keys, size = place, count[place]
    for d in range(depth):
        candidates.append(keys)
        shared = spark.sparkContext.broadcast((model, list(candidates)))

        def followers(words_: Words) -> np.ndarray:
            model, candidates = shared.value
            tokens, first = with_ends(words_)
            word = find(model.words, tokens)
            context = model.contexts_of(word, first, candidates)[-1]
            some = np.flatnonzero((context >= 0) & (word >= 0))
            return (context[some] << 32) + word[some]

        pairs = checkpoint(counted(train, followers).where(F.col("n") >= LEAST))
        both, n = _table(pairs)
        both = both.view(np.int64)
        if d == 0:
            suffix = np.zeros(len(keys), np.int64)
        else:
            suffix = _state_of(model, candidates, d - 1, keys >> 32)
        grow(model, suffix, size.astype(float), both, n, keys)
        if d + 1 < depth:
            # Next level: word pairs (earlier, context) frequent enough to be contexts themselves.
            keys, size = _extended(model, candidates, both, n, d)
    return model, candidates


def _state_of(model: Model, candidates: list[np.ndarray], level: int, place: np.ndarray) -> np.ndarray:
    """The state of each candidate of a level, or that of its longest suffix."""
    own = find(model.contexts[level], place)
    out = np.where(own >= 0, model.states[level][np.maximum(own, 0)] if len(model.states[level]) else 0, 0)
    if level:
        up = _state_of(model, candidates, level - 1, candidates[level][place] >> 32)
        out = np.where(own >= 0, out, up)
    return out


def _extended(model: Model, candidates: list[np.ndarray], both: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the contexts one word longer, from the counts of contexts with their next words.

    Context ``e c`` of ``d + 2`` words occurs as often as its first ``d + 1``
    words are followed by its last, so the counts at hand suffice.
    """
    context, last, size = both >> 32, both & ((1 << 32) - 1), n
    # Words of the context, earliest first.
    chain = []
    place = context
    for level in range(d, 0, -1):
        key = candidates[level][place]
        chain.append(key & ((1 << 32) - 1))
        place = key >> 32
    chain.append(candidates[0][place])
    chain.append(last)
    # The suffix context: all words but the earliest, built from the last one back.
    suffix = find(candidates[0], chain[-1])
    for k in range(1, d + 1):
        earlier = chain[-1 - k]
        suffix = np.where(suffix >= 0, find(candidates[k], (suffix << 32) + earlier), -1)
    good = suffix >= 0
    keys = (suffix[good] << 32) + chain[0][good]
    order = np.argsort(keys)
    return keys[order], size[good][order]


def _settled(df: DataFrame) -> DataFrame:
    """A checkpoint that has its shuffle files gone before the next stage writes its own.

    PySpark hands dropped references on once a second; the collector of the
    driver's JVM comes after them.
    """
    out = checkpoint(df)
    del df
    gc.collect()
    time.sleep(1.1)
    out.sparkSession._jvm.System.gc()
    return out


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    if not packed:
        return np.empty(0, kind)
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


_PIECE = "part long, tokens long, word binary, first binary, keys binary, doc_id array<long>, train array<boolean>"


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each part: its tokens as places in the sorted hashes of its words, where texts begin, their ids and folds."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        tokens, lengths, ids, train, size = [], [], [], [], 0

        def piece() -> pa.RecordBatch:
            keys, word = np.unique(np.concatenate(tokens), return_inverse=True)
            first = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
            values = [part, size, _pack(word.astype(np.int32)), _pack(first), _pack_keys(keys), pa.concat_arrays(ids).to_pylist(), pa.concat_arrays(train).to_pylist()]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            names = ["part", "tokens", "word", "first", "keys", "doc_id", "train"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            for lo, hi, words in stretches(batch.column(1)):
                token, first = with_ends(words)
                if size and size + len(token) > PART:
                    yield piece()
                    part += 1
                    tokens, lengths, ids, train, size = [], [], [], [], 0
                tokens.append(token)
                lengths.append(np.diff(first))
                ids.append(batch.column(0).slice(lo, hi - lo))
                train.append(batch.column(2).slice(lo, hi - lo))
                size += len(token)
        if size:
            yield piece()

    return rows.mapInArrow(work, _PIECE)


#: What a part asks: counts of runs of words (RUNS), or what the tree knows of contexts (STATES), of a level.
RUNS, STATES = 0, 1
_ASKED = "part long, level int, kind int, range long, keys binary, a binary, b binary, c binary, d binary, e binary"
_ANSWER = "part long, level int, kind int, range long, a binary, b binary, tokens long, kinds long"


def _asked(part: int, level: int, kind: int, bits: int, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[list]:
    """Rows of questions for sorted keys, one for each range of keys."""
    cuts = np.searchsorted(keys, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))) if bits else np.empty(0, np.int64)
    cuts = np.concatenate(([0], cuts, [len(keys)]))
    for k in np.flatnonzero(np.diff(cuts)):
        span = slice(cuts[k], cuts[k + 1])
        yield [part, level, kind, int(k), _pack_keys(keys[span]), *[_pack(v[span]) for v in values], *[None] * (5 - len(values))]


def _table_of(rows: list[list], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table([pa.array(list(c), types[k]) for c, k in zip(columns, kinds)], list(names))


def _answer(asked: pa.Table) -> pa.Table:
    """Adds up what the parts sent of one range of keys, and answers each part in the order of its keys.

    To RUNS: how often each occurs.  To STATES: one more than the kept words,
    0 for a context that is not retained, and the tokens of the kept words.
    """
    asked = asked.sort_by("part").to_pylist()
    level, kind, place = asked[0]["level"], asked[0]["kind"], asked[0]["range"]
    sizes = [0]
    every = []
    for row in asked:
        every.append(_unpack_keys(row["keys"]))
        sizes.append(sizes[-1] + len(every[-1]))
    keys, at = np.unique(np.concatenate(every), return_inverse=True)
    del every

    def joined(column: str, kind: type) -> np.ndarray:
        return np.concatenate([_unpack(row[column], kind) for row in asked])

    tokens = kinds = 0
    if kind == RUNS:
        # Weights of bincount are doubles: exact up to 2**53.
        total = np.bincount(at, joined("a", np.int64), len(keys)).astype(np.int64)
        tokens, kinds = int(total.sum()), int((total > 0).sum())
        out = [total]
    else:
        count = np.zeros(len(keys))
        sent = joined("a", np.int64)
        count[at[sent > 0]] = sent[sent > 0]
        seen = np.bincount(at, joined("b", np.int64), len(keys))
        kept, logs, q = (np.bincount(at, joined(c, t), len(keys)) for c, t in (("c", np.float32), ("d", np.float32), ("e", np.float64)))
        kept = np.rint(kept)
        size = np.maximum(1, count)
        other_p, other_q = 1 - seen / size, 1 - q
        other = np.where((other_p > 1e-12) & (other_q > 1e-12), other_p * np.log(np.maximum(other_p, 1e-300) / np.maximum(other_q, 1e-300)), 0.0)
        divergence = logs / size + other
        # As in grow().
        retained = (kept > 0) & (2 * count * divergence > kept + 4 * np.sqrt(2 * kept))
        out = [np.where(retained, kept + 1, 0).astype(np.int64), np.where(retained, seen, 0).astype(np.int64)]
    rows = []
    for k, row in enumerate(asked):
        own = at[sizes[k]:sizes[k + 1]]
        sent = [_pack(x[own]) for x in out]
        rows.append([row["part"], level, kind, place, sent[0], sent[1] if len(sent) > 1 else None, tokens if k == 0 else 0, kinds if k == 0 else 0])
    return _table_of(rows, _ANSWER)


class _Part:
    """A part's tokens, followed through the levels of the tree that were answered so far.

    A run of ``k`` words ends at a token; ``run[i]`` is its place among the
    part's distinct ones, -1 where it does not occur often enough.  ``log`` is
    log10 P of each token under the states of up to ``k - 1`` words.
    """

    def __init__(self, piece: dict, answers: list[dict], tokens: int, kinds: int):
        self.part, self.tokens, self.kinds = piece["part"], tokens, kinds
        self.word, self.first, self.keys = _unpack(piece["word"], np.int32), _unpack(piece["first"], np.int64), _unpack_keys(piece["keys"])
        self.ids, self.train = piece["doc_id"], np.array(piece["train"], bool)
        self.answers = {}
        for row in sorted(answers, key=lambda r: r["range"]):
            self.answers.setdefault((row["level"], row["kind"]), []).append(row)

    def answer(self, level: int, kind: int, column: str) -> np.ndarray:
        """Answers to what the part asked, in the order of its questions."""
        return np.concatenate([np.empty(0, np.int64), *(_unpack(r[column], np.int64) for r in self.answers.get((level, kind), []))])

    def follow(self, stage: int, depth: int, bits: int) -> Iterator[list]:
        """What the part asks in a stage, once those before it are answered: for RUNS of that level and STATES of the one below.

        After the last stage ``known``, ``base`` and ``log`` of each token are final.
        """
        learnt = np.repeat(self.train, np.diff(self.first))
        if stage == 1:
            yield from _asked(self.part, 1, RUNS, bits, self.keys, [np.bincount(self.word[learnt], minlength=len(self.keys))])
            return
        keys, count = self.keys, self.answer(1, RUNS, "a")
        word_log = np.log10((count + 1.0) / (self.tokens + self.kinds + 1.0))
        self.known, self.base, self.log = count[self.word] > 0, word_log[self.word], word_log[self.word]
        run = np.where(count[self.word] >= LEAST, self.word, -1)
        for level in range(2, min(stage, depth + 1) + 1):
            before = np.concatenate(([-1], run[:-1]))
            before[self.first[:-1]] = -1
            after = np.flatnonzero(before >= 0)
            # A run is frequent only where its context and its suffix are.
            at = after[run[after] >= 0]
            pair, own = np.unique((before[at] << 32) + self.word[at], return_inverse=True)
            context = pair >> 32
            hashes = mix(mix(keys[context] * np.uint64(3) + np.uint64(1)) + self.keys[pair & ((1 << 32) - 1)])
            order = np.argsort(hashes)
            n = np.bincount(own[learnt[at]], minlength=len(pair))
            if level == stage:
                yield from _asked(self.part, level, RUNS, bits, hashes[order], [n[order]])
                return
            total = np.empty(len(pair), np.int64)
            total[order] = self.answer(level, RUNS, "a")
            frequent = total >= LEAST
            suffix_log = np.empty(len(pair))
            suffix_log[own] = self.log[at]
            # Contexts in the order of their keys, and which of them is a run's.
            contexts = np.unique(before[after])
            contexts = contexts[np.argsort(keys[contexts])]
            place = np.zeros(len(keys), np.int64)
            place[contexts] = np.arange(len(contexts))
            size = count[contexts]
            if level == stage - 1:
                # Each part sends its share of what a kept word adds, so that the shares of all parts are the whole.  What only
                # decides whether a context is retained goes in single precision; distributions sum to 1 for any m.
                some = np.flatnonzero(frequent & (n > 0))
                share, log_q, of = n[some] / total[some], suffix_log[some] * np.log(10), place[context[some]]
                sums = lambda x: np.bincount(of, x, len(contexts))
                seen, gain = sums(n[some]).astype(np.int64), n[some] * (np.log(total[some] / size[of]) - log_q)
                values = [np.where(seen > 0, size, 0), seen, sums(share).astype(np.float32), sums(gain).astype(np.float32), sums(share * np.exp(log_q))]
                yield from _asked(self.part, level, STATES, bits, keys[contexts], values)
            else:
                m, seen = self.answer(level, STATES, "a"), self.answer(level, STATES, "b")
                of, state = place[context], place[before[after]]
                # Kept words go by their counts, others by what is left to the suffix.
                run_log = suffix_log.copy()
                some = np.flatnonzero(frequent)
                some = some[m[of[some]] > 0]
                c = of[some]
                run_log[some] = np.log10((total[some] + (m[c] + size[c] - seen[c]) * 10 ** suffix_log[some]) / (size[c] + m[c]))
                kept = np.zeros(len(run), bool)
                kept[at] = frequent[own]
                left = (m[state] > 0) & ~kept[after]
                c = state[left]
                self.log[after[left]] += np.log10((m[c] + size[c] - seen[c]) / (size[c] + m[c]))
                self.log[at[frequent[own]]] = run_log[own[frequent[own]]]
            run = np.full(len(run), -1)
            run[at] = np.where(frequent[own], own, -1)
            keys, count = hashes, total


def scored(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows whose fold is not ``fold``; a row without an id is
    held out.  A text that is null, empty or blank is its end alone.  Repeated
    rows are scored each.  Without training texts every score is that of the
    base, 0.  Other columns are not read; an empty table gives no rows.
    """
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = fields.withColumn("train", ~held_out(F.col("doc_id"), folds, fold))
    pieces = checkpoint(_pieces(rows))
    parts, size = (int(x or 0) for x in pieces.agg(F.count("*"), F.sum("tokens")).first())
    depth, bits, stages, tokens, kinds = DEPTH, max(0, -(-size // RANGE) - 1).bit_length(), DEPTH + 2, 0, 0
    answers, tasks = docs.sparkSession.createDataFrame([], _ANSWER), max(1, parts)
    pieces = pieces.repartition(tasks, "part")

    def met(work, schema: str) -> DataFrame:
        """``work`` of each part with its answers."""
        def run(piece: pa.Table, own: pa.Table) -> pa.Table:
            return _table_of([row for p in piece.to_pylist() for row in work(p, own.to_pylist())], schema)

        return pieces.groupBy("part").cogroup(answers.repartition(tasks, "part").groupBy("part")).applyInArrow(run, schema)

    for stage in range(1, stages + 1):
        def ask(piece: dict, own: list[dict], stage=stage, total=(tokens, kinds)) -> Iterator[list]:
            return _Part(piece, own, *total).follow(stage, depth, bits)

        new = _settled(met(ask, _ASKED).repartition(2 << bits, "kind", "range").groupBy("kind", "range").applyInArrow(_answer, _ANSWER))
        if stage == 1:
            tokens, kinds = (int(x or 0) for x in new.agg(F.sum("tokens"), F.sum("kinds")).first())
        answers = answers.unionByName(new)

    def score(piece: dict, own: list[dict]) -> Iterator[tuple]:
        part = _Part(piece, own, tokens, kinds)
        for _ in part.follow(stages + 1, depth, bits):
            pass
        sums = lambda x: np.add.reduceat(x, part.first[:-1]).tolist()
        return zip(part.ids, (~part.train).tolist(), np.diff(part.first).tolist(), sums(part.known.astype(np.int64)), [tokens] * len(part.ids),
                   sums(part.base), sums(part.log))

    return met(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

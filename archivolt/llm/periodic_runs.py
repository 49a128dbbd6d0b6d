"""Periodic runs of words: scale-tiled detection, stitched by document and period.

A run is a stretch of words whose smallest period ``q`` fits it ``copies`` times
or more and that cannot be extended.  Words ``i`` and ``i + q`` agree over an
interval of places; a run of period ``q`` is such an interval, made longer by
``q`` words.

Periods are sought octave by octave: from ``m`` up to ``2 * m``.  An interval
that is long enough holds a whole block of ``m`` words that begins at a multiple
of ``m``, so only those blocks are compared with the blocks one period away.
Each octave has tiles of its own, longer for longer periods, that overlap by
what the largest period needs.  A tile is solved from its own words alone: where
blocks agree, boundary Z-functions say how far the agreement reaches ahead of
the boundary and behind it.  What reaches a tile's edge is a fragment.
Fragments are shuffled by document and period and stitched where they overlap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.tables import checkpoint, doc_key, map_batches
from archivolt.llm.words import mix, stretches

#: Words that a tile is answerable for, where its octave does not need more.
TILE = 1 << 12
#: Periods below this are one octave, sought by blocks of half its length.
FIRST = 16
PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_664_525_223)

#: A rule that rearranges a document's words: from its id and number of words to the original places, or None.
Order = Callable[[int | None, int], np.ndarray | None]


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    for k in range(1, size.bit_length()):
        half = 1 << (k - 1)
        out[half:2 * half] = out[:half][:max(0, size - half)] * np.uint64(pow(base, half, PRIME)) % np.uint64(PRIME)
    return out


class Prints:
    """Prefix sums from which equal blocks of one tile are told."""

    def __init__(self, words: np.ndarray):
        self.n, values = len(words), mix(words) >> np.uint64(33)
        size = 1 << max(12, self.n.bit_length())
        self.sums, self.power, self.inverse = [], [], []
        for base in _BASES:
            self.power.append(_powers(base, size))
            self.inverse.append(_powers(pow(base, -1, PRIME), size))
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * self.power[-1][:self.n] % np.uint64(PRIME), out=sums[1:])
            self.sums.append(sums)

    def blocks(self, m: int) -> np.ndarray:
        """A print of the block of ``m`` words that begins at each place."""
        sums, inverse = self.sums[0], self.inverse[0]
        return (sums[m:] - sums[:-m]) % np.uint64(PRIME) * inverse[:self.n - m + 1] % np.uint64(PRIME)

    def agree(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` and from ``b`` (not smaller) agree over ``length`` places, by both prints."""
        out = np.ones(len(a), bool)
        for sums, power in zip(self.sums, self.power):
            left = (sums[a + length] - sums[a]) % np.uint64(PRIME) * power[b - a] % np.uint64(PRIME)
            out &= left == (sums[b + length] - sums[b]) % np.uint64(PRIME)
        return out


@lru_cache(maxsize=32)
def _divisors(m: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """For each period from ``m`` to ``top`` its largest proper divisors ``q / r``, r prime; and where each period's begin."""
    composite, out = np.zeros(top, bool), []
    for r in range(2, top):
        if not composite[r]:
            composite[r * r::r] = True
            q = np.arange(max(r, -(-m // r) * r), top, r)
            out.append(np.stack([q, q // r]))
    q, p = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    order = np.argsort(q, kind="stable")
    return p[order], np.searchsorted(q[order], np.arange(m, top + 1))


def _farthest(agrees: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The largest lengths up to ``most`` that agree; shorter ones always do."""
    low, high = np.zeros_like(most), most.copy()
    while np.any(low < high):
        middle = (low + high + 1) // 2
        good = agrees(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def boundary_z(prints: Prints, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Z-functions of the boundaries ``at`` for the shifts ``q``: over how many places words ``q`` apart agree before it and from it on."""
    behind = _farthest(lambda z: prints.agree(at - z, at + q - z, z), at)
    ahead = _farthest(lambda z: prints.agree(at, at + q, z), prints.n - q - at)
    return behind, ahead


def solve_tile(prints: Prints, first: int, last: int, m: int, periods: tuple[int, int]) -> np.ndarray:
    """Fragments of one tile, rows of ``(period, start, end)``: intervals of places in it whose words agree one period apart.

    Boundaries are the multiples of ``m`` from ``first`` to ``last``.  Periods
    that are multiples of a smaller one are left out: a stretch of ``q`` words
    that is a power shows that all of the run is.
    """
    n, (low, high) = prints.n, periods
    at = np.arange(first, last, m)
    at = at[at + low + m <= n]
    if not len(at):
        return np.empty((0, 3), np.int64)
    # Places beyond the text agree with nothing.
    blocks = np.full(int(at[-1]) + high, PRIME, np.uint64)
    own = prints.blocks(m)[:len(blocks)]
    blocks[:len(own)] = own
    shifted = np.lib.stride_tricks.sliding_window_view(blocks[at[0] + low:], high - low)[::m][:len(at)]
    row, column = np.nonzero(shifted == blocks[at][:, None])
    if not len(row):
        return np.empty((0, 3), np.int64)
    at, q = at[row], column + low
    divisors, edges = _divisors(low, high)
    many = edges[column + 1] - edges[column]
    each = np.repeat(np.arange(len(at)), many)
    p = divisors[np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(edges[column], many)]
    power = np.zeros(len(at), bool)
    power[each[prints.agree(at[each], at[each] + p, q[each] - p)]] = True
    at, q = at[~power], q[~power]
    behind, ahead = boundary_z(prints, at, q)
    return np.unique(np.stack([q, at - behind, at + ahead], axis=1)[ahead > 0], axis=0)


def tiles(n: int) -> Iterator[tuple[int, tuple[int, int], int, int, int, int]]:
    """All tiles of a text of ``n`` words: ``(m, periods, low, high, first, last)``.

    A tile of the octave holds the words ``low:high``; it is answerable for the
    boundaries from ``first`` to ``last``.
    """
    m, periods = FIRST // 2, (1, FIRST)
    while 3 * periods[0] <= n:
        core = max(TILE, 4 * m)
        for first in range(0, n, core):
            yield m, periods, max(0, first - m), min(n, first + core + 4 * m), first, min(n, first + core)
        m, periods = periods[1], (periods[1], 2 * periods[1])


def fragments(words: np.ndarray, least: int, copies: int) -> list[tuple[int, int, int]]:
    """Fragments ``(period, start, end)`` of all tiles of a text that belong to runs or may."""
    out, prints, seen, n = [], None, None, len(words)
    if n < least:
        return out
    for m, periods, low, high, first, last in tiles(n):
        if (low, high) != seen:
            seen, prints = (low, high), Prints(words[low:high])
        found = solve_tile(prints, first - low, last - low, m, periods)
        if len(found):
            q, start, end = found.T
            # A fragment that reaches no edge of its tile, other than the text's, is all there is.
            cut = ((start == 0) & (low > 0)) | ((end + q == high - low) & (high < n))
            kept = cut | (end - start + q >= np.maximum(least, copies * q))
            out += (found[kept] + [0, low, low]).tolist()
    return out


def _collapsed(words: list[bytes], order: np.ndarray | None, drop: np.ndarray | None) -> str:
    if order is not None or drop is not None:
        order = np.arange(len(words)) if order is None else order
        words = [words[i] for i in (order if drop is None else order[~drop]).tolist()]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, least: int = 24, copies: int = 3, order: Order | None = None) -> DataFrame:
    """``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs`` of each document.

    ``runs`` are ``(start, period, length)`` of all runs of at least ``least``
    words and ``copies`` periods, by start; the columns before describe the one
    with the greatest ratio of length to period, ties to the smaller start, then
    period.  ``collapsed_sha256`` is of the text without what repeats: a word is
    left out where a run holds it after the run's first period.

    Words differ where their bytes do; null and blank texts have none, no runs,
    and the digests of nothing.  ``order`` may rearrange a document's words
    first.  Rows with one id and text are answered alike, each of them; a
    missing id is one like others.  Columns other than ``doc_id`` and ``text``
    are not read; an empty table gives no rows.  ``least`` is 24 or more and
    ``copies`` 3 or more, which the blocks rely on.

    Tiles are made and solved where their document is read; only fragments, and
    the texts of documents that have some, are shuffled.
    """
    if least < 3 * FIRST // 2 or copies < 3:
        raise ValueError("runs of fewer than 24 words or three periods are not sought")
    kinds = "doc_id long, doc_key long, n_words long, plain string, text string, fragments array<struct<period:long,start:long,end:long>>"
    found_type = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(1), fold=False):
            ids, raw = batch.column(0).slice(lo, hi - lo).to_pylist(), words.raw.tobytes()
            count, plain, found = np.diff(words.first), [], []
            for i, doc in enumerate(ids):
                a, b = int(words.first[i]), int(words.first[i + 1])
                moved = order(doc, b - a) if order is not None and b > a else None
                hashes = words.hash[a:b] if moved is None else words.hash[a:b][moved]
                found.append([dict(zip(("period", "start", "end"), f)) for f in fragments(hashes, least, copies)])
                text = raw[words.start[a]:words.end[b - 1]] if b > a else b""
                plain.append(None if found[-1] else _collapsed(text.split(), moved, None))
            texts = [batch.column(1)[lo + i].as_py() if f else None for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.array(plain, pa.string()),
                    pa.array(texts, pa.string()), pa.array(found, found_type),
                ],
                ["doc_id", "doc_key", "n_words", "plain", "text", "fragments"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), doc_key(docs).alias("doc_key"))
    solved = checkpoint(map_batches(slim, work, kinds))
    # Rows that repeat have one key and the same fragments.
    pieces = solved.select("doc_key", F.inline("fragments")).distinct()
    before = Window.partitionBy("doc_key", "period").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    stitched = (
        pieces.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_key", "period", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length"))
        .where(F.col("length") >= F.greatest(F.lit(least), copies * F.col("period")))
    )
    runs = stitched.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,period:bigint,length:bigint>>)")
    repeats = F.size("fragments") > 0
    cut = solved.where(repeats).join(runs, "doc_key", "left").select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "text")

    def collapse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()):
            words = text.encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for r in spans:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            out.append(_collapsed(words, order(doc, len(words)) if order is not None and words else None, np.cumsum(edge)[:-1] > 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed_sha256"])

    final = "doc_id long, n_words long, runs array<struct<start:long,period:long,length:long>>, collapsed_sha256 string"
    whole = solved.where(~repeats).select("doc_id", "n_words", none.alias("runs"), F.col("plain").alias("collapsed_sha256"))
    rows = whole.unionByName(map_batches(cut, collapse, final))
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top),
    )
    line = lambda r: F.concat(*[x for name in ("start", "length", "period") for x in (r[name].cast("string"), F.lit("\n" if name == "period" else ","))])
    return rows.withColumn("best", best).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), "collapsed_sha256", "runs",
    )


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The rule by which the registered query rearranges every tenth document: its tail repeats from some word on."""
    if doc is None or not n:
        return None
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at

"""Benchmark items inside documents, also with other numbers, names and units.

A text becomes a template: words lose the signs around them and capitals,
numbers, units and names become placeholders of their kind, and what stood
there is kept beside them as the slot's value.  A name is a capitalised word;
one that begins a sentence may be a name or not, so windows that hold such words
have a key for every choice, in items and in documents.  Windows of :data:`WINDOW` template words are
joined on their hashes with the benchmark's.  Windows of one item that lie in a
document as they lie in the item form a run.  A run counts if its slots are
consistent: equal values in the item stand for equal values in the document and
the other way round, as when a question is asked anew with other numbers.  An
inserted or lost word begins a new run; an item's runs in a document are united.  A
window whose words are mostly slots says little by its template and is hashed
with its values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.tables import as_long, doc_key, map_batches, may_hold, slot_filter
from archivolt.llm.words import _BYTE, LOWER, Words, mix, ranges, span_hashes, stretches, words_of

WINDOW = 8
#: Windows that get their keys at a time: at most ``2**WINDOW`` keys for each.
AT_ONCE = 1 << 13
#: So many words of an item in a row are a leak, however long the item is.
ROW = 13
UNITS = (
    "% $ € £ km m cm mm kg g mg t l ml s h km/h mph kwh mile miles meter meters metre metres foot feet inch inches yard yards gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres second seconds minute minutes hour hours day days week "
    "weeks month months year years dollar dollars euro euros cent cents percent degree degrees watt watts volt volts meile meilen stunde "
    "stunden minuten tage jahre prozent heure heures jours ans pour-cent hora horas minutos días años por-ciento"
).split()

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_ALNUM[[ord("%"), ord("$")]] = True
_NUMBER, _NAME, _UNIT = (mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    words = words_of(raw, np.array([0, len(raw)]))
    return np.unique(words.hash)


_UNITS = _unit_hashes()


def template(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of every template word, its slot's value (0: a literal), where each text's begin, and which words may be names.

    Those are the capitalised words that begin a sentence; their code is the
    literal's.  Words of signs only are left out.
    """
    codes, slots, maybe, keep_all = [], [], [], []
    # A sentence begins with a text, and after a word that ends in . ! ? or :.
    ends = np.isin(words.raw[words.end - 1], np.frombuffer(b".!?:", np.uint8)) if len(words.end) else np.zeros(0, bool)
    begins = np.ones(len(ends), bool)
    begins[1:] = ends[:-1]
    begins[words.first[:-1][words.first[:-1] < len(ends)]] = True
    for lo, hi in ranges(words):
        at = words.start[lo]
        raw = words.raw[at:words.end[hi - 1]]
        start, end = words.start[lo:hi] - at, words.end[lo:hi] - at
        solid = _ALNUM[raw]
        place = np.flatnonzero(solid)
        # The core of a word: from its first to its last letter, digit or unit sign.
        a, b = np.searchsorted(place, start), np.searchsorted(place, end)
        keep = a < b
        place = np.append(place, 0)
        start, end = place[np.where(keep, a, 0)], place[np.where(keep, b - 1, 0)] + 1
        sums = np.zeros((3, len(raw) + 1), np.int32)
        np.cumsum((raw >= 48) & (raw <= 57), out=sums[0, 1:])
        upper = (raw >= 65) & (raw <= 90)
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        np.cumsum(upper, out=sums[1, 1:])
        np.cumsum((raw >= 97) & (raw <= 122) | (raw >= 128), out=sums[2, 1:])
        digits, uppers, lowers = (s[end] - s[start] for s in sums)
        head = upper[start] | (raw[start] == 0xC3) & upper[np.minimum(start + 1, len(raw) - 1)]
        hashes = span_hashes(_BYTE[LOWER[raw]], start, end)
        name = head & (uppers == 1) & (lowers > 0) & (digits == 0)
        unit = np.isin(hashes, _UNITS)
        maybe.append((name & begins[lo:hi] & ~unit)[keep])
        name &= ~begins[lo:hi]
        number = digits > 0
        code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, hashes)))
        codes.append(code[keep])
        slots.append(np.where(number | unit | name, hashes, np.uint64(0))[keep])
        keep_all.append(keep)
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(words.first), np.int64), np.empty(0, bool)
    kept = np.concatenate(([0], np.cumsum(np.concatenate(keep_all))))
    return np.concatenate(codes), np.concatenate(slots), kept[words.first], np.concatenate(maybe)


def window_keys(
    codes: np.ndarray, slots: np.ndarray, first: np.ndarray, maybe: np.ndarray, wide: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every window of ``wide`` template words inside one text, its first word, and which words are read as names.

    That is a bit for each word of a window.  A window has a key for every
    choice of the words in it that may be names, at most ``2**wide``.
    """
    total = len(codes) - wide + 1
    if total <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(owner[:total] == owner[wide - 1:])
    open_ = np.zeros(len(inside), np.int64)
    for k in range(wide):
        open_ |= maybe[inside + k].astype(np.int64) << k
    at, names = [inside], [np.zeros(len(inside), np.int64)]
    for choice in np.unique(open_[open_ > 0]):
        own, part = inside[open_ == choice], int(choice)
        while part:  # all parts of the choice but the empty one
            at.append(own)
            names.append(np.full(len(own), part))
            part = (part - 1) & int(choice)
    at, names = np.concatenate(at), np.concatenate(names)
    filled = np.zeros(len(at), np.int64)
    sums = np.full(len(at), wide, np.uint64)
    for k in range(wide):
        named = (names >> k & 1) > 0
        filled += named | (slots[at + k] != 0)
        sums = mix(sums) + np.where(named, _NAME, codes[at + k])
    some = np.flatnonzero(2 * filled > wide)
    if len(some):
        exact = sums[some]
        for k in range(wide):
            exact = mix(exact) + np.where(names[some] >> k & 1, codes[at[some] + k], slots[at[some] + k])
        sums[some] = exact
    return mix(sums), at, names


def sought_windows(codes: np.ndarray, slots: np.ndarray, first: np.ndarray, maybe: np.ndarray, wide: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`window_keys` that pass a filter, range by range of words, so that a text full of names holds no more than :data:`AT_ONCE` windows' keys at a time."""
    for lo in range(0, len(codes), AT_ONCE):
        part = slice(lo, min(len(codes), lo + AT_ONCE + wide - 1))
        keys, at, names = window_keys(codes[part], slots[part], np.clip(first, part.start, part.stop) - lo, maybe[part], wide)
        some = np.flatnonzero(may_hold(bits, keys))
        if len(some):
            yield keys[some], at[some] + lo, names[some]


def _slot_lists(codes: np.ndarray, slots: np.ndarray, at: np.ndarray, names: np.ndarray, wide: int) -> pa.Array:
    place, named = at[:, None] + np.arange(wide), (names[:, None] >> np.arange(wide) & 1) > 0
    flat = np.where(named, codes[place], slots[place]).ravel()
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, wide, dtype=np.int32), as_long(flat))


def item_windows(items: DataFrame, wide: int = WINDOW) -> DataFrame:
    """``key, wide, item_id, at, slots, loose, n_words`` of all windows of the items.

    An item shorter than a window is one window.  Of items with equal templates
    and slots the smallest id stands for all; items without words have none.
    ``loose`` windows read words that begin sentences as names.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(1), fold=False):
            codes, slots, first, maybe = template(words)
            for i in range(hi - lo):
                own = slice(int(first[i]), int(first[i + 1]))
                n = own.stop - own.start
                if not n:
                    continue
                w = min(n, wide)
                keys, at, names = window_keys(codes[own], slots[own], np.array([0, n]), maybe[own], w)
                whole = mix(np.array([n], np.uint64) + np.add.reduce(mix(codes[own] + np.arange(n, dtype=np.uint64)) ^ mix(slots[own] + np.arange(n, dtype=np.uint64))))
                same = lambda value, kind: pa.array([value] * len(keys), kind)
                yield pa.RecordBatch.from_arrays(
                    [as_long(keys), same(w, pa.int32()), same(batch.column(0)[lo + i].as_py(), pa.int64()), pa.array(at), _slot_lists(codes[own], slots[own], at, names, w), pa.array(names > 0),
                     same(n, pa.int64()), same(int(whole.view(np.int64)[0]), pa.int64())],
                    ["key", "wide", "item_id", "at", "slots", "loose", "n_words", "whole"],
                )

    rows = map_batches(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), work,
        "key long, wide int, item_id long, at long, slots array<long>, loose boolean, n_words long, whole long",
    )
    return rows.groupBy("key", "wide", "at", "slots", "loose", "n_words", "whole").agg(F.min("item_id").alias("item_id")).drop("whole")


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.4, wide: int = WINDOW) -> DataFrame:
    """``doc_key, doc_id, item_id, covered, n_words, renamed`` of each document and item that it holds.

    ``covered`` words of the item's ``n_words`` lie in windows of runs that
    count, at least ``share`` of them or :data:`ROW` in a row of one run;
    ``renamed`` says that some of them lie in no window with equal slots.  A run
    whose slots are not consistent counts only for windows that read no word
    which begins a sentence as a name, or else for windows with equal slots.
    ``doc_key`` is :func:`tables.doc_key` of the row, so rows with one id and other
    texts are told apart; repeated rows give one answer.  Null or empty texts
    and empty tables give no rows; other columns are not read.

    Documents' windows are first held against a filter of the benchmark's
    window hashes that has a fixed size, so that few windows of clean texts are
    shuffled; the join on the hash then decides.
    """
    windows = item_windows(items, wide)
    widths = sorted(r[0] for r in windows.select("wide").distinct().collect())  # at most ``wide`` numbers
    bits = docs.sparkSession.sparkContext.broadcast(slot_filter(windows, "key"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(2), fold=False):
            codes, slots, first, maybe = template(words)
            for w in widths:
                for keys, at, names in sought_windows(codes, slots, first, maybe, w, bits.value):
                    own = np.searchsorted(first, at, "right") - 1
                    rows = pa.array(lo + own)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), as_long(keys), pa.array(np.full(len(keys), w, np.int32)),
                         pa.array(at - first[own]), _slot_lists(codes, slots, at, names, w), pa.array(names > 0)],
                        ["doc_key", "doc_id", "key", "wide", "place", "values", "names"],
                    )

    texts = docs.select(doc_key(docs).alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = map_batches(texts, work, "doc_key long, doc_id long, key long, wide int, place long, values array<long>, names boolean")
    met = found.join(windows, ["key", "wide"])
    pieces = met.select(
        "doc_key", "doc_id", "item_id", "n_words", (F.col("place") - F.col("at")).alias("run"), "at", (F.col("slots") == F.col("values")).alias("equal"),
        (~(F.col("loose") | F.col("names")) | (F.col("slots") == F.col("values"))).alias("strict"),
        F.posexplode(F.arrays_zip("slots", "values")).alias("k", "slot"),
    )
    slot, value = F.nullif(F.col("slot.slots"), F.lit(0)), F.nullif(F.col("slot.values"), F.lit(0))
    word = F.col("at") + F.col("k")

    def fits(some: Column) -> Column:
        count = lambda column: F.countDistinct(F.when(some, column))
        pairs = count(F.when(slot.isNotNull(), F.struct(slot, value)))
        return (pairs == count(slot)) & (pairs == count(value))

    # A run's words are at most those of its item.
    runs = pieces.groupBy("doc_key", "doc_id", "item_id", "n_words", "run").agg(
        F.collect_set(word).alias("covered"), F.collect_set(F.when(F.col("equal"), word)).alias("equal"),
        F.collect_set(F.when(F.col("strict"), word)).alias("strict"), fits(F.lit(True)).alias("fits"), fits(F.col("strict")).alias("strict_fits"),
    )
    best = F.when(F.col("fits"), F.col("covered")).when(F.col("strict_fits"), F.col("strict")).otherwise(F.col("equal"))
    counted = runs.withColumn("covered", best)
    words = counted.withColumn("row", _longest(F.col("covered"))).select(
        "doc_key", "doc_id", "item_id", "n_words", "row", "equal", F.explode("covered").alias("word"))
    united = words.groupBy("doc_key", "doc_id", "item_id", "n_words").agg(
        F.countDistinct("word").alias("covered"), F.max("row").alias("row"),
        F.countDistinct(F.when(F.array_contains("equal", F.col("word")), F.col("word"))).alias("equal"),
    ).where((F.col("covered") >= share * F.col("n_words")) | (F.col("row") >= ROW))
    return united.select("doc_key", "doc_id", "item_id", "covered", "n_words", (F.col("equal") < F.col("covered")).alias("renamed"))


def _longest(words: Column) -> Column:
    """How many of the distinct numbers follow one another without a gap, at most."""
    none = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(state: Column, word: Column) -> Column:
        n = F.when(word == state["last"] + 1, state["n"] + 1).otherwise(F.lit(1))
        return F.struct(word.cast("long").alias("last"), n.alias("n"), F.greatest(state["most"], n).alias("most"))

    return F.aggregate(F.sort_array(words), none, step, lambda state: state["most"])


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = leaks(docs, items).select(F.col("doc_key").alias("_held")).distinct()
    return docs.join(found, doc_key(docs) == found["_held"], "left_anti")

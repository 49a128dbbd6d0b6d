"""Language by hyperdimensional profiles.

Every letter has a random vector of signs.  A run of three letters is bound into
one vector: the first letter's vector is permuted twice, the second's once, and
the three are multiplied.  A text's vector is the bundle, the sum, of those of
its runs; a language's prototype is the bundle of its texts' vectors.  A text
has the language whose prototype has the largest cosine with it.

Vectors of letters follow from their code points by a hash, so that tasks need
no table of them.  What is not a letter counts as one gap, also before and after
a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.labelled import held_out
from archivolt.llm.tables import map_batches
from archivolt.llm.words import mix

#: Places of a vector.
PLACES = 2048
#: A block of texts has about so many characters and at most so many texts; a longer text is taken in pieces.
BLOCK, TEXTS = 1 << 19, 256
#: Runs whose vectors a task holds at a time.
RUNS = 1 << 13
#: Prototypes that a task is sent at most: 256 MiB of them.
LANGUAGES = 1 << 15
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(codes: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A vector of -1 and 1 for each code point, from its hash; code 0 is the gap."""
    words = mix(mix(codes.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(places // 64, dtype=np.uint64))
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def run_vectors(runs: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vectors of runs of three, given as rows of numbers of ``letters``."""
    a, b, c = (np.roll(letters, 2 - k, axis=1)[runs[:, k]] for k in range(3))
    return a * b * c


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts in lower case and one 0 for each gap, with the number of the text that each is in."""
    low = ["\n" + text.lower() + "\n" for text in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(text) for text in low])
    letter = _letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    kept[1:] |= owner[1:] != owner[:-1]
    return np.where(letter, codes, 0)[kept], owner[kept]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Rows ``lo:hi`` and their texts; of a long text ``lo:lo + 1`` and a piece, cut behind a gap or after 4096 letters without one."""
    lo, texts, size = 0, [], 0
    for i, text in enumerate(column.to_pylist()):
        text = text or ""
        if texts and (size + len(text) > BLOCK or len(texts) == TEXTS):
            yield lo, i, texts
            texts, size = [], 0
        if not texts:
            lo = i
        if len(text) > BLOCK:
            at = 0
            while at < len(text):
                to = min(len(text), at + BLOCK)
                edge = next((j for j in range(to, max(at, to - 4096), -1) if not text[j - 1].isalpha()), to) if to < len(text) else to
                yield i, i + 1, [text[at:edge]]
                at = edge
            continue
        texts.append(text)
        size += len(text)
    if texts:
        yield lo, lo + len(texts), texts


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts: code points of the letters, distinct runs as rows of letters' numbers, and text and run of each occurrence."""
    symbols, owner = _symbols(texts)
    codes = np.flatnonzero(np.bincount(symbols))
    number = np.zeros(int(codes[-1]) + 1, np.int64)
    number[codes] = np.arange(len(codes))
    number = number[symbols]
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    k = len(codes)
    key = (number[inside] * k + number[inside + 1]) * k + number[inside + 2]
    if k**3 <= 1 << 22:
        present = np.flatnonzero(np.bincount(key, minlength=k**3))
        place = np.zeros(k**3, np.int64)
        place[present] = np.arange(len(present))
        run = place[key]
    else:
        present, run = np.unique(key, return_inverse=True)
    return codes, np.stack([present // (k * k), present // k % k, present % k], axis=1), owner[inside], run


def bundles(texts: list[str], group: np.ndarray, groups: int, places: int = PLACES) -> np.ndarray:
    """The sum of the runs' vectors of all texts of a group, one row each."""
    codes, runs, owner, run = counted(texts)
    letters, out = letter_vectors(codes, places), np.zeros((groups, places))
    owner = group[owner]
    if len(runs) > RUNS:
        order = np.argsort(run, kind="stable")
        owner, run = owner[order], run[order]
    for lo in range(0, len(runs), RUNS):
        a, b = np.searchsorted(run, (lo, lo + RUNS)) if len(runs) > RUNS else (0, len(run))
        part = runs[lo:lo + RUNS]
        counts = np.bincount(owner[a:b] * len(part) + run[a:b] - lo, minlength=groups * len(part)).reshape(groups, -1)
        # Counts below 2**24 are exact as single floats, and so are their sums.
        out += counts.astype(np.float32) @ run_vectors(part, letters).astype(np.float32)
    return out


def _has_letter(column: pa.Array) -> np.ndarray:
    return np.array([any(map(str.isalpha, text or "")) for text in column.to_pylist()], bool)


def prototypes(docs: DataFrame, chosen, places: int = PLACES) -> tuple[list[str], np.ndarray]:
    """Languages in the order of their code points, and the unit vector of each.

    Learnt from all rows with a language where the column ``chosen`` holds: each
    task bundles its own rows by language, then the bundles are added up, so
    what travels is a vector a language and task.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], ["lang", "bundle"])
            total.clear()
            return out

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, texts in _pieces(batch.column(1)):
                own = sorted(set(langs[lo:hi]))
                number = {lang: i for i, lang in enumerate(own)}
                sums = bundles(texts, np.array([number[lang] for lang in langs[lo:hi]]), len(own), places)
                for lang, row in zip(own, sums):
                    if row.any():
                        total[lang] = total[lang] + row if lang in total else row
            if len(total) > 4096:
                yield flush()
        if total:
            yield flush()

    def add(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, np.int64)
        for batch in batches:
            for bundle in batch.column(1).to_pylist():
                total += np.frombuffer(bundle, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([total.tobytes()], pa.binary())], ["lang", "bundle"])

    rows = docs.where(chosen).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.mapInArrow(work, "lang string, bundle binary").groupBy("lang").applyInArrow(add, "lang string, bundle binary").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; their prototypes would not fit every task")
    found = sorted((lang, np.frombuffer(bundle, np.int64).astype(float)) for lang, bundle in found)
    found = [(lang, bundle / np.linalg.norm(bundle)) for lang, bundle in found if bundle.any()]
    return [lang for lang, _ in found], np.array([v for _, v in found]).reshape(-1, places)


def languages(docs: DataFrame, langs: list[str], vectors: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` of every text under learnt prototypes; see :func:`classify`."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, vectors))
    places = vectors.shape[1]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, vectors = shared.value
        best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        row, long = -1, np.zeros((1, places))

        def decide(lo: int, sums: np.ndarray) -> None:
            length = np.linalg.norm(sums, axis=1)
            some = length > 0
            if len(langs) and some.any():
                # Rounded, so that ties do not depend on what a text is multiplied together with.
                near = np.round(sums[some] / length[some, None] @ vectors.T, 9)
                best[lo:lo + len(sums)][some], score[lo:lo + len(sums)][some] = near.argmax(axis=1), near.max(axis=1)

        for lo, hi, texts in _pieces(batch.column(1)):
            sums = bundles(texts, np.arange(hi - lo), hi - lo, places)
            if hi - lo == 1:  # perhaps a piece of a long text
                long = long + sums if lo == row else sums
                row, sums = lo, long
            decide(lo, sums)
        best[~_has_letter(batch.column(1))] = -1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([langs[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string()), pa.array(np.where(best >= 0, np.clip(score, 0, 1), 0.0))],
            ["doc_id", "lang_pred", "score"],
        )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, work, "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame, folds: int = 4, fold: int = 2, places: int = PLACES) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Learnt from rows with a language outside ``fold``; a row without an id is
    held out.  ``score`` is the cosine with the nearest prototype, not below 0;
    ties go to the language that comes first by code point.  A text that is
    null or has no letter is ``und`` with score 0, as is every text where
    nothing could be learnt.  Texts are read whole, long ones in pieces that
    are added up.  Repeated rows and equal texts get equal answers; an empty
    table gives no rows.  Only ``doc_id``, ``text`` and ``lang`` are read, and
    ``lang`` only to learn.
    """
    out = held_out(F.col("doc_id").cast("long"), folds, fold)
    langs, vectors = prototypes(docs, ~out, places)
    return languages(docs, langs, vectors).select("doc_id", out.alias("held_out"), "lang_pred", "score")

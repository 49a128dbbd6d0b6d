"""Which texts hold which of very many needles, as joins.

A text that holds a needle holds each piece of it.  Needles are cut in pieces of
a fixed length, and each is looked for by the one that fewest texts have.  Texts
give up only pieces that some needle is looked for by; a filter of fixed size
says which those may be, so most of a text's pieces never leave its task.  What
meets on a piece is confirmed on the whole texts.  Nothing is gathered: needles
are rows from start to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from archivolt.session import checkpoint

# Lengths of pieces, in characters; a needle is cut by the largest that it is not shorter than.
LENGTHS = (1, 2, 4, 8)
# Bits of a filter: 2 MiB, whatever the number of needles.
BITS = 24
# A piece that more texts than this have is divided among several tasks.
HOT = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pieces_of(text: str, length: int) -> np.ndarray:
    """A 64-bit hash of every piece of ``length`` characters, in order."""
    return next((own for n, own, _ in _pieces([text]) if n == length), np.empty(0, np.uint64))


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the hashes of all pieces of the texts, in order, and the text that each is of.

    Texts are hashed side by side; a piece is hashed from the one that is a
    character shorter, so each length costs what it adds.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the text's end
    sums = np.ones(len(codes), np.uint64)
    for k in range(max(LENGTHS)):
        sums = _spread(sums[:max(0, len(codes) - k)] * _ODD + codes[k:])
        if k + 1 in LENGTHS:
            whole = left[:len(sums)] > k
            yield k + 1, sums[whole], owner[:len(sums)][whole]


def _length_of(text: str) -> int:
    return max(n for n in LENGTHS if n <= len(text))


def piece_filter(pieces: DataFrame, column: str = "piece") -> np.ndarray:
    """A bit for each leading part of a hash that occurs, as bytes; the rows that make it stay in Spark."""
    slot = F.shiftrightunsigned(F.col(column), 64 - BITS)
    found = pieces.groupBy(F.expr(f"CAST(shiftrightunsigned({column}, {64 - BITS}) div 32768 AS INT)").alias("b")).agg(
        F.bitmap_construct_agg((slot % 32768).cast("long")).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for b, bits in found:
        out[b * 4096:b * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _text_pieces(texts: DataFrame, row: str, text: str, wanted: DataFrame) -> DataFrame:
    """``row, piece`` of the pieces of each text, each once, that are in ``wanted (piece, length)``, and a few others."""
    spark = texts.sparkSession
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # at most four
    bits = spark.sparkContext.broadcast(piece_filter(wanted))
    kind = texts.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                owner, found = [], []
                for length, own, of in _pieces([value or "" for value in part.column(1).to_pylist()]):
                    if length in lengths:
                        slot = (own >> np.uint64(64 - BITS)).astype(np.int64)
                        held = np.flatnonzero((bits.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                        # Each piece of a text once.
                        order = held[np.lexsort((own[held], of[held]))]
                        own, of = own[order], of[order]
                        first = np.ones(len(order), bool)
                        first[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
                        owner.append(of[first])
                        found.append(own[first])
                at = np.concatenate(owner) if owner else np.empty(0, np.int64)
                if len(at):
                    values = pa.array(np.concatenate(found).view(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), values], [row, "piece"])

    return texts.select(row, text).mapInArrow(run, f"{row} {kind}, piece long")


def _needle_pieces(needles: DataFrame, needle: str) -> DataFrame:
    """``needle, piece, length`` of every piece of each needle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                words = batch.column(0).slice(lo, 1024).to_pylist()
                own = [np.unique(pieces_of(w, _length_of(w))) for w in words]
                at = np.repeat(np.arange(len(words)), [len(p) for p in own])
                lengths = np.array([_length_of(w) for w in words], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()).take(pa.array(at)), pa.array(np.concatenate(own).view(np.int64)), pa.array(lengths[at])],
                    [needle, "piece", "length"])

    return needles.mapInArrow(run, f"{needle} string, piece long, length int")


def joined_needles(texts: DataFrame, needles: DataFrame, row: str, text: str, needle: str) -> DataFrame:
    """``row, needle`` of every needle that a text holds; rows of ``texts`` are told apart by ``row``.

    Empty and null needles and texts are passed over; a needle that repeats
    counts once.  A needle's piece is the one that fewest texts have, ties to
    the smaller hash; one that no text has drops the needle at once.
    """
    needles = needles.filter(F.length(needle) > 0).select(needle).distinct()
    cut = checkpoint(_needle_pieces(needles, needle))
    # How many texts have each piece of any needle; added up in tasks before anything is shuffled.
    frequent = _text_pieces(texts, row, text, cut).groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    rarest = cut.join(frequent, "piece", "left").groupBy(needle).agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece", "length")).alias("best")).select(needle, "best.*")
    sought = checkpoint(rarest.filter("texts > 0"))
    parts = F.ceil(F.col("texts") / HOT).cast("int")
    # A frequent piece is divided by text; its needles go to every part.
    pieces = sought.groupBy("piece").agg(F.max("texts").alias("texts"), F.max("length").alias("length")).withColumn("parts", parts)
    hot = pieces.filter("parts > 1").select("piece", "parts")
    own = _text_pieces(texts, row, text, pieces).join(hot, "piece", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(row), F.col("parts")), F.lit(0)).cast("int"))
    asked = sought.select(needle, "piece", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = own.join(asked, ["piece", "part"]).select(row, needle)
    return met.join(texts.select(row, F.col(text).alias("_held")), row).filter(F.contains("_held", needle)).select(row, needle)

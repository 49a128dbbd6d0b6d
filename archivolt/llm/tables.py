"""What several operators do with tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.words import Words, stretches
from archivolt.session import checkpoint, ship_package  # noqa: F401

#: Words of a text as the contracts count them.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Words of a text, of no text none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; of no key null."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def doc_key(docs: DataFrame) -> Column:
    """Tells rows of documents apart by id and text; nulls are told from empty texts."""
    text = docs["text"].cast("string")
    return F.xxhash64(docs["doc_id"].cast("long"), docs["doc_id"].isNull(), text, text.isNull())


def filter_texts(docs: DataFrame, keep: Callable[[Words], np.ndarray], fold: bool = True) -> DataFrame:
    """The rows whose text passes ``keep``, a mask over the texts of a stretch; all columns stay, nothing is shuffled."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(at), fold):
            yield batch.slice(lo, hi - lo).filter(pa.array(keep(words)))

    return map_batches(docs, work, docs.schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


#: Slots of :func:`slot_filter`; its bits take 2 MiB, however many keys there are.
SLOTS = 1 << 24


def slot_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of ``hash >> 40`` that occurs, as bytes.

    Its size does not depend on the table's.  With many keys most bits are set
    and it keeps less away; it never keeps away a row that has a partner.
    """
    slot = F.shiftrightunsigned(F.col(column), 40)
    rows = (
        hashes.where(F.col(column).isNotNull()).select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    # bitmap_bucket_number counts from 1 for positive values and puts 0 apart.
    out = np.zeros(SLOTS // 8 + 8192, np.uint8)
    for bucket, bits in rows:
        at = bucket * 4096
        part = np.frombuffer(bits, np.uint8)
        out[at:at + len(part)] |= part
    return out


def slot_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each hash in a :func:`slot_filter`."""
    slot = (hashes >> np.uint64(40)).astype(np.int64)
    # The inverse of Spark's bucket number and bit position.
    bucket = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
    place = np.where(slot > 0, (slot - 1) % 32768, 0)
    return bucket * 4096 + place // 8, (place % 8).astype(np.uint8)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    byte, bit = slot_bits(hashes)
    return (bits[byte] >> bit) & np.uint8(1) > 0


def as_long(hashes: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's longs."""
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))

"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

Each source's words form one stream, its documents in an order that a seed
fixes, cut into blocks of equal length.  A source's target is a number of whole
passes over its blocks and of blocks of one further pass.  Each pass has its own
permutation of the block numbers, so a source's draws are a list that nobody
needs to write down: draw ``g`` is the block that the permutation puts at place
``g``.  A binary tree deals the draws out to output shards: a node halves its
shards and draws, multivariate-hypergeometrically, how many blocks of each
source go left, so that shards have equal numbers of blocks and each is a fair
sample of the whole.  A leaf's draws are a range of every source's list; ranges
do not overlap.  Inside a shard pieces are shuffled by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.tables import checkpoint, count_words, doc_key, map_batches
from archivolt.llm.words import mix
from archivolt.operators.ordered import positions

WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often.
MOST = 3
#: A source has about so many blocks or more, and blocks of :data:`BLOCK` words at most.
BLOCKS, BLOCK = 1 << 12, 1 << 8
SHARDS = 16
#: Documents in one piece of a source's order whose sizes are summed together.
PIECE = 4096


def _code(source: Column) -> Column:
    """A source as a key that is never null; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source_key, source_size, target, place`` for ``sizes (source_key, source_size)``.

    Sources in the order of their keys weigh ``weights``, repeating, and share
    the sum of all sizes.  A share stops at ``most`` times its source's size;
    what is left over is shared by weight among the others until none is above.
    Only sums travel to the driver.
    """
    ranked = checkpoint(_ranked(sizes))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", weight.alias("weight"))
    limit = F.col("source_size") * float(most)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        free = limit > F.col("weight") * level if before >= 0 else F.lit(True)
        fixed, open_weight, n = ranked.agg(
            F.coalesce(F.sum(F.when(~free, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)), F.count(F.when(~free, 1))
        ).first()
        if n == before or not open_weight:
            break
        before, level = n, (total - fixed) / open_weight
    return ranked.select("source_key", "source_size", F.least(limit, F.col("weight") * level).alias("target"), "place")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``place``, the number of smaller keys: ranges are counted, then ranked inside, so no task sees all."""
    ranged = checkpoint(sizes.repartitionByRange("source_key").withColumn("range", F.spark_partition_id()))
    # As many rows as partitions.
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "before")
    own = F.row_number().over(Window.partitionBy("range").orderBy("source_key")) - 1
    return ranged.withColumn("own", own).join(before, "range").select("source_key", "source_size", (F.col("before") + F.col("own")).alias("place"))


def streams(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``row, doc_id, doc_key, source_key, size, begin``: where each document's words begin in its source's stream.

    ``row`` names a column that tells rows apart; without one they are numbered.
    The order inside a source is by hash of id and text.  Rows equal in both are
    interchangeable: they are one entry of the stream, as long as all of them,
    and each row has its own part of it.  A source is cut in pieces by the same
    hash, about :data:`PIECE` entries each on the average of the whole table;
    sums of pieces are added up first, so no task orders a whole source.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = checkpoint(docs.select(
        number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), doc_key(docs).alias("doc_key"), _code(F.col("source")).alias("source_key"),
        count_words(F.col("text").cast("string")).alias("size"),
    ))
    entries = rows.groupBy("source_key", "doc_key").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    entries = checkpoint(entries.withColumn("order", F.xxhash64("doc_key", F.lit(11))))
    pieces = max(1, entries.count() // PIECE)
    entries = entries.withColumn("piece", F.floor((F.shiftrightunsigned("order", 32) * pieces) / F.lit(float(1 << 32)))).withColumn("words", F.col("size") * F.col("copies"))
    own = Window.partitionBy("source_key", "piece").orderBy(F.shiftrightunsigned("order", 32), "order", "doc_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = entries.groupBy("source_key", "piece").agg(F.sum("words").alias("sum"))
    earlier = Window.partitionBy("source_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source_key", "piece", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    begun = entries.join(before, ["source_key", "piece"]).select(
        "doc_key", "source_key", "copies", (F.col("before") + F.coalesce(F.sum("words").over(own), F.lit(0))).alias("begin")
    )
    placed = rows.join(begun, ["source_key", "doc_key"])
    once = placed.where("copies = 1").drop("copies")
    # Numbered span by span: a row that fills a third of the table is no one task's.
    repeated = positions(placed.where("copies > 1").drop("copies"), ["source_key", "doc_key"], "row", "copy")
    repeated = repeated.withColumn("begin", F.col("begin") + (F.col("copy") - 1) * F.col("size")).drop("copy")
    return once.unionByName(repeated).select("row", "doc_id", "doc_key", "source_key", "size", "begin")


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the numbers ``x`` in a permutation of ``0 .. n - 1`` that ``key`` chooses.

    Four rounds of a balanced Feistel network on the next power of four; a
    number that leaves the range goes through again.
    """
    n, key = np.broadcast_to(n, x.shape), np.broadcast_to(key, x.shape)
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, left = x.astype(np.uint64), np.arange(len(x))
    while len(left):
        a, b = out[left] >> half[left], out[left] & low[left]
        for k in range(4):
            a, b = b, a ^ (mix(b + mix(key[left] + np.uint64(k))) & low[left])
        out[left] = (a << half[left]) | b
        left = left[out[left] >= n[left].astype(np.uint64)]
    return out.astype(np.int64)


class Tree:
    """The splitting tree over ``shards`` of the sources' numbers of draws."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int):
        self.quotas, self.shards, self.seed = quotas.astype(np.int64), shards, seed
        self.split = lru_cache(maxsize=4096)(self._split)

    def _split(self, node: int, shards: int, key: bytes) -> np.ndarray:
        """How many blocks of each source go to the left half of a node's shards."""
        have = np.frombuffer(key, np.int64)
        total = int(have.sum())
        draw = np.random.default_rng([self.seed, node])
        return draw.multivariate_hypergeometric(have, total * (shards // 2) // shards, method="marginals")

    def leaf(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The first draw and the number of draws of each source that a shard gets."""
        have, first, node, low, shards = self.quotas, np.zeros_like(self.quotas), 1, 0, self.shards
        while shards > 1:
            left, half = self.split(node, shards, have.tobytes()), shards // 2
            if shard < low + half:
                have, node, shards = left, 2 * node, half
            else:
                first, have, node, low, shards = first + left, have - left, 2 * node + 1, low + half, shards - half
        return first, have

    def edges(self) -> np.ndarray:
        """First draws of all shards, one row each, and the ends in a last row."""
        return np.stack([self.leaf(s)[0] for s in range(self.shards)] + [self.quotas])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = 1, row: str | None = None) -> DataFrame:
    """``row, doc_id, doc_key, source_key, size, source_size, target, pieces`` for each document; see :func:`streams` for ``row``.

    ``pieces`` are its parts of the mix: ``(shard, turn, start, words, place)``,
    ``words`` words of the text from ``start`` in the ``turn``-th pass, ``place``
    their order in the shard.  Parts of one shard and pass that meet are one.  No
    word occurs more than ``most`` times.  A document without words has size 0
    and no pieces; null sources are one source.  Rows of one id, source and text
    are interchangeable, other columns are not read, an empty table gives no
    rows.  Reruns agree, whatever the partitioning.

    The sources' numbers (a few for each source) are the same for all tasks and
    are sent to them; that is three numbers a source, refused beyond 16 million
    sources.  Everything about documents stays in Spark.
    """
    rows = checkpoint(streams(docs, row))
    aims = checkpoint(targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, most))
    if aims.count() > 1 << 24:
        raise ValueError("more than 16 million sources; their numbers would not fit every task")
    table = aims.orderBy("place").select("source_size", "target").toArrow()
    size, target = (table.column(k).to_numpy().astype(t) for k, t in ((0, np.int64), (1, float)))
    # Blocks grow with the table only where the tree could not count them otherwise.
    largest = max(BLOCK, 1 << max(0, int(target.sum() / 5e8)).bit_length()) if len(target) else BLOCK
    block = np.clip(size // BLOCKS, 1, largest)
    blocks = -(-size // block)
    turns = np.where(size > 0, target // np.maximum(size, 1), 0).astype(np.int64)
    rest = np.minimum(blocks, np.rint((target - turns * size) / block)).astype(np.int64)
    edges = Tree(turns * blocks + rest, shards, seed).edges()
    shared = docs.sparkSession.sparkContext.broadcast((block, blocks, turns, rest, edges))
    fields = pa.struct([("shard", pa.int32()), ("turn", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("place", pa.int64())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, blocks, turns, rest, edges = shared.value
        source, size, begin = (batch.column(k).to_numpy() for k in (0, 1, 2))
        long = block[source]
        first = begin // long
        many = np.where(size > 0, (begin + np.maximum(size, 1) - 1) // long - first + 1, 0)
        passes = turns[source] + (rest[source] > 0)
        # One row for each document, pass and block.
        count = many * passes
        doc = np.repeat(np.arange(len(source)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        turn, number = k // np.maximum(1, many[doc]), first[doc] + k % np.maximum(1, many[doc])
        s = source[doc]
        key = mix((s * (1 << 20) + turn).astype(np.uint64) + np.uint64(seed))
        at = permuted(number, blocks[s], key)
        drawn = (turn < turns[s]) | (at < rest[s])
        doc, turn, number, s, at = (x[drawn] for x in (doc, turn, number, s, at))
        draw = turn * blocks[s] + at
        shard = np.zeros(len(doc), np.int64)
        for one in np.unique(s):
            own = s == one
            shard[own] = np.searchsorted(edges[1:, one], draw[own], "right")
        a = np.maximum(begin[doc], number * block[s])
        b = np.minimum(begin[doc] + size[doc], (number + 1) * block[s])
        # Neighbours in one shard and pass are one piece.
        order = np.lexsort((number, shard, turn, doc))
        doc, turn, number, shard, a, b = (x[order] for x in (doc, turn, number, shard, a, b))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (turn[1:] != turn[:-1]) | (shard[1:] != shard[:-1]) | (number[1:] != number[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
        d = doc[head]
        place = mix(mix(begin[d].astype(np.uint64) + a[head].astype(np.uint64)) + (source[d] * 64 + turn[head]).astype(np.uint64)).view(np.int64)
        values = [shard[head].astype(np.int32), turn[head].astype(np.int32), a[head] - begin[d], b[tail] - a[head], place]
        lists = pa.ListArray.from_arrays(np.searchsorted(d, np.arange(len(source) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(fields)))
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3, 10)] + [lists], ["row", "doc_id", "doc_key", "source_key", "size", "source_size", "target", "pieces"])

    ready = rows.join(aims, "source_key").select("place", "size", "begin", "row", "doc_id", "doc_key", "source_key", F.col("size").alias("own_size"), "source_size", "target")
    return map_batches(ready, work, "row long, doc_id long, doc_key long, source_key string, size long, source_size long, target double, "
                       "pieces array<struct<shard:int,turn:int,start:long,words:long,place:long>>")


def taken(mixed: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: words of each document in the mix, repeats counted."""
    return mixed.select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def _taken() -> Column:
    return F.aggregate("pieces", F.lit(0).cast("long"), lambda total, p: total + p["words"])


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix takes words of, with ``size, source_size, target, taken, pieces`` beside their columns.

    Columns of these names that the table has already are replaced.
    """
    added = ["size", "source_size", "target", "taken", "pieces"]
    name = "_row"
    while name in docs.columns:
        name += "_"
    # Written once with numbers that stay, so that the texts are shuffled once and no row is looked for by its text.
    kept = checkpoint(docs.drop(*added).withColumn(name, F.monotonically_increasing_id()))
    mixed = mix_sources(kept, row=name, **settings).withColumn("taken", _taken()).where("taken > 0")
    both = kept.join(mixed.select(F.col("row").alias(name), *added), name)
    return both.select(*[c for c in kept.columns if c != name], *added)


def shard_rows(mixed: DataFrame) -> DataFrame:
    """``shard, place, doc_id, turn, start, words``: the mix itself, sorted inside each shard by its shuffled places."""
    rows = mixed.select("doc_id", F.inline("pieces"))
    return rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id", "turn", "start").select("shard", "place", "doc_id", "turn", "start", "words")

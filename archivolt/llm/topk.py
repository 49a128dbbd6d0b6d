"""Exact nearest vectors by inner product from an impact-ordered index, score at a time.

Vectors become integer vectors.  The index holds blocks of vectors; in a block
each dimension's values are quantised to impacts, the vectors whose impacts lie
within a factor of four being a posting segment.  A query gives a segment the
largest contribution that a member can make.  Segments are processed by
descending size of contribution, added up in accumulators, in classes whose
contributions halve; a batch of queries, each with classes of its own, is added
up at once by a product of its weights of segments and the segments' impacts.
After a class the best accumulators are scored exactly; the k-th best exact
score is a floor.  What a vector can still gain is bounded by the segments not
yet processed and by what quantising leaves; processing stops only when no more
than a few vectors can reach the floor, or no segment is left that can add, and
those vectors are rescored exactly.  So the answer is exact, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.tables import checkpoint

#: Vectors in a block of the index, and queries in a block of questions, on the average.
BLOCK, QUESTIONS = 1 << 15, 1 << 10
#: Blocks of questions that a task takes at most, tasks wanted for each core, and tasks that blocks are dealt to at most.
SHEETS, WAVES, TASKS = 16, 4, 1 << 14
#: Queries that are answered together; each has an accumulator for every vector of a block.
BATCH = 1 << 7
#: Impacts of a dimension in a block.
LEVELS = 64
#: A query goes over to exact scores when so many vectors for each wanted one, or this part of all, are left.
ENOUGH, SHARE = 8, 8


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id, values``: each component x as floor(scale * x), of vectors that are whole and finite."""
    column = F.col("embedding")
    whole = column.isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(whole & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("values"))


class Index:
    """The posting segments of a block of integer vectors, all of one length."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS):
        self.ids, self.values = ids, values
        low, high = values.min(axis=0), values.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // levels))
        # A value is its impact and a rest of 0 to step - 1.
        self.rest, self.impact = step - 1, low + (values - low) // step * step
        # The largest impact of each range of segments; the next range begins at a quarter of it.
        self.size, self.tops = np.abs(self.impact), []
        top = self.size.max(initial=0)
        while top:
            self.tops.append(top)
            top = self.size.max(initial=0, where=self.size <= top // 4)

    def _kind(self, queries: np.ndarray) -> type:
        """Numbers in which all sums and bounds are exact; products of matrices are fast in the first two."""
        most = 4.0 * np.abs(self.values).max(initial=0) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
        return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64

    def search(self, query: np.ndarray, k: int, skip: int | None = None, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` best vectors and their scores, best first, ties to the smaller id; row ``skip`` takes no part."""
        return next(self.answers(query[None], k, np.array([-1 if skip is None else skip]), enough))[1:]

    def _segments(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each segment with its members' impacts, of other vectors 0; the lowest and the highest of each row."""
        segments = np.empty((len(self.tops), self.values.shape[1], len(self.ids)), kind)
        for rows, top in zip(segments, self.tops):
            rows[:] = np.where((self.size > top // 4) & (self.size <= top), self.impact, 0).T
        segments = segments.reshape(-1, len(self.ids))
        return segments, segments.min(axis=1, initial=0).astype(np.int64), segments.max(axis=1, initial=0).astype(np.int64)

    def answers(self, queries: np.ndarray, k: int, skip: np.ndarray, enough: int = ENOUGH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """:meth:`search` of many queries: each one's number, rows and scores, in no order; a ``skip`` of -1 is no row."""
        n, kind = len(self.ids), self._kind(queries)
        asks, exact = queries.astype(kind), self.values.astype(kind)
        segments, low, high = self._segments(kind)
        # No score is larger than the product of two lengths; few are half of it.
        length = lambda x: np.sqrt(np.square(x, dtype=np.float64).sum(axis=1))
        large = length(queries) * length(self.values).max(initial=0) / 2

        def rescored(q: int, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            rows = rows[rows != skip[q]]
            score = (exact[rows] @ asks[q]).astype(np.int64)
            if len(rows) > k:
                good = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[good], score[good]
            keep = np.lexsort((self.ids[rows], -score))[:k]
            return q, rows[keep], score[keep]

        def left(level: np.ndarray, size: np.ndarray, gain: np.ndarray, batch: np.ndarray) -> np.ndarray:
            """What a vector can still gain from segments of contributions up to ``level``, one a dimension, and from rests."""
            each = np.where(size <= level[:, None], gain, 0).reshape(len(batch), len(self.tops), -1)
            return each.max(axis=1).sum(axis=1) + np.maximum(queries[batch], 0) @ self.rest

        for start in range(0, len(queries), BATCH):
            # The queries without a proof, their weights of segments, and the accumulators.
            batch = np.arange(start, min(start + BATCH, len(queries)))
            weight = np.tile(queries[batch], len(self.tops))
            least, gain = np.minimum(weight * low, weight * high), np.maximum(weight * low, weight * high)
            size = np.maximum(-least, gain)
            total, best, level = np.zeros((len(batch), n), kind), large[batch], size.max(axis=1, initial=0)
            while n > k + 1 and self.tops and len(batch):
                to = level // 2
                while (more := (to > 0) & (2 * left(to, size, gain, batch) > best)).any():
                    to[more] //= 2  # too much is left for a proof
                total += np.where((size > to[:, None]) & (size <= level[:, None]), weight, 0).astype(kind) @ segments
                level, best = to, total.max(axis=1)
                leaders = np.argpartition(total, n - k - 1, axis=1)[:, n - k - 1:]
                score = np.einsum("qkd,qd->qk", exact[leaders], asks[batch]).astype(np.int64)
                score[leaders == skip[batch, None]] = np.iinfo(np.int64).min
                # Of k + 1 scores, a query's own row among them or not, the k-th best.
                floor = np.partition(score, 1, axis=1)[:, 1]
                can = total >= (floor - left(level, size, gain, batch)).astype(kind)[:, None]
                done = (level == 0) | (np.count_nonzero(can, axis=1) <= max(enough * k, n // SHARE))
                for q, may in zip(batch[done].tolist(), can[done]):
                    yield rescored(q, np.flatnonzero(may))
                batch, weight, gain, size, total, best, level = (x[~done] for x in (batch, weight, gain, size, total, best, level))
            for q in batch.tolist():
                yield rescored(q, np.arange(n))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def layout(vectors: int, queries: int, cores: int) -> tuple[int, int]:
    """Blocks of the index, and parts of the queries that each block meets; each part is sent a copy of the vectors."""
    blocks, sheets = max(1, -(-vectors // BLOCK)), max(1, -(-queries // QUESTIONS))
    return blocks, min(sheets, max(-(-sheets // SHEETS), -(-WAVES * cores // blocks)))


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each row where the column ``is_query`` (of vec_id) holds.

    Every row but the query's own is a candidate, also another with its id.
    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id.  Of vectors of different lengths the shorter one
    is filled up with zeros.  Ties go to the smaller vec_id; with fewer
    candidates than ``k`` all are returned.  A query row that repeats is
    answered as often.  Other columns are not read; an empty table gives no
    rows.  Scores must fit a long.

    Vectors are dealt by hash into blocks, queries into parts of several blocks
    of questions, as many as keep all cores busy; a task answers one part from
    one block of the index, so that vectors are shuffled once for each part.
    Only a task's ``k`` best for each query are shuffled.
    """
    rows = checkpoint(quantised(vectors).withColumn("row", F.monotonically_increasing_id()))
    counts = rows.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    blocks, parts = layout(*counts, rows.sparkSession.sparkContext.defaultParallelism)
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    block, part = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts))
    left = rows.where(is_query(F.col("vec_id"))).select(part.alias("part"), each(blocks).alias("block"), "row", "vec_id", "values", F.lit(True).alias("asks"))
    right = rows.select(each(parts).alias("part"), block.alias("block"), "row", "vec_id", "values", F.lit(False).alias("asks"))

    def work(table: pa.Table) -> pa.Table:
        width = int(pc.max(pc.list_value_length(table["values"])).as_py() or 0)
        index, asks = table.filter(pc.invert(table["asks"])), table.filter(table["asks"])
        out = [[], [], [], []]
        if len(index) and len(asks):
            ids, row, query_id = index["vec_id"].to_numpy(), asks["row"].to_numpy(), asks["vec_id"].to_numpy()
            own = pc.fill_null(pc.index_in(asks["row"], value_set=index["row"].combine_chunks()), -1).to_numpy()
            segments = Index(ids, _matrix(index["values"], width))
            for q, found, score in segments.answers(_matrix(asks["values"], width), k, own):
                for column, values in zip(out, (np.full(len(found), row[q]), np.full(len(found), query_id[q]), ids[found], score)):
                    column.append(values)
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *column]) for n, column in zip(("row", "query_id", "vec_id", "score"), out)})

    # A tile takes long and holds few bytes, so each gets a task of its own.
    tile, tasks = F.col("block") * parts + F.col("part"), min(TASKS, blocks * parts)
    dealt = left.unionByName(right).withColumn("tile", tile).withColumn("task", (F.col("tile") % tasks).cast("int")).repartitionById(tasks, "task")
    found = dealt.groupBy("task", "tile").applyInArrow(work, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

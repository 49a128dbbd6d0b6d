"""Exact nearest chunks that leaves out cells of chunks on proof.

Chunks are dealt to the nearest of some centres; a cell knows its radius, the
distance of its farthest chunk from its centre.  By the triangle inequality no
chunk of a cell is nearer to a question than the centre's distance less the
radius.  A question first looks through its nearest cells until they hold enough
chunks.  Its k-th distance there is proof against every cell whose bound is
larger; the others are looked through in a second round, and then the answer is
exact.  Questions and chunks meet by cell as tables; nothing of either passes
the driver, only centres and radii do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from archivolt.operators.search import FILTERS, _cut, _unit, asked_once
from archivolt.session import checkpoint

# Centres, and chunks from which they are learnt (those with the smallest hashes of their keys).
CELLS, SAMPLE = 256, 1 << 16
# Chunks and questions that one task compares at a time.
PART, SHEET = 1 << 13, 1 << 11
# What rounding may add to a distance.
SLACK = 2e-6


@dataclass
class Cells:
    """Chunks with their cell, centres, and radius and number of chunks of each cell."""

    chunks: DataFrame
    key: str
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def _lists(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors from centres."""
    square = (units**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * units @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def learn_centres(corpus: DataFrame, key: str = "chunk_id", cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """At most ``cells`` centres of unit vectors, by k-means on at most ``sample`` chunks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    some = corpus.filter(F.col("embedding").isNotNull()).select(F.xxhash64(key).alias("_h"), F.col("embedding").cast("array<double>").alias("v")).orderBy("_h").limit(sample)
    units = Normalizer(inputCol="_raw", outputCol="_unit").transform(some.select(array_to_vector("v").alias("_raw")))
    rows = checkpoint(units.select(vector_to_array("_unit").alias("u")).distinct().select(array_to_vector("u").alias("_unit")))
    n = rows.count()
    if n <= cells:
        return np.array([r[0].toArray() for r in rows.collect()]) if n else np.zeros((0, 0))
    model = KMeans(featuresCol="_unit", k=cells, seed=seed, maxIter=10, initMode="random").fit(rows)
    return np.array(model.clusterCenters())


def make_cells(corpus: DataFrame, key: str = "chunk_id", cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> Cells:
    """Every chunk in the cell of its nearest centre; chunks without a vector are left out.

    ``corpus`` holds the key, ``embedding`` and, for filters, ``category``,
    ``chapter`` and ``name``.  Vectors of length 0 are a cell of their own.
    """
    centres = learn_centres(corpus, key, cells, sample, seed)
    have = [c for c in ("category", "chapter", "name") if c in corpus.columns]
    slim = corpus.filter(F.col("embedding").isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("embedding"), *[F.col(c).cast("string").alias(c) for c in have])
    schema = T.StructType([*slim.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                units = _lists(batch.column(1))
                far = _distances(units, centres)
                cell = np.where(units.any(axis=1), far.argmin(axis=1), len(centres)).astype(np.int32)
                own = np.where(cell < len(centres), far.min(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(own)], schema.names)

    chunks = checkpoint(slim.mapInArrow(run, schema))
    radius, count = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for cell, far, n in chunks.groupBy("cell").agg(F.max("_far"), F.count(F.lit(1))).collect():  # a row a cell
        radius[cell], count[cell] = far, n
    return Cells(chunks.drop("_far"), key, centres, radius, count)


def _bounds(cells: Cells, units: np.ndarray) -> np.ndarray:
    """The least cosine distance that a chunk of each cell can have from each question."""
    near = np.maximum(_distances(units, cells.centres) - cells.radius[:-1], 0.0) if len(cells.centres) else np.zeros((len(units), 0))
    bound = np.hstack([near**2 / 2, np.ones((len(units), 1))])
    bound[~units.any(axis=1)] = 1.0  # a question without length is as far from everything
    bound[:, cells.count == 0] = np.inf
    return bound


def _asks(cells: Cells, questions: DataFrame, k: int) -> DataFrame:
    """``questions`` (with ``floor``, null in the first round) once for each cell that they look through in this round."""
    light = Cells(None, cells.key, cells.centres, cells.radius, cells.count)
    schema = T.StructType([*questions.schema.fields, T.StructField("cell", T.IntegerType())])
    at, floor_at = questions.columns.index("embedding"), questions.columns.index("floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                bound = _bounds(light, _lists(batch.column(at)))
                order = np.argsort(bound, axis=1, kind="stable")
                # The first round takes cells by their bounds until they hold k chunks.
                held = np.cumsum(light.count[order], axis=1)
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, (held - light.count[order] < k), axis=1)
                floor = batch.column(floor_at).to_numpy(zero_copy_only=False).astype(float)[:, None]
                wanted = np.where(np.isnan(floor), first, ~first & (bound <= floor + SLACK)) & (light.count > 0)
                row, cell = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(cell.astype(np.int32))], schema.names)

    return questions.mapInArrow(run, schema)


def _look_through(cells: Cells, asks: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks of every question in each part of each cell that it asks."""
    spark, key = asks.sparkSession, cells.key
    sizes = asks.groupBy("cell").agg(F.count(F.lit(1)).alias("_asks"))
    counts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(cells.count)], "cell int, _n long")
    dealt = F.broadcast(sizes.join(counts, "cell").select(  # a row a cell
        "cell", F.ceil(F.col("_n") / PART).cast("int").alias("_parts"), F.ceil(F.col("_asks") / SHEET).cast("int").alias("_sheets")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(dealt, "cell").withColumn("sheet", F.pmod(F.xxhash64("query_id", "sub"), F.col("_sheets")).cast("int")).withColumn("part", each("_parts"))
    right = cells.chunks.join(dealt, "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).withColumn("sheet", each("_sheets"))
    where = {"category": "category", "chapter": "chapter", "name_has": "name"}
    out = T.StructType([
        T.StructField("query_id", T.StringType()), T.StructField("sub", T.IntegerType()), cells.chunks.schema[key], T.StructField("distance", T.DoubleType())])

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        best = pd.DataFrame({"q": [], "id": [], "distance": []})
        if asked.num_rows and held.num_rows:
            distance = np.round(1.0 - _lists(asked["embedding"].combine_chunks()) @ _lists(held["embedding"].combine_chunks()).T, 6) + 0.0
            for row in range(asked.num_rows):
                for name, column in where.items():
                    value = asked[name][row].as_py() if column in held.column_names else None
                    if value:
                        mask = pc.match_substring(held[column], value) if name == "name_has" else pc.equal(held[column], value)
                        distance[row, ~pc.fill_null(mask, False).combine_chunks().to_numpy(zero_copy_only=False)] = np.inf
            n = distance.shape[1]
            keep = np.isfinite(distance) & (distance <= (np.partition(distance, k - 1, axis=1)[:, k - 1:k] if n > k else np.inf))
            q, c = np.nonzero(keep)
            best = _cut(pd.DataFrame({"q": q, "id": held[key].combine_chunks().to_numpy(zero_copy_only=False)[c], "distance": distance[q, c]}), k)
        rows = pa.array(best["q"].to_numpy().astype(np.int64))
        ids = pa.array(best["id"].to_numpy(), held.schema.field(key).type)
        return pa.table([asked["query_id"].take(rows), asked["sub"].take(rows), ids, pa.array(best["distance"].to_numpy(), pa.float64())], names=out.names)

    at = ["cell", "part", "sheet"]
    left = left.select(*at, "query_id", "sub", "embedding", *FILTERS)
    right = right.select(*at, key, "embedding", *[c for c in ("category", "chapter", "name") if c in cells.chunks.columns])
    return left.join(counts.filter("_n > 0").select("cell"), "cell", "left_semi").groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(work, out)


def nearest(cells: Cells, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`search.top_k`, and one row on the work: ``questions, chunks, compared, skipped_share``.

    ``compared`` counts pairs of question and chunk in the cells that were
    looked through.
    """
    asked = checkpoint(asked_once(questions).filter(F.col("embedding").isNotNull()).withColumn("embedding", F.col("embedding").cast("array<double>")))
    key = cells.key
    ranked = lambda hits: hits.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "sub").orderBy("distance", key))).filter(F.col("rank") <= k)
    first = checkpoint(_asks(cells, asked.withColumn("floor", F.lit(None).cast("double")), k))
    hits = checkpoint(ranked(_look_through(cells, first, k)))
    floors = hits.groupBy("query_id", "sub").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("floor"))
    told = asked.join(floors, ["query_id", "sub"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("inf")))).select(*asked.columns, "floor")
    second = checkpoint(_asks(cells, told, k))
    every = hits.select("query_id", "sub", key, "distance").unionByName(_look_through(cells, second, k))
    best = checkpoint(ranked(every).select("query_id", "sub", "rank", key, "distance"))
    counts = asked.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(cells.count)], "cell int, _n long")
    pairs = first.select("cell").unionByName(second.select("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("_asks"))
    compared = pairs.join(F.broadcast(counts), "cell").agg(F.coalesce(F.sum(F.col("_asks") * F.col("_n")), F.lit(0)).alias("compared"))
    work = asked.agg(F.count(F.lit(1)).alias("questions")).join(compared).withColumn("chunks", F.lit(int(cells.count.sum())))
    share = 1 - F.col("compared") / F.nullif(F.col("questions") * F.col("chunks"), F.lit(0))
    return best, work.select("questions", "chunks", "compared", share.alias("skipped_share"))

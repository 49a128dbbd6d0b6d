"""A chunk index as two partitioned Parquet tables.

``documents`` holds what is known of each document, ``chunks`` their chunks;
both are partitioned by a hash of the document's id.  A run reads and rewrites
only the partitions that hold a document which changed, with Spark's dynamic
partition overwrite.  Chunks are written before documents: a run that ends in
between leaves documents that look changed, and the next run replaces their
chunks again under the same ids, so nothing is lost and nothing doubled.

One run at a time may write an index.  Readers of a partition that is being
replaced should begin anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from archivolt.functions.paths import normalise
from archivolt.functions.text import chunk_text, is_indexable
from archivolt.operators import index as ops
from archivolt.operators.ordered import rows_of, sent_if_small
from archivolt.session import checkpoint
from archivolt.sources import library as lib

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, chunk_ix int, text string, chapter string, name string, category string, "
    "size_kb double, n_chars int")
# Partitions of a new index; an index keeps the number it began with.
BUCKETS = 64


class ChunkIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._begun() or buckets

    def _begun(self) -> int | None:
        """Number of partitions of the index in the folder; it is part of its tables' names."""
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        found = [int(n.rsplit("_", 1)[1]) for n in names if n.startswith("chunks_")]
        return found[0] if found else None

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}_{self.buckets}"

    def _bucket(self, doc: str) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(self.buckets)).cast("int")

    def _buckets(self, docs: DataFrame, doc: str) -> list[int]:
        """Partitions that the documents lie in: at most as many numbers as there are partitions."""
        return sorted(r[0] for r in docs.select(self._bucket(doc).alias("b")).distinct().collect())

    def _table(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of a table, of the named partitions only; None while it was never written."""
        folder = self._folder(table)
        if not self._fs.exists(self._path(folder)):
            return None
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(folder)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _replace(self, table: str, rows: DataFrame, doc: str, buckets: list[int]) -> None:
        """Makes ``rows`` all that the partitions hold."""
        # A row without an id in each, so that an emptied partition is replaced too.
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        placed = rows.withColumn("bucket", self._bucket(doc)).unionByName(marks, allowMissingColumns=True)
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._folder(table))

    # --- reading -----------------------------------------------------------

    def _documents(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self._table("documents", ops.MANIFEST_SCHEMA, buckets)
        rows = self.spark.createDataFrame([], f"{ops.MANIFEST_SCHEMA}, bucket int") if rows is None else rows
        return rows.filter(F.col("rel_path").isNotNull()).drop("bucket")

    def manifest(self, buckets: list[int] | None = None) -> DataFrame:
        """Known documents; an index without any gives an empty table."""
        return self._documents(buckets).filter(F.col("content_sha256").isNotNull())

    def failed(self, buckets: list[int] | None = None) -> DataFrame:
        """Size, time and reason of documents that gave no chunks, so that they are not read again."""
        return self._documents(buckets).filter(F.col("content_sha256").isNull())

    def chunks(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All chunks, or None while nothing was ever indexed."""
        rows = self._table("chunks", CHUNK_SCHEMA, buckets)
        return None if rows is None else rows.filter(F.col("doc_id").isNotNull()).drop("bucket")

    # --- writing -----------------------------------------------------------

    def _exchange(self, retired: DataFrame, fresh: DataFrame | None) -> None:
        """Chunks of the documents ``retired (doc_id)`` out, ``fresh`` ones in."""
        buckets = self._buckets(retired, "doc_id")
        if not buckets:
            return
        kept = self.chunks(buckets)
        parts = [fresh] if fresh is not None else []
        if kept is not None:
            # Chunks are shuffled once, to be written: the ids go to them as long as they fit.
            parts.append(ops.without_documents(kept, sent_if_small(retired)))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self._replace("chunks", rows, "doc_id", buckets)

    def sync(self, library: DataFrame, fetch: Callable[[DataFrame | None], DataFrame], indexed_at: str, *,
             rebuild: bool = False, remove_missing: bool = True, again: DataFrame | None = None) -> DataFrame:
        """Brings the index up to the library and returns the outcome per path.

        ``library`` holds rel_path, size_bytes and modified_us.  ``fetch`` is
        asked only for the paths that need a look at their content, or with
        None for all of them; it gives rel_path, content_sha256, name,
        category, size_kb, ok, text and error, joined with what it was given.  A
        new document that failed before is not read again while its size and
        time stay, unless its path is in ``again``.  Without
        ``remove_missing`` the library is a part of the whole, and only the
        partitions of its documents are read.
        """
        part = None if remove_missing else self._buckets(library, "rel_path")
        looks = ops.stat_changes(library, self.manifest(part), rebuild)
        if not remove_missing:
            looks = looks.filter("look <> 'deleted'")
        # Decided once and written down: what follows must not see it change.
        looks = checkpoint(self._failed_before(looks, self.failed(part), rebuild, again))
        before = looks.filter("look = 'failed'").select("rel_path", "_why")
        seen = looks.agg(
            F.count(F.lit(1)).alias("all"), F.count_if(F.col("look") == "new").alias("new"),
            F.count_if(F.col("look").isin("same", "failed")).alias("same")).first()
        if seen["same"] == seen["all"]:
            none = self.spark.createDataFrame([], "rel_path string, chunk_count long")
            change = F.when(F.col("look") == "failed", "new").otherwise("unchanged")
            return self._with_reasons(ops.sync_items(looks.withColumn("change", change), none), before)
        if seen["new"] == seen["all"]:
            # A first build wants every text: nothing to join with.
            asked = fetch(None).select("*", F.lit("new").alias("look"), *[F.lit(None).cast("string").alias(c) for c in ("_sha", "_last")])
        else:
            asked = fetch(looks.filter("look in ('new', 'check')").select("rel_path", "size_bytes", "look", "_sha", "_last", "modified_us"))
        # Hash, change and chunks in one pass over the texts; they are written
        # down, so that a text is read and cut once.
        moved = ops.change_of_checked(rebuild).isin("new", "modified") & F.col("ok")
        stage = f"{self.path}/stage_{uuid.uuid4().hex}"
        asked.select(
            "rel_path", "content_sha256", "name", "category", F.col("size_kb").cast("double").alias("size_kb"),
            F.when(ops.change_of_checked(rebuild).isin("new", "modified") & ~F.col("ok"), F.col("error")).alias("_why"),
            F.when(moved & is_indexable("text"), chunk_text("text")).alias("chunks"),
        ).write.parquet(stage)
        try:
            return self._brought_in(self.spark.read.parquet(stage), looks, before, indexed_at, rebuild, remove_missing)
        finally:
            self._fs.delete(self._path(stage), True)

    def _brought_in(self, asked: DataFrame, looks: DataFrame, before: DataFrame, indexed_at: str, rebuild: bool, whole: bool) -> DataFrame:
        """The second half of :meth:`sync`: what was asked for is settled and written."""
        changes = checkpoint(ops.settle_changes(looks, asked, rebuild))
        counts = asked.select("rel_path", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("chunk_count")).filter("chunk_count > 0")
        reasons = asked.filter("_why IS NOT NULL").select("rel_path", "_why")
        items = checkpoint(self._with_reasons(ops.sync_items(changes, counts), reasons.unionByName(before)))

        cut = asked.filter(F.size("chunks") > 0).select(F.col("rel_path").alias("doc_id"), "name", "category", "size_kb", F.posexplode("chunks").alias("chunk_ix", "_chunk"))
        fresh = cut.select(
            ops.chunk_id("doc_id", "chunk_ix").alias("chunk_id"), "doc_id", "chunk_ix", F.col("_chunk.text").alias("text"),
            F.col("_chunk.chapter").alias("chapter"), "name", "category", "size_kb", F.length("_chunk.text").alias("n_chars"))
        self._exchange(items.filter("status in ('indexed', 'deleted')").select(F.col("rel_path").alias("doc_id")), fresh)

        old_failures = before.select("rel_path")
        moves = items.filter("status <> 'skipped' or change = 'touched'").join(old_failures, "rel_path", "left_anti")
        buckets = self._buckets(moves, "rel_path")
        if buckets:
            here = lambda df: df.filter(self._bucket("rel_path").isin(buckets))
            known = ops.next_manifest(self.manifest(buckets), here(changes), here(items), indexed_at)
            bad = here(changes).join(items.filter("status = 'failed' and change = 'new'").select("rel_path", "error"), "rel_path").select(
                "rel_path", "size_bytes", "modified_us", F.lit("failed").alias("last_operation"), F.col("error").alias("last_error"))
            if not whole:
                # A part of the library says nothing about the rest.
                bad = bad.unionByName(self.failed(buckets).select(bad.columns).join(changes.select("rel_path"), "rel_path", "left_anti"))
            self._replace("documents", known.unionByName(bad, allowMissingColumns=True), "rel_path", buckets)
        return items

    @staticmethod
    def _failed_before(looks: DataFrame, failed: DataFrame, rebuild: bool, again: DataFrame | None) -> DataFrame:
        """Adds ``_why``; a new document that failed before with the same size and time has the look ``failed`` and is not read."""
        if rebuild:
            return looks.withColumn("_why", F.lit(None).cast("string"))
        before = failed.select("rel_path", F.col("size_bytes").alias("_s"), F.col("modified_us").alias("_m"), F.col("last_error").alias("_why"))
        if again is not None:
            before = before.join(again.select("rel_path").distinct(), "rel_path", "left_anti")
        same = (F.col("look") == "new") & (F.col("_s") == F.col("size_bytes")) & (F.col("_m") == F.col("modified_us"))
        return looks.join(before, "rel_path", "left").withColumn("look", F.when(same, "failed").otherwise(F.col("look"))).drop("_s", "_m")

    @staticmethod
    def _with_reasons(items: DataFrame, reasons: DataFrame) -> DataFrame:
        return items.join(reasons, "rel_path", "left").withColumn("error", F.coalesce("_why", "error")).drop("_why")

    def sync_folder(self, root: str, indexed_at: str, *, extracted: DataFrame | None = None,
                    rebuild: bool = False) -> DataFrame:
        """:meth:`sync` with the files below ``root``; only wanted files are opened."""
        def fetch(wanted: DataFrame | None) -> DataFrame:
            bodies = lib.read_bodies(self.spark, root, wanted)
            return lib.load_documents(bodies.withColumn("content_sha256", F.sha2("content", 256)), extracted)

        return self.sync(lib.scan(self.spark, root), fetch, indexed_at, rebuild=rebuild, again=extracted)

    def sync_table(self, documents: DataFrame, indexed_at: str, **options) -> DataFrame:
        """:meth:`sync` with a table of rel_path, size_bytes, modified_us and text."""
        def fetch(wanted: DataFrame | None) -> DataFrame:
            rows = documents.select("rel_path", "size_bytes", "text")
            rows = rows if wanted is None else rows_of(rows, wanted.drop("size_bytes"), "rel_path")
            return lib.envelope(rows.withColumn("content_sha256", ops.content_hash("text")))

        return self.sync(documents, fetch, indexed_at, **options)

    def delete(self, wanted: DataFrame) -> DataFrame:
        """Removes documents (rel_path in ``doc_id``); asking twice does no harm."""
        wanted = checkpoint(wanted.select(normalise("doc_id").alias("doc_id")).distinct())
        buckets = self._buckets(wanted, "doc_id")
        known = self.manifest(buckets).select(F.col("rel_path").alias("doc_id"), "chunk_count")
        report = checkpoint(wanted.join(known, "doc_id", "left").select(
            "doc_id", F.when(F.col("chunk_count").isNull(), "not_found").otherwise("deleted").alias("status"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunks")))
        gone = report.filter("status = 'deleted'").select("doc_id")
        self._exchange(gone, None)
        buckets = self._buckets(gone, "doc_id")
        if buckets:
            kept = self._documents(buckets).join(gone.select(F.col("doc_id").alias("rel_path")), "rel_path", "left_anti")
            self._replace("documents", kept, "rel_path", buckets)
        return report

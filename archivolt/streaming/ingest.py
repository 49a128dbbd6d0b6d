"""Continuous ingest: what lands is indexed, once, whatever fails in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from archivolt.operators.ordered import first_seen
from archivolt.sources import library as lib
from archivolt.sources.store import ChunkIndex


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def landing_files(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """Stream of plain-text library files that appear below ``root``."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_batch).load(root))
    rows = lib._relative(files.select("path", "length", "modificationTime", "content"), lib._root_uri(spark, root))
    rows = rows.filter(lib.is_library_file("rel_path", [".md", ".txt"]))
    return rows.withColumn("text", lib.decode_text("content")).drop("content")


def index_batch(index: ChunkIndex, indexed_at: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that brings a batch into the index.

    Nothing is deleted: a batch says nothing about files it does not hold.
    Only the partitions of the batch's documents are read, and those rewritten
    that change.  A batch that comes again after a crash finds its documents as
    they are, or replaces them once more under the same ids.
    """
    def run(batch: DataFrame, number: int) -> None:
        # Of a file that changed twice in one batch the newest state counts.
        newest = first_seen(batch, ["rel_path"], [F.desc("modified_us")])
        index.sync_table(newest, indexed_at(number), remove_missing=False)

    return run


def start_ingest(stream: DataFrame, index: ChunkIndex, checkpoint: str, indexed_at: Callable[[int], str],
                 once: bool = False) -> StreamingQuery:
    """Starts the ingest; ``once`` works off what is there and ends."""
    writer = stream.writeStream.foreachBatch(index_batch(index, indexed_at)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

"""Single files by path, read and written where Spark puts the rows.

Spark's own file reader opens every file that it lists.  Here a table of paths
says which to open: it is dealt out by bytes, and each task opens its own.
Paths are reached through pyarrow's file systems: local and shared folders,
HDFS and object stores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from archivolt.operators.ordered import running
from archivolt.session import checkpoint

# Bytes of files in one task, and what opening one counts beside its size.
TASK_BYTES, OPEN_BYTES = 128 << 20, 1 << 20
# Contents that leave a task together.
BATCH_BYTES = 16 << 20
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfs"}


def place_of(spark: SparkSession, root: str) -> tuple[str, str, str]:
    """Scheme, host and path of a folder, as Hadoop resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getScheme(), uri.getAuthority() or "", uri.getPath().rstrip("/")


def reachable(place: tuple[str, str, str]) -> bool:
    """Whether tasks can open single files there; other stores are left to Spark's reader."""
    return place[0] in SCHEMES


def _system(place: tuple[str, str, str]):
    """A file system and the prefix of its paths."""
    from pyarrow import fs

    scheme, host, path = place
    if scheme == "file":
        return fs.LocalFileSystem(), path
    system, bucket = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{host}/")
    return system, bucket.rstrip("/") + path


def dealt_by_bytes(files: DataFrame, size: str = "size_bytes", task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` in partitions of about ``task_bytes``, by a running sum of sizes; a larger file is a partition of its own.

    The rows are written down first: sums and dealing use them three times, and
    behind them is mostly the listing of a folder, with a look at every file.
    """
    files = checkpoint(files)
    names = files.columns
    sized = files.withColumn("_cost", F.coalesce(F.col(size), F.lit(0)).cast("long") + OPEN_BYTES).withColumn("_order", F.xxhash64("rel_path"))
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("_cost"), F.lit(0))).first()
    if not n:
        return files
    # About 4096 files of a hash range are summed together.
    summed = running(sized, [], "_order", "_cost", "_before", span=max(1, (1 << 63) // (1 + n // 8192)))
    parts = 1 + total // task_bytes
    return summed.repartitionById(int(parts), F.expr(f"CAST(_before div {task_bytes} AS INT)")).select(*names)


def read_files(spark: SparkSession, root: str, wanted: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``wanted`` (rel_path, and size_bytes where known) with ``size_bytes`` as read and ``content``.

    Exactly the wanted files are opened, each once.  A file that is gone by
    then gives no row.  Contents leave a task in batches of bounded size; one
    file's content is one value, so it must fit a task.
    """
    place = place_of(spark, root)
    if "size_bytes" not in wanted.columns:
        wanted = wanted.withColumn("size_bytes", F.lit(0).cast("long"))
    rest = [c for c in wanted.columns if c not in ("rel_path", "size_bytes", "content")]
    kept = wanted.select("rel_path", "size_bytes", *rest)
    schema = kept.withColumn("content", F.lit(b"").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, prefix = _system(place)
        for batch in batches:
            rows, contents, held = [], [], 0

            def flush():
                out = batch.take(pa.array(rows, pa.int64()))
                sizes = pa.array([len(c) for c in contents], pa.int64())
                columns = [out.column(0), sizes, *(out.column(k) for k in range(2, out.num_columns)), pa.array(contents, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, schema.names)

            for row, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{prefix}/{path}") as stream:
                        contents.append(stream.readall())
                except FileNotFoundError:
                    continue
                rows.append(row)
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield flush()
                    rows, contents, held = [], [], 0
            if rows:
                yield flush()

    return dealt_by_bytes(kept, "size_bytes", task_bytes).mapInArrow(run, schema)


def write_files(rows: DataFrame, root: str) -> int:
    """Writes ``content`` (binary or string) of each row to ``rel_path`` below ``root`` and returns their number.

    A task that runs twice writes the same files again.
    """
    place = place_of(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, prefix = _system(place)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = f"{prefix}/{path}"
                folder = full.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(full) as stream:
                    stream.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    wanted = rows.select("rel_path", F.col("content").cast("binary").alias("content"))
    return wanted.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

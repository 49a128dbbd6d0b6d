"""Registered queries on the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archivolt.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for heavy work per row: a small file that Spark would read
        in fewer tasks than there are cores is dealt out first, in pieces of
        no less than 256 KiB.  A table with tasks enough is left as it is.
        """
        table = getattr(self, name)
        size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = min(self.spark.sparkContext.defaultParallelism, 1 + size // (256 << 10))
        # A file of one row group is one task, in however many splits it is cut.
        return table.repartition(wanted) if wanted > 1 and table.rdd.getNumPartitions() <= wanted else table


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function from tables to a result under its own name."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    from archivolt.plans import audit, dialogue, enrichment, exams, library, search, streams, web  # noqa: F401

"""Streaming jobs run to their end over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from archivolt import fixed
from archivolt.plans import Tables, query
from archivolt.plans.dialogue import PAIRS_SQL
from archivolt.plans.library import _v1, strip_sql
from archivolt.session import scratch_folder
from archivolt.sources.store import ChunkIndex
from archivolt.streaming import counters, history, ingest


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    # A pattern, since Spark takes a path without one for a folder.
    path = f"{t.folder}/{name}.parque[t]"
    return t.spark.readStream.schema(getattr(t, name).schema).option("maxBytesPerTrigger", str(256 << 20)).parquet(path)


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream to its end into a Parquet table below the scratch folder.

    Each batch is a folder of its own; the last batch of a key is its state.
    """
    folder = scratch_folder(spark)
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(out)


COUNTS = "count(*) AS events, count(*) FILTER (event_id % 7 = 1) AS injections, count(*) FILTER (user_id % 2 = 0) AS secrets"


def _events(t: Tables) -> DataFrame:
    # Payloads of even users get a key that counts as secret.
    props = F.when(F.col("user_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"k_token"'))).otherwise(F.col("props"))
    # Every seventh event holds one of the injection phrases, in capitals.
    phrases = F.array(*[F.lit(p.upper()) for p in fixed.INJECTION_PHRASES])
    phrase = F.element_at(phrases, (F.pmod(F.col("event_id"), F.lit(len(fixed.INJECTION_PHRASES))) + 1).cast("int"))
    return _stream(t, "events").withColumn("props", F.when(F.col("event_id") % 7 == 1, F.concat(props, F.lit(" "), phrase)).otherwise(props))


@query(f"SELECT event_type, {COUNTS} FROM events GROUP BY event_type")
def streaming_event_counts(t: Tables) -> DataFrame:
    done = _run(t.spark, counters.event_counts(_events(t)), "update")
    return done.groupBy("event_type").agg(*[F.max_by(c, "_batch").alias(c) for c in ("events", "injections", "secrets")])


@query(f"""WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, {COUNTS} FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, events, injections, secrets FROM w
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def streaming_windowed_counts(t: Tables) -> DataFrame:
    """Windows that the watermark has closed by the end of the stream."""
    done = _run(t.spark, counters.windowed_counts(_events(t)), "append")
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", "injections", "secrets")


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT conv_id, turn, question, length(answer) > 50 AS long, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM pairs),
g AS (SELECT conv_id, count(*) AS pairs, string_agg(question, chr(10) ORDER BY turn) FILTER (age <= 5) AS questions, count(*) FILTER (long) AS n FROM p GROUP BY conv_id)
SELECT c.conv_id, max(turn) AS last_turn, coalesce(any_value(pairs), 0) AS pairs, coalesce(any_value(questions), '') AS questions,
  (coalesce(any_value(n), 0) // 5)::BIGINT AS batches_due, (coalesce(any_value(n), 0) % 5)::BIGINT AS waiting FROM conversations c LEFT JOIN g ON c.conv_id = g.conv_id GROUP BY c.conv_id""")
def streaming_history(t: Tables) -> DataFrame:
    """The last five questions of every conversation, whose turns arrive in an order that has nothing to do with theirs."""
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", history.PROVIDER)
    try:
        done = _run(t.spark, history.rolling_history(_shuffled(t)), "update")
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    columns = ["last_turn", "pairs", "questions", "batches_due", "waiting"]
    return done.groupBy("conv_id").agg(*[F.max_by(c, "_batch").alias(c) for c in columns])


def _shuffled(t: Tables) -> DataFrame:
    """The turns as a stream of three batches or a few more, dealt by hash; a batch holds 256 MiB of files at most, however many they are."""
    folder = scratch_folder(t.spark)
    turns = t.spread("conversations")
    for part in range(3):
        turns.filter(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == part).write.parquet(f"{folder}/part={part}")
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    # A trigger takes a folder's files or fewer, never a turn twice.
    return t.spark.readStream.schema(t.conversations.schema).option("recursiveFileLookup", "true").option(
        "maxBytesPerTrigger", str(min(256 << 20, 1 + size // 3))).parquet(folder)


@query(f"""SELECT source || '/doc_' || doc_id || '.md' AS doc_id, sha256(text) AS content_sha256 FROM documents WHERE length({strip_sql('text')}) >= 50""")
def streaming_ingest(t: Tables) -> DataFrame:
    """Documents arrive as a stream; the manifest of the index afterwards."""
    folder = scratch_folder(t.spark)
    index = ChunkIndex(t.spark, f"{folder}/index")
    landed = _v1(Streamed(t))
    ingest.start_ingest(landed, index, f"{folder}/state", lambda n: f"batch {n}", once=True).awaitTermination()
    return index.manifest().select(F.col("rel_path").alias("doc_id"), "content_sha256")


class Streamed:
    """The documents table as a stream, for functions that take tables."""

    def __init__(self, t: Tables):
        self.documents = _stream(t, "documents")

    def spread(self, name: str) -> DataFrame:
        return getattr(self, name)


"""Streams in several batches, and what comes twice."""

import os
import random

from archivolt.sources.store import ChunkIndex
from archivolt.streaming import counters, history, ingest

BODY = "Texto de prueba con largo suficiente para formar un fragmento del indice. " * 2


def test_ingest_in_batches_and_again(spark, scratch):
    index = ChunkIndex(spark, scratch + "/index")
    schema = "rel_path string, text string, size_bytes long, modified_us long"

    def land(n, rows):
        spark.createDataFrame([(p, t, len(t), m) for p, t, m in rows], schema).coalesce(1).write.parquet(f"{scratch}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(scratch + "/in")
        ingest.start_ingest(stream, index, scratch + "/state", lambda n: f"b{n}", once=True).awaitTermination()

    land(1, [("a.md", BODY, 1), ("b.md", BODY, 1), ("b.md", BODY + "nuevo", 2)])
    run()
    assert {r["rel_path"]: r["modified_us"] for r in index.manifest().collect()} == {"a.md": 1, "b.md": 2}
    land(2, [("c.md", BODY, 3), ("a.md", BODY + "otra vez", 4)])
    run()
    assert {r["doc_id"] for r in index.chunks().collect()} == {"a.md", "b.md", "c.md"}
    # The last batch is delivered once more, as after a crash before its commit: nothing is doubled.
    rows = lambda: sorted(map(tuple, index.chunks().collect()))
    before = rows()
    again = spark.createDataFrame([("c.md", BODY, len(BODY), 3), ("a.md", BODY + "otra vez", len(BODY) + 8, 4)], schema)
    ingest.index_batch(index, lambda n: "x")(again, 1)
    assert rows() == before


def test_a_batch_writes_its_own_partitions(spark, scratch):
    index = ChunkIndex(spark, scratch, buckets=16)
    schema = "rel_path string, text string, size_bytes long, modified_us long"
    many = [(f"d{i}.md", BODY + str(i), len(BODY) + len(str(i)), 1) for i in range(200)]
    ingest.index_batch(index, lambda n: "t")(spark.createDataFrame(many, schema), 0)
    files = lambda: {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, ns in os.walk(scratch) for n in ns if n.endswith(".parquet")}
    before = files()
    ingest.index_batch(index, lambda n: "t")(spark.createDataFrame([("d7.md", BODY + "x", len(BODY) + 1, 2)], schema), 1)
    assert len({os.path.dirname(f) for f, _ in before.items() ^ files().items()}) == 2
    assert index.manifest().count() == 200 and index.manifest().filter("modified_us = 2").count() == 1


def test_landing_files(spark, scratch):
    with open(scratch + "/uno.md", "w") as f:
        f.write(BODY)
    index = ChunkIndex(spark, scratch + "-index")
    stream = ingest.landing_files(spark, scratch)
    ingest.start_ingest(stream, index, scratch + "-state", lambda n: "t", once=True).awaitTermination()
    assert [r["doc_id"] for r in index.chunks().collect()] == ["uno.md"]


def _turns(conv, n):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", f"{conv}.{i} " + "x" * (60 if i % 4 == 1 else 10)) for i in range(n)]


def _history(spark, scratch, parts, n=5):
    schema = "conv_id long, turn long, role string, text string"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{scratch}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(scratch + "/in")
    out, name = [], "spark.sql.streaming.stateStore.providerClass"

    def keep(batch, number):
        out.extend(r.asDict() for r in batch.collect())

    before = spark.conf.get(name)
    spark.conf.set(name, history.PROVIDER)
    try:
        history.rolling_history(stream, n, 3).writeStream.outputMode("update").option("checkpointLocation", scratch + "/state").trigger(
            availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return out


def test_history_in_order(spark, scratch):
    turns = _turns(1, 16)
    out = _history(spark, scratch, [turns[:5][::-1], turns[5:]])
    assert [(r["last_turn"], r["pairs"], r["batches_due"], r["waiting"]) for r in out] == [(4, 2, 0, 1), (15, 8, 1, 1)]
    assert [q.split(" ")[0] for q in out[-1]["questions"].split("\n")] == ["1.6", "1.8", "1.10", "1.12", "1.14"]


def test_late_turns_are_put_in_order(spark, scratch):
    """Any order of arrival ends in the same rows; questions without an answer and other roles count nothing."""
    turns = _turns(1, 30) + _turns(2, 7) + [(3, 0, "system", "s"), (3, 1, "user", "3.1 q"), (3, 2, "system", "s"), (3, 3, "user", "3.3 q"), (3, 4, "assistant", None)]
    draw = random.Random(4)
    draw.shuffle(turns)
    out = _history(spark, scratch, [turns[:9], turns[9:25], turns[25:26], turns[26:]])
    last = {r["conv_id"]: r for r in out}
    assert {c: (r["last_turn"], r["pairs"], r["batches_due"], r["waiting"]) for c, r in last.items()} == {1: (29, 15, 2, 2), 2: (6, 3, 0, 2), 3: (4, 1, 0, 0)}
    assert [q.split(" ")[0] for q in last[1]["questions"].split("\n")] == ["1.20", "1.22", "1.24", "1.26", "1.28"]
    assert last[3]["questions"] == "3.3 q"


def test_batches_do_not_grow_with_the_files(spark, scratch):
    from archivolt.plans import Tables, streams

    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(12).write.parquet(f"{scratch}/conversations.parquet")
    seen = []
    streams._shuffled(Tables(spark, scratch)).writeStream.option("checkpointLocation", scratch + "/state").trigger(
        availableNow=True).foreachBatch(lambda batch, number: seen.append(batch.count())).start().awaitTermination()
    assert 3 <= len(seen) <= 5 and sum(seen) == spark.read.parquet(f"{scratch}/conversations.parquet").count()

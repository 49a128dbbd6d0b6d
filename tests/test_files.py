import os
import tempfile

import pytest
from pyspark.sql import functions as F

from archivolt.sources import files, library as lib, records


def _library(spark, root, n=300):
    rows = [(f"d{i % 7}/Ñ {i} #%.md", f"text {i}" * (1 + i % 5)) for i in range(n)]
    assert files.write_files(spark.createDataFrame(rows, "rel_path string, content string"), root) == n
    return dict(rows)


def test_only_wanted_files_are_opened(spark, scratch):
    """A scattered part of the files is read although all others are unreadable by then."""
    bodies = _library(spark, scratch)
    listed = spark.createDataFrame(lib.scan(spark, scratch).collect())
    assert listed.count() == 300
    chosen = sorted(bodies)[::100]
    for path in bodies:
        if path not in chosen:
            os.remove(os.path.join(scratch, path))
            os.mkdir(os.path.join(scratch, path))  # opening it would fail
    wanted = listed.filter(F.col("rel_path").isin(chosen)).withColumn("note", F.lit("n"))
    got = lib.read_bodies(spark, scratch, wanted).collect()
    assert sorted((r.rel_path, r.content.decode(), r.size_bytes, r.note) for r in got) == [(p, bodies[p], len(bodies[p]), "n") for p in chosen]


def test_missing_files_and_empty_lists(spark, scratch):
    _library(spark, scratch, 3)
    wanted = spark.createDataFrame([("d0/Ñ 0 #%.md",), ("gone.md",)], "rel_path string")
    assert [(r.rel_path, bytes(r.content)) for r in lib.read_bodies(spark, scratch, wanted).collect()] == [("d0/Ñ 0 #%.md", b"text 0")]
    assert lib.read_bodies(spark, scratch, wanted.limit(0)).count() == 0
    assert files.write_files(wanted.limit(0).withColumn("content", F.lit("x")), scratch) == 0


def test_files_are_dealt_by_bytes(spark):
    mib = 1 << 20
    rows = [(f"f{i}", 40 * mib if i % 50 == 0 else i * 10) for i in range(1000)]
    dealt = files.dealt_by_bytes(spark.createDataFrame(rows, "rel_path string, size_bytes long"), task_bytes=64 * mib)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.col("size_bytes") + files.OPEN_BYTES).alias("b"), F.max("size_bytes").alias("m")).collect()
    total = sum(s + files.OPEN_BYTES for _, s in rows)
    assert sum(r.b for r in sizes) == total and len(sizes) <= 1 + total // (64 * mib)
    assert all(r.b <= 64 * mib + r.m + files.OPEN_BYTES for r in sizes)


def test_the_listing_is_made_once(spark, scratch):
    """Each row leaves a file wherever it is made; there are as many as rows."""
    def listed(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                tempfile.mkstemp(dir=scratch)
            yield batch

    rows = spark.createDataFrame([(f"f{i}", 10 * i) for i in range(40)], "rel_path string, size_bytes long")
    dealt = files.dealt_by_bytes(rows.mapInArrow(listed, rows.schema), task_bytes=8 << 20)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    assert len(os.listdir(scratch)) == 40


LINES = [f"2024-01-01 00:00:{i % 60:02d} - INFO - e{i}: d" if i % 3 else ("" if i % 2 else f"free {i} é") for i in range(2000)] + [" ", "last"]


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_log_lines_by_place(spark, scratch, split):
    """Numbers and tails over a file of many splits equal plain Python."""
    raw = "\n".join(LINES).encode() + b"\nbad \xff byte\n\n"
    os.makedirs(f"{scratch}/log")
    with open(f"{scratch}/log/a.txt", "wb") as f:
        f.write(raw)
    with open(f"{scratch}/log/b.txt", "w") as f:
        f.write("one\n\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k" if split == "3k" else "4m")
    try:
        lines = records.read_log_lines(spark, f"{scratch}/log")
        if split == "3k":
            assert lines.select("file", "block").distinct().count() > 5
        plain = {"a.txt": raw.decode(errors="replace").split("\n")[:-1], "b.txt": ["one", "", "two"]}
        got = [(os.path.basename(r.file), r.line_no, r.line) for r in records.numbered_lines(lines).collect()]
        assert sorted(got) == sorted((f, i + 1, t) for f, ts in plain.items() for i, t in enumerate(ts))
        every = sorted((r.line_no, r.line) for r in records.numbered_lines(lines, ()).collect())
        assert [t for _, t in every] == plain["a.txt"] + plain["b.txt"] and [n for n, _ in every] == list(range(1, len(every) + 1))
        tails = records.tail_lines(lines, 4).collect()
        for name, texts in plain.items():
            mine = sorted((r.age, r.line) for r in tails if r.file.endswith(name))
            assert [t for _, t in mine] == [t for t in reversed(texts) if t.strip()][:4]
        assert [r.line for r in sorted(records.tail_lines(lines, 3, ()).collect(), key=lambda r: r.age)] == ["two", "one", "bad � byte"]
        events = records.read_security_log(spark, f"{scratch}/log")
        assert records.tail(events, 2, ["file", "block", "row"]).select("line", "event").collect()[0]["line"] == "two"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])

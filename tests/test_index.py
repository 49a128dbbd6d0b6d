"""The index folder: what a run does, and that nothing is lost when one fails."""

import os

import pytest
from pyspark.sql import functions as F

from archivolt.operators import index as ix
from archivolt.sources import library as lib
from archivolt.sources.store import ChunkIndex

BODY = "Este documento tiene texto suficiente para ser indexado sin problemas. " * 3


def table(spark, rows):
    """rows: (rel_path, text, modified_us)"""
    return spark.createDataFrame(rows, "rel_path string, text string, modified_us long").withColumn(
        "size_bytes", F.octet_length("text").cast("long"))


def outcome(items):
    return {r["rel_path"]: (r["change"], r["status"]) for r in items.collect()}


def stored(root):
    """Every data file of an index, with its time."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def consistent(index):
    chunks, manifest = index.chunks(), index.manifest()
    ids = [r[0] for r in chunks.select("chunk_id").collect()]
    assert len(ids) == len(set(ids))
    total = manifest.agg(F.sum("chunk_count")).first()[0] or 0
    assert len(ids) == total
    return {r["doc_id"]: r["n"] for r in chunks.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}


V1 = [("a/keep.md", BODY, 1), ("a/touch.md", BODY, 1), ("a/change.md", BODY, 1), ("a/gone.md", BODY, 1),
      ("b/keep.md", BODY + "otro", 1), ("a/short.md", "x" * 49, 1)]
V2 = [("a/keep.md", BODY, 1), ("a/touch.md", BODY, 2), ("a/change.md", BODY + " nuevo", 2), ("b/keep.md", BODY + "otro", 1),
      ("a/short.md", "x" * 49, 1), ("c/new.md", BODY, 5)]


def test_life_of_an_index(spark, scratch):
    index = ChunkIndex(spark, scratch)
    first = index.sync_table(table(spark, V1), "t1")
    assert outcome(first)["a/short.md"] == ("new", "failed")
    assert ix.sync_summary(first).first().asDict() == dict(
        scanned=6, indexed_new=5, reindexed_modified=0, skipped_unchanged=0, removed_deleted=0, failed=1, mode="sync")
    assert set(consistent(index)) == {"a/keep.md", "a/touch.md", "a/change.md", "a/gone.md", "b/keep.md"}

    second = index.sync_table(table(spark, V2), "t2")
    assert outcome(second) == {
        "a/keep.md": ("unchanged", "skipped"), "a/touch.md": ("touched", "skipped"), "a/change.md": ("modified", "indexed"),
        "a/gone.md": ("deleted", "deleted"), "b/keep.md": ("unchanged", "skipped"), "a/short.md": ("new", "failed"),
        "c/new.md": ("new", "indexed")}
    assert set(consistent(index)) == {"a/keep.md", "a/touch.md", "a/change.md", "b/keep.md", "c/new.md"}
    known = {r["rel_path"]: r for r in index.manifest().collect()}
    assert known["a/touch.md"]["modified_us"] == 2 and known["a/touch.md"]["indexed_at"] == "t1"
    assert known["a/change.md"]["indexed_at"] == "t2" and "a/short.md" not in known
    assert "nuevo" in index.chunks().filter("doc_id = 'a/change.md'").orderBy(F.desc("chunk_ix")).first()["text"]

    files = stored(scratch)
    third = index.sync_table(table(spark, [r for r in V2 if r[0] != "a/short.md"]), "t3")
    assert {v[1] for v in outcome(third).values()} == {"skipped"} and stored(scratch) == files

    rebuilt = index.sync_table(table(spark, V2), "t4", rebuild=True)
    assert ix.sync_summary(rebuilt, "rebuild").first()["reindexed_modified"] == 5
    assert len(consistent(index)) == 5


def test_rebuild_equals_first_build(spark, scratch):
    one, two = ChunkIndex(spark, scratch + "/1"), ChunkIndex(spark, scratch + "/2")
    one.sync_table(table(spark, V1), "t")
    one.sync_table(table(spark, V2), "t")
    one.sync_table(table(spark, V2), "t", rebuild=True)
    two.sync_table(table(spark, V2), "t")
    rows = lambda i: sorted(map(tuple, i.chunks().collect()))
    assert rows(one) == rows(two)


def test_failed_document_keeps_its_chunks_and_is_retried(spark, scratch):
    index = ChunkIndex(spark, scratch)
    index.sync_table(table(spark, [("d.md", BODY, 1)]), "t1")
    before = consistent(index)
    bad = table(spark, [("d.md", "corto", 2)])
    assert outcome(index.sync_table(bad, "t2")) == {"d.md": ("modified", "failed")}
    entry = index.manifest().first()
    assert entry["last_operation"] == "failed" and entry["modified_us"] == 1 and consistent(index) == before
    # Back to the old state: the size and time fit again, but the failure is looked at.
    assert outcome(index.sync_table(table(spark, [("d.md", BODY, 1)]), "t3")) == {"d.md": ("modified", "indexed")}
    assert index.manifest().first()["last_error"] is None


def test_delete_is_idempotent_and_exact(spark, scratch):
    index = ChunkIndex(spark, scratch)
    index.sync_table(table(spark, V1), "t1")
    wanted = spark.createDataFrame([("a\\keep.md",), ("nowhere.md",)], "doc_id string")
    report = {r["doc_id"]: (r["status"], r["chunks"]) for r in index.delete(wanted).collect()}
    assert report == {"a/keep.md": ("deleted", 1), "nowhere.md": ("not_found", 0)}
    assert {r["status"] for r in index.delete(wanted).collect()} == {"not_found"}
    assert "b/keep.md" in consistent(index) and "a/keep.md" not in consistent(index)


def test_a_run_rewrites_touched_partitions_only(spark, scratch):
    index = ChunkIndex(spark, scratch, buckets=8)
    rows = [(f"d{i}.md", BODY + str(i), 1) for i in range(40)]
    index.sync_table(table(spark, rows), "t1")
    before = stored(scratch)
    rows[3] = ("d3.md", BODY * 2, 2)
    assert outcome(index.sync_table(table(spark, rows), "t2"))["d3.md"] == ("modified", "indexed")
    place = lambda f: os.path.relpath(os.path.dirname(f), scratch)
    changed = {place(f) for f in before.items() ^ stored(scratch).items() for f in [f[0]]}
    assert len(changed) == 2 and {c.split("/")[0] for c in changed} == {"chunks_8", "documents_8"}
    assert len({place(f) for f in before}) > 8 and len(consistent(index)) == 40
    # The number of partitions stays, whatever is asked for later; an emptied partition holds nothing.
    again = ChunkIndex(spark, scratch, buckets=3)
    assert again.buckets == 8
    again.sync_table(table(spark, rows[:1]), "t3")
    assert set(consistent(again)) == {"d0.md"} and not [n for n in os.listdir(scratch) if n.startswith("stage")]


@pytest.mark.parametrize("second", [V2, V1[:2]])
def test_run_that_dies_between_its_tables_is_made_up_for(spark, scratch, monkeypatch, second):
    """Chunks are in, documents are not: the next run settles it."""
    index = ChunkIndex(spark, scratch)
    index.sync_table(table(spark, V1), "t1")
    replace = ChunkIndex._replace

    def die(self, name, *rest):
        if name == "documents":
            raise OSError("disk full")
        replace(self, name, *rest)

    with monkeypatch.context() as m:
        m.setattr(ChunkIndex, "_replace", die)
        with pytest.raises(OSError):
            index.sync_table(table(spark, second), "t2")
    assert {r["rel_path"] for r in index.manifest().collect()} == {r[0] for r in V1 if r[0] != "a/short.md"}
    index.sync_table(table(spark, second), "t2")
    assert set(consistent(index)) == {r[0] for r in second if r[0] != "a/short.md"}


def test_documents_too_short_are_not_read_again(spark, scratch):
    index = ChunkIndex(spark, scratch)
    rows = V1 + [("z/short.md", "corto", 1)]
    first = index.sync_table(table(spark, rows), "t1")
    assert outcome(first)["z/short.md"] == ("new", "failed")
    files = stored(scratch)

    def fetch(wanted):
        raise AssertionError("a text was asked for")

    again = index.sync(table(spark, rows).drop("text"), fetch, "t2")
    assert outcome(again)["z/short.md"] == ("new", "failed") and again.filter("status = 'failed'").first()["error"]
    assert stored(scratch) == files
    grown = V1 + [("z/short.md", BODY, 2)]
    assert outcome(index.sync_table(table(spark, grown), "t3"))["z/short.md"] == ("new", "indexed")


def test_empty_index(spark, scratch):
    index = ChunkIndex(spark, scratch + "/none")
    assert index.manifest().count() == 0 and index.chunks() is None


def write(root, files):
    for path, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(body)


def test_folder_sync(spark, scratch):
    root = scratch + "/lib"
    write(root, {
        "a/uno.md": BODY.encode(), "a/DOS.TXT": BODY.encode() + b"\xff\xfe fin", "b/uno.md": BODY.encode(), "b/x.pdf": b"%PDF",
        "b/pic.png": b"no", ".git/z.md": BODY.encode(), "temp_ingestion/z.md": BODY.encode(), "a b/ñandú c.md": BODY.encode()})
    assert {r[0] for r in lib.scan(spark, root).select("rel_path").collect()} == {
        "a/uno.md", "a/DOS.TXT", "b/uno.md", "b/x.pdf", "a b/ñandú c.md"}
    index = ChunkIndex(spark, scratch + "/index")
    items = index.sync_folder(root, "t1")
    assert outcome(items)["b/x.pdf"] == ("new", "failed")
    assert items.filter("rel_path = 'b/x.pdf'").first()["error"] == "[Tipo de archivo no soportado: .pdf]"
    assert set(consistent(index)) == {"a/uno.md", "a/DOS.TXT", "b/uno.md", "a b/ñandú c.md"}
    assert index.chunks().filter("doc_id = 'a/DOS.TXT'").first()["text"].endswith("fin")

    os.utime(root + "/a/uno.md", (1, 1))
    write(root, {"b/uno.md": (BODY + "cambio").encode()})
    os.remove(root + "/a/DOS.TXT")
    again = outcome(index.sync_folder(root, "t2", extracted=spark.createDataFrame([("b/x.pdf", BODY)], "rel_path string, text string")))
    assert again == {
        "a/uno.md": ("touched", "skipped"), "b/uno.md": ("modified", "indexed"), "a/DOS.TXT": ("deleted", "deleted"),
        "b/x.pdf": ("new", "indexed"), "a b/ñandú c.md": ("unchanged", "skipped")}
    assert set(consistent(index)) == {"a/uno.md", "b/uno.md", "b/x.pdf", "a b/ñandú c.md"}


def test_stat_look_reads_no_bodies(spark, scratch):
    write(scratch, {"a.md": b"x"})
    plan = lib.scan(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_names_may_hold_any_sign(spark, scratch):
    names = ["nota [1].md", "a{b,c}.md", "x*y.md", "q?.md", "back\\slash.md", "plain.md", "50%.md"]
    names = [n for n in names if "\\" not in n]
    write(scratch, {f"lib/{n}": (BODY + n).encode() for n in names})
    index = ChunkIndex(spark, scratch + "/index")
    index.sync_folder(scratch + "/lib", "t1")
    assert set(consistent(index)) == set(names)
    write(scratch, {f"lib/{n}": (BODY * 2 + n).encode() for n in names[:4]})
    assert {k for k, v in outcome(index.sync_folder(scratch + "/lib", "t2")).items() if v == ("modified", "indexed")} == set(names[:4])


def test_bodies_of_wanted_files_only(spark, scratch):
    write(scratch, {f"{i}.md": b"x" * i for i in range(1, 6)})
    wanted = lib.scan(spark, scratch).filter("rel_path in ('1.md', '3.md', '5.md')").select("rel_path", "modified_us")
    assert {r[0] for r in lib.read_bodies(spark, scratch, wanted).select("rel_path").collect()} == {"1.md", "3.md", "5.md"}
    assert lib.read_bodies(spark, scratch, wanted.limit(0)).count() == 0


def test_chunks_are_not_shuffled_to_meet_the_documents_that_go(spark, scratch):
    """However low Spark's own limit, which ids of many documents pass."""
    index, plans = ChunkIndex(spark, scratch, buckets=4), []
    body = "Texto de prueba con largo suficiente para formar un fragmento del indice. " * 2
    rows = spark.createDataFrame([(f"d{i}.md", body, len(body), 1) for i in range(40)], "rel_path string, text string, size_bytes long, modified_us long")
    index.sync_table(rows, "t")
    replace = index._replace
    index._replace = lambda table, rows, doc, buckets: (plans.append(rows._jdf.queryExecution().executedPlan().toString()) if table == "chunks" else None, replace(table, rows, doc, buckets))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.delete(rows.filter("rel_path < 'd2'").select(F.col("rel_path").alias("doc_id")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert index.chunks().filter("doc_id < 'd2'").count() == 0 < index.chunks().count()

"""The chunk index: change detection, chunks, replacement, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt.functions import paths
from archivolt.functions.text import chunk_text, is_indexable
from archivolt.session import checkpoint

MANIFEST_SCHEMA = (
    "rel_path string, content_sha256 string, size_bytes long, modified_us long, indexed_at string, "
    "chunk_count long, last_operation string, last_error string"
)


def content_hash(text) -> Column:
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


def stat_changes(library: DataFrame, manifest: DataFrame, rebuild: bool = False) -> DataFrame:
    """First look at every path by size and time alone: no file is read.

    ``look``: new, same (nothing to do), check (the hash decides), deleted.
    A document whose last run failed is looked at again.
    """
    found = library.select("rel_path", "size_bytes", "modified_us")
    known = manifest.select(
        "rel_path", F.col("size_bytes").alias("_size"), F.col("modified_us").alias("_time"),
        F.col("content_sha256").alias("_sha"), F.col("last_operation").alias("_last"), F.col("chunk_count").alias("_chunks"),
        F.lit(True).alias("_known"))
    same = (F.col("size_bytes") == F.col("_size")) & (F.col("modified_us") == F.col("_time")) & (F.col("_last") != "failed")
    return found.join(known, "rel_path", "full_outer").withColumn("look", (
        F.when(F.col("size_bytes").isNull(), "deleted")
        .when(F.col("_known").isNull(), "new")
        .when(F.lit(rebuild), "check")
        .when(same, "same")
        .otherwise("check")))


def change_of_checked(rebuild: bool = False) -> Column:
    """Change of a row whose content was looked at: look, content_sha256, _sha, _last."""
    equal = (F.col("content_sha256") == F.col("_sha")) & (F.col("_last") != "failed")
    return F.when(F.col("look") == "new", "new").when(~F.lit(rebuild) & equal, "touched").otherwise("modified")


def settle_changes(looks: DataFrame, hashes: DataFrame, rebuild: bool = False) -> DataFrame:
    """Final change of every path, with the hashes of the paths to be checked.

    ``change``: new, modified, touched (only the time moved), unchanged, deleted.
    """
    checked = looks.join(hashes.select("rel_path", "content_sha256"), "rel_path", "left")
    return checked.withColumn("change", (
        F.when(F.col("look") == "deleted", "deleted")
        .when(F.col("look") == "same", "unchanged")
        .when(F.col("look") == "failed", "new")
        .otherwise(change_of_checked(rebuild))))


def detect_changes(library: DataFrame, manifest: DataFrame, rebuild: bool = False) -> DataFrame:
    """Both steps for a library that carries its text (a table, not files)."""
    # Written down: the join of library and manifest is made once.
    looks = checkpoint(stat_changes(library, manifest, rebuild))
    wanted = looks.filter("look in ('new', 'check')").select("rel_path")
    # Hashed where the text is; only the hashes travel to the join.
    hashes = library.select("rel_path", content_hash("text").alias("content_sha256")).join(wanted, "rel_path")
    return settle_changes(looks, hashes, rebuild)


def deleted_paths(library: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.select("rel_path").join(library.select("rel_path"), "rel_path", "left_anti")


def chunk_id(doc_id: str, place: str) -> Column:
    return F.concat(F.col(doc_id).cast("string"), F.lit(":chunk:"), F.col(place).cast("string"))


def make_chunks(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Chunks of every indexable document with ids that never change.

    Other columns of ``documents`` are carried along.  No shuffle: each
    document becomes its chunks in place.
    """
    rest = [c for c in documents.columns if c not in (text, doc_id)]
    cut = documents.filter(is_indexable(text)).select(
        doc_id, *rest, F.posexplode(chunk_text(text)).alias("chunk_ix", "_chunk"))
    return cut.select(
        chunk_id(doc_id, "chunk_ix").alias("chunk_id"),
        doc_id, "chunk_ix", F.col("_chunk.text").alias("text"), F.col("_chunk.chapter").alias("chapter"), *rest)


def chunk_counts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Number of chunks per document, 0 for one too short; no explode needed."""
    n = F.when(is_indexable(text), F.size(chunk_text(text))).otherwise(0)
    return documents.select(doc_id, n.cast("long").alias("chunk_count"))


def chunk_owner(doc_id="doc_id", legacy_path="ruta", name="name") -> Column:
    """Document of a chunk: its id, else the path that older chunks carry, else the name."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(col(doc_id), paths.normalise(legacy_path), col(name))


def without_documents(chunks: DataFrame, documents: DataFrame, owner: Column | None = None) -> DataFrame:
    """Chunks that belong to none of the documents (column ``doc_id``)."""
    owner = F.col("doc_id") if owner is None else owner
    gone = documents.select(F.col("doc_id").alias("_owner"))
    return chunks.withColumn("_owner", owner).join(gone, "_owner", "left_anti").drop("_owner")


def replace_documents(chunks: DataFrame, fresh: DataFrame, owner: Column | None = None) -> DataFrame:
    """The index with the chunks of some documents replaced by fresh ones."""
    kept = without_documents(chunks, fresh.select("doc_id").distinct(), owner)
    return kept.unionByName(fresh, allowMissingColumns=True)


def delete_report(chunks: DataFrame, wanted: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """For each wanted ``doc_id``: deleted or not_found, and the chunks it had."""
    counted = chunks.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    out = wanted.select("doc_id").distinct().join(counted, "doc_id", "left")
    listed = F.lit(False)
    if manifest is not None:
        out = out.join(manifest.select(F.col("rel_path").alias("doc_id"), F.lit(True).alias("_listed")), "doc_id", "left")
        listed = F.coalesce("_listed", F.lit(False))
    return out.select(
        "doc_id",
        F.when(F.col("chunks").isNotNull() | listed, "deleted").otherwise("not_found").alias("status"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"))


def index_statistics(chunks: DataFrame, by: str | None = None) -> DataFrame:
    count = F.count(F.lit(1)).alias("chunks")
    return chunks.agg(count) if by is None else chunks.groupBy(by).agg(count)


def sync_items(changes: DataFrame, counts: DataFrame) -> DataFrame:
    """Outcome per path from the changes and the chunk counts (rel_path, chunk_count)."""
    joined = changes.join(counts.select("rel_path", F.col("chunk_count").alias("_n")), "rel_path", "left")
    indexed = F.col("change").isin("new", "modified")
    failed = indexed & (F.coalesce("_n", F.lit(0)) == 0)
    return joined.select(
        "rel_path", "change",
        F.when(F.col("change") == "deleted", "deleted").when(failed, "failed").when(indexed, "indexed")
        .otherwise("skipped").alias("status"),
        F.when(F.col("change") == "deleted", F.col("_chunks")).when(indexed, F.coalesce("_n", F.lit(0)))
        .otherwise(F.lit(0)).cast("long").alias("chunk_count"),
        F.when(failed, F.lit("contenido vacío o muy corto para indexar")).alias("error"))


def sync_summary(items: DataFrame, mode: str = "sync") -> DataFrame:
    """One row: what a run saw and did."""
    status, change = F.col("status"), F.col("change")
    return items.agg(
        F.count_if(change != "deleted").alias("scanned"),
        F.count_if((status == "indexed") & (change == "new")).alias("indexed_new"),
        F.count_if((status == "indexed") & (change == "modified")).alias("reindexed_modified"),
        F.count_if(status == "skipped").alias("skipped_unchanged"),
        F.count_if(status == "deleted").alias("removed_deleted"),
        F.count_if(status == "failed").alias("failed"),
    ).withColumn("mode", F.lit(mode))


def next_manifest(manifest: DataFrame, changes: DataFrame, items: DataFrame, indexed_at: str) -> DataFrame:
    """The manifest after a run.

    Indexed documents get fresh rows, touched ones the new size and time;
    a failure keeps the last good state of a known document and adds no row
    for an unknown one.
    """
    seen = changes.select("rel_path", F.col("size_bytes").alias("_s"), F.col("modified_us").alias("_m"),
                          F.col("content_sha256").alias("_h"), "change")
    done = items.select("rel_path", "status", F.col("chunk_count").alias("_n"), "error")
    state = manifest.join(seen, "rel_path", "full_outer").join(done, "rel_path", "left")
    good, bad, moved = F.col("status") == "indexed", F.col("status") == "failed", F.col("change") == "touched"
    pick = lambda when, new, old: F.when(F.coalesce(when, F.lit(False)), new).otherwise(old)
    known = F.col("last_operation").isNotNull()
    return state.filter((F.coalesce("change", F.lit("unchanged")) != "deleted") & (known | good)).select(
        "rel_path",
        pick(good, F.col("_h"), F.col("content_sha256")).alias("content_sha256"),
        pick(good | moved, F.col("_s"), F.col("size_bytes")).alias("size_bytes"),
        pick(good | moved, F.col("_m"), F.col("modified_us")).alias("modified_us"),
        pick(good, F.lit(indexed_at), F.col("indexed_at")).alias("indexed_at"),
        pick(good, F.col("_n"), F.col("chunk_count")).alias("chunk_count"),
        pick(good, F.lit("indexed"), pick(bad, F.lit("failed"), F.col("last_operation"))).alias("last_operation"),
        pick(good, F.lit(None).cast("string"), pick(bad, F.col("error"), F.col("last_error"))).alias("last_error"))



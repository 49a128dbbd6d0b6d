"""

Besides the queries it times an index folder of its own: a full build, then a
run with nothing changed and one with 1 % of the documents changed, with the
counts of documents worked on.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from archivolt import plans
from archivolt.operators import index as ix
from archivolt.plans import Tables
from archivolt.plans.library import _v1
from archivolt.session import local_session
from archivolt.sources.store import ChunkIndex

HEADLINE = [
    "chunk_statistics", "chunk_paragraphs", "change_detection", "sync_summary", "chunk_replacement", "nearest_chunks",
    "name_search", "hybrid_search", "chapter_search", "context_assembly", "lexical_search", "turn_pairs", "history_window",
    "analysis_batches", "topic_histogram", "forced_answers", "page_text_and_links", "canonical_urls", "page_links",
    "bounded_crawl", "injection_scan", "redacted_texts", "document_digests", "study_notes", "exam_report",
    "streaming_event_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    t = Tables(spark, folder)
    t.documents.agg(F.count("*")).collect()  # start the executors before the clock
    times: dict[str, float] = {}
    counts: dict[str, float] = {}

    def timed(name: str, run) -> object:
        start = time.perf_counter()
        result = run()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    def full(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        timed(name, lambda: full(plans.QUERIES[name](spark, folder)))

    docs = _v1(t)
    chunks = t.spread("documents").select("doc_id", "text")
    timed("chunk_all_documents", lambda: full(ix.make_chunks(chunks)))
    counts["documents_per_second"] = round(t.documents.count() / times["chunk_all_documents"], 1)

    index = ChunkIndex(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))

    def worked(items) -> int:
        return items.filter("status = 'indexed'").count()

    changed = docs.withColumn("_hit", F.pmod(F.xxhash64("rel_path"), F.lit(100)) == 0)
    changed = changed.withColumn("text", F.when(F.col("_hit"), F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    changed = changed.withColumn("modified_us", F.col("modified_us") + F.col("_hit").cast("long")).drop("_hit")
    counts["rebuild_documents"] = timed("index_rebuild", lambda: worked(index.sync_table(docs, "t1")))
    counts["unchanged_documents"] = timed("index_sync_unchanged", lambda: worked(index.sync_table(docs, "t2")))
    counts["changed_documents"] = timed("index_sync_1_percent", lambda: worked(index.sync_table(changed, "t3")))

    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "counts": counts,
        "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Registered queries of the dealt operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import (
    decontaminate, language, mixing, near_dedup, periodic_runs, quality, quotes, suffix_tree, token_counts, topk, toxicity, warc, whitening,
)
from archivolt.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a reader of tables under its own name."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_SHINGLES = r"""
words AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT row_id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(1))]
        ELSE list_distinct([w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
    FROM words
)"""

OP2_SQL = rf"""
WITH RECURSIVE {_SHINGLES},
one AS (SELECT row_id, unnest(s) AS x FROM sets),
links AS (
    SELECT p.a, p.b FROM (SELECT l.row_id AS a, r.row_id AS b, count(*) AS n_both FROM one l JOIN one r USING (x) GROUP BY 1, 2) p
    JOIN sets sa ON sa.row_id = p.a JOIN sets sb ON sb.row_id = p.b
    WHERE 100 * n_both >= 85 * (len(sa.s) + len(sb.s) - n_both)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT r.a, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.row_id = r.b GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN low l ON l.a = s.row_id
"""


@query(OP2_SQL)
def op2_near_duplicates(table):
    """Groups of documents with 85 of 100 three-word shingles in common."""
    return near_dedup.groups(table("documents"), n=3, percent=85)


@query()
def op3_quality(table):
    """Every text's quality, learnt from labels outside the fold."""
    return quality.classify(table("documents"), table("labels"))


@query()
def op5_toxicity(table):
    """Every text's toxicity, learnt from labels outside the fold."""
    return toxicity.classify(table("documents"), table("labels"))


@query()
def op8_decontamination(table):
    """Documents that hold benchmark items, and which."""
    return decontaminate.leaks(table("documents"), table("benchmark")).drop("doc_key")


@query()
def op9_mixing(table):
    """How many words of each document the mix of sources takes."""
    return mixing.taken(mixing.mix_sources(table("documents")))


# DuckDB's base 32 is that of four 40-bit numbers, eight signs each.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 10 * k + 1, 10) AS BIGINT) >> (35 - 5 * j)) & 31 AS INTEGER), 1)
                        FOR k IN [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3]], '') AS payload_digest,
       CASE WHEN original IS NULL OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original IS NULL OR page_id = original THEN NULL ELSE original END AS refers_to
FROM d
"""
OP10_SQL = OP10_SQL.replace("(35 - 5 * j)", "(35 - 5 * ((i - 1) % 8))").replace("FOR k IN [", "FOR k, i IN [")


@query(OP10_SQL)
def op10_warc(table):
    """Pages written as archives and read again; every record is intact."""
    found = warc.round_trip(table("pages"))
    return found.where(F.expr("assert_true(intact, 'a record is damaged') IS NULL")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS row_id, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.row_id, a.vec_id AS query_id, b.vec_id,
           CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, least(len(a.q), len(b.q)) + 1)]) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.row_id <> b.row_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query(OP4_SQL)
def op4_top_k(table):
    """The 20 best vectors for every twentieth one."""
    return topk.nearest(table("embeddings"), lambda vec_id: vec_id % 20 == 0)


@query()
def op7_suffix_tree(table):
    """log10 probabilities of all texts under a suffix tree learnt from most of them."""
    return suffix_tree.scored(table("documents"))


@query()
def op1_token_counts(table):
    """Unigram pieces of every text."""
    return token_counts.token_counts(table("documents"), token_counts.vocabulary())


@query()
def op6_chat_quotations(table):
    """Messages without quotations, with what they reply to and their place in reading order."""
    return quotes.format_chats(table("conversations")).withColumn("path", F.concat_ws(".", "path"))


@query()
def op11_whitening(table):
    """All vectors on the 32 leading components of their covariance, with unit variance."""
    return whitening.whiten(table("embeddings"))


@query()
def op13_periodic_runs(table):
    """Words that repeat one period apart, three times or more, in every text; one text in ten has a tail that the contract makes repeat."""
    return periodic_runs.periodic_runs(table("documents"), order=periodic_runs.planted).drop("n_words", "runs")


@query()
def op12_language(table):
    """Every text's language by its cosine with profiles learnt outside the fold."""
    return language.classify(table("documents"))

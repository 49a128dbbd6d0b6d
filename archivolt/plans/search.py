"""Queries on vectors: nearest chunks by filter, name, chapter, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt.functions import text as tx
from archivolt.operators import cells, index as ix
from archivolt.operators import search as se
from archivolt.plans import Tables, query
from archivolt.plans.library import chunks_sql, strip_sql

# Chunks are the vectors with the text of the document of the same number;
# questions are the mean vectors of the labels, so that every vector counts.
CHUNKS_SQL = """e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label::VARCHAR AS category,
    source || '_' || lang || '_' || vec_id || '.md' AS name, 'capitulo_' || (n_chars % 4 + 1) AS chapter, text
  FROM embeddings JOIN documents ON vec_id = doc_id),
q AS (SELECT label, list(a ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS a FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)"""
DISTANCE_SQL = "round(list_cosine_distance(qv, v), 6) + 0.0"


def _chunks(t: Tables) -> DataFrame:
    return t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("category"),
        F.concat_ws("_", "source", "lang", F.concat(F.col("vec_id").cast("string"), F.lit(".md"))).alias("name"),
        F.concat(F.lit("capitulo_"), (F.col("n_chars") % 4 + 1).cast("string")).alias("chapter"), "text")


def _questions(t: Tables, dims: int = 64) -> DataFrame:
    means = t.embeddings.groupBy("label").agg(*[F.avg(F.get("embedding", F.lit(i))).alias(f"m{i}") for i in range(dims)])
    return means.select("label", F.col("label").cast("string").alias("query_id"), F.array(*[f"m{i}" for i in range(dims)]).alias("embedding"))


@query(f"""WITH {CHUNKS_SQL},
r AS (SELECT label::VARCHAR AS query_id, chunk_id, {DISTANCE_SQL} AS distance FROM q CROSS JOIN e),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM r)
SELECT query_id, rank, chunk_id, distance FROM k WHERE rank <= 5""")
def nearest_chunks(t: Tables) -> DataFrame:
    return se.top_k(_chunks(t), _questions(t), 5).select("query_id", "rank", "chunk_id", "distance")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS qv FROM embeddings JOIN labels ON vec_id = doc_id AND toxic = 1),
r AS (SELECT q.query_id::VARCHAR AS query_id, v.vec_id, round(list_cosine_distance(qv, v), 6) + 0.0 AS distance FROM q JOIN v ON q.label % 2 = 0 OR q.label = v.label),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM r)
SELECT DISTINCT query_id, rank, vec_id, distance FROM k WHERE rank <= 3""")
def nearest_in_cells(t: Tables) -> DataFrame:
    """The nearest vectors of those whose document is toxic, cells left out on proof; odd labels look in their own label only."""
    found = cells.make_cells(t.embeddings.withColumn("category", F.col("label").cast("string")), "vec_id", cells=64)
    toxic = t.labels.filter("toxic = 1").select("doc_id").distinct()
    asked = t.embeddings.join(toxic, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").cast("string").alias("query_id"), "embedding", F.when(F.col("label") % 2 == 1, F.col("label").cast("string")).alias("category"))
    return cells.nearest(found, asked, 3)[0].select("query_id", "rank", "vec_id", "distance")


@query(f"""WITH {CHUNKS_SQL},
r AS (SELECT label::VARCHAR AS query_id, chunk_id, {DISTANCE_SQL} AS distance FROM q JOIN e
  ON category = ((label + 1) % 10)::VARCHAR AND (label % 2 = 1 OR chapter = 'capitulo_2')),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM r)
SELECT query_id, rank, chunk_id, distance FROM k WHERE rank <= 5""")
def nearest_in_category(t: Tables) -> DataFrame:
    """Every question looks in the next label; the even ones in one chapter of it only."""
    asked = _questions(t).withColumn("category", ((F.col("label") + 1) % 10).cast("string")).withColumn(
        "chapter", F.when(F.col("label") % 2 == 0, "capitulo_2"))
    return se.top_k(_chunks(t), asked, 5).select("query_id", "rank", "chunk_id", "distance")


KEYWORDS_SQL = "CASE WHEN label = 9 THEN ['zzz', 'ab'] ELSE ['src' || label || '_', 'de_', 'ab'] END"
NAMED_SQL = f"""
kw AS (SELECT label, qv, unnest({KEYWORDS_SQL}) AS kw, generate_subscripts({KEYWORDS_SQL}, 1) AS sub FROM q),
nr AS (SELECT label::VARCHAR AS query_id, sub, chunk_id, {DISTANCE_SQL} AS distance FROM kw JOIN e ON contains(name, kw) WHERE length(kw) >= 3),
nk AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY distance, chunk_id) AS rank FROM nr),
nu AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub, rank) AS seen FROM nk WHERE rank <= {{k}}),
named AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sub, rank) AS position, chunk_id, distance, 'name' AS found_by FROM nu WHERE seen = 1),
pr AS (SELECT label::VARCHAR AS query_id, chunk_id, {DISTANCE_SQL} AS distance FROM q CROSS JOIN e),
plain AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS position, chunk_id, distance, 'semantic' AS found_by FROM pr),
by_name AS (SELECT * FROM named UNION ALL SELECT * FROM plain WHERE position <= {{k}} AND query_id NOT IN (SELECT query_id FROM named))"""


def _keywords() -> Column:
    return F.when(F.col("label") == 9, F.array(F.lit("zzz"), F.lit("ab"))).otherwise(
        F.array(F.concat(F.lit("src"), F.col("label").cast("string"), F.lit("_")), F.lit("de_"), F.lit("ab")))


@query(f"""WITH {CHUNKS_SQL}, {NAMED_SQL.format(k=10)} SELECT query_id, position::INT AS position, chunk_id, distance, found_by FROM by_name""")
def name_search(t: Tables) -> DataFrame:
    return se.name_search(_chunks(t), _questions(t).withColumn("keywords", _keywords()), 10)


@query(f"""WITH {CHUNKS_SQL}, {NAMED_SQL.format(k=15)},
total AS (SELECT query_id, sum(length(text)) AS n FROM plain JOIN e USING (chunk_id) WHERE position <= 15 GROUP BY query_id),
keep AS (SELECT query_id FROM total WHERE n >= 36000 OR query_id = '4')
SELECT query_id, position::INT AS position, chunk_id, distance, found_by FROM plain WHERE position <= 15 AND query_id IN (SELECT query_id FROM keep)
UNION ALL SELECT query_id, position::INT, chunk_id, distance, found_by FROM by_name WHERE query_id NOT IN (SELECT query_id FROM keep)""")
def hybrid_search(t: Tables) -> DataFrame:
    """The threshold is set so high that some questions fall back; one has no keywords."""
    words = F.when(F.col("label") == 4, F.array().cast("array<string>")).otherwise(_keywords())
    return se.hybrid_search(_chunks(t), _questions(t).withColumn("keywords", words), 15, 36000)


def chapter_search_sql(chapters: int, per: int, otherwise: int) -> str:
    return f"""
ch AS (SELECT label, qv, CASE label % 3 WHEN 0 THEN ['capitulo_1', 'capitulo_2', 'capitulo_3', 'capitulo_4'] WHEN 1 THEN ['capitulo_2'] ELSE [] END AS chapters FROM q),
cx AS (SELECT label, qv, unnest(chapters[1:{chapters}]) AS c, generate_subscripts(chapters[1:{chapters}], 1) AS sub FROM ch),
cr AS (SELECT label::VARCHAR AS query_id, sub, chunk_id, {DISTANCE_SQL} AS distance, 'chapter' AS found_by FROM cx JOIN e ON chapter = c
  UNION ALL SELECT label::VARCHAR, 0, chunk_id, {DISTANCE_SQL}, 'semantic' FROM ch CROSS JOIN e WHERE len(chapters) = 0),
ck AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY distance, chunk_id) AS rank FROM cr),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sub, rank)::INT AS position, chunk_id, distance, found_by
  FROM ck WHERE rank <= CASE found_by WHEN 'chapter' THEN {per} ELSE {otherwise} END)"""


def _with_chapters(t: Tables) -> DataFrame:
    text = F.when(F.col("label") % 3 == 0, "Resumen de los Capítulos 1 al 4").when(F.col("label") % 3 == 1, "ver capítulo 2").otherwise("todo")
    return _questions(t).withColumn("chapters", tx.chapter_request(text))


@query(f"WITH {CHUNKS_SQL}, {chapter_search_sql(3, 3, 7)} SELECT query_id, position, chunk_id, distance, found_by FROM hits")
def chapter_search(t: Tables) -> DataFrame:
    return se.chapter_search(_chunks(t), _with_chapters(t))


@query(f"WITH {CHUNKS_SQL}, {chapter_search_sql(5, 4, 15)} SELECT query_id, position, chunk_id, distance, found_by FROM hits")
def exam_chapter_search(t: Tables) -> DataFrame:
    return se.chapter_search(_chunks(t), _with_chapters(t), 5, 4, 15)


def _hits(t: Tables) -> DataFrame:
    return se.with_payload(se.chapter_search(_chunks(t), _with_chapters(t)), _chunks(t), ["name", "chapter", "text"])


@query(f"""WITH {CHUNKS_SQL}, {chapter_search_sql(3, 3, 7)}
SELECT query_id, md5(string_agg(chr(10) || '--- Chunk ' || position || ' (de: ' || name || ', ' || chapter || ') ---' || chr(10) || text, chr(10) ORDER BY position)) AS context_md5
FROM hits JOIN e USING (chunk_id) GROUP BY query_id""")
def context_assembly(t: Tables) -> DataFrame:
    return se.assemble_context(_hits(t)).select("query_id", F.md5("context").alias("context_md5"))


@query(f"""WITH {CHUNKS_SQL}, {chapter_search_sql(3, 3, 7)},
f AS (SELECT query_id, source, min(position) AS position FROM hits JOIN (SELECT chunk_id, regexp_extract(name, '^[^_]*') AS source FROM e) USING (chunk_id) GROUP BY ALL)
SELECT query_id, string_agg(source, ', ' ORDER BY position) AS sources FROM f GROUP BY query_id""")
def sources_used(t: Tables) -> DataFrame:
    return se.sources_used(_hits(t).withColumn("name", F.substring_index("name", "_", 1)))


LEXICAL_SQL = f"""
texts AS (SELECT 'c' AS kind, doc_id || ':chunk:' || chunk_ix AS id, text FROM chunks UNION ALL SELECT 'q', item_id::VARCHAR, text FROM benchmark),
words AS (SELECT kind, id, unnest(string_split_regex(lower({strip_sql('text')}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) AS w FROM texts),
signed AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS place, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM words GROUP BY ALL),
unit AS (SELECT s.kind, s.id, place, (x / l)::FLOAT::DOUBLE AS x FROM signed s JOIN (SELECT kind, id, sqrt(sum(x * x)) AS l FROM signed GROUP BY ALL) n ON n.kind = s.kind AND n.id = s.id AND l > 0),
size AS (SELECT kind, id, sqrt(sum(x * x)) AS l FROM unit GROUP BY ALL),
dots AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.x * c.x) AS dot FROM unit q JOIN unit c ON q.kind = 'q' AND c.kind = 'c' AND q.place = c.place GROUP BY ALL),
met AS (SELECT q.id AS query_id, c.id AS chunk_id, round(1 - coalesce(dot / (sq.l * sc.l), 0), 6) + 0.0 AS distance
  FROM (SELECT id FROM texts WHERE kind = 'q') q CROSS JOIN (SELECT id FROM texts WHERE kind = 'c') c LEFT JOIN dots d ON d.query_id = q.id AND d.chunk_id = c.id
  LEFT JOIN size sq ON sq.kind = 'q' AND sq.id = q.id LEFT JOIN size sc ON sc.kind = 'c' AND sc.id = c.id)"""


@query(f"""WITH RECURSIVE {chunks_sql('SELECT doc_id, text FROM documents')}, {LEXICAL_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM met)
SELECT query_id, 0::INT AS sub, rank, chunk_id, distance FROM r WHERE rank <= 5""")
def lexical_search(t: Tables) -> DataFrame:
    """Benchmark passages look for their nearest chunks by hashed words."""
    chunks = ix.make_chunks(t.spread("documents").select("doc_id", "text")).select("chunk_id", "text")
    asked = se.lexical_vectors(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    return se.top_k(se.lexical_vectors(chunks), asked, 5)


@query("""
WITH n AS (SELECT item_id, text, item_id % 9 AS k FROM benchmark),
t AS (SELECT item_id, CASE k WHEN 0 THEN 'los capítulos 2 al 5' WHEN 1 THEN 'CAPÍTULOS 3 y 4' WHEN 2 THEN 'capitulos 7 a 3' WHEN 3 THEN 'capítulo 12' WHEN 4 THEN 'capítulos 1 hasta 3'
  ELSE '' END || ' ' || text AS q FROM n)
SELECT item_id, CASE item_id % 9 WHEN 0 THEN 'capitulo_2,capitulo_3,capitulo_4,capitulo_5' WHEN 1 THEN 'capitulo_3,capitulo_4' WHEN 2 THEN '' WHEN 3 THEN 'capitulo_12' END AS chat,
  CASE item_id % 9 WHEN 0 THEN 'capitulo_2,capitulo_3,capitulo_4,capitulo_5' WHEN 1 THEN 'capitulo_3,capitulo_4' WHEN 2 THEN '' WHEN 3 THEN 'capitulo_12'
  WHEN 4 THEN 'capitulo_1,capitulo_2,capitulo_3' END AS exam FROM t""")
def chapter_requests(t: Tables) -> DataFrame:
    k = F.col("item_id") % 9
    head = (
        F.when(k == 0, "los capítulos 2 al 5").when(k == 1, "CAPÍTULOS 3 y 4").when(k == 2, "capitulos 7 a 3")
        .when(k == 3, "capítulo 12").when(k == 4, "capítulos 1 hasta 3").otherwise(""))
    asked = F.concat(head, F.lit(" "), "text")
    return t.benchmark.select(
        "item_id", F.array_join(tx.chapter_request(asked), ",").alias("chat"),
        F.array_join(tx.chapter_request(asked, "hasta"), ",").alias("exam"))

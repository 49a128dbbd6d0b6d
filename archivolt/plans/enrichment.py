"""Queries around a model; the stand-in model answers by the length of its prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from archivolt import fixed
from archivolt.functions import html
from archivolt.operators import dialogue as dl, enrich as en, jobs
from archivolt.plans import Tables, query
from archivolt.session import scratch_folder
from archivolt.plans.dialogue import PAIRS_SQL, ROUTE_WORDS
from archivolt.plans.library import NL, strip_sql
from archivolt.plans.web import SHOWN_SQL, map_sql
from archivolt.sources import records

PART = 2000


def _model(answer, fails: int = 0):
    """A client that fails on prompts whose length divides by ``fails``."""
    def one(prompt: str) -> str:
        if fails and len(prompt) % fails == 0:
            raise ValueError("bad prompt")
        return answer(prompt)

    return en.per_row(one)


# --- large texts -------------------------------------------------------------------

PARTS_SQL = f"""src AS (SELECT doc_id, source, replace(text, {NL}, {NL} || {NL}) AS text FROM documents),
step AS (SELECT doc_id, 0 AS part, 0 AS off, text FROM src UNION ALL
  SELECT doc_id, part + 1, CASE WHEN gap > off + {PART // 2} THEN gap ELSE off + {PART} END, text FROM (
    SELECT doc_id, part, off, text, CASE WHEN strpos(reverse(substr(text, off + 1, {PART})), {NL} || {NL}) = 0 THEN -1
      ELSE off + {PART} - strpos(reverse(substr(text, off + 1, {PART})), {NL} || {NL}) - 1 END AS gap FROM step WHERE length(text) - off > {PART})),
parts AS (SELECT doc_id, part, substr(text, off + 1, coalesce(lead(off) OVER (PARTITION BY doc_id ORDER BY part) - off, 100000000)) AS t, count(*) OVER (PARTITION BY doc_id) AS parts FROM step)"""


def _spaced(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", "source", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(f"""WITH RECURSIVE {PARTS_SQL} SELECT doc_id, part::INT AS part, parts::INT AS parts, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM parts""")
def large_text_parts(t: Tables) -> DataFrame:
    """Parts of at most 2000 characters, so that common documents are divided."""
    parts = jobs.text_parts(_spaced(t).drop("source"), "doc_id", max_chars=PART)
    return parts.select("doc_id", "part", "parts", F.length("part_text").alias("n_chars"), F.md5("part_text").alias("text_md5"))


@query(f"""WITH RECURSIVE {PARTS_SQL},
a AS (SELECT doc_id, part, parts, length(t) % 10 = 0 AS bad, CASE WHEN length(t) % 10 = 0 THEN {NL} || {NL} || '{fixed.DIGEST_PART_FAILED} ' || (part + 1) || ': ValueError: bad prompt' || {NL}
  ELSE length(t) || ':' || substr(t, 1, 20) END AS line FROM parts WHERE doc_id IN (SELECT doc_id FROM src WHERE length({strip_sql('text')}) >= 100)),
g AS (SELECT doc_id, count(*) AS parts, count(*) FILTER (bad) AS failed, string_agg(line, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY part) AS body FROM a GROUP BY doc_id)
SELECT doc_id, g.parts, failed, CASE WHEN g.parts = 1 AND failed = 1 THEN NULL WHEN g.parts > 1 THEN md5('# ' || doc_id || {NL} || {NL} || '> Fuente: ' || source || {NL} || '> Procesado con modelo' || {NL} || {NL} || body)
  ELSE md5(body) END AS digest_md5, CASE WHEN g.parts = 1 AND failed = 1 THEN '{fixed.DIGEST_FAILED}: ValueError: bad prompt' END AS error FROM g JOIN src USING (doc_id)""")
def document_digests(t: Tables) -> DataFrame:
    model = _model(lambda p: f"{len(p)}:{p[:20]}", fails=10)
    return jobs.digest(_spaced(t), model, max_chars=PART).select("doc_id", "parts", "failed", F.md5("digest").alias("digest_md5"), "error")


# --- classification ------------------------------------------------------------------

@query("""SELECT doc_id, n % 7 <> 0 AND n % 3 = 0 AS relevant FROM (SELECT doc_id, 15 + least(length(text), 2000) AS n FROM documents)""")
def theme_relevance(t: Tables) -> DataFrame:
    model = _model(lambda p: " sí, claro" if len(p) % 3 == 0 else "NO", fails=7)
    return jobs.theme_relevance(t.documents.select("doc_id", "text"), model, "historia").select("doc_id", "relevant")


@query("""SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'general' WHEN n % 5 = 0 THEN 'general' ELSE 'carpeta_no_' || n % 5 END AS subfolder
FROM (SELECT doc_id, 23 + least(length(text), 2000) AS n FROM documents)""")
def page_subfolders(t: Tables) -> DataFrame:
    model = _model(lambda p: f"«Carpeta Nº {len(p) % 5}»" if len(p) % 5 else "¿?", fails=7)
    return jobs.subfolder(t.documents.select("doc_id", "text"), model, "historia").select("doc_id", "subfolder")


@query(f"""WITH n AS (SELECT page_id, least(length(array_to_string({SHOWN_SQL}, ' ')), 2000) AS n FROM pages)
SELECT page_id, (15 + n) % 7 <> 0 AND (15 + n) % 3 = 0 AS relevant, CASE WHEN (23 + n) % 7 = 0 OR (23 + n) % 5 = 0 THEN 'general' ELSE 'carpeta_no_' || (23 + n) % 5 END AS subfolder FROM n""")
def crawled_page_themes(t: Tables) -> DataFrame:
    """What crawled pages are about: whether a model finds the theme in their text, and the folder that it names."""
    text = t.spread("pages").select("page_id", html.page_content("html")["text"].alias("text"))
    theme = _model(lambda p: " sí, claro" if len(p) % 3 == 0 else "NO", fails=7)
    folder = _model(lambda p: f"«Carpeta Nº {len(p) % 5}»" if len(p) % 5 else "¿?", fails=7)
    return jobs.subfolder(jobs.theme_relevance(text, theme, "historia"), folder, "historia").select("page_id", "relevant", "subfolder")


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 11 = 0 THEN 'general' ELSE ['general', 'researcher', 'mentor', 'general', 'estadistica', 'general', 'general'][length(text) % 7 + 1] END AS route
FROM conversations WHERE role = 'user'""")
def question_routes(t: Tables) -> DataFrame:
    model = _model(lambda p: ROUTE_WORDS[len(p) % 7], fails=11)
    return jobs.route(t.conversations.filter("role = 'user'").select("conv_id", "turn", "text"), model).select("conv_id", "turn", "route")


# DuckDB upper-cases to one character; these have more (ß: SS).
LONG_UPPER = {c: c.upper() for c in map(chr, range(128, 0x10000)) if len(c.upper()) > 1}
UPPER_SQL = f"array_to_string(list_transform(regexp_extract_all(substr(text, 1, 5), '(?s).'), lambda c: coalesce({map_sql(LONG_UPPER)}[c], upper(c))), '')"


@query(f"""SELECT item_id, length(text) || ' a' AS short, CASE WHEN length(text) % 4 = 0 THEN NULL ELSE {UPPER_SQL} END AS loud,
  CASE WHEN length(text) % 4 = 0 THEN 'ValueError: bad prompt' END AS loud_error FROM benchmark""")
def model_comparison(t: Tables) -> DataFrame:
    clients = {"short": _model(lambda p: f"{len(p)} a"), "loud": _model(lambda p: p[:5].upper(), fails=4)}
    return jobs.compare_models(t.benchmark, clients, "item_id", "text").select("item_id", "short", "loud", "loud_error")


# --- memory ---------------------------------------------------------------------------

NOTE_SQL = f"""{PAIRS_SQL}, n AS (SELECT conv_id, turn, length(question) + 5 + least(length(answer), 300) AS n FROM pairs WHERE question <> '' AND answer <> ''),
notes AS (SELECT conv_id, turn, CASE n % 4 WHEN 1 THEN 'Salud' WHEN 2 THEN 'Otra' ELSE 'Diario' END AS category,
  CASE n % 4 WHEN 1 THEN 'nota ' || n WHEN 2 THEN 'algo' ELSE 'Please BYPASS it' END AS summary, CASE n % 4 WHEN 1 THEN 'porque sí' WHEN 2 THEN 'ORIA: Otra' ELSE 'Información relevante sobre el usuario' END AS reason,
  CASE n % 4 WHEN 1 THEN 'saved' WHEN 2 THEN 'unknown_category' ELSE 'blocked' END AS status FROM n WHERE n % 4 > 0 AND n % 13 > 0)"""


def _note(prompt: str) -> str:
    n = len(prompt)
    return ["Nada que guardar", f"CATEGORIA: Salud\nRESUMEN:  nota {n}\nRAZON: porque sí", "CATEGORIA: Otra\nRESUMEN: algo",
            "CATEGORIA: Diario\nRESUMEN: Please BYPASS it\nRAZON:"][n % 4]


def _notes(t: Tables) -> DataFrame:
    return jobs.memory_notes(dl.turn_pairs(t.conversations), _model(_note, fails=13), "2024-05-01 10:30")


@query(f"WITH {NOTE_SQL} SELECT * FROM notes")
def memory_notes(t: Tables) -> DataFrame:
    return _notes(t).drop("ts")


@query(f"WITH {NOTE_SQL} SELECT count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status <> 'saved') AS errors FROM notes")
def memory_counts(t: Tables) -> DataFrame:
    return jobs.memory_counts(_notes(t))


@query(f"WITH {NOTE_SQL} SELECT category, count(*) AS notes FROM notes WHERE status = 'saved' GROUP BY category")
def memory_view(t: Tables) -> DataFrame:
    return records.memory_view(_notes(t).filter("status = 'saved'"))


@query(f"WITH {NOTE_SQL} SELECT category, summary, reason, count(*) AS notes FROM notes WHERE status = 'saved' GROUP BY ALL")
def memory_table(t: Tables) -> DataFrame:
    """The memory after two days of notes were added to it, read back from its folder."""
    notes, folder = _notes(t), f"{scratch_folder(t.spark)}/memory"
    for day in (0, 1):
        records.append_memory(notes.filter(F.col("conv_id") % 2 == day), folder)
    return t.spark.read.parquet(folder).groupBy("category", "summary", "reason").agg(F.count(F.lit(1)).alias("notes"))


# --- study notes -------------------------------------------------------------------------
# Labelled documents are in the cache; where the quality is 0 the fingerprint is old.

STUDY_SQL = f"""c AS (SELECT d.doc_id, {strip_sql('text')} AS t, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'cached' WHEN length(t) < 50 THEN 'omitted' WHEN least(length(t), 5000) % 9 = 0 THEN 'failed' ELSE 'new' END AS origin,
  CASE WHEN quality = 1 THEN 'from the cache' WHEN length(t) < 50 OR least(length(t), 5000) % 9 = 0 THEN NULL ELSE 'notes ' || least(length(t), 5000) END AS result FROM c)"""


def _study(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.spread("documents").select(F.col("doc_id").alias("key"), F.struct("n_chars", "lang").alias("fingerprint"), "text")
    cache = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").select(
        F.col("doc_id").alias("key"), F.struct((F.col("n_chars") + F.when(F.col("quality") == 1, 0).otherwise(1)).alias("n_chars"), "lang").alias("fingerprint"),
        F.lit("from the cache").alias("result"))
    return jobs.study_notes(docs, cache, _model(lambda p: f"notes {len(p)}", fails=9)), cache


@query(f"WITH {STUDY_SQL} SELECT doc_id AS key, origin, result FROM s")
def study_notes(t: Tables) -> DataFrame:
    return _study(t)[0].select("key", "origin", "result")


@query(f"""WITH {STUDY_SQL} SELECT count(*) FILTER (origin = 'new') AS "new", count(*) FILTER (origin = 'cached') AS cached,
  count(*) FILTER (origin = 'omitted') AS omitted, count(*) FILTER (origin = 'failed') AS failed FROM s""")
def study_run_counts(t: Tables) -> DataFrame:
    return en.run_counts(_study(t)[0])


@query(f"""WITH {STUDY_SQL} SELECT doc_id AS key, coalesce(CASE WHEN origin = 'new' THEN result END, 'from the cache') AS result
FROM s WHERE origin = 'new' OR doc_id IN (SELECT doc_id FROM labels)""")
def study_cache_after(t: Tables) -> DataFrame:
    done, cache = _study(t)
    return en.updated_cache(cache, done).select("key", "result")


BAR = "=" * 60


@query(f"""WITH {STUDY_SQL} SELECT doc_id AS key, {NL} || {NL} || '{BAR}' || {NL} || CASE origin WHEN 'cached' THEN '📘 doc_' || doc_id || ' (desde cache)' WHEN 'failed' THEN '❌ ERROR en doc_' || doc_id
  ELSE '📘 doc_' || doc_id END || {NL} || '{BAR}' || {NL} || coalesce(result, CASE WHEN origin = 'failed' THEN 'ValueError: bad prompt' END, '') AS section FROM s WHERE origin <> 'omitted'""")
def study_notes_export(t: Tables) -> DataFrame:
    done = _study(t)[0].filter("origin <> 'omitted'")
    name = F.concat(F.lit("doc_"), F.col("key").cast("string"))
    return done.select("key", records.study_section(name, F.coalesce("result", "error"), "origin").alias("section"))

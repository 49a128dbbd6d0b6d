"""Queries on documents: paths, text, chapters, chunks and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions import paths, text as tx
from archivolt.operators import index as ix
from archivolt.operators import jobs, ordered
from archivolt.plans import Tables, query
from archivolt.sources import files, library as lib, records
from archivolt.session import checkpoint, scratch_folder
from archivolt.sources.store import ChunkIndex

NL = "chr(10)"


def strip_sql(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


# --- paths ---------------------------------------------------------------------

PATH_SQL = r"source || '\' || lang || '\doc_' || doc_id || CASE lang WHEN 'en' THEN '.MD' WHEN 'es' THEN '.txt' WHEN 'fr' THEN '.log' ELSE '.pdf' END"


@query(rf"""
WITH p AS (SELECT doc_id, replace({PATH_SQL}, '\', '/') AS rel_path FROM documents)
SELECT doc_id, rel_path, regexp_extract(rel_path, '[^/]*$') AS name, regexp_extract(rel_path, '^(.*)/', 1) AS category,
       lower(regexp_extract(rel_path, '[.][^.]*$')) AS ext
FROM p WHERE lower(regexp_extract(rel_path, '[.][^.]*$')) IN ('.md', '.txt', '.pdf', '.docx', '.pptx')""")
def library_paths(t: Tables) -> DataFrame:
    kind = F.when(F.col("lang") == "en", ".MD").when(F.col("lang") == "es", ".txt").when(F.col("lang") == "fr", ".log").otherwise(".pdf")
    raw = F.concat("source", F.lit("\\"), "lang", F.lit("\\doc_"), F.col("doc_id").cast("string"), kind)
    rows = t.documents.select("doc_id", paths.normalise(raw).alias("rel_path"))
    return rows.filter(lib.is_library_file("rel_path")).select(
        "doc_id", "rel_path", paths.base_name("rel_path").alias("name"), paths.folder("rel_path").alias("category"),
        paths.extension("rel_path").alias("ext"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN source || '/' || doc_id || '.md' WHEN 'es' THEN doc_id || '.md' END AS rel_path
FROM documents""")
def path_containment(t: Tables) -> DataFrame:
    """en: inside, by a detour; es: inside; fr: a look-alike neighbour; de: climbs out."""
    tail = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("/lib/../lib/memory/./x/../"), "source", F.lit("/"), tail))
        .when(F.col("lang") == "es", F.concat(F.lit("/lib/memory//"), tail))
        .when(F.col("lang") == "fr", F.concat(F.lit("/lib/memory_old/"), tail))
        .otherwise(F.concat(F.lit("/lib/memory/../"), tail)))
    return t.documents.select("doc_id", paths.relative_to(path, F.lit("/lib/memory")).alias("rel_path"))


@query("""
WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS size_bytes, lang,
  source || '/doc_' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'es' THEN '.txt' ELSE '.xyz' END AS rel_path FROM documents)
SELECT rel_path, size_bytes, regexp_extract(rel_path, '[^/]*$') AS name, regexp_extract(rel_path, '^(.*)/', 1) AS category,
  lang IN ('en', 'es') AS ok, CASE WHEN lang IN ('en', 'es') THEN md5(text) END AS text_md5,
  CASE WHEN lang NOT IN ('en', 'es') THEN '[Tipo de archivo no soportado: .xyz]' END AS error
FROM d""")
def load_envelope(t: Tables) -> DataFrame:
    """File bodies as bytes, decoded by type; other types carry an error."""
    kind = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "es", ".txt").otherwise(".xyz")
    bodies = t.documents.select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), kind).alias("rel_path"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.encode("text", "UTF-8").alias("content"))
    return lib.load_documents(bodies).select("rel_path", "size_bytes", "name", "category", "ok", F.md5("text").alias("text_md5"), "error")


@query("""
WITH f AS (SELECT source AS folder, lang FROM documents)
SELECT folder, count(*) FILTER (lang = 'en') AS md, count(*) FILTER (lang = 'es') AS pdf,
       count(*) FILTER (lang NOT IN ('en', 'es')) AS other FROM f GROUP BY folder""")
def library_inventory(t: Tables) -> DataFrame:
    kind = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "es", ".pdf").otherwise(".txt")
    return lib.inventory(t.documents.select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), kind).alias("rel_path")))


@query("""
SELECT source AS folder FROM documents UNION SELECT source || '/' || lang FROM documents""")
def folder_domain(t: Tables) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.lit("deep"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return lib.folders(t.documents.select(path.alias("rel_path")))


@query(f"""
WITH pages AS (SELECT doc_id, unnest(string_split(text, {NL})) AS page FROM documents),
c AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (length({strip_sql('page')}) > 50) AS text_pages FROM pages GROUP BY doc_id)
SELECT doc_id, pages, text_pages, CASE WHEN text_pages > pages * 0.3 THEN 'direct' ELSE 'recognise' END AS route,
  CASE WHEN text_pages > pages * 0.3 THEN 0 ELSE least(pages, 600) END::BIGINT AS recognise_pages FROM c""")
def extraction_route(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return lib.extraction_route(pages)


# --- text -----------------------------------------------------------------------

@query(f"""
SELECT doc_id, md5({strip_sql(f"replace(replace(text, {NL}, {NL} || {NL} || {NL}), {NL} || {NL} || {NL}, {NL} || {NL})")}) AS clean_md5
FROM documents""")
def clean_documents(t: Tables) -> DataFrame:
    """NULs and triple line ends are put in first, so that there is something to clean."""
    dirty = F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit(" "), F.lit("\x00"))
    return t.documents.select("doc_id", F.md5(tx.clean_text(dirty)).alias("clean_md5"))


@query(f"""
SELECT doc_id, length({strip_sql('text')}) >= 50 AS document, length(text) > 20 AS chunk, length({strip_sql('text')}) >= 100 AS digest,
  length(text) > 50 AS answer FROM documents""")
def length_gates(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", tx.is_indexable("text").alias("document"), tx.longer_than("text", 20).alias("chunk"),
        (F.length(tx.strip("text")) >= 100).alias("digest"), tx.longer_than("text", 50).alias("answer"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"


@query(f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[[:word:]áéíóúñèêçäöüßàâîôûùëïœæ]+')) AS w FROM documents)
SELECT doc_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS keywords FROM w
WHERE regexp_full_match(w, '[a-záéíóúñ]{{3,}}') AND NOT list_contains({STOP_SQL}, w) GROUP BY doc_id""")
def document_keywords(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.array_join(tx.keywords("text"), " ").alias("keywords"))
    return words.filter("keywords <> ''")


@query(f"""
SELECT item_id, array_to_string(list_filter(regexp_split_to_array({strip_sql('text')}, '\\s+'), lambda w: length(w) > 4)[1:5], ' ') AS words
FROM benchmark""")
def query_words(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.query_words("text").alias("words"))


@query("""
WITH h AS (SELECT doc_id, text, lang, strpos(lower(text), lower('The ')) AS pos FROM documents)
SELECT doc_id, CASE WHEN pos = 0 THEN '' ELSE '...' || substr(text, greatest(1, pos - 100)::BIGINT,
  (least(length(text), pos + 4 + 100 - 1) - greatest(1, pos - 100) + 1)::BIGINT) || '...' END AS fragment FROM h""")
def keyword_in_context(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.in_context("text", "The ").alias("fragment"))


# --- chapters and chunks ------------------------------------------------------------

def label_sql(p: str) -> str:
    """Label of a paragraph as SQL; roman numerals up to XX are listed."""
    got = "coalesce(" + ", ".join(
        f"nullif(regexp_extract(substr({p}, 1, 500), '{w}\\s+(\\d+|[IVX]+)', 1, 'i'), '')"
        for w in ("cap[íi]tulo", "t[íi]tulo", "secci[óo]n")) + ")"
    romans = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
    values = " ".join(f"WHEN '{r}' THEN '{i}'" for i, r in enumerate(romans, 1))
    return f"'capitulo_' || (CASE {got} {values} ELSE {got} END)"


LABELLED_SQL = """CASE lang WHEN 'en' THEN 'Ver el Capítulo ' || (doc_id + 1) || '. ' || text
  WHEN 'fr' THEN repeat('z', 480) || ' CAPÍTULO ' || ['I','IV','VII','IX','XIV','XIX'][(doc_id % 6 + 1)::INT] || ' ' || text
  WHEN 'es' THEN 'título vii; Sección 3. ' || text ELSE text END"""


def _labelled() -> Column:
    roman = F.element_at(F.array(*[F.lit(r) for r in ("I", "IV", "VII", "IX", "XIV", "XIX")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return (
        F.when(F.col("lang") == "en", F.concat(F.lit("Ver el Capítulo "), (F.col("doc_id") + 1).cast("string"), F.lit(". "), "text"))
        .when(F.col("lang") == "fr", F.concat(F.repeat(F.lit("z"), F.lit(480)), F.lit(" CAPÍTULO "), roman, F.lit(" "), "text"))
        .when(F.col("lang") == "es", F.concat(F.lit("título vii; Sección 3. "), "text"))
        .otherwise(F.col("text")))


@query(f"""WITH d AS (SELECT doc_id, {LABELLED_SQL} AS t FROM documents) SELECT doc_id, {label_sql('t')} AS chapter FROM d""")
def chapter_labels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.chapter_label(_labelled()).alias("chapter"))


PARAGRAPHS_SQL = f"""replace(replace(replace(text, {NL} || 'T', {NL} || 'Capítulo 4 T'), {NL} || 'E', {NL} || 'Título XII: E'), {NL}, {NL} || {NL})"""


def _paragraphs() -> Column:
    """Line ends become blank lines, and some paragraphs open a chapter."""
    out = F.replace(F.replace("text", F.lit("\nT"), F.lit("\nCapítulo 4 T")), F.lit("\nE"), F.lit("\nTítulo XII: E"))
    return F.replace(out, F.lit("\n"), F.lit("\n\n"))


def chunks_sql(source: str) -> str:
    """CTEs ending in ``chunks(doc_id, chunk_ix, text, chapter)`` for a relation (doc_id, text)."""
    return f"""
src AS (SELECT doc_id, text FROM ({source}) WHERE length({strip_sql('text')}) >= 50),
para AS (SELECT doc_id, unnest(string_split(text, {NL} || {NL})) AS p, generate_subscripts(string_split(text, {NL} || {NL}), 1) AS ix FROM src),
lab AS (SELECT doc_id, ix, p, {label_sql('p')} AS label FROM para),
fold(doc_id, ix, open, chapter, closed) AS (
  SELECT doc_id, 0::BIGINT, ''::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM src
  UNION ALL
  SELECT f.doc_id, l.ix,
    CASE WHEN length(f.open) + length(l.p) > 500 AND f.open <> '' THEN right(f.open, 100) || l.p ELSE f.open || {NL} || {NL} || l.p END,
    coalesce(l.label, f.chapter),
    CASE WHEN length(f.open) + length(l.p) > 500 AND f.open <> '' THEN {strip_sql('f.open')} END
  FROM fold f JOIN lab l ON l.doc_id = f.doc_id AND l.ix = f.ix + 1),
gathered AS (
  SELECT doc_id, ix, 0 AS late, closed AS text, chapter FROM fold WHERE closed IS NOT NULL
  UNION ALL
  SELECT doc_id, ix, 1, {strip_sql('open')}, chapter FROM (SELECT *, max(ix) OVER (PARTITION BY doc_id) AS m FROM fold) WHERE ix = m),
cut AS (
  SELECT doc_id, ix, late, 0 AS off, text, chapter FROM gathered WHERE length(text) <= 750
  UNION ALL
  SELECT doc_id, ix, late, off, {strip_sql("substr(text, off + 1, 500)")}, chapter
  FROM (SELECT *, unnest(range(0, length(text), 400)) AS off FROM gathered WHERE length(text) > 750)),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix, late, off) - 1 AS chunk_ix, text, chapter
  FROM cut WHERE length(text) > 20)"""


@query(f"""WITH RECURSIVE {chunks_sql(f'SELECT doc_id, {PARAGRAPHS_SQL} AS text FROM documents')}
SELECT doc_id || ':chunk:' || chunk_ix AS chunk_id, doc_id, chunk_ix::BIGINT AS chunk_ix, chapter, length(text)::BIGINT AS n_chars, md5(text) AS text_md5
FROM chunks""")
def chunk_paragraphs(t: Tables) -> DataFrame:
    return _chunk_digest(ix.make_chunks(t.spread("documents").select("doc_id", _paragraphs().alias("text"))))


@query(f"""WITH RECURSIVE {chunks_sql('SELECT doc_id, text FROM documents')}
SELECT doc_id || ':chunk:' || chunk_ix AS chunk_id, doc_id, chunk_ix::BIGINT AS chunk_ix, chapter, length(text)::BIGINT AS n_chars, md5(text) AS text_md5
FROM chunks""")
def chunk_raw_texts(t: Tables) -> DataFrame:
    return _chunk_digest(ix.make_chunks(t.spread("documents").select("doc_id", "text")))


@query(f"""WITH RECURSIVE {chunks_sql('SELECT doc_id, text FROM documents')}
SELECT coalesce(source, '*') AS category, count(*) AS chunks FROM chunks c JOIN documents d ON c.doc_id = d.doc_id GROUP BY ROLLUP (source)""")
def index_statistics(t: Tables) -> DataFrame:
    """Chunks of the index by category and, under a star, in all."""
    chunks = ix.make_chunks(t.spread("documents").select("doc_id", F.col("source").alias("category"), "text")).select("category")
    by = checkpoint(ix.index_statistics(chunks, "category"))
    return by.unionByName(by.agg(F.sum("chunks").alias("chunks")).select(F.lit("*").alias("category"), "chunks"))


def _chunk_digest(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id", "doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), "chapter",
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE {chunks_sql(f'''SELECT doc_id, replace({strip_sql(f"text")}, {NL}, {NL} || {NL}) AS text FROM documents''')}
SELECT source, count(*) AS chunks, count(DISTINCT c.doc_id) AS documents, sum(length(c.text))::BIGINT AS chars
FROM chunks c JOIN documents d ON c.doc_id = d.doc_id GROUP BY source""")
def chunk_statistics(t: Tables) -> DataFrame:
    """Clean, gate, chunk and count: the way of a document into the index."""
    cleaned = tx.clean_text(F.replace(tx.strip("text"), F.lit("\n"), F.lit("\n\n")))
    # Counted per document first, so that no chunk text is shuffled.
    texts = ordered.settled(t.spread("documents").select("doc_id", "source", "text"), cleaned=cleaned)
    chunked = ordered.settled(texts.filter(tx.is_indexable("cleaned")), c=tx.chunk_text("cleaned"))
    sized = chunked.select("source", F.size("c").alias("n"), F.aggregate(
        F.transform("c", lambda k: F.length(k["text"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"))
    return sized.filter("n > 0").groupBy("source").agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))


@query("""
WITH l AS (SELECT conv_id, turn, CASE WHEN text LIKE '%the%' THEN 'capitulo_' || (turn + 1) END AS label FROM conversations)
SELECT conv_id, turn, last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chapter FROM l""")
def chapter_carry_forward(t: Tables) -> DataFrame:
    label = F.when(F.col("text").contains("the"), F.concat(F.lit("capitulo_"), (F.col("turn") + 1).cast("string")))
    rows = t.conversations.select("conv_id", "turn", label.alias("label"))
    return ordered.carried(rows, ["conv_id"], "turn", "label", "chapter", span=4).select("conv_id", "turn", "chapter")


@query("""
WITH s AS (SELECT source AS category, doc_id, chr(10) || chr(10) || '===== doc_' || doc_id || '.md =====' || chr(10) || text AS section FROM documents WHERE text <> '' AND source IS NOT NULL),
b AS (SELECT *, octet_length(encode(section)) AS n, sum(octet_length(encode(section))) OVER (PARTITION BY category ORDER BY doc_id) AS upto FROM s),
i AS (SELECT *, unnest(range(0, (length(section) - 1) // 4096 + 1)) AS i FROM b),
p AS (SELECT category, doc_id, i, substr(section, i * 4096 + 1, 4096) AS piece, (upto - n + octet_length(encode(substr(section, 1, i * 4096)))) // 16384 AS part FROM i)
SELECT category, part::BIGINT AS part, md5(string_agg(piece, '' ORDER BY doc_id, i)) AS text_md5, sum(octet_length(encode(piece)))::BIGINT AS bytes FROM p GROUP BY ALL""")
def corpus_concatenation(t: Tables) -> DataFrame:
    """All documents of a source as one text, in parts of at most 32 KiB."""
    named = t.documents.select(F.col("source").alias("category"), "doc_id", "text", F.concat(
        F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"))
    return jobs.corpus_sections(named, "category", "doc_id", F.col("name"), part_bytes=32 << 10).select("category", "part", F.md5("text").alias("text_md5"), "bytes")


# --- the index -----------------------------------------------------------------------
# Version 1 of the library is the documents table.  In version 2 toxic documents are
# gone, good ones are revised, other labelled ones only touched, and the benchmark
# passages are new files.

V1_SQL = "SELECT source || '/doc_' || doc_id || '.md' AS rel_path, text, octet_length(encode(text)) AS size_bytes, doc_id * 1000 AS modified_us FROM documents"
V2_SQL = """SELECT source || '/doc_' || d.doc_id || '.md' AS rel_path,
    CASE WHEN l.quality = 1 THEN text || chr(10) || 'Revised.' ELSE text END AS text,
    octet_length(encode(CASE WHEN l.quality = 1 THEN text || chr(10) || 'Revised.' ELSE text END)) AS size_bytes,
    d.doc_id * 1000 + CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END AS modified_us
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0
  UNION ALL SELECT 'benchmark/item_' || item_id || '.md', text, octet_length(encode(text)), item_id FROM benchmark"""
CHANGES_SQL = f"""
v1 AS ({V1_SQL}), v2 AS ({V2_SQL}),
changes AS (SELECT coalesce(v1.rel_path, v2.rel_path) AS rel_path, CASE WHEN v2.rel_path IS NULL THEN 'deleted' WHEN v1.rel_path IS NULL THEN 'new'
    WHEN v1.size_bytes = v2.size_bytes AND v1.modified_us = v2.modified_us THEN 'unchanged'
    WHEN sha256(v1.text) = sha256(v2.text) THEN 'touched' ELSE 'modified' END AS change,
    v1.text AS old_text, v2.text AS new_text, v1.size_bytes AS old_size, v2.size_bytes AS new_size, v1.modified_us AS old_time, v2.modified_us AS new_time
  FROM v1 FULL JOIN v2 ON v1.rel_path = v2.rel_path)"""


def _v1(t: Tables) -> DataFrame:
    return t.spread("documents").select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), "text",
        F.octet_length("text").cast("long").alias("size_bytes"), (F.col("doc_id") * 1000).alias("modified_us"))


def _v2(t: Tables) -> DataFrame:
    d = t.spread("documents").join(t.labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    text = F.when(F.col("quality") == 1, F.concat("text", F.lit("\nRevised."))).otherwise(F.col("text"))
    kept = d.select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), text.alias("text"),
        (F.col("doc_id") * 1000 + F.col("quality").isNotNull().cast("long")).alias("modified_us"))
    fresh = t.benchmark.select(
        F.concat(F.lit("benchmark/item_"), F.col("item_id").cast("string"), F.lit(".md")).alias("rel_path"), "text",
        F.col("item_id").alias("modified_us"))
    return kept.unionByName(fresh).withColumn("size_bytes", F.octet_length("text").cast("long"))


def _manifest(t: Tables) -> DataFrame:
    """What an index of version 1 knows; documents too short for a chunk never entered it."""
    v1 = _v1(t).filter(tx.is_indexable("text"))
    return v1.select(
        "rel_path", ix.content_hash("text").alias("content_sha256"), "size_bytes", "modified_us",
        F.lit("2024-01-01T00:00:00+00:00").alias("indexed_at"), F.lit(1).cast("long").alias("chunk_count"),
        F.lit("indexed").alias("last_operation"), F.lit(None).cast("string").alias("last_error"))


KNOWN_SQL = CHANGES_SQL.replace(
    "v1 AS (", "v0 AS (").replace(", v2 AS (", f", v1 AS (SELECT * FROM v0 WHERE length({strip_sql('text')}) >= 50), v2 AS (", 1)
ITEMS_SQL = f"""
{KNOWN_SQL},
items AS (SELECT rel_path, change, CASE WHEN change = 'deleted' THEN 'deleted' WHEN change IN ('unchanged', 'touched') THEN 'skipped'
    WHEN length({strip_sql('new_text')}) < 50 THEN 'failed' ELSE 'indexed' END AS status FROM changes)"""
SUMMARY_SQL = """SELECT count(*) FILTER (change <> 'deleted') AS scanned, count(*) FILTER (status = 'indexed' AND change = 'new') AS indexed_new,
  count(*) FILTER (status = 'indexed' AND change = 'modified') AS reindexed_modified, count(*) FILTER (status = 'skipped') AS skipped_unchanged,
  count(*) FILTER (status = 'deleted') AS removed_deleted, count(*) FILTER (status = 'failed') AS failed"""


@query(f"WITH {KNOWN_SQL} SELECT rel_path, change FROM changes")
def change_detection(t: Tables) -> DataFrame:
    return ix.detect_changes(_v2(t), _manifest(t)).select("rel_path", "change")


@query(f"WITH {KNOWN_SQL} SELECT rel_path FROM changes WHERE change = 'deleted'")
def deleted_documents(t: Tables) -> DataFrame:
    return ix.deleted_paths(_v2(t), _manifest(t))


def _items(t: Tables, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """Changes and outcomes, each worked out once and written down."""
    v2 = _v2(t)
    changes = checkpoint(ix.detect_changes(v2, _manifest(t), rebuild))
    todo = ordered.rows_of(v2, changes.filter("change in ('new', 'modified')").select("rel_path"), "rel_path")
    return changes, checkpoint(ix.sync_items(changes, ix.chunk_counts(todo, doc_id="rel_path")))


@query(f"WITH {ITEMS_SQL} {SUMMARY_SQL}, 'sync' AS mode FROM items")
def sync_summary(t: Tables) -> DataFrame:
    return ix.sync_summary(_items(t)[1])


@query(f"""WITH {ITEMS_SQL}, all_items AS (SELECT rel_path, CASE WHEN change IN ('unchanged', 'touched') THEN 'modified' ELSE change END AS change,
  CASE WHEN status = 'skipped' THEN 'indexed' ELSE status END AS status FROM items) {SUMMARY_SQL}, 'rebuild' AS mode FROM all_items""")
def rebuild_summary(t: Tables) -> DataFrame:
    return ix.sync_summary(_items(t, rebuild=True)[1], "rebuild")


@query(f"""WITH {ITEMS_SQL}
SELECT c.rel_path, CASE WHEN status = 'indexed' THEN sha256(new_text) ELSE sha256(old_text) END AS content_sha256,
  CASE WHEN status = 'indexed' OR c.change = 'touched' THEN new_size ELSE old_size END AS size_bytes,
  CASE WHEN status = 'indexed' OR c.change = 'touched' THEN new_time ELSE old_time END AS modified_us,
  CASE WHEN status = 'indexed' THEN '2024-02-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS indexed_at,
  CASE WHEN status = 'failed' THEN 'failed' ELSE 'indexed' END AS last_operation
FROM changes c JOIN items i ON c.rel_path = i.rel_path WHERE status <> 'deleted' AND NOT (status = 'failed' AND old_text IS NULL)""")
def next_manifest(t: Tables) -> DataFrame:
    changes, items = _items(t)
    return ix.next_manifest(_manifest(t), changes, items, "2024-02-01T00:00:00+00:00").select(
        "rel_path", "content_sha256", "size_bytes", "modified_us", "indexed_at", "last_operation")


@query(f"""WITH {ITEMS_SQL},
n AS (SELECT rel_path, CASE WHEN status IN ('skipped', 'failed') AND old_text IS NOT NULL THEN old_text WHEN status = 'indexed' THEN new_text END AS live
      FROM changes JOIN items USING (rel_path) WHERE status <> 'deleted'),
w AS (SELECT rel_path, unnest(CASE WHEN length({strip_sql('live')}) > 750 THEN list_transform(range(0, length({strip_sql('live')}), 400),
   lambda i: {strip_sql(f"substr({strip_sql('live')}, i + 1, 500)")}) ELSE [{strip_sql('live')}] END) AS c FROM n WHERE live IS NOT NULL)
SELECT rel_path AS doc_id, count(*) AS chunks, sum(length(c))::BIGINT AS chars FROM w WHERE length(c) > 20 GROUP BY rel_path""")
def chunk_replacement(t: Tables) -> DataFrame:
    """The live index after the changes of version 2, counted per document."""
    old = ix.make_chunks(_v1(t).select(F.col("rel_path").alias("doc_id"), "text"))
    changes, items = _items(t)
    fresh_ids = items.filter("status = 'indexed'").select("rel_path")
    fresh = ix.make_chunks(ordered.rows_of(_v2(t), fresh_ids, "rel_path").select(F.col("rel_path").alias("doc_id"), "text"))
    gone = items.filter("status in ('indexed', 'deleted')").select(F.col("rel_path").alias("doc_id"))
    live = ix.without_documents(old, gone).unionByName(fresh)
    return live.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS version FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def legacy_chunk_replacement(t: Tables) -> DataFrame:
    """Chunks of three ages (id, old path, bare name) give way to the labelled documents' new ones."""
    path = F.concat("source", F.lit("\\doc_"), F.col("doc_id").cast("string"))
    old = t.documents.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("lang") == "en", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"))).alias("doc_id"),
        F.when(F.col("lang").isin("en", "es", "fr"), path).alias("ruta"),
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("name"), F.lit("old").alias("version"))
    fresh = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.lit("new").alias("version"))
    return ix.replace_documents(old, fresh, ix.chunk_owner()).select(F.col("row_id").alias("doc_id"), "version")


@query(f"""
WITH wanted AS (SELECT doc_id::VARCHAR AS doc_id FROM labels WHERE toxic = 1 UNION SELECT 'item_' || item_id FROM benchmark),
{chunks_sql('SELECT doc_id, text FROM documents')},
n AS (SELECT doc_id::VARCHAR AS doc_id, count(*) AS n FROM chunks GROUP BY ALL)
SELECT w.doc_id, CASE WHEN n.n IS NULL THEN 'not_found' ELSE 'deleted' END AS status, coalesce(n.n, 0) AS chunks
FROM wanted w LEFT JOIN n ON w.doc_id = n.doc_id""".replace("WITH wanted", "WITH RECURSIVE wanted"))
def document_deletion(t: Tables) -> DataFrame:
    chunks = ix.make_chunks(t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    wanted = t.labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id")).unionByName(
        t.benchmark.select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("doc_id")))
    return ix.delete_report(chunks, wanted)


@query(f"WITH {ITEMS_SQL} SELECT rel_path, status FROM items")
def stored_index_sync(t: Tables) -> DataFrame:
    """A real index folder: version 1 is indexed, then version 2 is synchronised."""
    folder = scratch_folder(t.spark)
    index = ChunkIndex(t.spark, folder)
    index.sync_table(_v1(t), "2024-01-01T00:00:00+00:00")
    return index.sync_table(_v2(t), "2024-02-01T00:00:00+00:00").select("rel_path", "status")


@query("""
SELECT 'Ingestion_2024-01-01 00-00_' || substr(replace('doc ' || doc_id || ' ' || lang, ' ', '_'), 1, 40) || '_' || substr(md5(source || doc_id), 1, 8) || '.md' AS name,
  source AS category, (n_chars % 28)::VARCHAR AS date FROM documents""")
def ingested_listing(t: Tables) -> DataFrame:
    from archivolt.functions.urls import ingest_file_name

    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit(".txt"))
    rows = t.documents.select(
        ingest_file_name(title, "2024-01-01 00-00", F.concat("source", F.col("doc_id").cast("string"))).alias("name"),
        F.col("source").alias("category"), (F.col("n_chars") % 28).cast("string").alias("date"))
    return records.ingested_artifacts(rows)


@query("""SELECT DISTINCT source || '/doc_' || d.doc_id || '.md' AS rel_path, octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes,
  sha256(coalesce(text, '')) AS content_sha256 FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 WHERE text <> ''""")
def changed_bodies(t: Tables) -> DataFrame:
    """Every document is a file of a folder; only those that are labelled toxic are opened again.  Spark lists no empty files."""
    root = f"{scratch_folder(t.spark)}/library"
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    files.write_files(t.spread("documents").select(path.alias("rel_path"), F.coalesce("text", F.lit("")).alias("content")), root)
    toxic = t.labels.filter("toxic = 1").select("doc_id").distinct().join(t.documents.select("doc_id", path.alias("rel_path")), "doc_id")
    wanted = lib.scan(t.spark, root).join(toxic.select("rel_path").distinct(), "rel_path")
    return lib.read_bodies(t.spark, root, wanted).select("rel_path", "size_bytes", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH RECURSIVE wanted AS (SELECT doc_id FROM labels WHERE toxic = 1), {chunks_sql('SELECT doc_id, text FROM documents')}
SELECT source || '/doc_' || d.doc_id || '.md' AS doc_id, count(*) AS chunks, count(*) AS listed FROM chunks c JOIN documents d ON d.doc_id = c.doc_id
WHERE d.doc_id NOT IN (SELECT doc_id FROM wanted) GROUP BY ALL""")
def stored_index_deletion(t: Tables) -> DataFrame:
    """A real index folder from which toxic documents are deleted: the chunks that stay, and what the manifest says of them."""
    index = ChunkIndex(t.spark, scratch_folder(t.spark))
    index.sync_table(_v1(t), "2024-01-01T00:00:00+00:00")
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    index.delete(t.labels.filter("toxic = 1").select("doc_id").distinct().join(t.documents, "doc_id").select(path.alias("doc_id")))
    held = index.chunks().groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return held.join(index.manifest().select(F.col("rel_path").alias("doc_id"), F.col("chunk_count").alias("listed")), "doc_id", "full_outer")

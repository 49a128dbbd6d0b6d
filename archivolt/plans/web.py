"""Queries on web pages: text, links, URL policy, names, crawls, search results."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions import html, text as tx, urls
from archivolt.operators import crawl, enrich
from archivolt.plans import Tables, query
from archivolt.plans.library import strip_sql
from archivolt.sources import records

# --- text of pages ------------------------------------------------------------------

ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\xa0"), ("&amp;", "&")]


def unescape_sql(c: str) -> str:
    for entity, char in ENTITIES:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def map_sql(pairs: dict) -> str:
    literal = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in pairs.items()) + "}"


# Character references as the HTML standard reads them: names that end in a semicolon, names that need none, and numbers.
NAMED = map_sql({name: char for name, char in html5.items() if name.endswith(";")})
BARE = map_sql({name: char for name, char in html5.items() if not name.endswith(";")})
LOW_NUMBERS = map_sql({n: unescape(f"&#{n};") for n in range(160)})
LONGEST_BARE = max(len(name) for name in html5 if not name.endswith(";"))


def charrefs_sql(c: str) -> str:
    """Character references give way to their characters; of a name without a semicolon the longest known beginning counts."""
    bare = ", ".join(f"{BARE}[substr(p, 2, {k})] || substr(p, {k + 2})" for k in range(LONGEST_BARE, 1, -1))
    number = "coalesce(try_cast(CASE WHEN p[3] IN ('x', 'X') THEN '0x' || rtrim(p[4:], ';') ELSE rtrim(p[3:], ';') END AS BIGINT), 1114112)"
    digits = f"""list_transform([{number}], lambda n: CASE WHEN n < 160 THEN {LOW_NUMBERS}[n::INT] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
      WHEN n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END)[1]"""
    one = f"CASE WHEN p[1] <> '&' OR length(p) = 1 THEN p WHEN p[2] = '#' THEN {digits} ELSE coalesce({NAMED}[substr(p, 2)], {bare}, p) END"
    pieces = f"regexp_extract_all({c}, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)|[^&]+|&')"
    return f"CASE WHEN contains({c}, '&') THEN array_to_string(list_transform({pieces}, lambda p: {one}), '') ELSE {c} END"


def without_tags_sql(c: str, tags: list[str]) -> str:
    """Elements of the given names give way to an empty tag."""
    for tag in tags:
        c = f"regexp_replace({c}, '<{tag}[^a-z][^>]*>.*?</{tag}>|<{tag}>.*?</{tag}>', '<i>', 'gs')"
    return c


BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in fixed.BLANKS)
RUNS = "regexp_split_to_array({c}, '<!--.*?-->|<[^>]*>')"


@query(f"""
WITH r AS (SELECT page_id, list_filter({RUNS.format(c=without_tags_sql('html', fixed.HTML_HIDDEN_TAGS))}, lambda x: x <> '') AS runs FROM pages)
SELECT page_id, md5(array_to_string(list_transform(list_transform(runs, lambda x: {charrefs_sql('x')}),
  lambda x: CASE WHEN {strip_sql('x')} <> '' THEN x WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END), ' ')) AS text_md5 FROM r""")
def html_document_text(t: Tables) -> DataFrame:
    return t.spread("pages").select("page_id", F.md5(html.document_text("html")).alias("text_md5"))


# Texts of a page outside menus, each without blanks of any script at its ends.
SHOWN_SQL = f"""list_filter(list_transform({RUNS.format(c=without_tags_sql("coalesce(html, '')", fixed.HTML_SKIP_TAGS))}, lambda x: trim({charrefs_sql('x')}, {BLANKS_SQL})), lambda x: x <> '')"""


@query(f"""
WITH r AS (SELECT page_id, array_to_string({SHOWN_SQL}, ' ') AS text,
  list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '<a [^>]*href="([^"]+)"', 1), lambda x: {charrefs_sql('x')}), lambda x: x <> ''))) AS hrefs FROM pages)
SELECT page_id, md5(text) AS text_md5, len(hrefs)::INT AS links, md5(array_to_string(hrefs, ' ')) AS links_md5 FROM r""")
def page_text_and_links(t: Tables) -> DataFrame:
    read = t.spread("pages").select("page_id", html.page_content("html").alias("c"))
    return read.select(
        "page_id", F.md5("c.text").alias("text_md5"), F.size("c.hrefs").alias("links"),
        F.md5(F.array_join(F.array_sort("c.hrefs"), " ")).alias("links_md5"))


TEXT_SQL = f"""w AS (SELECT page_id, regexp_split_to_array({strip_sql("regexp_replace(" + without_tags_sql('html', fixed.HTML_SKIP_TAGS) + ", '<!--.*?-->|<[^>]*>', ' ', 'gs')")}, '\\s+') AS words FROM pages)"""


@query(f"""WITH {TEXT_SQL}
SELECT page_id, len(words) >= 40 AND len(list_filter(words, lambda x: length({unescape_sql('x')}) > 5)) >= 5 AS useful FROM w""")
def useful_pages(t: Tables) -> DataFrame:
    read = t.spread("pages").select("page_id", html.page_content("html")["text"].alias("text"))
    return read.select("page_id", tx.useful_content("text").alias("useful"))


# --- URLs ----------------------------------------------------------------------------
# Some addresses are spelled another way first, by page number.

URL_SQL = """CASE page_id % 7 WHEN 0 THEN replace(upper(regexp_extract(url, '^[^/]*//[^/]*')), '.COM', '.COM:80') || regexp_extract(url, '^[^/]*//[^/]*(.*)', 1)
  WHEN 1 THEN replace(url, '/en/', '/en/?b=2&a=&a=1') WHEN 2 THEN replace(url, '://', '://user:pw@') WHEN 3 THEN replace(url, 'http', 'ftp')
  WHEN 4 THEN regexp_replace(url, '^(https?://[^/]*).*', '\\1') WHEN 5 THEN url || ' ' ELSE replace(url, '.html', '.pdf') END"""


def _url() -> Column:
    k, url = F.col("page_id") % 7, F.col("url")
    head, rest = F.regexp_extract(url, "^[^/]*//[^/]*", 0), F.regexp_extract(url, "^[^/]*//[^/]*(.*)", 1)
    return (
        F.when(k == 0, F.concat(F.replace(F.upper(head), F.lit(".COM"), F.lit(".COM:80")), rest))
        .when(k == 1, F.replace(url, F.lit("/en/"), F.lit("/en/?b=2&a=&a=1")))
        .when(k == 2, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(k == 3, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(k == 4, head).when(k == 5, F.concat(url, F.lit(" ")))
        .otherwise(F.replace(url, F.lit(".html"), F.lit(".pdf"))))


PARTS_SQL = f"""u AS (SELECT page_id, {strip_sql(URL_SQL)} AS u FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)', 1) AS port, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) AS query, contains(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1), '@') AS creds FROM u)"""
CANONICAL_SQL = """scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(list_transform(string_split(query, '&'),
  lambda x: split_part(x, '=', 1) || '=' || CASE WHEN contains(x, '=') THEN replace(replace(replace(substr(x, strpos(x, '=') + 1), '?', '%3F'), '=', '%3D'), '/', '%2F') ELSE '' END)), '&') END"""


@query(f"WITH {PARTS_SQL} SELECT page_id, {CANONICAL_SQL} AS canonical FROM p")
def canonical_urls(t: Tables) -> DataFrame:
    return t.spread("pages").select("page_id", urls.canonical(_url()).alias("canonical"))


@query(f"""WITH {PARTS_SQL},
r AS (SELECT page_id, host, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN creds THEN 'credentials' WHEN host LIKE '%.org' THEN 'unresolved' WHEN host LIKE '%.net' THEN 'address' END AS reason, {CANONICAL_SQL} AS c FROM p)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN c END AS canonical FROM r""")
def url_policy(t: Tables) -> DataFrame:
    """Hosts of .net also resolve to a private address, those of .org to none."""
    hosts = t.pages.select(urls.parts(_url())["host"].alias("host")).distinct().filter(~F.col("host").endswith(".org"))
    public = hosts.select("host", F.lit("93.184.216.34").alias("ip"))
    private = hosts.filter(F.col("host").endswith(".net")).select("host", F.lit("10.0.0.7").alias("ip"))
    seen = t.pages.select("page_id", _url().alias("url"))
    return crawl.admit(seen, public.unionByName(private)).select("page_id", "reason", "canonical")


@query(f"""WITH {PARTS_SQL}, o AS (SELECT page_id, scheme, host, CASE WHEN port <> '' THEN port::INT WHEN scheme = 'https' THEN 443 ELSE 80 END AS port FROM p)
SELECT scheme, host, port, count(*) AS pages FROM o GROUP BY ALL""")
def page_origins(t: Tables) -> DataFrame:
    return t.pages.select(urls.origin(_url()).alias("o")).groupBy("o").agg(F.count(F.lit(1)).alias("pages")).select("o.*", "pages")


EXT_SQL = "lower(regexp_extract(path, '[^/]*?([.][^./]+)/*$', 1))"


@query(f"""WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '/issues/1' WHEN 1 THEN replace(url, '/en/', '/en/Search?q=') WHEN 2 THEN replace(url, '.html', '.PNG') ELSE url END AS u FROM pages),
p AS (SELECT page_id, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*([?][^#]*)', 1) AS q FROM v)
SELECT page_id, ({' OR '.join(f"contains(lower(path || q), '{x}')" for x in fixed.URL_SKIP_FRAGMENTS)})
  OR {EXT_SQL} IN ({', '.join(f"'{x}'" for x in fixed.URL_SKIP_EXTENSIONS)}) AS skipped FROM p""")
def skipped_urls(t: Tables) -> DataFrame:
    k, url = F.col("page_id") % 5, F.col("url")
    seen = (
        F.when(k == 0, F.concat(url, F.lit("/issues/1"))).when(k == 1, F.replace(url, F.lit("/en/"), F.lit("/en/Search?q=")))
        .when(k == 2, F.replace(url, F.lit(".html"), F.lit(".PNG"))).otherwise(url))
    return t.pages.select("page_id", urls.is_skipped(seen).alias("skipped"))


@query(f"""SELECT page_id, {' OR '.join(f"ends_with(regexp_extract(url, '^https?://([^/?#]*)', 1), '{x}')" for x in fixed.TRUSTED_SUFFIXES)} AS trusted,
  split_part(replace(regexp_extract(url, '^https?://([^/?#]*)', 1), 'www.', ''), '.', 1) AS label FROM pages""")
def trusted_and_labelled(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.is_trusted("url").alias("trusted"), urls.domain_label("url").alias("label"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE starts_with(url, 'https://') OR starts_with(url, 'http://') END AS valid FROM pages""")
def web_sources(t: Tables) -> DataFrame:
    """The address is in url, in href, or not of the web."""
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("ftp:"), "url")).when(k == 1, "").when(k == 2, F.col("url")).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.is_web_url(url, F.when(k == 1, F.col("url"))).alias("valid"))


# --- names ----------------------------------------------------------------------------



@query("""WITH n AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
a AS (SELECT page_id, replace(strip_accents(title), 'ß', '') AS t FROM n),
s AS (SELECT page_id, trim(substr(regexp_replace(trim(regexp_replace(t, '[^a-zA-Z0-9_-]+', '_', 'g'), '._- '), '_+', '_', 'g'), 1, 60)) AS s FROM a)
SELECT page_id, lower(CASE WHEN rtrim(s, '._- ') = '' THEN 'page' ELSE rtrim(s, '._- ') END) AS name FROM s""")
def safe_names(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", urls.safe_name(title, "page").alias("name"))


STEM_SQL = "regexp_replace(regexp_extract(rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), '[^/]*$'), '[.][^.]+$', '')"


@query(f"""SELECT page_id, lower({STEM_SQL}) || '_' || substr(sha256(url), 1, 10) || '.md' AS crawl_name,
  'Ingestion_2024-05-01 10-30_' || substr(replace('page ' || page_id, ' ', '_'), 1, 40) || '_' || substr(md5(url), 1, 8) || '.md' AS ingest_name,
  'Local_2024-05-01 10-30_' || substr(replace('a rather long name of a local page ' || page_id, ' ', '_'), 1, 30) || '_' || substr(md5('a rather long name of a local page ' || page_id || '.html'), 1, 8) || '.md' AS local_name
FROM pages""")
def artifact_names(t: Tables) -> DataFrame:
    number = F.col("page_id").cast("string")
    return t.pages.select(
        "page_id", urls.page_file_name("url", ascii_only=True).alias("crawl_name"),
        urls.ingest_file_name(F.concat(F.lit("page "), number, F.lit(".pdf")), "2024-05-01 10-30", "url").alias("ingest_name"),
        urls.ingest_file_name(F.concat(F.lit("a rather long name of a local page "), number, F.lit(".html")),
                              "2024-05-01 10-30", prefix="Local", cut=30).alias("local_name"))


@query("""SELECT page_id, md5('---' || chr(10) || 'titulo: "page ' || page_id || '"' || chr(10) || 'fuente: "' || url || '"' || chr(10) || 'fecha_ingestion: "2024-05-01T10:30:00"' || chr(10)
  || 'categoria: "Estudio"' || chr(10) || 'hash_url: "' || substr(md5(url), 1, 8) || '"' || chr(10) || '---' || chr(10) || chr(10) || html) AS ingest_md5,
  md5('# Fuente: ' || url || chr(10) || chr(10) || html) AS crawl_md5 FROM pages""")
def artifact_texts(t: Tables) -> DataFrame:
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    text = records.artifact_text(title, "url", "2024-05-01T10:30:00", F.lit("Estudio"), "html", F.substring(F.md5("url"), 1, 8))
    return t.pages.select("page_id", F.md5(text).alias("ingest_md5"), F.md5(records.page_artifact_text("url", "html")).alias("crawl_md5"))


@query("""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'APPLICATION/PDF' WHEN 2 THEN 'image/png' WHEN 3 THEN '' ELSE 'text/plain' END AS ct,
  octet_length(encode(html)) * CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4000 ELSE 40000 END AS n FROM pages)
SELECT page_id, CASE WHEN n > 52428800 THEN 'size' WHEN ct NOT IN ('text/html; charset=utf-8', 'APPLICATION/PDF', 'text/plain') THEN 'type' END AS ingest,
  CASE WHEN ct NOT IN ('text/html; charset=utf-8', '', 'text/plain') THEN 'type' WHEN n > 5242880 THEN 'size' END AS crawl FROM f""")
def fetch_gates(t: Tables) -> DataFrame:
    k = F.col("page_id") % 5
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "APPLICATION/PDF").when(k == 2, "image/png").when(k == 3, "").otherwise("text/plain")
    scale = F.when(F.col("page_id") % 3 == 0, 1).when(F.col("page_id") % 3 == 1, 4000).otherwise(40000)
    size = F.octet_length("html").cast("long") * scale
    return t.pages.select("page_id", crawl.fetch_verdict(kind, size).alias("ingest"), crawl.fetch_verdict(kind, size, crawl=True).alias("crawl"))


# --- links, robots, crawls ---------------------------------------------------------------

@query("""WITH p AS (SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_replace(url, '#.*$', '') AS u, html FROM pages),
l AS (SELECT DISTINCT origin, u, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) AS href FROM p)
SELECT array_to_string(list_transform([u], lambda x: CASE WHEN contains(x, '?') THEN regexp_replace(x, '[?].*', '') || '?' ||
    array_to_string(list_sort(string_split(regexp_extract(x, '[?](.*)', 1), '&')), '&') ELSE x END), '') AS src, origin || href AS dst FROM l WHERE starts_with(href, '/')""")
def page_links(t: Tables) -> DataFrame:
    return crawl.page_links(t.spread("pages"))


ROBOTS = """User-agent: *
Disallow: /es/   # Spanish pages
Allow: /fr/8
Disallow: /fr/
Disallow:

User-agent: OtherBot
Disallow: /
"""


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, url LIKE 'https://%' AS secure FROM pages)
SELECT page_id, NOT secure OR (path NOT LIKE '/es/%' AND (path LIKE '/fr/8%' OR path NOT LIKE '/fr/%')) AS allowed FROM p""")
def robots_rules(t: Tables) -> DataFrame:
    """Secure origins have a robots file; the others answer 404."""
    origin = F.array_join(F.array(*[urls.origin("url")[p].cast("string") for p in ("scheme", "host", "port")]), "|")
    files = t.pages.select(origin.alias("origin")).distinct().select(
        "origin", F.when(F.col("origin").startswith("https|"), 200).otherwise(404).alias("status"), F.lit(ROBOTS).alias("body"))
    rules = crawl.parse_robots(files, "archivolt/1.0 (knowledge crawler)")
    return crawl.robots_allowed(t.pages.select("page_id", "url"), rules).select("page_id", "allowed")


# A web drawn from the pages: five sites, every page links to three further ones, back to
# its parent and to another site.  Pages whose number ends in 7 are thin.
GRAPH_SQL = """n AS (SELECT page_id % 5 AS site, page_id // 5 AS i FROM pages),
links AS (SELECT n.site, n.i AS src, x.i AS dst FROM n JOIN n x ON n.site = x.site AND (x.i IN (3 * n.i + 1, 3 * n.i + 2, 3 * n.i + 3) OR x.i = (n.i - 1) // 3 AND n.i > 0)),
walk AS (SELECT DISTINCT site, 0 AS i, 0 AS depth FROM n UNION SELECT w.site, l.dst, w.depth + 1 FROM walk w JOIN links l ON w.site = l.site AND w.i = l.src WHERE w.depth < 3),
reached AS (SELECT site, i, min(depth) AS depth FROM walk GROUP BY ALL)"""


def _graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    url = lambda site, i: F.concat(F.lit("https://site"), site.cast("string"), F.lit(".example/p"), F.lpad(i.cast("string"), 12, "0"))
    n = t.pages.select((F.col("page_id") % 5).alias("site"), F.floor(F.col("page_id") / 5).cast("long").alias("i"), "page_id")
    pages = n.select(
        url(F.col("site"), F.col("i")).alias("url"), F.when(F.col("i") % 10 == 7, "thin").otherwise("saved").alias("outcome"), F.lit(False).alias("skip"))
    to = F.array(3 * F.col("i") + 1, 3 * F.col("i") + 2, 3 * F.col("i") + 3, F.floor((F.col("i") - 1) / 3).cast("long"))
    out = n.select("site", "i", F.explode(to).alias("j")).filter("j >= 0").select(url(F.col("site"), F.col("i")).alias("src"), url(F.col("site"), F.col("j")).alias("dst"))
    links = out.join(pages.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")
    seeds = n.filter("i = 0").select(F.col("site").cast("string").alias("seed"), url(F.col("site"), F.col("i")).alias("url"))
    return seeds, pages, links


@query(f"""WITH RECURSIVE {GRAPH_SQL}
SELECT site::VARCHAR AS seed, 'https://site' || site || '.example/p' || lpad(i::VARCHAR, 12, '0') AS url, depth::INT AS depth,
  row_number() OVER (PARTITION BY site ORDER BY depth, i)::INT AS visit, CASE WHEN i % 10 = 7 THEN 'thin' ELSE 'saved' END AS outcome FROM reached""")
def bounded_crawl(t: Tables) -> DataFrame:
    """The budget of 100 pages does not bind here; the depth of 3 does."""
    return crawl.traverse(*_graph(t), max_pages=100)


@query()
def budgeted_crawl(t: Tables) -> DataFrame:
    """Ten pages, fifteen requests and a queue of eight per crawl."""
    return crawl.traverse(*_graph(t), max_pages=10, max_requests=15, queue=8)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT site::VARCHAR AS seed, count(*) FILTER (i % 10 <> 7) AS saved, count(*) FILTER (i % 10 = 7) AS skipped, count(*) AS requests,
  count(*) FILTER (i % 10 <> 7 AND i % 4 <> 3) AS indexed, count(*) FILTER (i % 10 <> 7 AND i % 4 = 3) AS failed FROM reached GROUP BY site)
SELECT *, CASE WHEN indexed > 0 AND failed = 0 THEN 'actualizado' WHEN indexed > 0 THEN 'parcial' ELSE 'sin_cambios' END AS index_state FROM s""")
def crawl_summary(t: Tables) -> DataFrame:
    visits = crawl.traverse(*_graph(t), max_pages=100)
    number = F.substring("url", -12, 12).cast("long")
    done = visits.filter("outcome = 'saved'").select("seed", "url", F.when(number % 4 == 3, "failed").otherwise("indexed").alias("status"))
    return crawl.crawl_summary(visits, done)


# --- search results: pages as answers of three backends ------------------------------------

BACKENDS_SQL = """b AS (SELECT * FROM (VALUES ('first', 1), ('second', 2), ('third', 3)) v(backend, priority)),
r AS (SELECT page_id // 6 AS query_id, ['first', 'second', 'third'][(page_id % 3 + 1)::INT] AS backend, page_id AS pos, 'page ' || page_id AS title,
    CASE WHEN page_id % 4 = 3 THEN 'ftp' ELSE '' END || url AS url, 'line' || chr(10) || page_id AS snippet,
    CASE WHEN (page_id // 6) % 3 = 1 AND page_id % 3 = 0 OR (page_id // 6) % 3 = 2 THEN 'error ' || page_id % 3 END AS error FROM pages)"""


def _results(t: Tables) -> DataFrame:
    group = F.floor(F.col("page_id") / 6).cast("long")
    bad = ((group % 3 == 1) & (F.col("page_id") % 3 == 0)) | (group % 3 == 2)
    return t.pages.select(
        group.alias("query_id"),
        F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("third")), (F.col("page_id") % 3 + 1).cast("int")).alias("backend"),
        F.col("page_id").alias("pos"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"),
        F.concat(F.when(F.col("page_id") % 4 == 3, "ftp").otherwise(""), "url").alias("url"),
        F.concat(F.lit("line\n"), F.col("page_id").cast("string")).alias("snippet"),
        F.when(bad, F.concat(F.lit("error "), (F.col("page_id") % 3).cast("string"))).alias("error"))


def _backends(t: Tables) -> DataFrame:
    order = F.when(F.col("backend") == "first", 1).when(F.col("backend") == "second", 2).otherwise(3)
    return _results(t).select("backend").distinct().withColumn("priority", order)


CHAIN_SQL = f"""{BACKENDS_SQL},
st AS (SELECT query_id, backend, priority, arg_min_null(error, pos) AS e FROM r JOIN b USING (backend) GROUP BY ALL),
good AS (SELECT query_id, min(priority) AS priority FROM st WHERE e IS NULL GROUP BY query_id),
chain AS (SELECT query_id, backend, pos, title, url, snippet, error FROM r JOIN b USING (backend) JOIN good USING (query_id, priority)
  UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, NULL, arg_max(e, priority) FROM st WHERE query_id NOT IN (SELECT query_id FROM good) GROUP BY query_id)"""


@query(f"WITH {CHAIN_SQL} SELECT * FROM chain")
def backend_fallback(t: Tables) -> DataFrame:
    return crawl.first_good_backend(_results(t), _backends(t))


@query(f"""WITH {CHAIN_SQL},
e AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i, * EXCLUDE (query_id) FROM chain)
SELECT query_id, CASE WHEN max(error) IS NOT NULL THEN '[Búsqueda web no disponible: ' || max(error) || ']' ELSE string_agg('[' || i || '] ' || title || chr(10) || '    URL: ' || url || chr(10)
  || '    ' || replace(snippet, chr(10), ' ') || chr(10) || '    Fuente: ' || backend, chr(10) ORDER BY i) END AS block FROM e GROUP BY query_id""")
def result_blocks(t: Tables) -> DataFrame:
    return crawl.result_block(crawl.first_good_backend(_results(t), _backends(t)), ["query_id"])


@query(f"""WITH {BACKENDS_SQL},
f AS (SELECT query_id, pos, url, 0 AS source FROM r WHERE backend = 'first' AND regexp_matches(url, '^https?://')),
a AS (SELECT query_id, pos, url, 1 AS source FROM r WHERE regexp_matches(url, '^https?://') AND query_id NOT IN (SELECT query_id FROM f GROUP BY query_id HAVING count(*) >= 2)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY source, pos) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM a))
SELECT query_id, pos, url, source FROM k WHERE n = 1""")
def widened_results(t: Tables) -> DataFrame:
    every = _results(t).select("query_id", "backend", "pos", "url")
    return crawl.widen_results(every.filter("backend = 'first'").drop("backend"), every.drop("backend"), 2)


UNIQUE_URL_SQL = "lower(trim(regexp_extract(url, '^(https?://[^/?#]*)', 1)))"


@query(f"""SELECT page_id, {UNIQUE_URL_SQL} AS site FROM (SELECT *, row_number() OVER (PARTITION BY {UNIQUE_URL_SQL} ORDER BY page_id) AS n FROM pages) WHERE n = 1""")
def unique_results(t: Tables) -> DataFrame:
    site = F.concat(F.lit(" "), F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit("\n"))
    rows = t.pages.select("page_id", site.alias("url"))
    return records.unique_results(rows, ["page_id"]).select("page_id", urls.url_key("url").alias("site"))


@query(f"""WITH every AS (SELECT k, page_id, {UNIQUE_URL_SQL} AS site FROM pages, (SELECT unnest([0, 1, 2]) AS k) WHERE page_id % 3 = k OR page_id % 7 = k),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY k, page_id) AS n FROM every)
SELECT ['papers', 'code', 'news'][k + 1] AS category, page_id, site FROM r WHERE n = 1""")
def category_results(t: Tables) -> DataFrame:
    """Three categories that share pages, united before repeats go."""
    site = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    rows = t.pages.select("page_id", site.alias("url"))
    parts = [(name, rows.filter((F.col("page_id") % 3 == k) | (F.col("page_id") % 7 == k))) for k, name in enumerate(("papers", "code", "news"))]
    return records.category_results(parts, ["page_id"]).select("category", "page_id", urls.url_key("url").alias("site"))


@query("""WITH stored AS (SELECT DISTINCT lower(c_name) AS k FROM customer WHERE c_acctbal > 0), found AS (SELECT o_orderkey AS pos, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || '  ' AS url, o_orderpriority AS category FROM orders),
k AS (SELECT *, lower(trim(url)) AS key, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY pos) AS n FROM found)
SELECT pos, key, category FROM k WHERE n = 1 AND key NOT IN (SELECT k FROM stored)""")
def new_rows_only(t: Tables) -> DataFrame:
    """Insert of rows whose key is not stored yet, on keys that many rows share."""
    stored = t.customer.filter("c_acctbal > 0").select(F.col("c_name").alias("url"))
    found = t.orders.select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("  ")).alias("url"),
        F.col("o_orderpriority").alias("category"))
    return records.new_recommendations(stored, found).select("pos", urls.url_key("url").alias("key"), "category")


@query(f"""WITH old AS (SELECT lower(url) AS url, page_id, 'old' AS age FROM pages WHERE page_id % 3 = 0),
found AS (SELECT lower(url) AS url, page_id, lower(trim(url, {BLANKS_SQL})) AS key FROM pages),
once AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id, url) AS n FROM found WHERE key <> '')
SELECT url, page_id, age FROM old UNION ALL
SELECT url, page_id, 'new' FROM once WHERE n = 1 AND key NOT IN (SELECT lower(trim(url, {BLANKS_SQL})) FROM old WHERE url IS NOT NULL)""")
def recommendation_store(t: Tables) -> DataFrame:
    """The stored recommendations with the new ones added (old first, then new)."""
    old = t.pages.filter("page_id % 3 = 0").select(F.lower("url").alias("url"), "page_id", F.lit("old").alias("age"))
    found = t.pages.select(F.lower("url").alias("url"), "page_id", F.lit("new").alias("age"))
    return old.unionByName(enrich.insert_new(old, found, urls.url_key("url"), ["page_id", "url"]))


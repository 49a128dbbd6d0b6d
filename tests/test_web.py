"""URLs, robots and crawls against the standard library and a step-by-step queue."""

import random
from collections import deque
from urllib.parse import parse_qsl, urlencode, urlsplit
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from archivolt.functions import html, urls
from archivolt.operators import crawl
from archivolt.sources import records


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expr.alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def canonical(url):
    p = urlsplit(url.strip())
    host = (p.hostname or "").rstrip(".")
    try:
        port = p.port
    except ValueError:
        return None
    if not host:
        return None
    shown = f"[{host}]" if ":" in host else host
    if port is not None and {"http": 80, "https": 443}.get(p.scheme) != port:
        shown += f":{port}"
    query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
    return f"{p.scheme}://{shown}{p.path or '/'}" + (f"?{query}" if query else "")


URLS = [
    "http://example.com:80/a", "https://example.com:443", "HTTP://EXAMPLE.com./x#frag", "https://e.com/p?b=2&a=1&a=&c", "https://e.com/?q=a+b%20c",
    "https://e.com/?q=%C3%B1&x=~*", "https://e.com:8443/x?", "http://[2001:db8::1]:80/y", "https://u:p@e.com/z", "https://e.com:99999/", "https:///nohost",
    " https://e.com/a b ", "https://e.com/?a=1&&b==2", "https://e.com?x=1/2?3", "https://e.com/#only",
]


def test_canonical_urls(spark):
    assert column(spark, URLS, urls.canonical("v")) == [canonical(u) for u in URLS]


def test_query_variants_stay_apart_and_fragments_do_not(spark):
    got = column(spark, ["https://e.com/a?page=1", "https://e.com/a?page=2", "https://e.com/a?page=1#top"], urls.canonical("v"))
    assert got[0] != got[1] and got[0] == got[2]
    names = column(spark, got, urls.page_file_name("v"))
    assert names[0] != names[1] and all(n.startswith("a_") and n.endswith(".md") for n in names)


def test_rejections(spark):
    cases = {"ftp://e.com": "scheme", "https://u:p@e.com": "credentials", "https://u@e.com": "credentials", "http:///x": "host",
             "https://e.com:0x1/": "port", "https://e.com/": None, "javascript:alert(1)": "scheme"}
    assert column(spark, list(cases), urls.rejection("v")) == list(cases.values())


@pytest.mark.parametrize("ip", [
    "93.184.216.34", "127.0.0.1", "10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.9.9", "192.168.0.1", "169.254.1.1", "100.64.0.1",
    "8.8.8.8", "0.0.0.0", "198.18.0.1", "203.0.113.9", "240.0.0.1", "255.255.255.255", "::1", "fe80::1%eth0", "fc00::1", "2606:4700::1111", "2001:db8::1"])
def test_public_addresses(spark, ip):
    import ipaddress

    assert column(spark, [ip], urls.address_is_public("v")) == [ipaddress.ip_address(ip.split("%")[0]).is_global]


def test_admit_needs_every_address_public(spark):
    pages = spark.createDataFrame([("https://a.com/",), ("https://b.com/x",), ("https://c.com/",), ("ftp://a.com/",)], "url string")
    hosts = spark.createDataFrame([("a.com", "93.184.216.34"), ("b.com", "93.184.216.34"), ("b.com", "127.0.0.1")], "host string, ip string")
    got = {r["url"]: (r["reason"], r["canonical"]) for r in crawl.admit(pages, hosts).collect()}
    assert got == {"https://a.com/": (None, "https://a.com/"), "https://b.com/x": ("address", None),
                   "https://c.com/": ("unresolved", None), "ftp://a.com/": ("scheme", None)}


def test_skipped(spark):
    cases = {"https://e.com/a/issues/1": True, "https://e.com/f.PDF": True, "https://e.com/search?q=1": True, "https://e.com/searching": False,
             "https://e.com/a.pdf/more": False, "https://e.com/settings": True, "https://e.com/x?u=/blob/": True, "https://e.com/": False}
    assert column(spark, list(cases), urls.is_skipped("v")) == list(cases.values())


def test_safe_names(spark):
    cases = {"Métodos Numéricos: ¿qué?": "metodos_numericos_que", "CON": "page", "com1": "page", "___": "page", "a" * 80: "a" * 60, "«»": "page",
             "Año 2024 / Nº 3": "ano_2024_no_3"}
    assert column(spark, list(cases), urls.safe_name("v", "page")) == list(cases.values())


def test_page_content(spark):
    page = ("<html><head><style>x{}</style></head><body><nav>menu <a href='/n'>n</a></nav><p>Uno &amp; <b>dos</b><!-- c --> tres</p>"
            "<noscript>no</noscript><a href='/a'>A</a><a href='/a'>B</a><a>sin</a><script>var a='</p>'</script><footer>pie</footer></body></html>")
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(html.page_content("h").alias("c"), html.document_text("h").alias("t"))
    first, none, empty = df.collect()
    assert first["c"]["text"] == "Uno & dos tres A B sin" and first["c"]["hrefs"] == ["/n", "/a"]
    assert none["c"]["text"] == "" and none["t"] is None and empty["c"]["hrefs"] == []
    assert "menu" in first["t"] and "pie" in first["t"] and "x{}" not in first["t"] and "var a" not in first["t"]


ROBOTS = """# comment
User-agent: OtherBot
Disallow: /

User-agent: archi
User-agent: Foo
Allow: /private/ok
Disallow: /private
Disallow: /tmp?x

User-agent: *
Disallow: /all
"""


@pytest.mark.parametrize("agent", ["archivolt/1.0", "unknown/2", "otherbot"])
def test_robots_like_the_standard_library(spark, agent):
    paths = ["/", "/private/x", "/private/ok/1", "/tmp?x=1", "/tmp", "/all/1", "/alles"]
    parser = RobotFileParser()
    parser.parse(ROBOTS.splitlines())
    files = spark.createDataFrame([("https|e.com|443", 200, ROBOTS), ("https|down.com|443", 500, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    pages = spark.createDataFrame([(f"https://{h}{p}",) for h in ("e.com", "down.com", "none.com") for p in paths], "url string")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(pages, crawl.parse_robots(files, agent)).collect()}
    want = {f"https://e.com{p}": parser.can_fetch(agent, f"https://e.com{p}") for p in paths}
    want.update({f"https://{h}{p}": True for h in ("down.com", "none.com") for p in paths})
    assert got == want


def test_an_origin_with_very_many_rules(spark):
    """Rules that begin one another, repeat, and forbid or allow: the first that fits decides, and nothing gathers them."""
    draw = random.Random(2)
    path = lambda n: "/" + "".join(draw.choice("ab/") for _ in range(n))
    rules = [("https|big.example|443", i, draw.random() < 0.5, draw.choice([path(draw.randrange(0, 9)), "*" if i > 2900 else path(12)])) for i in range(3000)]
    rules += [("https|small.example|443", 5, False, "/"), ("https|small.example|443", 2, True, "/a"), ("https|empty.example|443", 1, True, "")]
    pages = [(f"https://{h}.example{path(draw.randrange(0, 14))}{draw.choice(['', '?q=a'])}",) for h in ("big",) * 300 + ("small",) * 30 + ("empty", "none") for _ in range(2)]
    df = spark.createDataFrame(pages + pages[:3] + [(None,)], "url string").withColumn("prefix", F.lit("own"))
    out = crawl.robots_allowed(df, spark.createDataFrame(rules, "origin string, pos int, allow boolean, prefix string"))
    assert out.columns == ["url", "prefix", "allowed"] and out.count() == len(pages) + 4

    def plain(url):
        host, target = url[8:].split("/", 1)
        own = sorted(r[1:] for r in rules if r[0] == f"https|{host}|443")
        return next((allow for _, allow, prefix in own if prefix == "*" or f"/{target}".startswith(prefix)), True)

    assert all(r.allowed == plain(r.url) for r in out.collect() if r.url)


# --- crawls --------------------------------------------------------------------------

def walk(start, outcome, links, max_pages, max_requests, max_depth, size):
    """The queue, one page at a time."""
    queue, waiting, seen, out, saved, asked = deque([(start, 0)]), {start}, set(), [], 0, 0
    while queue and saved < max_pages and asked < max_requests:
        url, depth = queue.popleft()
        waiting.discard(url)
        seen.add(url)
        kind = outcome.get(url, "missing")
        out.append((url, depth, kind))
        if kind == "skipped":
            continue
        asked += 1
        if kind == "missing":
            continue
        if depth < max_depth:
            for to in sorted(links.get(url, ())):
                if len(queue) < size and to not in seen and to not in waiting:
                    queue.append((to, depth + 1))
                    waiting.add(to)
        saved += kind == "saved"
    return out


@pytest.mark.parametrize("seed,limits", [
    (1, dict(max_pages=100, max_requests=1000, max_depth=3, queue=500)), (2, dict(max_pages=6, max_requests=1000, max_depth=3, queue=500)),
    (3, dict(max_pages=100, max_requests=9, max_depth=3, queue=500)), (4, dict(max_pages=100, max_requests=1000, max_depth=3, queue=4)),
    (5, dict(max_pages=8, max_requests=14, max_depth=2, queue=3)), (6, dict(max_pages=5, max_requests=50, max_depth=0, queue=3))])
def test_crawl_like_a_queue(spark, seed, limits):
    rng = random.Random(seed)
    names = [f"u{i:02d}" for i in range(40)]
    outcome = {n: rng.choice(["saved", "saved", "thin", "skipped"]) for n in names if rng.random() < 0.9}
    links = {n: {rng.choice(names) for _ in range(rng.randint(0, 7))} for n in outcome}
    starts = [n for n in names if outcome.get(n) != "skipped"][:3]
    pages = spark.createDataFrame([(n, o, o == "skipped") for n, o in outcome.items()], "url string, outcome string, skip boolean")
    edges = spark.createDataFrame([(a, b) for a, bs in links.items() for b in bs], "src string, dst string")
    seeds = spark.createDataFrame([(s, s) for s in starts], "seed string, url string")
    got = {}
    for r in crawl.traverse(seeds, pages, edges, **limits).orderBy("seed", "visit").collect():
        got.setdefault(r["seed"], []).append((r["url"], r["depth"], r["outcome"]))
    assert got == {s: walk(s, outcome, links, limits["max_pages"], limits["max_requests"], limits["max_depth"], limits["queue"]) for s in starts}


def test_irrelevant_page_still_leads_on(spark):
    body = "contenidoimportante " * 60
    pages = spark.createDataFrame([
        ("https://example.com/", "<a href='/article'>x</a><p>breve</p><a href='https://other.com/'>y</a>"),
        ("https://example.com/article", f"<main>{body}</main>")], "url string, html string")
    links = crawl.page_links(pages)
    assert {tuple(r) for r in links.collect()} == {("https://example.com/", "https://example.com/article")}
    seeds = spark.createDataFrame([("s", "https://example.com/")], "seed string, url string")
    visits = crawl.traverse(seeds, crawl.page_outcomes(pages), links, max_pages=1)
    assert [(r["url"], r["outcome"]) for r in visits.orderBy("visit").collect()] == [
        ("https://example.com/", "thin"), ("https://example.com/article", "saved")]
    done = spark.createDataFrame([("s", "https://example.com/article", "indexed")], "seed string, url string, status string")
    row = crawl.crawl_summary(visits, done).first()
    assert (row["saved"], row["requests"], row["indexed"], row["index_state"]) == (1, 2, 1, "actualizado")
    assert crawl.crawl_summary(visits).first()["index_state"] == "sin_cambios"


def test_backend_chain_and_blocks(spark):
    results = spark.createDataFrame([
        (1, "a", 1, None, None, None, "a: down"), (1, "b", 1, "T", "https://x", "s\nt", None), (2, "a", 1, None, None, None, "a: 202"),
        (2, "b", 1, None, None, None, "b: late")], "query_id int, backend string, pos int, title string, url string, snippet string, error string")
    order = spark.createDataFrame([("a", 1), ("b", 2)], "backend string, priority int")
    good = crawl.first_good_backend(results, order)
    blocks = crawl.no_results(spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), crawl.result_block(good, ["query_id"]))
    assert {r["query_id"]: r["block"] for r in blocks.collect()} == {
        1: "[1] T\n    URL: https://x\n    s t\n    Fuente: b", 2: "[Búsqueda web no disponible: b: late]", 3: "No se encontraron resultados."}


def test_new_recommendations_once_and_first(spark):
    stored = spark.createDataFrame([("https://A.com ",)], "url string")
    found = spark.createDataFrame([(1, "https://a.com", "x"), (2, "https://B.com", "y"), (3, " https://b.com", "z"), (4, "", "w")], "pos int, url string, kind string")
    assert [(r["pos"], r["kind"]) for r in records.new_recommendations(stored, found).collect()] == [(2, "y")]


def test_fetch_verdicts(spark):
    df = spark.createDataFrame([("TEXT/HTML; charset=x", 10), ("application/pdf", 60 << 20), ("image/png", 1), (None, 1)], "t string, n long")
    got = df.select(crawl.fetch_verdict("t", "n").alias("i"), crawl.fetch_verdict("t", "n", crawl=True).alias("c")).collect()
    assert [(r["i"], r["c"]) for r in got] == [(None, None), ("size", "type"), ("type", "type"), ("type", None)]

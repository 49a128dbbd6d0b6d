"""Bounded same-site traversal of a stored web, and what surrounds it.

Pages and links are tables.  Every crawl (one per ``seed``) visits pages in
the order of a queue, level by level.  One level is one Spark pass over all
crawls at once: the queue of a crawl never holds more than ``queue`` pages,
so what a level has to order per crawl is bounded, while pages and links of
any number are met by equi-joins only.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from archivolt import fixed
from archivolt.functions import html, urls
from archivolt.functions.text import useful_content
from archivolt.operators.ordered import first_seen, settled
from archivolt.session import checkpoint


def page_links(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Links between pages of one site: src, dst in canonical form, junk left out."""
    read = pages.select(F.col(url).alias("_url"), html.page_content(source).alias("c"))
    out = read.select("_url", F.explode(urls.join_links("_url", "c.hrefs")).alias("_to"))
    out = settled(out, src=urls.canonical("_url"), dst=urls.canonical("_to"), _why=urls.rejection("_to"))
    out = settled(out, _ok=urls.same_origin("src", "dst") & ~urls.is_skipped("dst"))
    return out.filter(F.col("_why").isNull() & F.col("_ok")).select("src", "dst").distinct()


def admit(urls_df: DataFrame, addresses: DataFrame, url: str = "url") -> DataFrame:
    """URL policy: canonical form and reason of rejection, addresses included.

    ``addresses`` holds host and ip.  A host without any address is
    ``unresolved``; one address that is not public rejects the host.
    """
    judged = addresses.groupBy("host").agg(
        F.min(F.coalesce(urls.address_is_public("ip"), F.lit(False))).alias("_public"))
    out = settled(urls_df, canonical=urls.canonical(url), _why=urls.rejection(url), host=F.rtrim(urls.parts(url)["host"], F.lit(".")))
    out = out.join(judged, "host", "left")
    reason = F.coalesce("_why", F.when(F.col("canonical").isNull(), "port").when(F.col("_public").isNull(), "unresolved").when(
        ~F.col("_public"), "address"))
    return out.withColumn("reason", reason).withColumn(
        "canonical", F.when(reason.isNull(), F.col("canonical"))).drop("_why", "_public")


# --- robots ----------------------------------------------------------------------

def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """Rules that bind ``agent``: origin, position, allow, prefix.

    ``files`` holds origin, status and body.  Without a good file everything
    is allowed.  A group that names the agent wins over the ``*`` group.
    """
    product = agent.split("/")[0].lower()
    lines = files.filter("status = 200").select(
        "origin", F.posexplode(F.split(F.col("body"), r"\r\n|\r|\n")).alias("pos", "_line"))
    bare = F.trim(F.substring_index("_line", "#", 1))
    key = F.lower(F.trim(F.substring_index(bare, ":", 1)))
    value = F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1))
    fields = lines.select("origin", "pos", key.alias("key"), value.alias("value")).filter(
        F.col("key").isin("user-agent", "allow", "disallow"))
    # A run of user-agent lines opens a group; one robots file is one bounded text.
    order = Window.partitionBy("origin").orderBy("pos")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = fields.withColumn("_opens", opens.cast("int")).withColumn("group", F.sum("_opens").over(order)).filter("group > 0")
    named = grouped.filter("key = 'user-agent'").select(
        "origin", "group",
        F.when(F.col("value") == "*", 1).when(
            F.contains(F.lit(product), F.lower(F.substring_index("value", "/", 1))), 2).otherwise(0).alias("_fit"))
    # The first group that names the agent counts, else the first '*' group.
    best = named.filter("_fit > 0").groupBy("origin").agg(
        F.min_by("group", F.struct(-F.col("_fit"), F.col("group"))).alias("group"))
    rules = grouped.filter("key <> 'user-agent'").join(best, ["origin", "group"], "left_semi")
    return rules.select(
        "origin", "pos",
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("prefix"))


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed``: the first rule of the origin whose prefix fits decides, of rules with one place that which forbids.

    A target is cut to every length that prefixes of its origin have, and each
    cut meets the rules as an equal key; the first of those that meet is an
    aggregate.  So rules of an origin are rows, however many, and are never
    gathered; an origin has at most as many lengths as its longest prefix.
    """
    origin = F.array_join(F.array(*[urls.origin(url)[p].cast("string") for p in ("scheme", "host", "port")]), "|")
    part = urls.parts(url)
    target = F.concat(F.when(part["path"] == "", F.lit("/")).otherwise(part["path"]),
                      F.when(part["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), part["query"])))
    # A star alone fits everything, as the empty prefix does.
    once = rules.filter(F.col("prefix").isNotNull()).groupBy(
        "origin", F.when(F.col("prefix") == "*", "").otherwise(F.col("prefix")).alias("_cut")).agg(F.min(F.struct("pos", "allow")).alias("_rule"))
    lengths = once.groupBy("origin").agg(F.collect_set(F.length("_cut")).alias("_lengths"))
    placed = pages.withColumn("origin", origin).withColumn("_target", target)
    asked = placed.select("origin", "_target").distinct().join(lengths, "origin").select(
        "origin", "_target", F.explode(F.filter("_lengths", lambda n: n <= F.length("_target"))).alias("_n"))
    cuts = asked.select("origin", "_target", F.substring("_target", F.lit(1), F.col("_n")).alias("_cut"))
    first = cuts.join(once, ["origin", "_cut"]).groupBy("origin", "_target").agg(F.min("_rule")["allow"].alias("_allow"))
    return placed.join(first, ["origin", "_target"], "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).select(*pages.columns, "allowed")


# --- traversal ---------------------------------------------------------------------



def traverse(seeds: DataFrame, pages: DataFrame, links: DataFrame, *, max_pages: int = fixed.CRAWL_PAGES,
             max_requests: int | None = None, max_depth: int = fixed.CRAWL_DEPTH, queue: int = fixed.CRAWL_QUEUE) -> DataFrame:
    """Visits of every crawl in order: seed, url, depth, place, outcome, saved_before.

    ``seeds``: seed, url.  ``pages``: url, outcome (``saved``, or why a page
    is fetched but not kept), ``skip`` for pages that are never requested.
    ``links``: src, dst.  A URL that is no page is requested and ``missing``.
    """
    max_requests = max_requests or max_pages * fixed.CRAWL_REQUESTS_PER_PAGE
    known = pages.select("url", F.col("outcome").alias("_outcome"), F.coalesce("skip", F.lit(False)).alias("_skip"))
    frontier = seeds.select(
        F.col("seed").cast("string").alias("seed"), "url", F.lit(1).cast("long").alias("place"),
        F.lit(0).cast("long").alias("requests"), F.lit(0).cast("long").alias("saved"))
    visited = None
    for depth in range(max_depth + 1):
        # Pages of this level in queue order, until a budget of the crawl ends it.
        order = Window.partitionBy("seed").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        level = frontier.join(known, "url", "left").select(
            "seed", "url", "place", "requests", "saved",
            F.when(F.col("_skip"), "skipped").otherwise(F.coalesce("_outcome", F.lit("missing"))).alias("outcome"))
        asked = F.coalesce(F.sum((F.col("outcome") != "skipped").cast("long")).over(order), F.lit(0))
        kept = F.coalesce(F.sum((F.col("outcome") == "saved").cast("long")).over(order), F.lit(0))
        level = level.withColumn("requests", F.col("requests") + asked).withColumn("saved", F.col("saved") + kept)
        level = checkpoint(level.filter(
            (F.col("requests") < max_requests) & (F.col("saved") < max_pages)).withColumn("depth", F.lit(depth)))
        visited = level if visited is None else visited.unionByName(level)
        if depth == max_depth or level.isEmpty():
            break
        frontier = _next_level(level, visited, links, queue)
    rank = Window.partitionBy("seed").orderBy("depth", "place")
    return visited.select("seed", "url", "depth", F.row_number().over(rank).alias("visit"), "outcome")


def _next_level(level: DataFrame, visited: DataFrame, links: DataFrame, queue: int) -> DataFrame:
    """Pages that the level puts in the queue, each once, in the order found."""
    reading = level.filter("outcome not in ('skipped', 'missing')")
    found = reading.select("seed", "place", F.col("url").alias("src")).join(links, "src").select("seed", "place", F.col("dst").alias("url"))
    fresh = found.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
    # The rest of the level may itself still wait in the queue; it is in
    # ``visited`` already.  A page adds at most ``queue`` links, and at most
    # ``queue`` more of its first ones can be taken by pages before it.
    first = Window.partitionBy("seed", "place").orderBy("url")
    fresh = fresh.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 2 * queue)
    waiting = level.groupBy("seed").agg(
        F.max("place").alias("_last"), F.max("requests").alias("_r"), F.max("saved").alias("_s"),
        F.max_by("outcome", "place").alias("_o"))
    asked = waiting.select(
        "seed", "_last",
        (F.col("_r") + (F.col("_o") != "skipped").cast("long")).alias("requests"),
        (F.col("_s") + (F.col("_o") == "saved").cast("long")).alias("saved"))
    rows = fresh.join(asked, "seed").select("seed", "place", "url", "_last", "requests", "saved")

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        """Replays one crawl's queue over a level of at most ``queue`` pages."""
        taken: dict[str, None] = {}
        last = int(frame["_last"].iloc[0])
        for place, part in frame.sort_values(["place", "url"]).groupby("place", sort=True):
            room = queue - (last - int(place))
            for url in part["url"]:
                if len(taken) >= room:
                    break
                taken.setdefault(url)
        n = len(taken)
        return pd.DataFrame({
            "seed": [frame["seed"].iloc[0]] * n, "url": list(taken), "place": range(1, n + 1),
            "requests": [int(frame["requests"].iloc[0])] * n, "saved": [int(frame["saved"].iloc[0])] * n})

    return rows.groupBy("seed").applyInPandas(fill, "seed string, url string, place long, requests long, saved long")


def page_outcomes(pages: DataFrame, relevant: Column | None = None, url: str = "url", source: str = "html") -> DataFrame:
    """What a crawl does with each stored page: saved, thin or irrelevant."""
    read = pages.select(urls.canonical(url).alias("url"), html.page_content(source)["text"].alias("text"))
    verdict = F.when(~useful_content("text"), "thin")
    if relevant is not None:
        verdict = verdict.when(~relevant, "irrelevant")
    return read.select("url", verdict.otherwise("saved").alias("outcome"), urls.is_skipped("url").alias("skip"))


def crawl_summary(visits: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Per seed: saved, skipped, requests, indexed, failed and the state of the index.

    ``indexed`` holds seed, url and status of the pages that were indexed.
    """
    outcome = F.col("outcome")
    out = visits.groupBy("seed").agg(
        F.count_if(outcome == "saved").alias("saved"),
        F.count_if(outcome != "saved").alias("skipped"),
        F.count_if(outcome != "skipped").alias("requests"))
    if indexed is None:
        done = visits.select("seed").distinct().select("seed", F.lit(0).cast("long").alias("indexed"), F.lit(0).cast("long").alias("failed"))
    else:
        done = indexed.groupBy("seed").agg(
            F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") != "indexed").alias("failed"))
    out = out.join(done, "seed", "left").fillna(0, ["indexed", "failed"])
    state = (
        F.when((F.col("indexed") > 0) & (F.col("failed") == 0), "actualizado")
        .when(F.col("indexed") > 0, "parcial").otherwise("sin_cambios"))
    return out.withColumn("index_state", state)


# --- fetch metadata ------------------------------------------------------------------

def fetch_verdict(content_type, length, crawl: bool = False) -> Column:
    """Why a fetched resource is refused (``type``, ``size``), or null.

    Crawled pages may leave the type out; ingested files may not.
    """
    kind = F.lower(F.col(content_type) if isinstance(content_type, str) else content_type)
    kind = F.coalesce(kind, F.lit(""))
    size = F.coalesce(F.col(length) if isinstance(length, str) else length, F.lit(0))
    if crawl:
        bare = F.trim(F.substring_index(kind, ";", 1))
        return F.when((bare != "") & ~bare.isin(fixed.CRAWL_CONTENT_TYPES), "type").when(size > fixed.CRAWL_MAX_BYTES, "size")
    known = F.lit(False)
    for allowed in fixed.INGEST_CONTENT_TYPES:
        known = known | F.contains(kind, F.lit(allowed))
    return F.when(size > fixed.INGEST_MAX_BYTES, "size").when(~known, "type")


# --- search backends -------------------------------------------------------------------

def first_good_backend(results: DataFrame, backends: DataFrame) -> DataFrame:
    """Results of the first backend, in priority order, that has any.

    ``results``: query_id, backend, pos, title, url, snippet, error.
    ``backends``: backend, priority.  A backend whose first row is an error
    counts as failed.  Queries without any good backend keep one row with the
    last error.
    """
    ranked = results.join(backends.select("backend", "priority"), "backend")
    state = ranked.groupBy("query_id", "backend", "priority").agg(F.min_by("error", "pos").alias("_error"))
    good = state.filter(F.col("_error").isNull()).groupBy("query_id").agg(F.min("priority").alias("priority"))
    chosen = ranked.join(good, ["query_id", "priority"], "left_semi")
    failed = state.join(good.select("query_id"), "query_id", "left_anti").groupBy("query_id").agg(
        F.max_by("_error", "priority").alias("error"))
    columns = ["query_id", "backend", "pos", "title", "url", "snippet", "error"]
    return chosen.select(*columns).unionByName(failed.select(
        "query_id", F.lit(None).cast("string").alias("backend"), F.lit(None).cast(results.schema["pos"].dataType).alias("pos"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("snippet"), "error"))


def widen_results(primary: DataFrame, alternative: DataFrame, enough: int = 3) -> DataFrame:
    """Valid results, joined by a second search where the first gave too few.

    Both hold query_id, pos, url; each address counts once, first results first.
    """
    valid = primary.filter(urls.is_web_url("url"))
    counted = valid.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= enough)
    more = alternative.filter(urls.is_web_url("url")).join(counted, "query_id", "left_anti")
    both = valid.withColumn("source", F.lit(0)).unionByName(more.withColumn("source", F.lit(1)))
    return first_seen(both, ["query_id", "url"], ["source", "pos"])


def result_block(results: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered text block of a query's results (title, url, snippet, backend, error)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "title", "url", "snippet", "backend", "error")))
    empty = lambda c: F.coalesce(c, F.lit(""))

    def entry(r, i):
        lines = F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), empty(r["title"]), F.lit("\n    URL: "), empty(r["url"]),
            F.lit("\n    "), F.replace(empty(r["snippet"]), F.lit("\n"), F.lit(" ")))
        return F.concat(lines, F.when(empty(r["backend"]) != "", F.concat(F.lit("\n    Fuente: "), r["backend"])).otherwise(F.lit("")))

    grouped = results.groupBy(*keys).agg(rows.alias("_rows"))
    first_error = F.get("_rows", F.lit(0))["error"]
    return grouped.select(*keys, F.when(
        first_error.isNotNull(), F.concat(F.lit("[Búsqueda web no disponible: "), first_error, F.lit("]"))).otherwise(
        F.array_join(F.transform("_rows", entry), "\n")).alias("block"))


def no_results(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of all queries; one without results says so."""
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("block", F.lit("No se encontraron resultados.")).alias("block"))


__all__ = [
    "admit", "crawl_summary", "fetch_verdict", "first_good_backend", "no_results", "page_links", "page_outcomes",
    "parse_robots", "result_block", "robots_allowed", "traverse", "widen_results",
]

"""Queries against their SQL on rows that the given tables seldom hold."""

from html import unescape
from html.entities import html5

import duckdb
import pytest
from oracle import compare, connect

from archivolt import plans
from archivolt.functions.security import redact_arguments
from archivolt.plans.web import charrefs_sql

plans.load_all()

REFERENCES = ["&&& &amp and &amperf &amp;&ampamp; &lt3 &notit; &notin; &copy2024 &Aacuteb &hellip &hellip; &unknown; &x &;",
              "&#65;&#65 &#x41;&#X41g &#0; &#x80;&#128; &#1;| &#xD800; &#x110000; &#99999999999999999999; &#xfdd0;| &#x1fffe;| &#; &#x; &# &", "", "none"]


def differences(spark, scratch, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{scratch}/{table}.parquet")
    return compare(spark, connect(scratch), plans.QUERIES[name], plans.ORACLES[name], scratch)


def test_character_references_in_sql():
    texts = REFERENCES + [f"a&{name}b &{name} {name}" for name in html5] + [f"&#{n};&#{n:#x}".replace("#0x", "#x") for n in range(1, 300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS c", [texts])
    rows = con.execute(f"SELECT c, {charrefs_sql('c')} FROM t").fetchall()
    assert [(c, u, unescape(c)) for c, u in rows if u != unescape(c)] == []


PAGES = [(i, f"https://e.com/{i}", f"<html><body><p>{text}</p>\n  <p>&nbsp;uno <a href=\"/a?x=1{text.replace('<', '')}\">dos</a> <b>&#32;</b></p> \t<i>x</i></body></html>")
         for i, text in enumerate(REFERENCES)]
PAGE = "page_id long, url string, html string"


def test_html_document_text(spark, scratch):
    assert differences(spark, scratch, "html_document_text", pages=(PAGES + [(90, "u", None), (91, "u", "")], PAGE)) == []


def test_page_text_and_links(spark, scratch):
    assert differences(spark, scratch, "page_text_and_links", pages=(PAGES + [(90, "u", None), (91, "u", "")], PAGE)) == []


def test_crawled_page_themes(spark, scratch):
    assert differences(spark, scratch, "crawled_page_themes", pages=(PAGES + [(90, "u", None), (91, "u", "")], PAGE)) == []


def test_model_comparison(spark, scratch):
    texts = ["ßtraße im Regen", "ﬁne ŉ ǰ ΐ", "ςσ ıİ ǆ", "straßen", "ab", "", None, "a\nß\tc", "𐐨ßx"]
    assert differences(spark, scratch, "model_comparison", benchmark=(list(enumerate(texts)), "item_id long, text string")) == []


def test_recommendation_store(spark, scratch):
    urls = ["a", "A ", "b", "c", "b", " B", "d", "e", "E", "f\xa0", "F", "", None, None, " ", "c", "d", "g"]
    assert differences(spark, scratch, "recommendation_store", pages=([(i, u, "") for i, u in enumerate(urls)], PAGE)) == []


def test_redacted_commands(spark, scratch):
    texts = ["token and more", "password=abc x", "My-KEY= x", "KEYS", "https://u:p@h/x y", "http://a:b@c:d@e", "bearer abc", "", None, " \n", "\xa0uno\x1cdos", "uno\x0bdos", "a=b"]
    documents = [(i, text) for i, text in enumerate(texts)]
    assert differences(spark, scratch, "redacted_commands", documents=(documents, "doc_id long, text string")) == []
    # A null argument leaves what is secret after it hidden.
    row = spark.createDataFrame([(["--token", None, "--key=x", None, "--secret", "y"],)], "a array<string>").select(redact_arguments("a").alias("o")).first()
    assert row["o"] == ["--token", "***", "--key=***", None, "--secret", "***"]
    row = spark.createDataFrame([(["run", None, "--key=x"],)], "a array<string>").select(redact_arguments("a").alias("o")).first()
    assert row["o"] == ["run", None, "--key=***"]


@pytest.mark.parametrize("files", [1, 5])
def test_streamed_tables_of_one_or_more_files(spark, scratch, files):
    """A table is a folder of files where it is large."""
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{scratch}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{scratch}/{name}.parquet/*.parquet'")
    for name in ("streaming_ingest", "streaming_event_counts", "streaming_windowed_counts"):
        assert compare(spark, con, plans.QUERIES[name], plans.ORACLES[name], scratch) == []

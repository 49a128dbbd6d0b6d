"""Chunks, chapters and word functions against plain Python."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from archivolt.functions import text as tx
from archivolt.operators import jobs


def column(spark, values, expr, schema="i int, v string"):
    rows = spark.createDataFrame(list(enumerate(values)), schema).select("i", expr.alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def label(paragraph):
    head = paragraph[:500]
    for word in ("cap[íi]tulo", "t[íi]tulo", "secci[óo]n"):
        hit = re.search(word + r"\s+(\d+|[IVX]+)", head, re.I)
        if hit:
            n = hit.group(1)
            if n and all(c in "IVX" for c in n):
                v = [{"I": 1, "V": 5, "X": 10}[c] for c in n]
                n = str(sum(x - (2 * v[i - 1] if i and x > v[i - 1] else 0) for i, x in enumerate(v)))
            return "capitulo_" + n
    return None


def expected_chunks(text):
    """The fold, written out step by step."""
    gathered, open_, chapter = [], "", None
    for p in text.split("\n\n"):
        chapter = label(p) or chapter
        if open_ and len(open_) + len(p) > 500:
            gathered.append((open_.strip(), chapter))
            open_ = open_[-100:] + p
        else:
            open_ = open_ + "\n\n" + p
    gathered.append((open_.strip(), chapter))
    out = []
    for body, ch in gathered:
        cuts = [body[i:i + 500].strip() for i in range(0, len(body), 400)] if len(body) > 750 else [body]
        out += [(c, ch) for c in cuts if len(c) > 20]
    return out


CASES = [
    "", "x" * 20, "x" * 21, "a" * 500, "a" * 501, "b" * 750, "b" * 751, "c" * 2000, " " * 900,
    "\n\n".join(["p" * 200, "q" * 200, "r" * 200]),
    "\n\n".join(["p" * 300, "q" * 190 + " ", "Capítulo IV " + "r" * 100, "s" * 600]),
    "\n\n".join(["Título 2 " + "p" * 480, "z" * 480 + " SECCIÓN X", "w" * 1300]),
    "\n\n\n\n" + "uno " * 40 + "\n\n" + "dos " * 200, "😀é" * 600,
]


def test_chunks_of_fixed_cases(spark):
    got = column(spark, CASES, tx.chunk_text("v"))
    assert [[(c["text"], c["chapter"]) for c in row] for row in got] == [expected_chunks(v) for v in CASES]


def test_chunks_of_random_texts(spark):
    rng = random.Random(3)
    pieces = ["Capítulo 3 ", "sección V", "x" * 90, "palabra ", "\n", "\n\n", " ", "CAPITULO IX\n\n", "y" * 400]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    got = column(spark, texts, tx.chunk_text("v"))
    assert [[(c["text"], c["chapter"]) for c in row] for row in got] == [expected_chunks(v) for v in texts]


def test_overlap_as_large_as_chunk_gives_nothing(spark):
    assert column(spark, ["x" * 600], tx.chunk_text("v", 100, 100)) == [[]]


@pytest.mark.parametrize("text,want", [
    ("Capítulo 7", "capitulo_7"), ("CAPÍTULO VII", "capitulo_7"), ("capítulo vii", "capitulo_vii"),
    ("título inicial", "capitulo_i"), ("x" * 500 + "Sección 3", None), ("Título IV y Capítulo 2", "capitulo_2"),
    ("capitulo 12", "capitulo_12"), ("nada", None),
])
def test_chapter_label(spark, text, want):
    assert column(spark, [text], tx.chapter_label("v")) == [want]


def test_roman_numbers(spark):
    assert column(spark, ["I", "IV", "IX", "XIV", "MCMXC", "IIX", "Q"], tx.roman_to_int("v")) == [1, 4, 9, 14, 1990, 10, None]


def test_strip_knows_every_blank(spark):
    values = ["　 a b \n", "\x1c\x85", "x", "\t\x0b "]
    assert column(spark, values, tx.strip("v")) == [v.strip() for v in values]
    assert column(spark, values, tx.words("v")) == [v.split() for v in values]


def test_clean_text_folds_once(spark):
    assert column(spark, [None, "a\x00b\n\n\n\n\nc "], tx.clean_text("v")) == ["", "a b\n\n\n\nc"]


def test_useful_content_needs_long_words(spark):
    short, good = "uno " * 50, "palabra " * 5 + "uno " * 35
    assert column(spark, [short, good, "palabra " * 39], tx.useful_content("v")) == [False, True, False]


def test_title_preview(spark):
    long = "supercalifragilistico espialidoso increible hoy"
    assert column(spark, ["hola  que tal estas", long], tx.title_preview("v")) == ["hola que tal", " ".join(long.split()[:3])[:32] + "..."]


def test_in_context(spark):
    text = "a" * 150 + "Clave" + "b" * 150
    assert column(spark, [text, "nada", "clave"], tx.in_context("v", "CLAVE")) == [
        "..." + text[50:255] + "...", "", "...clave..."]


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ab\n", max_size=200), st.integers(min_value=4, max_value=40))
def test_large_text_parts_lose_nothing(text, size):
    import pandas as pd

    parts = jobs.split_large(size).func(pd.Series([text])).iloc[0]
    assert "".join(parts) == text and all(len(p) <= size for p in parts)


def test_large_text_parts_end_at_a_late_blank_line(spark):
    text = "a" * 60 + "\n\n" + "b" * 60
    assert column(spark, [text, "short", None], jobs.split_large(100)("v")) == [["a" * 60, "\n\n" + "b" * 60], ["short"], None]
    assert column(spark, ["a" * 20 + "\n\n" + "b" * 90], jobs.split_large(100)("v"))[0][0] == "a" * 20 + "\n\n" + "b" * 78


def test_keywords_are_sorted_and_distinct(spark):
    assert column(spark, ["La Estadística de Muestreo, muestreo según él"], tx.keywords("v")) == [["estadística", "muestreo"]]


def test_reads_only_needed_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", tx.chunk_text("text").alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan

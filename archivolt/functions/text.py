"""Text columns: cleaning, chapter labels, chunking, keywords, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from archivolt import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Both ends without blanks of any script (Spark's ``trim`` knows spaces only)."""
    return F.btrim(_col(c), F.lit(fixed.BLANKS))


def words(c) -> Column:
    """The pieces of a text between runs of blanks, none of them empty."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"(?U)[\s\x1c-\x1f]+")
    )


def has_any(c, needles: list[str]) -> Column:
    """True when the column holds any of the literal needles."""
    return reduce(lambda a, b: a | b, [F.contains(_col(c), F.lit(n)) for n in needles], F.lit(False))


def first_group(c, groups: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first group with a needle in the lower-cased column."""
    low = F.lower(_col(c))
    chain = None
    for name, needles in groups:
        hit = has_any(low, needles)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(default))


def clean_text(c) -> Column:
    """NULs become spaces, one pass folds triple line ends, ends are stripped."""
    c = F.coalesce(_col(c), F.lit(""))
    return strip(F.replace(F.replace(c, F.lit("\x00"), F.lit(" ")), F.lit("\n\n\n"), F.lit("\n\n")))


def longer_than(c, n: int) -> Column:
    return F.length(_col(c)) > n


def is_indexable(c) -> Column:
    """A document is worth chunking from 50 characters on, blanks at the ends aside."""
    return F.length(strip(F.coalesce(_col(c), F.lit("")))) >= fixed.MIN_DOCUMENT_CHARS


# --- chapters ---------------------------------------------------------------

def roman_to_int(c) -> Column:
    """Value of an upper-case roman numeral; null when a letter is not roman."""
    digits = F.transform(F.filter(F.split(_col(c), ""), lambda x: x != ""), _roman_digit)
    total = F.aggregate(
        digits,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, d: F.struct(
            (acc["sum"] + d - F.when((acc["last"] > 0) & (d > acc["last"]), 2 * acc["last"]).otherwise(0)).alias("sum"),
            d.alias("last"),
        ),
        lambda acc: acc["sum"],
    )
    return total


def _roman_digit(letter: Column) -> Column:
    out = None
    for roman, value in fixed.ROMAN_VALUES.items():
        out = F.when(letter == roman, value) if out is None else out.when(letter == roman, value)
    return out


def chapter_label(c) -> Column:
    """``capitulo_N`` named in the first 500 characters, or null."""
    head = F.substring(_col(c), 1, fixed.CHAPTER_HEAD_CHARS)
    found = F.coalesce(*[
        F.nullif(F.regexp_extract(head, rf"(?iuU){word}\s+(\d+|[IVX]+)", 1), F.lit(""))
        for word in fixed.CHAPTER_WORDS
    ])
    number = F.when(found.rlike("^[IVX]"), F.coalesce(roman_to_int(found).cast("string"), found)).otherwise(found)
    # One cheap test spares most paragraphs the three searches.
    likely = head.rlike(rf"(?iuU)(?:{'|'.join(fixed.CHAPTER_WORDS)})\s")
    return F.when(likely & found.isNotNull(), F.concat(F.lit("capitulo_"), number))


def chapter_range(c, extra_word: str = "") -> Column:
    """What a question asks for: ``low, high`` of a range of chapters, else the ``label`` of a single one, else null.

    ``extra_word`` adds another range word (exam requests also say ``hasta``).
    A range that runs backwards has a ``low`` above its ``high``.
    """
    c = _col(c)
    joiner = "al|a|y" + (f"|{extra_word}" if extra_word else "")
    span = rf"(?iuU)cap[íi]tulos?\s+(\d+)\s+(?:{joiner})\s+(\d+)"
    number = lambda i: F.try_to_number(F.regexp_extract(c, span, i), F.lit("9" * 18)).cast("long")
    low, high = number(1), number(2)
    # Numbers of more than 18 digits name no chapters.
    whole = low.isNotNull() & high.isNotNull()
    single = F.nullif(F.regexp_extract(c, r"(?iuU)cap[íi]tulo\s+(\d+)", 1), F.lit(""))
    none = F.lit(None).cast("string")
    return (
        F.when(c.rlike(span), F.struct(F.when(whole, low).otherwise(1).alias("low"), F.when(whole, high).otherwise(0).alias("high"), none.alias("label")))
        .when(single.isNotNull(), F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.concat(F.lit("capitulo_"), single).alias("label")))
    )


def chapter_request(c, extra_word: str = "", first: int = fixed.NAMED_CHAPTERS) -> Column:
    """The ``first`` chapters that a question asks for, in order, null where it names none.

    A range that runs backwards asks for nothing and gives an empty list.
    Searches look at the first few chapters only (3 in a chat, 5 for an exam);
    :func:`chapter_range` holds a whole range, however long, in two numbers.
    """
    asked = chapter_range(c, extra_word)
    label = lambda n: F.concat(F.lit("capitulo_"), n.cast("string"))
    low, high = asked["low"], asked["high"]
    return (
        F.when(asked["label"].isNotNull(), F.array(asked["label"]))
        .when(low <= high, F.transform(F.sequence(low, F.least(high, low + (first - 1))), label))
        .when(low > high, F.array().cast("array<string>"))
    )


# --- chunks -----------------------------------------------------------------

_CHUNK = "array<struct<text:string,chapter:string>>"
_RUN = 128


def chunk_text(c, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Overlapping, chapter-aware chunks of a text: ``array<struct<text,chapter>>``.

    Paragraphs (split at blank lines) gather until the next one would pass
    ``size``; the next chunk then starts with the last ``overlap`` characters.
    A chunk over 1.5 times ``size`` is cut in windows.  The whole fold is one
    expression, so no text leaves the JVM.
    """
    if size <= overlap:
        return F.array().cast(_CHUNK)
    def cut(label):
        return F.transform(F.split(_col(c), r"\n\n"), lambda p: F.struct(
            p.alias("text"), F.length(p).alias("n"), label(p).alias("chapter")))

    # Most texts name no chapter at all, which one look at the whole text tells.
    low = F.lower(_col(c))
    may_name = has_any(low, fixed.CHAPTER_STEMS)
    paragraphs = F.when(may_name, cut(chapter_label)).otherwise(cut(lambda p: F.lit(None).cast("string")))
    # Spark copies what a fold carries at every step.  So paragraphs are folded in
    # runs: a step carries the chunks of its run, and only a run's end the rest.
    def step(acc, p):
        chapter = F.coalesce(p["chapter"], acc["chapter"])
        full = (acc["open"] != "") & (F.length(acc["open"]) + p["n"] > size)
        closed = F.array(F.struct(strip(acc["open"]).alias("text"), chapter.alias("chapter")))
        return F.struct(
            F.when(full, F.concat(acc["done"], closed)).otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(F.right(acc["open"], F.lit(overlap)), p["text"]))
            .otherwise(F.concat(acc["open"], F.lit("\n\n"), p["text"])).alias("open"),
            chapter.alias("chapter"),
        )

    def once(value, use):
        """``use`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def run(ps):
        def fold(acc, i):
            start = F.struct(F.array().cast(_CHUNK).alias("done"), acc["open"].alias("open"), acc["chapter"].alias("chapter"))
            return once(F.aggregate(F.slice(ps, i * _RUN + 1, F.lit(_RUN)), start, step), lambda r: F.struct(
                F.concat(acc["runs"], F.array(r["done"])).alias("runs"), r["open"].alias("open"), r["chapter"].alias("chapter")))
        return fold

    def close(acc):
        # An empty rest falls to the minimum length below.
        last = F.array(F.struct(strip(acc["open"]).alias("text"), acc["chapter"].alias("chapter")))
        return F.concat(F.flatten(acc["runs"]), last)

    begin = F.struct(
        F.array().cast(f"array<{_CHUNK}>").alias("runs"), F.lit("").alias("open"), F.lit(None).cast("string").alias("chapter"))
    gathered = F.when(_col(c).isNotNull(), once(paragraphs, lambda ps: F.aggregate(
        F.sequence(F.lit(0), ((F.size(ps) - 1) / _RUN).cast("int")), begin, run(ps), close)))
    windows = F.flatten(F.transform(gathered, lambda k: F.when(
        F.length(k["text"]) > int(size * 1.5), _windows(k, size, size - overlap)).otherwise(F.array(k))))
    return F.filter(windows, lambda k: F.length(k["text"]) > fixed.MIN_CHUNK_CHARS)


def _windows(chunk: Column, size: int, step: int) -> Column:
    """Windows of ``size`` every ``step`` characters, stripped, in one pass.

    Each match moves ``step`` characters on while the look-ahead captures the
    whole window, so a text of any length is walked once.
    """
    cuts = F.regexp_extract_all(chunk["text"], F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    return F.transform(cuts, lambda w: F.struct(strip(w).alias("text"), chunk["chapter"].alias("chapter")))


# --- words and keywords ------------------------------------------------------

def useful_content(c) -> Column:
    """At least 40 words, at least 5 of them longer than 5 characters."""
    found = words(c)
    long_ones = F.filter(found, lambda w: F.length(w) > fixed.LONG_WORD_CHARS)
    return (F.size(found) >= fixed.MIN_PAGE_WORDS) & (F.size(long_ones) >= fixed.MIN_LONG_WORDS)


def keywords(c) -> Column:
    """Distinct lower-case words of 3+ letters, stop words left out, sorted."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)\b[a-záéíóúñ]{3,}\b"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return F.array_sort(F.array_except(found, stop))


def query_words(c, n: int = 5, min_chars: int = 4) -> Column:
    """The first ``n`` words longer than ``min_chars``, joined by spaces."""
    return F.array_join(F.slice(F.filter(words(c), lambda w: F.length(w) > min_chars), 1, n), " ")


def in_context(c, term, around: int = 100) -> Column:
    """First hit of ``term``, case aside, with its surroundings; '' when absent."""
    c = _col(c)
    term = term if isinstance(term, Column) else F.lit(term)
    at = F.instr(F.lower(c), F.lower(term))
    first = F.greatest(F.lit(1), at - around)
    last = F.least(F.length(c), at + F.length(term) + around - 1)
    return F.when(at == 0, F.lit("")).otherwise(
        F.concat(F.lit("..."), F.substring(c, first, last - first + 1), F.lit("...")))


def title_preview(c) -> Column:
    """A chat title from its first message: three words, cut at 35 characters."""
    preview = F.array_join(F.slice(words(c), 1, 3), " ")
    return F.when(F.length(preview) > 35, F.concat(F.substring(preview, 1, 32), F.lit("..."))).otherwise(preview)

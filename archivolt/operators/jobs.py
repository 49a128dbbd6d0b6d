"""Whole jobs around a model: digests, notes, memory, themes, exams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from archivolt import fixed
from archivolt.functions import dialogue as dlg
from archivolt.functions import exam as ex
from archivolt.functions.text import clean_text, strip
from archivolt.functions.urls import safe_name, to_ascii
from archivolt.operators.enrich import ask, enrich, enrich_by, with_cache
from archivolt.operators.ordered import joined_text, running
from archivolt.session import checkpoint
from archivolt.sources.records import accepted_notes

Client = Callable[[], Callable[[list[str]], list[str]]]


# --- large texts ---------------------------------------------------------------

def split_large(max_chars: int = fixed.LARGE_TEXT_CHARS):
    """Column function: a text in parts of at most ``max_chars`` characters.

    A part ends at its last blank line when that lies beyond its middle.
    Where a part starts depends on all before it, hence the Arrow batch.
    """
    def cut(text: str | None) -> list[str] | None:
        if text is None:
            return None
        parts, at = [], 0
        while len(text) - at > max_chars:
            end = at + max_chars
            gap = text.rfind("\n\n", at, end)
            end = gap if gap > at + max_chars // 2 else end
            parts.append(text[at:end])
            at = end
        return [*parts, text[at:]] if at < len(text) or not parts else parts

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return split


def text_parts(documents: DataFrame, key: str, text: str = "text", max_chars: int = fixed.LARGE_TEXT_CHARS) -> DataFrame:
    """Documents as parts: key, part, parts, part_text."""
    rest = [c for c in documents.columns if c != text]
    big = F.length(text) > max_chars
    # Short texts go through Python as nulls.
    cut = documents.withColumn("_large", split_large(max_chars)(F.when(big, F.col(text))))
    cut = cut.withColumn("_parts", F.when(big, F.col("_large")).otherwise(F.array(F.col(text))))
    return cut.select(*rest, F.size("_parts").alias("parts"), F.posexplode("_parts").alias("part", "part_text")).select(
        *rest, "part", "parts", "part_text")


def digest(documents: DataFrame, client: Client, key: str = "doc_id", text: str = "text", source: str = "source",
           engine: str = "modelo", max_chars: int = fixed.LARGE_TEXT_CHARS, partitions: int | None = None) -> DataFrame:
    """Digest of every document of 100 characters or more: key, parts, failed, digest, error.

    Parts of a large text are spread over the tasks and put together in order
    below a heading; a part that failed leaves a line that says so.  A short
    text has no heading, and fails as a whole.
    """
    fit = documents.filter(F.length(strip(F.coalesce(F.col(text), F.lit("")))) >= 100)
    parts = text_parts(fit.select(key, F.col(source).alias("_source"), text), key, text, max_chars)
    answered = enrich(parts, client, "part_text", "_answer", "_error", partitions=partitions).drop("part_text")
    warning = F.format_string(f"\n\n{fixed.DIGEST_PART_FAILED} %d: %s\n", F.col("part") + 1, "_error")
    line = F.when(F.col("_error").isNull(), F.coalesce("_answer", F.lit(""))).otherwise(warning)
    rows = F.array_sort(F.collect_list(F.struct("part", line.alias("t"))))
    whole = answered.groupBy(key).agg(
        F.first("_source").alias("_source"), F.count(F.lit(1)).alias("parts"),
        F.count_if(F.col("_error").isNotNull()).alias("failed"), F.min("_error").alias("_error"), rows.alias("_rows"))
    body = F.array_join(F.filter(F.transform("_rows", lambda r: r["t"]), lambda t: t != ""), "\n\n---\n\n")
    heading = F.concat(F.lit("# "), F.col(key).cast("string"), F.lit("\n\n> Fuente: "), "_source",
                       F.lit(f"\n> Procesado con {engine}\n\n"))
    lost = (F.col("parts") == 1) & (F.col("failed") == 1)
    return whole.select(
        key, "parts", "failed",
        F.when(lost, F.lit(None)).when(F.col("parts") > 1, F.concat(heading, body)).otherwise(body).alias("digest"),
        F.when(lost, F.concat(F.lit(f"{fixed.DIGEST_FAILED}: "), "_error")).alias("error"))


# --- classification --------------------------------------------------------------

def theme_relevance(pages: DataFrame, client: Client, theme: str, text: str = "text") -> DataFrame:
    """Adds ``relevant``: the answer on the first 2000 characters starts with SI.

    A failed call means not relevant.
    """
    prompt = F.concat(F.lit(f"Tema: {theme}\n"), F.substring(text, 1, fixed.THEME_CHARS))
    asked = ask(pages.withColumn("_prompt", prompt), client, "_prompt", "_answer", "_error").drop("_prompt")
    yes = F.upper(strip(to_ascii("_answer"))).startswith("SI")
    return asked.withColumn("relevant", F.coalesce(yes & F.col("_error").isNull(), F.lit(False))).drop("_answer", "_error")


def subfolder(pages: DataFrame, client: Client, theme: str, text: str = "text") -> DataFrame:
    """Adds ``subfolder``, a safe name from the answer; ``general`` when the call fails."""
    prompt = F.concat(F.lit(f"Carpeta para: {theme}\n"), F.substring(text, 1, fixed.THEME_CHARS))
    asked = ask(pages.withColumn("_prompt", prompt), client, "_prompt", "_answer", "_error").drop("_prompt")
    named = safe_name(F.coalesce("_answer", F.lit("")), "general", 50)
    return asked.withColumn("subfolder", F.when(F.col("_error").isNull(), named).otherwise(F.lit("general"))).drop("_answer", "_error")


def route(questions: DataFrame, client: Client, text: str = "text") -> DataFrame:
    """Adds ``route``, one of the five labels; the default when the call fails."""
    asked = ask(questions, client, text, "_answer", "_error")
    return asked.withColumn("route", F.when(F.col("_error").isNull(), dlg.route_label("_answer")).otherwise(
        F.lit(fixed.DEFAULT_ROUTE))).drop("_answer", "_error")


def compare_models(prompts: DataFrame, clients: dict[str, Client], key: str, prompt: str) -> DataFrame:
    """Answers of several models side by side, a column per model, for each prompt.

    Every prompt becomes a row per model, so all models are asked in one pass,
    each for a batch of its own; a row's number and prompt are all that travels.
    """
    numbered = checkpoint(prompts.select(key, prompt).withColumn("_row", F.monotonically_increasing_id()))
    asked = numbered.filter(F.col(prompt).isNotNull()).select("_row", prompt, F.explode(F.array(*map(F.lit, clients))).alias("_model"))
    answers = checkpoint(enrich_by(asked, clients, "_model", prompt, keep_prompt=False))
    wide = answers.groupBy("_row").pivot("_model", list(clients)).agg(F.first("answer").alias("answer"), F.first("error").alias("error"))
    named = wide.select("_row", *[F.col(c).alias(n) for m in clients for c, n in ((f"{m}_answer", m), (f"{m}_error", f"{m}_error"))])
    return numbered.join(named, "_row", "left").drop("_row")


# --- memory and notes ----------------------------------------------------------------

def memory_notes(pairs: DataFrame, client: Client, ts: Column | str = "") -> DataFrame:
    """Notes found in turn pairs, with the status they would be stored under."""
    whole = pairs.filter((F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))
    prompt = F.concat(F.col("question"), F.lit("\n---\n"), F.substring("answer", 1, fixed.MEMORY_ANSWER_CHARS))
    asked = ask(whole.withColumn("_prompt", prompt), client, "_prompt", "_answer", "_error")
    noted = asked.withColumn("_note", dlg.memory_note("_answer")).filter(F.col("_note").isNotNull())
    rest = [c for c in pairs.columns if c not in ("question", "answer")]
    stamp = ts if isinstance(ts, Column) else F.lit(ts)
    return accepted_notes(noted.select(*rest, stamp.alias("ts"), "_note.*"))


def memory_counts(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count_if(F.col("status") == "saved").alias("saved"), F.count_if(F.col("status") != "saved").alias("errors"))


def study_notes(documents: DataFrame, cache: DataFrame, client: Client, key: str = "key",
                fingerprint: str = "fingerprint", text: str = "text") -> DataFrame:
    """Study notes per document from the cache or the model: key, notes, error, origin.

    Texts are cleaned, gated at 50 characters and cut at 5000 for the prompt.
    """
    cleaned = clean_text(text)
    prompt = F.when(F.length(cleaned) >= fixed.MIN_DOCUMENT_CHARS, F.substring(cleaned, 1, fixed.NOTES_CHARS))
    # Cut before the join, so that no more than the prompt is shuffled.
    return with_cache(documents.select(key, fingerprint, prompt.alias("_prompt")), cache, client, "_prompt",
                      key=key, fingerprint=fingerprint)


# --- exams ---------------------------------------------------------------------------

def exam_prompts(requests: DataFrame, contexts: DataFrame, key: str = "request_id", text: str = "text") -> DataFrame:
    """Prompt parts of every request: mix per kind, material, context cut or left out."""
    asked = requests.select(key, text, ex.parse_request(text).alias("r")).join(contexts, key, "left")
    context = F.coalesce("context", F.lit(""))
    mix = ex.question_mix(F.col("r.total"), F.col("r.concept"), F.col("r.essay"), F.col("r.truth"))
    usable = F.length(context) >= fixed.EXAM_MIN_CONTEXT
    return asked.select(
        key, F.coalesce("r.material", F.lower(text)).alias("material"), "r.chapters", F.col("r.total").alias("total"),
        mix.alias("mix"), usable.alias("from_material"),
        F.when(usable, F.substring(context, 1, fixed.EXAM_CONTEXT_CHARS)).otherwise(F.lit("No disponible.")).alias("context"))


def exam_questions(prompts: DataFrame, client: Client, prompt: str, key: str = "request_id") -> DataFrame:
    """Questions of the generated exams, one row each; a failed call keeps its error."""
    asked = ask(prompts, client, prompt, "_answer", "error")
    # One pass, so that the model is asked once: a failed row has no questions.
    parsed = F.when(F.col("error").isNull(), ex.parse_questions("_answer"))
    return asked.select(key, "error", F.posexplode_outer(parsed).alias("place", "q")).select(key, "place", "q.*", "error")


def grade_answers(answers: DataFrame, client: Client, prompt: str, max_points: str = "points") -> DataFrame:
    """Adds grade struct columns to student answers; a failed call scores 0."""
    asked = ask(answers.withColumnRenamed(max_points, "_max"), client, prompt, "_answer", "_error")
    rest = [c for c in answers.columns if c != max_points]
    return asked.select(*rest, ex.parse_grade("_answer", "_max", "_error").alias("g")).select(*rest, "g.*")


def exam_report(grades: DataFrame, by: list[str]) -> DataFrame:
    """Points, percentage, mark, right and wrong answers and advice per exam."""
    out = grades.groupBy(*by).agg(
        F.sum("points").alias("points"), F.sum("max_points").alias("max_points"),
        F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect"))
    percent = F.when(F.col("max_points") > 0, F.col("points") / F.col("max_points") * 100).otherwise(F.lit(0.0))
    band = None
    for floor, text in fixed.EXAM_BANDS[:-1]:
        band = F.when(percent >= floor, text) if band is None else band.when(percent >= floor, text)
    return out.select(
        *by, "points", "max_points", "correct", "incorrect", F.round(percent, 6).alias("percent"),
        F.bround(percent / 10, 1).alias("mark"), band.otherwise(fixed.EXAM_BANDS[-1][1]).alias("advice"))


def error_analysis(grades: DataFrame) -> DataFrame:
    """Wrong answers with statement and expected answer cut for the report."""
    return grades.filter(~F.col("correct")).select(
        *[c for c in grades.columns if c not in ("statement", "answer")],
        F.concat(F.substring("statement", 1, 120), F.lit("...")).alias("statement"),
        F.substring("answer", 1, 200).alias("answer"))


def corpus_sections(documents: DataFrame, group: str, order: str, name: str, text: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """Documents of a group joined under headings, in parts of at most ``part_bytes``: group, part, text, bytes.

    ``order`` is a whole number, unique in its group; rows without group or
    order are in no part.  Bytes are summed over the documents before each one,
    span by span, and a long text is divided among parts, so neither a group nor
    a document of any size is one row.  Parts in order are the whole.
    """
    unit, piece = part_bytes // 2, max(1, part_bytes // 8)  # a character has four bytes at most
    section = F.concat(F.lit("\n\n===== "), name, F.lit(" =====\n"), text)
    rows = documents.filter((F.coalesce(F.col(text), F.lit("")) != "") & F.col(group).isNotNull() & F.col(order).isNotNull()).select(
        group, F.col(order).cast("long").alias(order), section.alias("_section"))
    before = running(rows.select(group, order, F.octet_length("_section").cast("long").alias("_bytes")), [group], order, "_bytes", "_before")
    pieces = rows.join(before.select(group, order, "_before"), [group, order]).select(
        group, order, "_before", "_section", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((char_length(_section) - 1) div {piece} AS INT)"))).alias("_i"))
    at = F.col("_before") + F.octet_length(F.substring("_section", F.lit(1), F.col("_i") * piece))
    cut = pieces.select(group, order, "_i", F.expr(f"substring(_section, _i * {piece} + 1, {piece})").alias("_piece"), at.alias("_at"))
    return joined_text(cut.withColumn("part", F.expr(f"_at div {unit}")), [group, "part"], [order, "_i"], "_piece", "", "text").withColumn(
        "bytes", F.octet_length("text").cast("long"))

"""Queries on exams: requests, mixes, questions, grades, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions import exam as ex
from archivolt.operators import enrich as en, jobs
from archivolt.plans import Tables, query

REQUESTS = [
    "Hazme 10 preguntas de muestreo, capítulo 3",
    "muestreo aleatorio simple, 5 conceptuales y 3 desarrollo",
    "quiero preguntas sobre Derecho capítulos 2 hasta 4",
    "4 preguntas de verdadero o falso, 2 conceptuales",
    "20 preguntas aleatorias, finanzas",
    "Historia del arte",
]


def _request(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in REQUESTS]), (F.col(key) % len(REQUESTS) + 1).cast("int"))


@query("""SELECT doc_id, ['capitulo_3', '', 'capitulo_2,capitulo_3,capitulo_4', '', '', ''][(doc_id % 6 + 1)::INT] AS chapters,
  [NULL, 5, NULL, 2, NULL, NULL][(doc_id % 6 + 1)::INT] AS concept, [NULL, 3, NULL, NULL, NULL, NULL][(doc_id % 6 + 1)::INT] AS essay,
  [NULL, NULL, NULL, 4, NULL, NULL][(doc_id % 6 + 1)::INT] AS truth, [10, 8, 10, 6, 20, 10][(doc_id % 6 + 1)::INT] AS total,
  ['muestreo', 'muestreo aleatorio simple', 'derecho capítulos 2 hasta 4', 'de verdadero o falso', 'finanzas', 'historia del arte'][(doc_id % 6 + 1)::INT] AS material FROM documents""")
def exam_requests(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ex.parse_request(_request("doc_id")).alias("r")).select(
        "doc_id", F.array_join("r.chapters", ",").alias("chapters"), "r.concept", "r.essay", "r.truth", "r.total", "r.material")


@query("""WITH n AS (SELECT doc_id, (n_chars % 60)::INT AS total FROM documents)
SELECT doc_id, total, round_even(total * 0.4, 0)::INT AS concept, round_even(total * 0.4, 0)::INT AS essay, (total - 2 * round_even(total * 0.4, 0)::INT)::INT AS truth FROM n""")
def exam_mix(t: Tables) -> DataFrame:
    total = (F.col("n_chars") % 60).cast("int")
    return t.documents.select("doc_id", total.alias("total"), ex.question_mix(total).alias("m")).select("doc_id", "total", "m.*")


# A generated exam per document, in one of four shapes by its number.
def _exam_text() -> Column:
    n = F.col("doc_id").cast("string")
    strict = F.concat(
        F.lit("PREGUNTA 1: [CONCEPTUAL]\nENUNCIADO: ¿Qué es "), n, F.lit("?\nRESPUESTA CORRECTA: Es "), n,
        F.lit(".\nSegunda línea.\nCRITERIOS: claro\nPUNTAJE: 15\n---\nPregunta 2: [v/f]\nENUNCIADO: Verdad "), n,
        F.lit("\nRESPUESTA: F\nJUSTIFICACION: porque no\nPUNTAJE: 5\n---\nPREGUNTA 3: [DESARROLLO]\nRESPUESTA: sin enunciado\n"))
    # Without dashes the text is one question, whatever headings it holds.
    numbered = F.concat(F.lit("PREGUNTA 1: [DESARROLLO]\nDefina "), n, F.lit("\nPUNTAJE: 7\nPREGUNTA 2:\nENUNCIADO: Otra "), n, F.lit("\nPUNTAJE: x"))
    loose = F.concat(F.lit("Pregunta 4\nUna "), n, F.lit("\nPregunta 5 dos"))
    k = F.col("doc_id") % 4
    return F.when(k == 0, strict).when(k == 1, numbered).when(k == 2, loose).otherwise(F.lit(""))


QUESTIONS_SQL = f"""q AS (
  SELECT doc_id, 1 AS number, 'conceptual' AS kind, '¿Qué es ' || doc_id || '?' AS statement, 'Es ' || doc_id || '.' || chr(10) || 'Segunda línea.' AS answer, NULL AS justification, 'claro' AS criteria, 15 AS points FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 2, 'vf', 'Verdad ' || doc_id, 'F', 'porque no', '{fixed.EXAM_DEFAULT_CRITERIA}', 5 FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 1, 'desarrollo', 'Otra ' || doc_id, '{fixed.EXAM_NO_ANSWER}', NULL, '{fixed.EXAM_DEFAULT_CRITERIA}', 7 FROM documents WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 4, 'general', 'Una ' || doc_id, '{fixed.EXAM_NO_ANSWER}', NULL, '{fixed.EXAM_DEFAULT_CRITERIA}', 10 FROM documents WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, 1, 'general', '{fixed.EXAM_UNPARSED}', 'N/A', NULL, 'N/A', 0 FROM documents WHERE doc_id % 4 = 3)"""


@query(f"WITH {QUESTIONS_SQL} SELECT * FROM q")
def exam_questions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(ex.parse_questions(_exam_text())).alias("q")).select("doc_id", "q.*")


@query(f"""WITH p AS (SELECT doc_id, CASE WHEN length(text) < 200 THEN 0 ELSE least(length(text), 18000) END AS n FROM documents)
SELECT doc_id, CASE WHEN n % 5 = 0 AND n > 0 THEN NULL ELSE 1 END AS number, CASE WHEN n % 5 = 0 AND n > 0 THEN NULL ELSE 'Sobre ' || n END AS statement,
  CASE WHEN n % 5 = 0 AND n > 0 THEN 'ValueError: bad prompt' END AS error FROM p""")
def generated_exams(t: Tables) -> DataFrame:
    """Context of the request, cut or left out, through the model to questions."""
    asked = t.documents.select(F.col("doc_id").alias("request_id"), _request("doc_id").alias("text"))
    contexts = t.documents.select(F.col("doc_id").alias("request_id"), F.col("text").alias("context"))
    prompts = jobs.exam_prompts(asked, contexts).withColumn("prompt", F.when(F.col("from_material"), F.col("context")).otherwise(F.lit("")))

    def model(prompt: str) -> str:
        if prompt and len(prompt) % 5 == 0:
            raise ValueError("bad prompt")
        return f"PREGUNTA 1:\nENUNCIADO: Sobre {len(prompt)}\nPUNTAJE: 3"

    made = jobs.exam_questions(prompts.select("request_id", "prompt"), en.per_row(model), "prompt")
    return made.select(F.col("request_id").alias("doc_id"), "number", "statement", "error")


# --- grades: the model gives points by the length of the student's text -----------------

GRADES_SQL = """g AS (SELECT doc_id, source AS exam, CASE WHEN length(text) % 17 = 0 THEN 0 ELSE least(length(text) % 14, 10) END::BIGINT AS points, 10::BIGINT AS max_points,
  CASE WHEN length(text) % 17 = 0 THEN 'Error: ValueError: bad prompt' WHEN length(text) % 2 = 0 THEN 'Bien' || chr(10) || 'hecho ' || length(text) ELSE 'Sin feedback.' END AS feedback FROM documents)"""


def _grades(t: Tables) -> DataFrame:
    def model(prompt: str) -> str:
        n = len(prompt)
        if n % 17 == 0:
            raise ValueError("bad prompt")
        return f"Puntaje: {n % 14}" + (f"\nFEEDBACK: Bien\nhecho {n}\n" if n % 2 == 0 else "")

    answers = t.spread("documents").select(
        "doc_id", F.col("source").alias("exam"), F.lit(10).alias("points"), "text",
        F.concat(F.lit("¿Qué es "), F.repeat(F.lit("x"), F.lit(130)), F.col("lang"), F.lit("?")).alias("statement"),
        F.repeat(F.lit("y"), F.lit(250)).alias("answer"))
    return jobs.grade_answers(answers, en.per_row(model), "text")


@query(f"WITH {GRADES_SQL} SELECT *, points >= max_points * 0.7 AS correct FROM g")
def exam_grades(t: Tables) -> DataFrame:
    return _grades(t).select("doc_id", "exam", "points", "max_points", "feedback", "correct")


@query(f"""WITH {GRADES_SQL}, s AS (SELECT exam, sum(points)::BIGINT AS points, sum(max_points)::BIGINT AS max_points, count(*) FILTER (points >= 7) AS correct, count(*) FILTER (points < 7) AS incorrect FROM g GROUP BY exam)
SELECT *, round(points / max_points * 100, 6) AS percent, round_even(points / max_points * 100 / 10, 1) AS mark,
  CASE WHEN points / max_points * 100 >= 80 THEN '{fixed.EXAM_BANDS[0][1]}' WHEN points / max_points * 100 >= 60 THEN '{fixed.EXAM_BANDS[1][1]}' ELSE '{fixed.EXAM_BANDS[2][1]}' END AS advice FROM s""")
def exam_report(t: Tables) -> DataFrame:
    return jobs.exam_report(_grades(t), ["exam"])


@query(f"""WITH {GRADES_SQL} SELECT doc_id, '¿Qué es ' || repeat('x', 112) || '...' AS statement, repeat('y', 200) AS answer, feedback FROM g WHERE points < 7""")
def exam_error_analysis(t: Tables) -> DataFrame:
    return jobs.error_analysis(_grades(t)).select("doc_id", "statement", "answer", "feedback")

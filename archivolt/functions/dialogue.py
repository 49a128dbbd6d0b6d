"""Columns on questions, answers, rules and routing labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions.text import _col, first_group, has_any, strip, title_preview


def question_topic(c) -> Column:
    return first_group(c, fixed.QUESTION_TOPICS, fixed.OTHER_TOPIC)


def diary_category(c, project_words: list[str] | None = None) -> Column:
    """Diary category by keyword; ``project_words`` adds names of own projects."""
    groups = [
        (name, needles + (project_words or []) if name == "proyecto" else needles)
        for name, needles in fixed.DIARY_CATEGORIES
    ]
    return first_group(c, groups, fixed.DIARY_DEFAULT)


def is_content_rule(c) -> Column:
    low = F.lower(_col(c))
    asks = F.contains(low, F.lit(fixed.RULE_ASK)) & has_any(low, fixed.RULE_ANSWER)
    always = low.startswith(fixed.RULE_ALWAYS[0]) | low.startswith(fixed.RULE_ALWAYS[1])
    return asks | always


def is_format_rule(c) -> Column:
    return has_any(F.lower(_col(c)), fixed.RULE_FORMAT)


def parse_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """Adds ``topics`` with ``topic_answer``, and ``any_answer``, to a table of rules.

    ``topics`` is empty and ``any_answer`` null where a rule has no such part.
    """
    plain, accented = fixed.RULE_ANSWER
    low, pieces = F.col("_low"), F.col("_pieces")
    asks = F.contains(low, F.lit(fixed.RULE_ASK)) & has_any(low, fixed.RULE_ANSWER) & (F.size(pieces) == 2)
    rest = low
    for phrase in fixed.RULE_ALWAYS:
        rest = F.replace(rest, F.lit(phrase), F.lit(""))
    always = low.startswith(fixed.RULE_ALWAYS[0]) | low.startswith(fixed.RULE_ALWAYS[1])
    answer = strip(F.btrim(F.btrim(strip(F.get(pieces, F.lit(1))), F.lit('"')), F.lit("'")))
    # Step by step, so that no expression is written out more than once.
    return (
        rules.withColumn("_low", F.lower(rule))
        .withColumn("_pieces", F.when(F.contains(low, F.lit(plain)), F.split(low, plain)).otherwise(F.split(low, accented)))
        .withColumn("_topic", F.when(asks, strip(F.replace(F.get(pieces, F.lit(0)), F.lit(fixed.RULE_ASK), F.lit("")))))
        .withColumn("topics", F.filter(F.split(F.coalesce("_topic", F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
        .withColumn("topic_answer", F.when(asks, answer))
        .withColumn("any_answer", F.when(always, strip(rest)))
        .drop("_low", "_pieces", "_topic")
    )


def route_label(c) -> Column:
    """Label in a model's answer: exact, else its first whole word, else the default."""
    low = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    found = F.regexp_extract(low, rf"(?iuU)\b({'|'.join(fixed.ROUTE_LABELS)})\b", 1)
    return F.when(low.isin(fixed.ROUTE_LABELS), low).when(found != "", F.lower(found)).otherwise(F.lit(fixed.DEFAULT_ROUTE))


def memory_note(c) -> Column:
    """Category, summary and reason in a model's answer; null when it has none."""
    c = F.coalesce(_col(c), F.lit(""))
    field = lambda label: strip(F.substring_index(
        F.when(F.instr(c, label) > 0, F.substring(c, F.instr(c, label) + len(label), F.length(c)))
        .otherwise(F.substring(c, len(label), F.length(c))), "\n", 1))
    category, summary, reason = field("CATEGORIA:"), field("RESUMEN:"), field("RAZON:")
    usable = (
        ~F.contains(F.substring(F.upper(c), 1, 30), F.lit("NADA"))
        & F.contains(c, F.lit("CATEGORIA:")) & F.contains(c, F.lit("RESUMEN:"))
        & (category != "") & (summary != "")
    )
    return F.when(usable, F.struct(
        category.alias("category"), summary.alias("summary"),
        F.when(reason == "", F.lit(fixed.MEMORY_DEFAULT_REASON)).otherwise(reason).alias("reason"),
    ))


def chat_title(name, first_message, default: str = "Nuevo chat") -> Column:
    """A chat keeps its name unless that is still the default one."""
    return F.when(_col(name) == default, title_preview(first_message)).otherwise(_col(name))


__all__ = [
    "chat_title", "diary_category", "is_content_rule", "is_format_rule", "memory_note",
    "parse_rules", "question_topic", "route_label",
]

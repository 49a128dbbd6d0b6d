"""Conversations as tables: turn pairs, history, rules, topics, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions.dialogue import parse_rules, question_topic
from archivolt.operators.needles import joined_needles
from archivolt.operators.ordered import following, joined_text, newest, positions
from archivolt.session import checkpoint

def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User turns answered by the very next turn: conv, turn, question, answer."""
    ahead = following(turns.select(conv, turn, "role", "text"), [conv], turn, ["role", "text"])
    return ahead.filter("role = 'user' and next_role = 'assistant'").select(
        conv, turn, F.col("text").alias("question"), F.col("next_text").alias("answer"))


def history(pairs: DataFrame, n: int = fixed.HISTORY_PAIRS, conv: str = "conv_id", turn: str = "turn",
            cut: int | None = None) -> DataFrame:
    """The last ``n`` pairs of each conversation, oldest first as ``position``."""
    last = newest(pairs, [conv], turn, n)
    depth = F.count(F.lit(1)).over(_conv(conv))
    answer = F.col("answer") if cut is None else F.substring("answer", 1, cut)
    return last.withColumn("position", (depth - F.col("age") + 1).cast("int")).select(
        conv, turn, "position", "question", answer.alias("answer"))


def _conv(conv):
    from pyspark.sql import Window

    return Window.partitionBy(conv)


def history_prompt(pairs: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The history block of a prompt, answers cut at 300 characters."""
    rows = history(pairs, conv=conv, cut=fixed.HISTORY_ANSWER_CHARS)
    entry = F.format_string("\n%d. Usuario: %s\n   Asistente: %s...\n", "position", "question", "answer")
    text = joined_text(rows.withColumn("_e", entry), [conv], ["position"], "_e", "", "_all")
    return text.select(conv, F.concat(
        F.lit("\n========================\nHISTORIAL DE CONVERSACIÓN:\n"), F.col("_all")).alias("prompt"))


def reflection_history(pairs: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Last 10 pairs with answers cut at 200, for conversations of 2 pairs or more."""
    rows = history(pairs, fixed.REFLECTION_PAIRS, conv, cut=fixed.REFLECTION_ANSWER_CHARS)
    return rows.withColumn("_n", F.count(F.lit(1)).over(_conv(conv))).filter("_n >= 2").drop("_n")


def analysis_batches(pairs: DataFrame, size: int = fixed.ANALYSIS_INTERVAL, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Answers longer than 50 characters in batches of five; the last may be short."""
    long_ones = pairs.filter(F.length("answer") > fixed.ANALYSIS_MIN_ANSWER)
    placed = positions(long_ones, [conv], turn)
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def batch_sizes(batched: DataFrame, size: int = fixed.ANALYSIS_INTERVAL, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    counted = batched.groupBy(conv, "batch").agg(
        F.count(F.lit(1)).alias("pairs"), F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"))
    return counted.withColumn("full", F.col("pairs") == size)


# --- rules -------------------------------------------------------------------------

# Needles of at most so many characters are sent to tasks as one automaton; more are joined.
NEEDLE_CHARS = 8 << 20


def forced_answers(questions: DataFrame, rules: DataFrame, text: str = "text", most: int = NEEDLE_CHARS) -> DataFrame:
    """Adds ``rule_pos`` and ``forced`` from the first rule that applies, or null.

    ``rules`` holds rule_pos and rule.  Of rules with one position the smallest
    answer counts, an answer to a topic before an answer to anything.
    """
    parsed = parse_rules(rules.select(F.col("rule_pos").cast("long").alias("rule_pos"), "rule"))
    # The numbers must not change between the two reads.
    numbered = checkpoint(questions.withColumn("_row", F.monotonically_increasing_id()))
    words = parsed.select(F.explode("topics").alias("word"), F.struct("rule_pos", F.col("topic_answer").alias("answer")).alias("_rule"))
    words = words.groupBy("word").agg(F.min("_rule").alias("_rule"))
    hits = holds_word(numbered.select("_row", F.lower(text).alias("_low")), words.select("word"), "_row", "_low", "word", most)
    by_topic = hits.join(words, "word").groupBy("_row").agg(F.min("_rule").alias("_topic"))
    always = parsed.agg(F.min(F.when(
        F.col("any_answer").isNotNull(), F.struct("rule_pos", F.col("any_answer").alias("answer"))))).scalar()
    best = numbered.join(by_topic, "_row", "left").withColumn("_any", always)
    topic_wins = F.col("_topic").isNotNull() & (
        F.col("_any").isNull() | (F.col("_topic.rule_pos") <= F.col("_any.rule_pos")))
    pick = F.when(topic_wins, F.col("_topic")).otherwise(F.col("_any"))
    return best.withColumn("rule_pos", pick["rule_pos"]).withColumn("forced", pick["answer"]).drop("_row", "_topic", "_any")


def holds_word(texts: DataFrame, needles: DataFrame, row: str, text: str, needle: str, most: int = NEEDLE_CHARS) -> DataFrame:
    """``row, needle`` of every needle that a text holds.

    Needles of at most ``most`` characters together become an automaton that
    walks each text once, whatever their number; only the row's number and the
    needle leave it.  A larger table is joined, see :mod:`needles`; the answer
    is the same.
    """
    from collections.abc import Iterator

    import ahocorasick
    import pyarrow as pa

    needles = needles.filter(F.length(needle) > 0).select(needle).distinct()
    size = needles.agg(F.sum(F.length(needle))).first()[0] or 0
    if size > most:
        return joined_needles(texts, needles, row, text, needle)
    words = [r[0] for r in needles.collect()]
    kind = texts.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for at, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word in {w for _, w in automaton.iter(held.as_py() or "")} if words else ():
                    rows.append(at)
                    found.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(rows, batch.schema.field(0).type), pa.array(found, pa.string())], [row, needle])

    return texts.select(row, text).mapInArrow(run, f"{row} {kind}, {needle} string")


# --- topics --------------------------------------------------------------------------

def topic_histogram(questions: DataFrame, text: str = "question", by: list[str] | None = None) -> DataFrame:
    """Questions per topic with zeros for topics that do not occur."""
    names = [name for name, _ in fixed.QUESTION_TOPICS] + [fixed.OTHER_TOPIC]
    counted = questions.select(*(by or []), question_topic(text).alias("_topic")).groupBy(*(by or [])).agg(
        *[F.count_if(F.col("_topic") == n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("topic"), F.col(n).alias("questions")) for n in names])
    return counted.select(*(by or []), F.inline(rows))


def suggestions(histogram: DataFrame) -> DataFrame:
    """Suggestions for topics above their threshold, or the one that all is well."""
    bag = histogram.agg(*[
        F.coalesce(F.max(F.when(F.col("topic") == t, F.col("questions"))), F.lit(0)).alias(t) for t, _, _ in fixed.SUGGESTIONS])
    every = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(text).alias("suggestion"), (F.col(t) > above).alias("_on"))
                      for i, (t, above, text) in enumerate(fixed.SUGGESTIONS, 1)])
    on = F.filter(every, lambda s: s["_on"])
    none = F.array(F.struct(F.lit(1).alias("position"), F.lit(fixed.NO_SUGGESTION).alias("suggestion"), F.lit(True).alias("_on")))
    return bag.select(F.inline(F.when(F.size(on) > 0, on).otherwise(none))).select("position", "suggestion")


def conversation_listing(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations with number of messages and a title from the first user turn."""
    from archivolt.functions.text import title_preview

    user = F.when(F.col("role") == "user", F.col(turn))
    return turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("messages"),
        F.min_by(title_preview("text"), user).alias("title")).orderBy(F.desc(conv))

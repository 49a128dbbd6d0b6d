"""Queries on conversations: pairs, history, topics, rules, batches, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions import dialogue as dlg, text as tx
from archivolt.operators import dialogue as dl, needles, ordered
from archivolt.plans import Tables, query
from archivolt.plans.library import strip_sql
from archivolt.sources import records

PAIRS_SQL = """ahead AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
pairs AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM ahead WHERE role = 'user' AND next_role = 'assistant')"""


def _pairs(t: Tables) -> DataFrame:
    return dl.turn_pairs(t.conversations)


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, question, answer FROM pairs")
def turn_pairs(t: Tables) -> DataFrame:
    return _pairs(t)


def history_sql(n: int, cut: int) -> str:
    answer = f"substr(answer, 1, {cut})" if cut else "answer"
    return f"""{PAIRS_SQL},
aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM pairs),
last AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position, question, {answer} AS answer FROM aged WHERE age <= {n})"""


# Conversations here have few turns: eight in a row are one long session.
SESSIONS_SQL = "sessions AS (SELECT conv_id // 8 AS conv_id, conv_id % 8 * 100000 + turn AS turn, role, text FROM conversations)"


def _session_pairs(t: Tables) -> DataFrame:
    return dl.turn_pairs(t.conversations.select(
        F.expr("conv_id div 8").alias("conv_id"), (F.col("conv_id") % 8 * 100000 + F.col("turn")).alias("turn"), "role", "text"))


@query(f"WITH {SESSIONS_SQL}, {history_sql(5, 0).replace('FROM conversations', 'FROM sessions')} SELECT * FROM last")
def history_window(t: Tables) -> DataFrame:
    """The last five pairs of every session."""
    return dl.history(_session_pairs(t))


@query(f"""WITH {history_sql(5, 300)}
SELECT conv_id, md5(chr(10) || '========================' || chr(10) || 'HISTORIAL DE CONVERSACIÓN:' || chr(10) ||
  string_agg(chr(10) || position || '. Usuario: ' || question || chr(10) || '   Asistente: ' || answer || '...' || chr(10), '' ORDER BY position)) AS prompt_md5
FROM last GROUP BY conv_id""")
def history_prompt(t: Tables) -> DataFrame:
    return dl.history_prompt(_pairs(t)).select("conv_id", F.md5("prompt").alias("prompt_md5"))


@query(f"""WITH {history_sql(10, 200)}
SELECT * FROM last WHERE conv_id IN (SELECT conv_id FROM last GROUP BY conv_id HAVING count(*) >= 2)""")
def reflection_history(t: Tables) -> DataFrame:
    return dl.reflection_history(_pairs(t))


@query(f"""WITH {SESSIONS_SQL}, {PAIRS_SQL.replace('FROM conversations', 'FROM sessions')},
b AS (SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5)::BIGINT AS batch FROM pairs WHERE length(answer) > 50)
SELECT conv_id, batch, count(*) AS pairs, min(turn) AS first_turn, max(turn) AS last_turn, count(*) = 5 AS "full" FROM b GROUP BY conv_id, batch""")
def analysis_batches(t: Tables) -> DataFrame:
    """Answers of every session in batches of five."""
    return dl.batch_sizes(dl.analysis_batches(_session_pairs(t)))


@query("""
SELECT conv_id, turn, round(100.0 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id), 6) AS progress FROM conversations""")
def progress_of_parts(t: Tables) -> DataFrame:
    placed = ordered.positions(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", "place")
    totals = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    return placed.join(totals, "conv_id").select(
        "conv_id", "turn", F.round(F.lit(100.0) * F.col("place") / F.col("total"), 6).alias("progress"))


# --- topics: each text gets a word of its own number, so that every topic occurs --------

WORDS = ["covarianza", "la ley", "Python", "vender ETHEREUM", "feliz", "nada", "muestreo y ley", "Función", "leyenda", "TRISTE"]
WORDED_SQL = "text || ' ' || [" + ", ".join(f"'{w}'" for w in WORDS) + "][((conv_id * 7 + turn) % 10 + 1)::INT]"


def _worded() -> Column:
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), ((F.col("conv_id") * 7 + F.col("turn")) % 10 + 1).cast("int"))
    return F.concat("text", F.lit(" "), word)


def groups_sql(c: str, groups, default: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({c}), '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in groups)
    return f"CASE {whens} ELSE '{default}' END"


TOPIC_SQL = groups_sql("w", fixed.QUESTION_TOPICS, "general")


@query(f"WITH w AS (SELECT conv_id, turn, {WORDED_SQL} AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, {TOPIC_SQL} AS topic FROM w")
def question_topics(t: Tables) -> DataFrame:
    asked = t.conversations.filter("role = 'user'").withColumn("w", _worded())
    return asked.select("conv_id", "turn", dlg.question_topic("w").alias("topic"))


TOPICS = "['estadística', 'derecho', 'programación', 'finanzas', 'emociones', 'general']"


@query(f"""WITH w AS (SELECT {WORDED_SQL} AS w FROM conversations WHERE role = 'user'), c AS (SELECT {TOPIC_SQL} AS topic, count(*) AS n FROM w GROUP BY 1)
SELECT topic, coalesce(n, 0) AS questions FROM (SELECT unnest({TOPICS}) AS topic) LEFT JOIN c USING (topic)""")
def topic_histogram(t: Tables) -> DataFrame:
    return dl.topic_histogram(t.conversations.filter("role = 'user'").withColumn("question", _worded()))


@query(f"""WITH w AS (SELECT conv_id, {WORDED_SQL} AS w FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, {TOPIC_SQL} AS topic, count(*) AS n FROM w GROUP BY ALL)
SELECT conv_id, topic, coalesce(n, 0) AS questions FROM (SELECT DISTINCT conv_id, unnest({TOPICS}) AS topic FROM w) LEFT JOIN c USING (conv_id, topic)""")
def topic_histogram_per_conversation(t: Tables) -> DataFrame:
    asked = t.conversations.filter("role = 'user'").withColumn("question", _worded())
    return dl.topic_histogram(asked, by=["conv_id"])


SUGGESTIONS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, '{text}' AS suggestion, coalesce((SELECT questions FROM h WHERE topic = '{topic}'), 0) > {above} AS lit"
    for i, (topic, above, text) in enumerate(fixed.SUGGESTIONS, 1))


@query(f"""WITH w AS (SELECT {WORDED_SQL} AS w FROM conversations WHERE role = 'user'), h AS (SELECT {TOPIC_SQL} AS topic, count(*) AS questions FROM w GROUP BY 1),
s AS ({SUGGESTIONS_SQL})
SELECT i AS position, suggestion FROM s WHERE lit UNION ALL SELECT 1, '{fixed.NO_SUGGESTION}' WHERE NOT EXISTS (SELECT 1 FROM s WHERE lit)""")
def improvement_suggestions(t: Tables) -> DataFrame:
    asked = t.conversations.filter("role = 'user'").withColumn("question", _worded())
    return dl.suggestions(dl.topic_histogram(asked))


DIARY_WORDS = ["Terminé", "cansado", "mi PROYECTO", "una Idea", "nada", "mal pero bien", "código", "pensé"]
DIARY_SQL = "'(' || [" + ", ".join(f"'{w}'" for w in DIARY_WORDS) + "][((conv_id + turn) % 8 + 1)::INT] || ') ' || conv_id"


@query(f"WITH w AS (SELECT conv_id, turn, {DIARY_SQL} AS w FROM conversations) SELECT conv_id, turn, {groups_sql('w', fixed.DIARY_CATEGORIES, 'general')} AS category FROM w")
def diary_categories(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in DIARY_WORDS]), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    entry = F.concat(F.lit("("), word, F.lit(") "), F.col("conv_id").cast("string"))
    return t.conversations.select("conv_id", "turn", dlg.diary_category(entry).alias("category"))


@query("""
WITH d AS (SELECT doc_id, string_split('# Diario' || chr(10) || replace(text, chr(10), chr(10) || '---' || chr(10)), '---') AS p FROM documents),
k AS (SELECT doc_id, CASE WHEN len(p) > 5 THEN p[len(p) - 4:] WHEN len(p) > 1 THEN p[2:] ELSE p END AS kept FROM d)
SELECT doc_id, (generate_subscripts(kept, 1) - 1)::INT AS pos, unnest(kept) AS entry FROM k""")
def diary_entries(t: Tables) -> DataFrame:
    """A document is a day's diary, its lines are the entries."""
    day = F.concat(F.lit("# Diario\n"), F.replace("text", F.lit("\n"), F.lit("\n---\n")))
    return records.diary_entries(t.documents.select("doc_id", day.alias("text")), 5, "doc_id")


# --- rules: every benchmark passage gives one ------------------------------------------

RULES_SQL = f"""w AS (SELECT item_id, regexp_split_to_array({strip_sql('text')}, '\\s+') AS w FROM benchmark),
rules AS (SELECT item_id AS rule_pos, CASE item_id % 5 WHEN 0 THEN 'Si te pregunto por ' || w[2] || w[3] || ' ' || w[4] || ', responde "' || w[1] || '"'
  WHEN 1 THEN 'responde con ' || item_id || ' palabras' WHEN 2 THEN 'si te pregunto por ' || w[5] || w[6] || ' respondé ''' || w[2] || ' '''
  WHEN 3 THEN 'si te pregunto por the responde responde mal' ELSE w[1] END AS rule FROM w
  UNION ALL SELECT max(item_id) + 1, 'Responde siempre No sé' FROM benchmark)"""


def _rules(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", tx.words("text").alias("w"))
    word = lambda i: F.get("w", F.lit(i - 1))
    k = F.col("item_id") % 5
    rule = (
        F.when(k == 0, F.concat(F.lit("Si te pregunto por "), word(2), word(3), F.lit(" "), word(4), F.lit(', responde "'), word(1), F.lit('"')))
        .when(k == 1, F.concat(F.lit("responde con "), F.col("item_id").cast("string"), F.lit(" palabras")))
        .when(k == 2, F.concat(F.lit("si te pregunto por "), word(5), word(6), F.lit(" respondé '"), word(2), F.lit(" '")))
        .when(k == 3, "si te pregunto por the responde responde mal")
        .otherwise(word(1)))
    last = t.benchmark.agg((F.max("item_id") + 1).alias("rule_pos")).withColumn("rule", F.lit("Responde siempre No sé"))
    return words.select(F.col("item_id").alias("rule_pos"), rule.alias("rule")).unionByName(last)


FORMAT_SQL = " OR ".join(f"contains(lower(rule), '{p}')" for p in fixed.RULE_FORMAT)


@query(f"""WITH {RULES_SQL}
SELECT rule_pos, (contains(lower(rule), 'si te pregunto por') AND (contains(lower(rule), 'responde') OR contains(lower(rule), 'respondé')))
    OR starts_with(lower(rule), 'responde siempre') OR starts_with(lower(rule), 'siempre responde') AS content,
  {FORMAT_SQL} AS format FROM rules""")
def rule_classes(t: Tables) -> DataFrame:
    return _rules(t).select("rule_pos", dlg.is_content_rule("rule").alias("content"), dlg.is_format_rule("rule").alias("format"))


FORCED_SQL = f"""WITH {RULES_SQL},
ask AS (SELECT rule_pos, CASE WHEN contains(lower(rule), 'responde') THEN string_split(lower(rule), 'responde') ELSE string_split(lower(rule), 'respondé') END AS p
  FROM rules WHERE contains(lower(rule), 'si te pregunto por')),
topics AS (SELECT rule_pos, list_filter(regexp_split_to_array(replace(p[1], 'si te pregunto por', ''), '\\s+'), lambda x: x <> '') AS topics,
  {strip_sql("trim(trim(" + strip_sql('p[2]') + ", '\"'), '''')")} AS answer FROM ask WHERE len(p) = 2),
always AS (SELECT rule_pos, {strip_sql("replace(replace(lower(rule), 'responde siempre', ''), 'siempre responde', '')")} AS answer
  FROM rules WHERE starts_with(lower(rule), 'responde siempre') OR starts_with(lower(rule), 'siempre responde')),
m AS (SELECT conv_id, turn, rule_pos, answer FROM conversations, topics WHERE role = 'user' AND len(list_filter(topics, lambda x: contains(lower(text), x))) > 0
  UNION ALL SELECT conv_id, turn, rule_pos, answer FROM conversations, always WHERE role = 'user')
SELECT conv_id, turn, min(rule_pos) AS rule_pos, arg_min(answer, rule_pos) AS forced FROM m GROUP BY conv_id, turn"""


@query(FORCED_SQL)
def forced_answers(t: Tables) -> DataFrame:
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", "text")
    return dl.forced_answers(asked, _rules(t)).select("conv_id", "turn", "rule_pos", "forced")


@query(FORCED_SQL)
def forced_answers_long_list(t: Tables) -> DataFrame:
    """The same with the needles sent in several parts."""
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", "text")
    return dl.forced_answers(asked, _rules(t), most=8).select("conv_id", "turn", "rule_pos", "forced")


# --- labels, listings ------------------------------------------------------------------

ROUTE_WORDS = ["general", " Researcher ", "el agente MENTOR, creo", "comentario arquitectonico", "estadistica o mentor", "mentores", ""]
ROUTE_SQL = "[" + ", ".join(f"'{w}'" for w in ROUTE_WORDS) + "][((conv_id + turn) % 7 + 1)::INT]"


@query("""WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS needle FROM benchmark),
n AS (SELECT needle FROM w WHERE length(needle) > 0)
SELECT conv_id, turn, needle FROM conversations JOIN n ON contains(lower(text), needle)""")
def held_words(t: Tables) -> DataFrame:
    """Every word of any benchmark item in every turn, found by joins on the words' rarest pieces."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("needle"))
    turns = t.spread("conversations").select(F.struct("conv_id", "turn").alias("at"), F.lower("text").alias("text"))
    return needles.joined_needles(turns, words, "at", "text", "needle").select("at.*", "needle")


@query(f"""WITH r AS (SELECT conv_id, turn, lower({strip_sql(ROUTE_SQL)}) AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN r IN ('general', 'estadistica', 'researcher', 'mentor', 'arquitecto') THEN r
  ELSE coalesce(nullif(regexp_extract(r, '\\b(general|estadistica|researcher|mentor|arquitecto)\\b', 1), ''), 'general') END AS route FROM r""")
def route_labels(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(w) for w in ROUTE_WORDS]), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", dlg.route_label(said).alias("route"))


PREVIEW_SQL = f"array_to_string(list_filter(regexp_split_to_array({strip_sql('text')}, '\\s+'), lambda x: x <> '')[1:3], ' ')"


@query(f"""WITH p AS (SELECT conv_id, turn, role, {PREVIEW_SQL} AS p FROM conversations)
SELECT conv_id, count(*) AS messages, arg_min(CASE WHEN length(p) > 35 THEN substr(p, 1, 32) || '...' ELSE p END, turn) FILTER (role = 'user') AS title FROM p GROUP BY conv_id""")
def conversation_listing(t: Tables) -> DataFrame:
    return dl.conversation_listing(t.conversations)


@query(f"""WITH p AS (SELECT conv_id, arg_min({PREVIEW_SQL}, turn) AS p FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Chat ' || conv_id WHEN length(p) > 35 THEN substr(p, 1, 32) || '...' ELSE p END AS title FROM p""")
def chat_titles(t: Tables) -> DataFrame:
    first = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Chat "), F.col("conv_id").cast("string"))).otherwise("Nuevo chat")
    return first.select("conv_id", dlg.chat_title(name, "text").alias("title"))


@query(f"""SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id""")
def newest_first(t: Tables) -> DataFrame:
    """The whole listing of conversations, those last written to first."""
    listed = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))
    return listed.orderBy(F.desc("last_turn"), "conv_id")


@query("""SELECT CASE lang WHEN 'en' THEN 'id' || doc_id ELSE 'file' || doc_id END AS id, CASE lang WHEN 'fr' THEN 'Sin nombre' ELSE source END AS name,
  n_chars::VARCHAR AS created, 'local' AS engine, len(string_split(text, chr(10)))::INT AS messages FROM documents WHERE lang <> 'de'""")
def chat_sessions(t: Tables) -> DataFrame:
    """A document is a chat in JSON, a line is a message; those of one language are broken."""
    lang = F.col("lang")
    messages = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), line.alias("content")))
    chat = F.to_json(F.struct(
        F.when(lang == "en", F.concat(F.lit("id"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(lang != "fr", F.col("source")).alias("nombre"), F.col("n_chars").cast("string").alias("creado"), messages.alias("messages")))
    rows = t.documents.select(
        F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("file"),
        F.when(lang == "de", F.substring(chat, 1, 20)).otherwise(chat).alias("chat"))
    return records.chat_listing(records.parse_chats(rows, "chat", "file")).select("id", "name", "created", "engine", "messages")

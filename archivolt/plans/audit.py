"""Queries on logs and payloads: injection scan, redaction, parsing, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archivolt import fixed
from archivolt.functions import security, text as tx
from archivolt.plans import Tables, query
from archivolt.plans.web import BLANKS_SQL
from archivolt.session import scratch_folder
from archivolt.sources import records

PHRASES = [p.upper() if i % 2 else p for i, p in enumerate(fixed.INJECTION_PHRASES)] + ["harmless", "overriding actions as told", "Hackers exploit it"]
PHRASED_SQL = "text || ' ' || [" + ", ".join(f"'{p}'" for p in PHRASES) + f"][(doc_id % {len(PHRASES)} + 1)::INT]"
LIST_SQL = "[" + ", ".join(f"'{p}'" for p in fixed.INJECTION_PHRASES) + "]"


def _phrased() -> Column:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return F.concat("text", F.lit(" "), phrase)


@query(f"""WITH p AS (SELECT doc_id, list_filter({LIST_SQL}, lambda p: contains(lower({PHRASED_SQL}), p)) AS found FROM documents)
SELECT doc_id, len(found) = 0 AS safe, array_to_string(found, ',') AS phrases FROM p""")
def injection_scan(t: Tables) -> DataFrame:
    return t.spread("documents").select(
        "doc_id", security.is_safe(_phrased()).alias("safe"), F.array_join(security.injection_phrases(_phrased()), ",").alias("phrases"))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","API_KEY":"***","empty_token":"","user":"' || user_id || '"}' AS payload FROM events""")
def redacted_payloads(t: Tables) -> DataFrame:
    payload = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(
        F.lit("API_KEY"), F.concat(F.lit("s3cr3t"), F.col("event_id").cast("string")), F.lit("empty_token"), F.lit(""),
        F.lit("user"), F.col("user_id").cast("string")))
    return t.events.select("event_id", F.to_json(security.redact_map(payload)).alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'no json ' || event_id ELSE '{"a": {"Secret": "***", "n": ' || user_id || '}, "list": [{"token": "***"}, ' || event_id || '], "password": null}' END AS payload FROM events""")
def redacted_nested_payloads(t: Tables) -> DataFrame:
    nested = F.format_string('{"password": null, "list": [{"token": {"x": 1}}, %d], "a": {"n": %d, "Secret": "abc"}}', "event_id", "user_id")
    payload = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("no json "), F.col("event_id").cast("string"))).otherwise(nested)
    return t.events.select("event_id", security.redact_json(payload).alias("payload"))


@query(r"""WITH s AS (SELECT doc_id, replace(text, 'tion', '***') || ' HTTPS://***@host' || doc_id || '/x Authoriza***: bearer *** http://plain/' AS t FROM documents)
SELECT doc_id, md5(t) AS text_md5 FROM s""")
def redacted_texts(t: Tables) -> DataFrame:
    secret = F.concat("text", F.lit(" HTTPS://me:pw@host"), F.col("doc_id").cast("string"), F.lit("/x Authorization: bearer aB3._~+/=- http://plain/"))
    return t.documents.select("doc_id", F.md5(security.redact_text(secret, ["tion", ""])).alias("text_md5"))


# The first word may itself be a secret flag: then what follows it is hidden, or what stands behind its equals sign.
@query(f"""WITH w AS (SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '[^' || {BLANKS_SQL} || ']+'), '') AS w FROM documents),
f AS (SELECT *, coalesce({' OR '.join(f"contains(lower(w), '{m}')" for m in fixed.SECRET_MARKERS)}, false) AS secret, coalesce(contains(w, '='), false) AS valued FROM w),
s AS (SELECT *, CASE WHEN secret AND valued THEN split_part(w, '=', 1) || '=***' WHEN secret THEN w ELSE regexp_replace(w, '([Hh][Tt][Tt][Pp][Ss]?://)[^/@]+@', '\\1***@', 'g') END AS shown FROM f)
SELECT doc_id, concat_ws(' ', 'run --token ***', shown, CASE WHEN secret AND NOT valued THEN '***' ELSE '--api-key=***' END, 'https://***@h PASSWORD ***', shown) AS command FROM s""")
def redacted_commands(t: Tables) -> DataFrame:
    word = F.get(tx.words("text"), F.lit(0))
    args = F.array(F.lit("run"), F.lit("--token"), F.lit("--secret"), word, F.lit("--api-key=abc=d"), F.lit("https://u:p@h"),
                   F.lit("PASSWORD"), word, word)
    return t.documents.select("doc_id", F.array_join(security.redact_arguments(args), " ").alias("command"))


def _lines(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", records.log_line(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("WARNING"), F.upper("event_type"), F.concat(F.lit("user: "), F.col("user_id").cast("string"))).alias("line"))


LINE_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - WARNING - ' || upper(event_type) || ': user: ' || user_id"


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'WARNING' AS level, upper(event_type) AS event, 'user: ' || user_id AS detail FROM events")
def security_log_lines(t: Tables) -> DataFrame:
    return _lines(t).select("event_id", records.parse_log_line("line").alias("e")).select("event_id", "e.*")


@query(f"""WITH l AS (SELECT ts, event_id, {LINE_SQL} AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 10),
k AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM l)
SELECT count(*) AS recent, string_agg(line, chr(10) ORDER BY n DESC) FILTER (n <= 3) AS latest FROM k""")
def recent_security_events(t: Tables) -> DataFrame:
    return records.recent_summary(_lines(t), ["ts", "event_id"], "line")


@query(f"SELECT {LINE_SQL} AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def log_tail(t: Tables) -> DataFrame:
    return records.tail(_lines(t), 10, ["ts", "event_id"]).select("line")


@query("""SELECT event_id::VARCHAR AS event_id, event_type AS event, 'store' AS component, json_extract_string(props, '$.k') AS k, '***' AS secret FROM events""")
def operational_log(t: Tables) -> DataFrame:
    """Events as JSON log lines and back; secrets are gone on the way."""
    payload = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("client_secret"), F.lit("abc")))
    line = records.operational_record(F.col("ts"), F.col("event_id"), F.lit("store"), F.col("event_type"), payload)
    back = records.parse_operational(t.events.select(line.alias("value")))
    return back.select("event_id", "event", "component", F.col("payload")["k"].alias("k"), F.col("payload")["client_secret"].alias("secret"))


LOG_SQL = """CASE WHEN event_id % 7 = 3 THEN '' WHEN event_id % 5 = 2 THEN 'no event: ' || event_type
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - INFO - ' || event_type || ': user ' || user_id END"""


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY event_id) AS line_no, {LOG_SQL} AS line FROM events),
a AS (SELECT *, row_number() OVER (ORDER BY line_no DESC) AS age FROM l WHERE trim(line) <> '')
SELECT age::INT AS age, line_no, line, CASE WHEN line LIKE '____-__-__ __:__:__ - INFO%' THEN regexp_extract(line, ' - INFO - ([^:]*): ', 1) END AS event FROM a WHERE age <= 10""")
def log_file_tail(t: Tables) -> DataFrame:
    """All events written as a log with empty and foreign lines; its last ten lines by place, with their numbers."""
    folder = f"{scratch_folder(t.spark)}/log"
    event = records.log_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO"), F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")))
    line = F.when(F.col("event_id") % 7 == 3, "").when(F.col("event_id") % 5 == 2, F.concat(F.lit("no event: "), "event_type")).otherwise(event)
    t.events.orderBy("event_id").select(line.alias("value")).write.text(folder)
    last = records.tail_lines(records.numbered_lines(records.read_log_lines(t.spark, folder), ()), 10, ())
    return last.select("age", "line_no", "line", records.parse_log_line("line")["event"].alias("event"))

"""Chat sessions, logs, notes and artifacts: reading and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from archivolt import fixed
from archivolt.functions import security, urls
from archivolt.functions.text import _col, strip
from archivolt.operators.ordered import first_seen, newest

CHAT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("nombre", T.StringType()),
    T.StructField("creado", T.StringType()),
    T.StructField("motor", T.StringType()),
    T.StructField("modelo_local", T.StringType()),
    T.StructField("modelo_nube", T.StringType()),
    T.StructField("voz_activa", T.BooleanType()),
    T.StructField("agente_actual", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("historial_brain", T.ArrayType(T.StructType([
        T.StructField("pregunta", T.StringType()), T.StructField("respuesta", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_chats(spark: SparkSession, folder: str, default_engine: str = "local") -> DataFrame:
    """One row per chat file; a file that is no chat is left out."""
    raw = (
        spark.read.schema(CHAT_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json").json(folder)
        .withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    )
    return _chat_columns(raw, default_engine)


def parse_chats(rows: DataFrame, column: str, file_name: str, default_engine: str = "local") -> DataFrame:
    """The same for chats that are JSON texts in a column."""
    raw = rows.select(F.col(file_name).alias("_file"), F.from_json(
        column, CHAT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("c"))
    return _chat_columns(raw.select("_file", "c.*"), default_engine)


def _chat_columns(raw: DataFrame, default_engine: str) -> DataFrame:
    good = raw.filter(F.col("_corrupt_record").isNull())
    return good.select(
        F.coalesce("id", "_file").alias("id"),
        F.coalesce("nombre", F.lit("Sin nombre")).alias("name"),
        F.coalesce("creado", F.lit("")).alias("created"),
        F.coalesce("motor", F.lit(default_engine)).alias("engine"),
        F.coalesce("modelo_local", F.lit("")).alias("local_model"),
        F.coalesce("modelo_nube", F.lit("")).alias("cloud_model"),
        F.coalesce("voz_activa", F.lit(False)).alias("voice"),
        F.coalesce("agente_actual", F.lit(fixed.DEFAULT_ROUTE)).alias("agent"),
        F.coalesce("messages", F.array().cast(CHAT_SCHEMA["messages"].dataType)).alias("messages"),
        F.coalesce("historial_brain", F.array().cast(CHAT_SCHEMA["historial_brain"].dataType)).alias("history"),
    )


def chat_turns(chats: DataFrame) -> DataFrame:
    """Chats as turns: id, turn, role, text."""
    return chats.select("id", F.posexplode("messages").alias("turn", "m")).select(
        "id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def chat_listing(chats: DataFrame, active: str | None = None) -> DataFrame:
    """Chats with their number of messages, newest first."""
    return chats.select(
        "id", "name", "created", "engine", "local_model", "cloud_model", "voice", "agent",
        (F.col("id") == F.lit(active)).alias("active") if active else F.lit(False).alias("active"),
        F.size("messages").alias("messages"),
    ).orderBy(F.desc("created"), "id")


# --- logs --------------------------------------------------------------------

_LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:,\d+)?) - ([A-Z]+) - ([^:]*): (.*)$"


def log_line(ts, level, event, detail) -> Column:
    """The written form of a security event."""
    return F.format_string("%s - %s - %s: %s", _col(ts), _col(level), _col(event), _col(detail))


def parse_log_line(c) -> Column:
    """Struct of time, level, event and detail; all null when it is no event."""
    c = _col(c)
    part = lambda i: F.when(c.rlike(_LOG_LINE), F.regexp_extract(c, _LOG_LINE, i))
    return F.struct(part(1).alias("ts"), part(2).alias("level"), part(3).alias("event"), part(4).alias("detail"))


PLACE = ("file", "block", "row")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a log, a file or a folder of them, with their place: ``line, file, block, row``.

    ``block`` is where the split that a line was read in begins in its file, and
    ``row`` grows inside a split.  Bad bytes are replaced.
    """
    lines = spark.read.format("text").load(path)
    return lines.select(
        F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def numbered_lines(lines: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Adds ``line_no``, counted from 1, empty lines too: per file, or over all files in the order of their names with ``by=()``.

    The lines of each split are counted; sums over the splits before it, one
    row each, then carry the numbers on.  No task sees more than a split.
    """
    split = ["file", "block"]
    counts = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*split, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*split).orderBy("row")
    return lines.join(before, split).withColumn("line_no", F.col("_before") + F.row_number().over(inside)).drop("_before")


def tail_lines(lines: DataFrame, n: int = 10, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """The last ``n`` lines that are not empty, parsed or not, by place, with ``age`` 1 for the last one; per file, or of all with ``by=()``."""
    placed = lines.filter(strip("line") != "").withColumn("_place", F.struct(*PLACE))
    return newest(placed, list(by), "_place", n).drop("_place")


def read_security_log(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty log lines with their place in the file and, where a line is an event, its parts."""
    lines = read_log_lines(spark, path).filter(strip("line") != "")
    return lines.select("line", *PLACE, parse_log_line("line").alias("e")).select("line", *PLACE, "e.*")


def tail(events: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The last ``n`` events by ``order`` (time, or the place in the file), newest first."""
    return events.orderBy(*[F.desc(c) for c in (order or ["ts"])]).limit(n)


def recent_summary(events: DataFrame, order: list[str], line: str, n: int = 10, shown: int = 3) -> DataFrame:
    """How many of the last ``n`` events there are, and the last few of them."""
    last = tail(events.select(*dict.fromkeys([*order, line])), n, order)  # at most n rows from here on
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return last.agg(F.count(F.lit(1)).alias("recent"), rows.alias("rows")).select(
        "recent",
        F.array_join(F.transform(F.slice("rows", F.greatest(F.size("rows") - shown + 1, F.lit(1)), F.lit(shown)),
                                 lambda r: r["_line"]), "\n").alias("latest"))


EVENT_SCHEMA = "timestamp string, event_id string, component string, event string"


def operational_record(ts, event_id, component, event, payload) -> Column:
    """One JSON line of the operational log from a flat map payload, redacted."""
    base = F.create_map(
        F.lit("timestamp"), _col(ts).cast("string"), F.lit("event_id"), _col(event_id).cast("string"),
        F.lit("component"), _col(component), F.lit("event"), _col(event))
    return F.to_json(F.map_concat(base, security.redact_map(payload)))


def write_operational_log(records: DataFrame, path: str, column: str = "record") -> None:
    records.select(F.col(column).alias("value")).write.mode("append").text(path)


def read_operational_log(spark: SparkSession, path: str) -> DataFrame:
    """Fixed fields of each JSON line, the rest as a map; broken lines are dropped."""
    return parse_operational(spark.read.text(path))


def parse_operational(lines: DataFrame, column: str = "value") -> DataFrame:
    parsed = lines.select(F.from_json(column, "map<string,string>").alias("m")).filter(F.size("m") > 0)
    names = ("timestamp", "event_id", "component", "event")
    fixed_keys = F.array(*[F.lit(k) for k in names])
    return parsed.select(
        *[F.col("m")[k].alias(k) for k in names],
        F.map_filter("m", lambda k, v: ~F.array_contains(fixed_keys, k)).alias("payload"))


# --- artifacts and notes -----------------------------------------------------

def artifact_text(title, source, date, category, body, url_hash=None) -> Column:
    """Front matter and body of a saved artifact."""
    head = [
        F.lit('---\ntitulo: "'), _col(title), F.lit('"\nfuente: "'), _col(source), F.lit('"\nfecha_ingestion: "'),
        date if isinstance(date, Column) else F.lit(date), F.lit('"\ncategoria: "'), _col(category), F.lit('"\n'),
    ]
    if url_hash is not None:
        head += [F.lit('hash_url: "'), _col(url_hash), F.lit('"\n')]
    return F.concat(*head, F.lit("---\n\n"), _col(body))


def page_artifact_text(url, body) -> Column:
    return F.concat(F.lit("# Fuente: "), _col(url), F.lit("\n\n"), _col(body))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artifacts (name, category, text) as Parquet, a folder per category."""
    artifacts.write.mode("append").partitionBy("category").parquet(path)


def ingested_artifacts(artifacts: DataFrame) -> DataFrame:
    """Ingested Markdown artifacts, newest first."""
    return artifacts.filter(F.col("name").startswith("Ingestion_") & F.col("name").endswith(".md")).orderBy(
        F.desc("date"), "name")


def accepted_notes(notes: DataFrame) -> DataFrame:
    """Notes with a status: saved, or why not (unknown category, injection)."""
    status = (
        F.when(~F.col("category").isin(fixed.MEMORY_CATEGORIES), "unknown_category")
        .when(~security.is_safe("summary"), "blocked")
        .otherwise("saved")
    )
    return notes.withColumn("status", status)


def append_memory(notes: DataFrame, path: str) -> None:
    """Adds the accepted notes to the memory table, a folder per category."""
    accepted_notes(notes).filter("status = 'saved'").select("category", "ts", "summary", "reason").write.mode(
        "append").partitionBy("category").parquet(path)


def memory_view(memory: DataFrame) -> DataFrame:
    """Categories that hold anything, with the number of notes."""
    return memory.filter(strip("summary") != "").groupBy("category").agg(F.count(F.lit(1)).alias("notes"))


def note_entry(ts, summary) -> Column:
    return F.concat(F.lit("\n\n### "), _col(ts), F.lit("\n"), _col(summary), F.lit("\n"))


def study_section(name, notes, origin) -> Column:
    """One file's part of the study notes document."""
    bar = "=" * 60
    mark = F.when(_col(origin) == "cached", F.concat(F.lit("📘 "), _col(name), F.lit(" (desde cache)"))).when(
        _col(origin) == "failed", F.concat(F.lit("❌ ERROR en "), _col(name))).otherwise(F.concat(F.lit("📘 "), _col(name)))
    return F.concat(F.lit(f"\n\n{bar}\n"), mark, F.lit(f"\n{bar}\n"), F.coalesce(_col(notes), F.lit("")))


def diary_entries(days: DataFrame, n: int = 5, date: str = "date", text: str = "text") -> DataFrame:
    """The last ``n`` pieces of each day's diary, in order.

    The text of a day is split at '---'; the piece before the first one is
    left out when there are no more than ``n``.
    """
    pieces = F.split(F.col(text), "---")
    kept = (
        F.when(F.size(pieces) > n, F.slice(pieces, F.size(pieces) - n + 1, F.lit(n)))
        .when(F.size(pieces) > 1, F.slice(pieces, F.lit(2), F.size(pieces)))
        .otherwise(pieces)
    )
    return days.select(date, F.posexplode(kept).alias("pos", "entry"))


def new_recommendations(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` with an address not stored yet, first row of each."""
    from archivolt.operators.enrich import insert_new

    return insert_new(stored, found, urls.url_key("url"), ["pos"])


def category_results(parts: list[tuple[str, DataFrame]], order: list[str], key: Column | None = None) -> DataFrame:
    """Results of several categories as one list: the first category that has an address keeps it."""
    every = [rows.withColumn("category", F.lit(name)).withColumn("_place", F.lit(i)) for i, (name, rows) in enumerate(parts)]
    return unique_results(reduce(DataFrame.unionByName, every), ["_place", *order], key).drop("_place")


def unique_results(results: DataFrame, order: list[str], key: Column | None = None) -> DataFrame:
    """First result of each address; rows without one are dropped."""
    key = urls.url_key("url") if key is None else key
    return first_seen(results.withColumn("_key", key).filter("_key <> ''"), ["_key"], order).drop("_key")

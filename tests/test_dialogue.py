"""Order-dependent columns, rules, notes, exams, logs, enrichment."""

import json
import os

import pytest
from pyspark.sql import Window, functions as F

from archivolt.functions import dialogue as dlg, exam as ex, paths, security, text as tx
from archivolt.operators import dialogue as dl, enrich as en, jobs, ordered
from archivolt.sources import records


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expr.alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


@pytest.fixture(scope="module")
def hot(spark):
    """One conversation holds most rows; turns have gaps."""
    rows = [("hot", i * 3 % 997, "user" if i % 3 else "assistant", f"t{i}" if i % 5 else None) for i in range(300)]
    rows += [("cold", 7, "user", "x"), ("cold", 900, "assistant", "y")]
    return spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").dropDuplicates(["conv_id", "turn"])


@pytest.mark.parametrize("span", [1, 10, 5000])
def test_spans_equal_plain_windows(spark, hot, span):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(ordered.positions(hot, ["conv_id"], "turn", "n", span).select("conv_id", "turn", F.col("n").cast("long"))) == rows(
        hot.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("n")))
    assert rows(ordered.following(hot, ["conv_id"], "turn", ["role", "text"], span=span).select("conv_id", "turn", "next_role", "next_text")) == rows(
        hot.select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text")))
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    assert rows(ordered.carried(hot, ["conv_id"], "turn", "text", "c", span).select("conv_id", "turn", "c")) == rows(
        hot.select("conv_id", "turn", F.last("text", True).over(whole).alias("c")))


def test_rows_without_a_group_are_kept(spark):
    df = spark.createDataFrame([(None, 1, "a"), ("c", None, "b"), ("c", 5, "d"), ("c", 900, "e")], "conv_id string, turn long, text string")
    assert {r["text"]: r["n"] for r in ordered.positions(df, ["conv_id"], "turn", "n", 10).collect()} == {"a": None, "b": None, "d": 1, "e": 2}
    assert {r["text"]: r["next_text"] for r in ordered.following(df, ["conv_id"], "turn", ["text"], span=10).collect()} == {
        "a": None, "b": None, "d": "e", "e": None}
    assert {r["text"]: r["c"] for r in ordered.carried(df, ["conv_id"], "turn", "text", "c", 10).collect()} == {"a": None, "b": None, "d": "d", "e": "e"}


def test_newest_is_cut_before_the_shuffle(spark, hot):
    plan = ordered.newest(hot, ["conv_id"], "turn", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_pairs_and_history(spark):
    turns = [("c", i, r, f"{r[0]}{i}") for i, r in enumerate(["system", "user", "user", "assistant", "assistant"] + ["user", "assistant"] * 12)]
    pairs = dl.turn_pairs(spark.createDataFrame(turns, "conv_id string, turn long, role string, text string"))
    assert pairs.count() == 13
    assert [(r["position"], r["question"]) for r in dl.history(pairs).orderBy("position").collect()] == [
        (i, f"u{n}") for i, n in enumerate((19, 21, 23, 25, 27), 1)]
    long = pairs.withColumn("answer", F.repeat(F.lit("z"), F.lit(60)))
    assert [(r["batch"], r["pairs"], r["full"]) for r in dl.batch_sizes(dl.analysis_batches(long)).orderBy("batch").collect()] == [
        (0, 5, True), (1, 5, True), (2, 3, False)]
    assert dl.analysis_batches(pairs).count() == 0
    assert "Asistente: a28..." in dl.history_prompt(pairs).first()["prompt"]


RULES = [
    (0, "responde con 3 palabras"), (1, "Si te pregunto por el clima, responde \"Llueve\""), (2, "si te pregunto por Messi respondé 'el mejor'"),
    (3, "si te pregunto por x responde responde y"), (4, "siempre responde HOLA"),
]


@pytest.mark.parametrize("part", [dl.NEEDLE_CHARS, 1])
def test_rules(spark, part):
    rules = spark.createDataFrame(RULES, "rule_pos int, rule string")
    asked = spark.createDataFrame([("¿Cómo está el CLIMA,?",), ("quién es messi",), ("zzz",)], "text string")
    got = {r["text"]: (r["rule_pos"], r["forced"]) for r in dl.forced_answers(asked, rules, most=part).collect()}
    assert got == {"¿Cómo está el CLIMA,?": (1, "llueve"), "quién es messi": (2, "el mejor"), "zzz": (4, "hola")}
    none = dl.forced_answers(asked, rules.filter("rule_pos = 0")).select("forced").collect()
    assert [r[0] for r in none] == [None] * 3
    shared = spark.createDataFrame([(1, "si te pregunto por x responde omega"), (1, "si te pregunto por x responde abc"), (1, "siempre responde aa")], "rule_pos int, rule string")
    one = dl.forced_answers(spark.createDataFrame([("x y",), ("q",)], "text string"), shared, most=part).collect()
    assert {r["text"]: r["forced"] for r in one} == {"x y": "abc", "q": "aa"}


def test_rule_classes(spark):
    values = [r for _, r in RULES] + ["sé amable"]
    assert column(spark, values, dlg.is_content_rule("v")) == [False, True, True, True, True, False]
    assert column(spark, values, dlg.is_format_rule("v")) == [True, False, False, False, False, False]


def test_route_labels(spark):
    assert column(spark, ["mentor", " Mentor.", "comentador", None, "", "creo que ARQUITECTO o mentor"], dlg.route_label("v")) == [
        "mentor", "mentor", "general", "general", "general", "arquitecto"]


def test_memory_notes(spark):
    values = ["NADA", "CATEGORIA: Salud\nRESUMEN: duerme mal\nRAZON: importa", "CATEGORIA:\nRESUMEN: x", "CATEGORIA: Salud\nRESUMEN: y\nRAZON:",
              "x" * 40 + "NADA CATEGORIA: A\nRESUMEN: b\nRAZON: c", None]
    got = column(spark, values, dlg.memory_note("v"))
    assert [tuple(g) if g else None for g in got] == [
        None, ("Salud", "duerme mal", "importa"), None, ("Salud", "y", "Información relevante sobre el usuario"), ("A", "b", "c"), None]


def test_diary_takes_project_names(spark):
    assert column(spark, ["avance de Faro", "mal día", "logré algo triste"], dlg.diary_category("v", ["faro"])) == ["proyecto", "emocion", "logro"]


# --- exams -----------------------------------------------------------------------------

def test_exam_without_structure_is_one_marker(spark):
    row = column(spark, [""], ex.parse_questions("v"))[0]
    assert len(row) == 1 and row[0]["points"] == 0 and row[0]["answer"] == "N/A"


def test_exam_numbers_and_defaults(spark):
    text = "PREGUNTA\nENUNCIADO: uno\n---\nPREGUNTA N° 7: [VERDADERO/FALSO]\nENUNCIADO: dos\nOPCIONES: a\nPUNTAJE: 4\n---\nPREGUNTA\nRESPUESTA: nada"
    got = column(spark, [text], ex.parse_questions("v"))[0]
    assert [(q["number"], q["kind"], q["statement"], q["points"]) for q in got] == [
        (1, "general", "ENUNCIADO: uno", 10), (7, "vf", "dos", 4)]  # a field needs a line after it


def test_grades_are_cut_to_the_maximum(spark):
    df = spark.createDataFrame([("PUNTAJE: 15\nFEEDBACK: a\nb", 10), ("nada", 10), ("puntaje : 7", 10), ("PUNTAJE: 6", 10)], "v string, m int")
    assert [tuple(r["g"]) for r in df.select(ex.parse_grade("v", "m").alias("g")).collect()] == [
        (10, 10, "a\nb", True), (0, 10, "Sin feedback.", False), (7, 10, "Sin feedback.", True), (6, 10, "Sin feedback.", False)]


def test_exam_report_bands(spark):
    rows = [("a", 10, 10, True), ("a", 6, 10, False), ("b", 6, 10, False), ("c", 0, 0, True)]
    grades = spark.createDataFrame(rows, "exam string, points long, max_points long, correct boolean")
    got = {r["exam"]: (r["percent"], r["mark"], r["correct"], r["advice"][0]) for r in jobs.exam_report(grades, ["exam"]).collect()}
    assert got == {"a": (80.0, 8.0, 1, "✅"), "b": (60.0, 6.0, 0, "⚠"), "c": (0.0, 0.0, 1, "🔴")}


# --- paths, logs, redaction ---------------------------------------------------------------

def test_containment(spark):
    cases = {"/m/a/b.md": "a/b.md", "/m": None, "/m/": None, "/m_evil/a": None, "/m/../x": None, "/m/a/../b": "b", "\\m\\c.md": "c.md"}
    assert column(spark, list(cases), paths.relative_to("v", F.lit("/m"))) == list(cases.values())
    assert column(spark, ["a/B.MD", ".bashrc", "x.tar.gz", "d.e/f"], paths.extension("v")) == [".md", "", ".gz", ""]


def test_redaction(spark):
    nested = json.dumps({"API_KEY": "x", "a": {"token": ["s"], "ok": 1, "Password": ""}, "l": [{"secret": False}]})
    assert json.loads(column(spark, [nested], security.redact_json("v"))[0]) == {
        "API_KEY": "***", "a": {"token": "***", "ok": 1, "Password": ""}, "l": [{"secret": False}]}
    assert column(spark, ["GET https://u:p@h/x Bearer abc.d hush"], security.redact_text("v", ["hush"])) == ["GET https://***@h/x Bearer *** ***"]
    got = spark.range(1).select(security.redact_arguments(F.array(*[F.lit(x) for x in ("a", "--key", "--token", "v", "p=1", "k_token=9")])).alias("o"))
    assert got.first()["o"] == ["a", "--key", "***", "v", "p=1", "k_token=***"]


def test_security_log_file(spark, scratch):
    with open(f"{scratch}/log.txt", "wb") as f:
        f.write(b"2024-01-01 10:00:00,123 - WARNING - ACCESO: a: b\n\n  \nsuelta \xff\n")
    rows = records.read_security_log(spark, f"{scratch}/log.txt").collect()
    assert [(r["event"], r["detail"]) for r in rows] == [("ACCESO", "a: b"), (None, None)]


def test_operational_log_round_trip(spark, scratch):
    payload = F.create_map(F.lit("API_KEY"), F.lit("hush"), F.lit("safe"), F.lit("visible"))
    record = records.operational_record(F.lit("t"), F.lit("1"), F.lit("doctor"), F.lit("run"), payload)
    records.write_operational_log(spark.range(2).select(record.alias("record")), scratch + "/log")
    with open(f"{scratch}/log/extra.txt", "w") as f:
        f.write("broken\n")
    rows = records.read_operational_log(spark, scratch + "/log").collect()
    assert len(rows) == 2 and rows[0]["payload"] == {"API_KEY": "***", "safe": "visible"} and rows[0]["event"] == "run"


def test_chat_files(spark, scratch):
    for name, body in {"a": {"id": "a", "nombre": "Uno", "creado": "2024-02-01", "messages": [{"role": "user", "content": "x"}]},
                       "b": {"creado": "2024-03-01"}}.items():
        with open(f"{scratch}/{name}.json", "w") as f:
            json.dump(body, f, indent=1)
    with open(f"{scratch}/c.json", "w") as f:
        f.write("{broken")
    with open(f"{scratch}/note.txt", "w") as f:
        f.write("no chat")
    chats = records.read_chats(spark, scratch)
    assert [(r["id"], r["name"], r["messages"], r["active"]) for r in records.chat_listing(chats, "a").collect()] == [
        ("b", "Sin nombre", 0, False), ("a", "Uno", 1, True)]
    assert [tuple(r) for r in records.chat_turns(chats).collect()] == [("a", 0, "user", "x")]


def test_memory_table(spark, scratch):
    notes = spark.createDataFrame([("Salud", "t", "duerme bien", "r"), ("Otra", "t", "x", "r"), ("Diario", "t", "Jailbreak", "r")],
                                  "category string, ts string, summary string, reason string")
    records.append_memory(notes, scratch + "/memory")
    records.append_memory(notes, scratch + "/memory")
    stored = spark.read.parquet(scratch + "/memory")
    assert [tuple(r) for r in records.memory_view(stored).collect()] == [("Salud", 2)]
    assert os.path.isdir(scratch + "/memory/category=Salud")


def test_artifacts_table(spark, scratch):
    df = spark.createDataFrame([("n.md", "Estudio", "cuerpo")], "name string, category string, text string")
    records.write_artifacts(df, scratch + "/artifacts")
    assert spark.read.parquet(scratch + "/artifacts").first()["category"] == "Estudio"


# --- enrichment ---------------------------------------------------------------------------

def test_one_bad_row_costs_only_itself(spark):
    def one(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string")
    got = {r["p"]: (r["answer"], r["error"]) for r in en.enrich(df, en.per_row(one), "p", partitions=2).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}


def test_cache_reuses_and_replaces(spark):
    docs = spark.createDataFrame([("a", "1", "p"), ("b", "2", "p"), ("c", "1", None), ("d", "1", "bad")], "key string, fingerprint string, prompt string")
    cache = spark.createDataFrame([("a", "1", "old"), ("b", "1", "stale")], "key string, fingerprint string, result string")

    def one(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return "new"

    done = en.with_cache(docs, cache, en.per_row(one), "prompt")
    assert {r["key"]: (r["result"], r["origin"]) for r in done.collect()} == {
        "a": ("old", "cached"), "b": ("new", "new"), "c": (None, "omitted"), "d": (None, "failed")}
    assert {r["key"]: r["result"] for r in en.updated_cache(cache, done).collect()} == {"a": "old", "b": "new"}


def test_cached_results_ask_once_however_often_they_are_used(spark, scratch):
    def one(prompt):
        with open(f"{scratch}/calls", "a") as f:
            f.write(prompt + "\n")
        return "new"

    docs = spark.createDataFrame([(f"k{i}", "1", f"p{i}") for i in range(10)], "key string, fingerprint string, prompt string")
    cache = spark.createDataFrame([("k0", "1", "old")], "key string, fingerprint string, result string")
    done = en.with_cache(docs, cache, en.per_row(one), "prompt")
    assert en.updated_cache(cache, done).count() == 10 and en.run_counts(done).first()["new"] == 9 and done.count() == 10
    with open(f"{scratch}/calls") as f:
        assert sorted(f.read().split()) == [f"p{i}" for i in range(1, 10)]


def test_model_is_asked_once_per_row(spark, scratch):
    """Rows that failed and rows that did not come from one pass."""
    def one(prompt):
        with open(f"{scratch}/calls", "a") as f:
            f.write(prompt + "\n")
        return "PREGUNTA 1:\nENUNCIADO: x\nPUNTAJE: 1"

    made = jobs.exam_questions(spark.createDataFrame([(1, "p1"), (2, "p2")], "request_id int, p string"), en.per_row(one), "p")
    assert made.count() == 2
    with open(f"{scratch}/calls") as f:
        assert sorted(f.read().split()) == ["p1", "p2"]


def test_ranges_of_any_length(spark):
    asked = spark.createDataFrame([("capítulos 2 al 999999999999",), ("capítulos 9 a 3",), ("capítulo 12",), ("nada",), ("capitulos 1 y " + "9" * 30,)], "q string")
    got = [tuple(r) for r in asked.select(tx.chapter_request("q").alias("c"), tx.chapter_range("q").alias("r")).collect()]
    assert [g[0] for g in got] == [[f"capitulo_{i}" for i in range(2, 7)], [], ["capitulo_12"], None, []]
    assert (got[0][1]["low"], got[0][1]["high"]) == (2, 999999999999) and got[3][1] is None


def test_parts_are_bounded_in_bytes(spark):
    """Parts of a group in order are its whole text; none is above the size, a long text is divided."""
    rows = [("g", i, "é" * (5000 if i == 3 else 10 * i)) for i in range(40)] + [("h", 0, ""), ("h", 1, None), (None, 1, "x"), ("h", 2, "ñ")]
    df = spark.createDataFrame(rows, "g string, i long, text string")
    got = jobs.corpus_sections(df, "g", "i", F.col("i").cast("string"), part_bytes=1024).collect()
    assert all(r["bytes"] == len(r.text.encode()) <= 1024 for r in got)
    whole = lambda g: "".join(r.text for r in sorted((r for r in got if r.g == g), key=lambda r: r.part))
    assert whole("g") == "".join(f"\n\n===== {i} =====\n{t}" for _, i, t in rows[:40] if t)
    assert whole("h") == "\n\n===== 2 =====\nñ" and {r.g for r in got} == {"g", "h"}


def test_models_are_asked_once_for_each_prompt(spark, scratch):
    def counting(name, fails):
        def make():
            def client(prompts):
                with open(f"{scratch}/{name}", "a") as f:
                    f.write("".join(f"{p}\n" for p in prompts))
                if fails in prompts:
                    raise ValueError("no")
                return [f"{name} {p}" for p in prompts]
            return client
        return make

    prompts = spark.createDataFrame([(i, f"p{i}" if i != 4 else None) for i in range(6)] + [(0, "p0")], "id long, prompt string")
    out = jobs.compare_models(prompts, {"a": counting("a", None), "b": counting("b", "p2")}, "id", "prompt")
    for _ in range(2):
        got = sorted((r["id"], r["a"], r["b"], r["b_error"]) for r in out.collect())
    assert got == [(i, None, None, None) if i == 4 else (i, f"a p{i}", None if i == 2 else f"b p{i}", "ValueError: no" if i == 2 else None) for i in (0, 0, 1, 2, 3, 4, 5)]
    with open(f"{scratch}/a") as f:
        assert sorted(f.read().split()) == sorted(["p0", "p0", "p1", "p2", "p3", "p5"])
    routed = jobs.route(prompts.filter("prompt IS NOT NULL"), counting("r", None), "prompt")
    assert routed.count() == routed.count() == 6
    with open(f"{scratch}/r") as f:
        assert len(f.read().split()) == 6


def test_other_columns_stay_as_they_are_and_prompts_need_not_come_back(spark):
    rows = [(i, f"p{i}" if i % 3 else None, [i, None], (None, "x") if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, p string, a array<long>, s struct<x:int,y:string>").coalesce(1)
    got = en.enrich(df, en.per_row(lambda p: p.upper()), "p", batch_size=7, keep_prompt=False)
    assert got.columns == ["i", "a", "s", "answer", "error"]
    assert [(r.i, r.a, tuple(r.s) if r.s else None, r.answer) for r in got.orderBy("i").collect()] == [(i, a, s, p and p.upper()) for i, p, a, s in rows]

"""Nearest chunks against brute force, with ties, filters and small blocks."""

import numpy as np
import pytest

from archivolt.operators import search as se


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    # A third of the chunks are copies of one vector: ties must go by key.
    vectors = np.vstack([base, np.repeat(base[:1], 20, axis=0)])
    rows = [(f"c{i:03d}", [float(x) for x in v], f"k{i % 3}", f"capitulo_{i % 4}", f"src{i % 5}_x.md", "t" * (i % 7)) for i, v in enumerate(vectors)]
    asked = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(np.vstack([base[:1], rng.normal(size=(6, 8))]))]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, category string, chapter string, name string, text string")
    return rows, asked, corpus.repartition(5)


def brute(rows, vector, k, keep=lambda r: True):
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    found = sorted((round(1 - float(unit(vector) @ unit(r[1])), 6) + 0.0, r[0]) for r in rows if keep(r))
    return [(c, d) for d, c in found[:k]]


def hits(df, by="rank"):
    out = {}
    for r in df.orderBy("query_id", by).collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["distance"]))
    return out


@pytest.mark.parametrize("block", [2, 2048])
def test_top_k(spark, data, monkeypatch, block):
    rows, asked, corpus = data
    monkeypatch.setattr(se, "BLOCK_ROWS", block)
    questions = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    assert hits(se.top_k(corpus, questions, 7)) == {q: brute(rows, v, 7) for q, v in asked}


@pytest.mark.parametrize("block", [2, 2048])
def test_repeated_questions_are_one_search(spark, data, monkeypatch, block):
    rows, asked, corpus = data
    monkeypatch.setattr(se, "BLOCK_ROWS", block)
    questions = spark.createDataFrame(asked[:1] * 9, "query_id string, embedding array<double>")
    assert hits(se.top_k(corpus, questions, 3)) == {"q0": brute(rows, asked[0][1], 3)}


def test_buckets_find_most_of_the_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(f"c{i:03d}", [float(x) for x in centres[i % 12] + 0.15 * rng.normal(size=16)]) for i in range(240)]
    asked = [(f"q{i}", [float(x) for x in centres[i]]) for i in range(12)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4)
    questions = spark.createDataFrame(asked + asked[:1], "query_id string, embedding array<double>")
    near, exact = hits(se.near_top_k(corpus, questions, 5)), hits(se.top_k(corpus, questions, 5))
    found = sum(len(set(near.get(q, [])) & set(want)) for q, want in exact.items())
    assert found >= 0.9 * 60 and all(len(v) <= 5 for v in near.values())


def test_filters(spark, data):
    rows, asked, corpus = data
    wanted = [(q, v, c, h) for (q, v), (c, h) in zip(asked, [("k1", None), (None, "capitulo_2"), ("k2", "capitulo_1"), ("none", None)])]
    questions = spark.createDataFrame(wanted, "query_id string, embedding array<double>, category string, chapter string")
    want = {q: brute(rows, v, 4, lambda r: (not c or r[2] == c) and (not h or r[3] == h)) for q, v, c, h in wanted}
    assert hits(se.top_k(corpus, questions, 4)) == {q: v for q, v in want.items() if v}


def test_name_search_and_fallback(spark, data):
    rows, asked, corpus = data
    questions = spark.createDataFrame(
        [(asked[0][0], asked[0][1], ["src1", "src"]), (asked[1][0], asked[1][1], ["zz", "nada"])],
        "query_id string, embedding array<double>, keywords array<string>")
    got = hits(se.name_search(corpus, questions, 4), "position")
    first = brute(rows, asked[0][1], 4, lambda r: "src1" in r[4])
    second = [h for h in brute(rows, asked[0][1], 4, lambda r: "src" in r[4]) if h[0] not in {c for c, _ in first}]
    assert got == {"q0": first + second, "q1": brute(rows, asked[1][1], 4)}


def test_hybrid_keeps_or_falls_back(spark, data):
    rows, asked, corpus = data
    length = {r[0]: len(r[5]) for r in rows}
    total = {q: sum(length[c] for c, _ in brute(rows, v, 3)) for q, v in asked}
    limit = sorted(total.values())[len(total) // 2]
    questions = spark.createDataFrame([(q, v, ["src2"]) for q, v in asked], "query_id string, embedding array<double>, keywords array<string>")
    got = hits(se.hybrid_search(corpus, questions, 3, limit), "position")
    assert got == {q: brute(rows, v, 3) if total[q] >= limit else brute(rows, v, 3, lambda r: "src2" in r[4]) for q, v in asked}


def test_zero_vector_is_far_from_everything(spark, data):
    _, _, corpus = data
    questions = spark.createDataFrame([("z", [0.0] * 8)], "query_id string, embedding array<double>")
    assert hits(se.top_k(corpus, questions, 2)) == {"z": [("c000", 1.0), ("c001", 1.0)]}


def test_no_questions(spark, data):
    questions = spark.createDataFrame([], "query_id string, embedding array<double>")
    assert se.top_k(data[2], questions, 2).count() == 0


def test_lexical_vectors_are_unit_and_compare_words(spark):
    df = spark.createDataFrame([(1, "Gato perro casa"), (2, "casa GATO perro"), (3, "otra cosa distinta")], "i int, text string")
    rows = {r["i"]: np.array(r["embedding"]) for r in se.lexical_vectors(df, dims=512).collect()}
    assert np.allclose(rows[1], rows[2]) and abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and rows[1] @ rows[3] < 0.5


def test_rare_words_weigh_more(spark):
    df = spark.createDataFrame([(i, f"comun palabra{i}") for i in range(6)], "i int, text string")
    plain = {r["i"]: np.array(r["embedding"]) for r in se.lexical_vectors(df, dims=512).collect()}
    weighted = {r["i"]: np.array(r["embedding"]) for r in se.lexical_vectors(df, dims=512, weights=se.word_weights(df, dims=512)).collect()}
    assert weighted[0] @ weighted[1] < plain[0] @ plain[1] and abs(np.linalg.norm(weighted[0]) - 1) < 1e-6


def test_lexical_search_equals_brute_force(spark):
    texts = ["el muestreo aleatorio simple", "derecho constitucional argentino", "muestreo por conglomerados", "receta de cocina"]
    corpus = se.lexical_vectors(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string"))
    asked = se.lexical_vectors(spark.createDataFrame([("q", "muestreo simple")], "query_id string, text string"))
    rows = [(r["chunk_id"], list(r["embedding"])) for r in corpus.collect()]
    assert hits(se.top_k(corpus, asked, 3)) == {"q": brute(rows, asked.first()["embedding"], 3)}


def test_model_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "i int, text string")
    got = se.model_vectors(df, lambda: (lambda texts: [[len(t), 1] for t in texts])).orderBy("i").collect()
    assert [list(r["embedding"]) for r in got] == [[2.0, 1.0], [3.0, 1.0]]


def test_chunks_stay_in_place(spark, data):
    """Hits travel to the chunks, never the other way round."""
    rows, asked, corpus = data
    questions = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    joined = se.with_payload(se.top_k(corpus, questions, 3), corpus, ["text"])
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_hashed_words_with_and_without_weights_share_their_places(spark):
    """Vectors without weights equal those counted by the vectoriser of the weights, blanks and words of other scripts included."""
    from pyspark.ml.functions import vector_to_array

    texts = ["Uno dos, uno!", "¿qué? ñandú_1 日本", "", " ", "--", "ẞ İ ΑΣ", "a\x0bb\nc", None, "x y " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [r.embedding for r in se.lexical_vectors(df, dims=32).orderBy("i").collect()]
    counted = [r.v for r in se._hashed_words(df, "text", 32).select("i", vector_to_array("_tf").alias("v")).orderBy("i").collect()]
    for own, both in zip(got, counted):
        signed = np.array(both[:32]) - np.array(both[32:])
        length = np.sqrt((signed * signed).sum())
        assert own == (signed / length if length else signed).astype(np.float32).tolist()
    plan = se.lexical_vectors(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "zip_with" not in plan

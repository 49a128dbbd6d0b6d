"""The pipeline's stages, and all of them in order, against plain readings of what each should keep."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from archivolt.llm import mixing, quality, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return (text or "").lower().split()


def _shingles(text, n=5):
    w = _words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def _kept(rows, percent=80):
    """Rows that near-dedup keeps, by comparing every pair: of each group the smallest id, of equal rows one."""
    rows = list(dict.fromkeys(r for r in rows if _words(r[1]))) + [r for r in rows if not _words(r[1])]
    sets, up = [_shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i) if sets[i] else -1 - i].append(r)
    return groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with copies, odd rows and a column more."""
    draw = random.Random(5)
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = [r for r in rows if len(_words(r[1])) > 60]
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, " \n ", "en", "src0", 3), (9002, " \n ", "en", "src0", 3), (None, "alpha beta", "en", "s", 10)]
    near = [(9100 + i, " ".join(_words(r[1])[:-1] + ["other"]), r[2], r[3], 1) for i, r in enumerate(long[:6])]
    same = [(9200, *long[7][1:]), (None, *long[8][1:]), tuple(long[9]), tuple(long[9])]
    leaks = [(9300, f"{long[10][1]} {item} {long[11][1]}", "en", "src1", 1)]
    words = sorted({w for r in long for w in _words(r[1])})
    fresh = [(9400, " ".join(draw.choice(words) for _ in range(80)), "en", "src2", 1), (9400, " ".join(draw.choice(words) for _ in range(80)), "en", "src2", 1)]
    spark.createDataFrame(rows + odd + near + same + leaks + fresh, SCHEMA).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path, rows + odd + near + same + leaks + fresh, item


def _rows(df):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect())


def _read(spark, folder, name="documents"):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_filters_keep_what_their_classifiers_pass(spark, folder):
    path, _, _ = folder
    docs, labels = _read(spark, path), _read(spark, path, "labels")
    for stage, found in ((cp.drop_toxic, toxicity.classify(docs, labels).where("predicted = 0")), (cp.drop_low_quality, quality.classify(docs, labels).where("predicted = 1"))):
        kept = stage(spark, docs, path)
        assert kept.columns == COLUMNS
        assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in found.collect())


def test_one_row_of_each_group_stays(spark, folder):
    path, rows, _ = folder
    got = _rows(cp.drop_near_copies(spark, _read(spark, path), path))
    groups = _kept(rows)
    assert sum(got.values()) == len(groups)
    for group in groups.values():
        best = min(group, key=lambda r: (r[0] is None, r[0] or 0))
        assert sum(got[r] for r in set(group)) >= 1 and (any(got[r] for r in group if r[0] == best[0]))


def test_documents_that_hold_an_item_go(spark, folder):
    path, rows, item = folder
    got = _rows(cp.drop_benchmark_leaks(spark, _read(spark, path), path))
    items = [" ".join(_words(r.text)) for r in _read(spark, path, "benchmark").collect()]
    holds = lambda r: any(f" {i} " in f" {' '.join(_words(r[1]))} " for i in items if i)
    assert not any(holds(r) for r in got) and any(holds(r) for r in rows)
    assert all(got[r] for r in rows if r[0] in (9001, 9002, 9400) or r[1] is None)
    assert got - collections.Counter(rows) == collections.Counter()


def test_the_mix_comes_near_its_targets(spark, folder):
    path, rows, _ = folder
    got = cp.mix_to_weights(spark, _read(spark, path), path).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == size[r.source] and 0 < r.taken <= 3 * len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= max(1, size[s] // mixing.BLOCKS) for s in target)
    assert sum(target.values()) <= sum(size.values()) + 1


def test_run_is_the_stages_in_order(spark, folder):
    path, rows, item = folder
    assert [name for name, _ in cp.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "mixing"]
    out = cp.run(spark, path)
    assert out.columns == COLUMNS + ["size", "source_size", "target", "taken", "pieces"]
    docs = _read(spark, path)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
    key = lambda df: collections.Counter((r.doc_id, r.text, r.source, r.taken) for r in df.collect())
    assert key(out) == key(docs)
    got = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    assert got and not any(" ".join(_words(item)) in " ".join(_words(t)) for _, t in got)
    texts = [t for _, t in got]
    assert len(texts) == len(set(texts)) and collections.Counter(got) - collections.Counter((r[0], r[1]) for r in rows) == collections.Counter()


def test_empty_tables_and_columns_of_the_same_names(spark, folder):
    path, _, _ = folder
    docs = _read(spark, path)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), path).collect() == []
        if name not in ("toxicity", "quality"):
            more = docs.where("doc_id < 20").withColumns({c: F.lit("x") for c in ("_key", "key", "class", "_row", "label", "score")})
            assert all(r["_key"] == r["class"] == r["_row"] == r["score"] == "x" for r in stage(spark, more, path).collect())

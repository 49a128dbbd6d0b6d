import random

import pytest

from archivolt.operators import cells as ce, search as se

CHUNK = "chunk_id long, embedding array<float>, category string, chapter string, name string"
ASK = "query_id string, sub int, embedding array<float>, category string, chapter string, name_has string"


def _clustered(seed, n, dim=6, groups=9):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [[x + draw.gauss(0, 0.08) for x in centres[i % groups]] for i in range(n)]


def _same(spark, chunks, asks, k, n_cells):
    corpus, asked = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(asks, ASK)
    found, work = ce.nearest(ce.make_cells(corpus, cells=n_cells), asked, k)
    key = ["query_id", "sub", "rank", "chunk_id", "distance"]
    got, want = (sorted(tuple(r) for r in df.select(*key).collect()) for df in (found, se.top_k(corpus.filter("embedding IS NOT NULL"), asked.filter("embedding IS NOT NULL"), k)))
    assert got == want
    return work.first()


@pytest.mark.parametrize("k, n_cells", [(1, 9), (5, 9), (5, 40), (700, 9)])
def test_equals_the_scan(spark, k, n_cells):
    chunks = [(i, v, f"c{i % 3}", f"t{i % 4}", f"name {i % 11}") for i, v in enumerate(_clustered(1, 600))]
    # Ties, repeated vectors, vectors without length, and none.
    chunks += [(1000 + i, chunks[0][1], "c0", None, None) for i in range(20)] + [(2000, [0.0] * 6, "c1", "t0", "x"), (2001, [0.0] * 6, "c0", "t0", "x"), (2002, None, "c0", "t0", "x")]
    asks = [(f"q{i}", 0, v, None, None, None) for i, v in enumerate(_clustered(2, 30))]
    asks += [("own", 0, chunks[0][1], None, None, None), ("zero", 0, [0.0] * 6, None, None, None), ("none", 0, None, None, None, None), ("q0", 0, asks[0][2], None, None, None)]
    asks += [(f"f{i}", i % 2, v, f"c{i % 3}", "t1" if i % 2 else None, "name 1" if i % 4 == 0 else None) for i, v in enumerate(_clustered(3, 12))]
    asks += [("nothing", 0, chunks[5][1], "absent", None, None)]
    work = _same(spark, chunks, asks, k, n_cells)
    assert work.chunks == 622 and 0 <= work.skipped_share <= 1


def test_far_cells_are_left_out(spark):
    chunks = [(i, v, None, None, None) for i, v in enumerate(_clustered(4, 900))]
    asks = [(f"q{i}", 0, chunks[i][1], None, None, None) for i in range(0, 900, 30)]
    assert _same(spark, chunks, asks, 5, 9).skipped_share > 0.7


def test_empty_tables(spark):
    corpus, asked = spark.createDataFrame([(1, [1.0, 0.0], None, None, None)], CHUNK), spark.createDataFrame([("q", 0, [1.0, 0.0], None, None, None)], ASK)
    assert ce.nearest(ce.make_cells(corpus.limit(0)), asked, 3)[0].count() == 0
    found, work = ce.nearest(ce.make_cells(corpus), asked.limit(0), 3)
    assert found.count() == 0 and work.first().skipped_share is None
    assert [tuple(r) for r in ce.nearest(ce.make_cells(corpus), asked, 3)[0].collect()] == [("q", 0, 1, 1, 0.0)]

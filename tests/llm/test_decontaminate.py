import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.llm import decontaminate as d

ITEM = "A train leaves Paris at 9 and drives 120 km to Lyon with 3 stops of 5 minutes each before it turns back toward Paris again"
LONG = "we consider the set of all words that a careful reader would find in this rather plain passage about nothing"


@pytest.fixture()
def items(frame):
    rows = [(7, ITEM), (9, LONG), (8, LONG), (10, "red green blue"), (11, None), (12, ""), (13, "..."), (None, "some words without an id that are long enough to be found")]
    return frame(rows, "item_id long, text string", extra=("key", "slots", "doc_key"))


def _found(docs, items, rows):
    return {(r.doc_id, r.item_id) for r in d.leaks(docs(rows), items).collect()}


def test_exact_and_renamed_passages(docs, items):
    other = ITEM.replace("Paris", "Bern").replace("Lyon", "Genf").replace("120", "300").replace("9", "7").replace("3 stops", "4 stops").replace("5", "6")
    torn = other.replace("toward Bern", "toward Rom")  # one name for two
    rows = [
        (1, "before it. " + ITEM + " after it"), (2, "so. " + other + " ok"), (3, "so. " + torn), (4, "x " * 4000 + LONG.upper() + " y" * 4000),
        (5, None), (6, ""), (20, "nothing of the kind is in here at all, not even a number like 5 or a name like Paris"), (21, "red green, blue!"),
        (22, " ".join(LONG.split()[:6])), (23, "so. " + ITEM), (23, "another text"), (None, LONG), (24, LONG + " " + ITEM), (24, LONG + " " + ITEM),
    ]
    got = _found(docs, items, rows)
    assert {(1, 7), (2, 7), (4, 8), (21, 10), (23, 7), (None, 8), (24, 7), (24, 8)} <= got
    assert {i for i, _ in got} == {1, 2, 4, 21, 23, None, 24} | ({3} & {i for i, _ in got})
    by = {(r.doc_id, r.item_id): r for r in d.leaks(docs(rows), items).collect()}
    assert by[2, 7].renamed and not by[1, 7].renamed
    # A torn renaming counts at most as far as its consistent run.
    assert (3, 7) not in by or by[3, 7].covered < by[2, 7].covered
    table = docs(rows)
    kept = d.without_leaks(table, items)
    assert kept.columns == table.columns
    want = [r for r in rows if r[0] not in (1, 2, 4, 21, None, 24) and not (r[0] == 23 and "train" in r[1]) and not (r[0] == 3 and (3, 7) in by)]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in want)


def test_inconsistent_slots_do_not_count(docs, frame):
    item = "if x costs 5 and y costs 7 then x and y cost 12 while 5 of x cost 25 says Anna to Otto and Anna is right about 5"
    items = frame([(1, item)], "item_id long, text string", extra=())
    same = item.replace("5", "8").replace("28", "28")
    mixed = "if x costs 1 and y costs 1 then x and y cost 1 while 2 of x cost 3 says Karl to Karl and Eva is right about 4"
    assert _found(docs, items, [(1, same), (2, mixed)]) == {(1, 1)}


def test_runs_are_united_and_long_rows_found(docs, frame):
    long = [f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(200)]
    items = frame([(1, " ".join(long[:40])), (2, " ".join(long[40:]))], "item_id long, text string", extra=())
    edited = [w for i in range(0, 40, 13) for w in long[i:i + 13] + ["more"]]
    rows = [(1, " ".join(edited)), (2, "so " + " ".join(long[5:20]) + " ok"), (3, " ".join(long[60:138])), (4, " ".join(long[0:12])), (5, " ".join(long[60:71]))]
    assert {(r.doc_id, r.item_id, r.covered, r.renamed) for r in d.leaks(docs(rows), items).collect()} == {
        (1, 1, 39, False), (2, 1, 15, False), (3, 2, 78, False)}


def test_names_that_begin_sentences(docs, frame):
    items = frame([(1, "Tom has 3 apples. Anna has 5 apples. Who has more?"), (2, "What is the capital of France?")], "item_id long, text string", extra=())
    rows = [
        (1, "So. Peter has 4 apples. Eva has 7 apples. Who has more?"), (2, "Question\nWhat is the capital of France?"), (3, "x. what is the capital of France?"),
        (4, "and then Peter has 4 apples. Eva has 7 apples. who has more?"), (5, "Peter has 4 apples. Peter has 7 apples. Who has more?"),
        (6, "Tom has 3 pears. Anna eats 5 apples. Who was it?"),
    ]
    got = {(r.doc_id, r.item_id): r.renamed for r in d.leaks(docs(rows), items).collect()}
    assert got == {(1, 1): True, (2, 2): False, (3, 2): False, (4, 1): True}


def test_empty_tables(docs, items, frame):
    none = frame([], "item_id long, text string", extra=())
    assert d.leaks(docs([]), items).collect() == [] and d.leaks(docs([(1, ITEM)]), none).collect() == []
    assert d.without_leaks(docs([(1, ITEM)]), none).count() == 1


def test_the_filter_loses_nothing(spark):
    import numpy as np

    from archivolt.llm.tables import may_hold, slot_filter

    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 3000)
    keys[:4] = [0, -1, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "key long")
    bits = slot_filter(df, "key")
    assert may_hold(bits, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 100000)
    assert may_hold(bits, other.view(np.uint64)).mean() < 0.001
    assert not may_hold(slot_filter(df.where(F.lit(False)), "key"), keys.view(np.uint64)).any()


def test_planted_passages_against_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    texts = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = {(i, r.item_id) for i, t in texts for r in items.collect() if plain(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == want != set()


@pytest.mark.parametrize("wide", [3, 8])
def test_windows_range_by_range_are_all_windows(monkeypatch, wide):
    """Keys that are made range by range are those made at once, whatever the range and the texts' edges."""
    draw = np.random.default_rng(3)
    first = np.array([0, 0, 5, 6, 40, 90, 90, 97, 200])
    codes, slots = draw.integers(1, 9, 200).astype(np.uint64), (draw.integers(0, 3, 200) == 0).astype(np.uint64)
    maybe = draw.integers(0, 4, 200) == 0
    everything = np.full(1 << 22, 255, np.uint8)
    whole = sorted(zip(*(x.tolist() for x in d.window_keys(codes, slots, first, maybe, wide))))
    for size in (1, 7, 64, 1 << 13):
        monkeypatch.setattr(d, "AT_ONCE", size)
        assert sorted(t for part in d.sought_windows(codes, slots, first, maybe, wide, everything) for t in zip(*(x.tolist() for x in part))) == whole


def test_a_long_list_of_names_keeps_to_its_memory(docs, items):
    """Tens of thousands of sentences of one capitalised word in one text, with an item at its end."""
    text = " ".join(f"Name{i}." for i in range(60_000))
    assert _found(docs, items, [(1, text), (2, text + " " + LONG)]) == {(2, 8)}

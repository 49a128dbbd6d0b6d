"""Near-duplicate documents by SuperMinHash signatures.

A document's set holds its distinct word shingles.  SuperMinHash gives each
shingle a random order of the signature's places and a rank in each: in round j
a shingle takes its j-th place with the value j + u, u uniform in [0, 1).  A
place keeps the smallest value.  Since the ranks of one shingle are a
permutation, places are filled evenly and the estimate of the Jaccard
similarity varies less than with independent hashes; once no place holds more
than j + 1, later rounds cannot change it and the document is done.

Documents with equal sets form a class.  Classes that agree on all places of a
band are candidates; candidates are confirmed on the full sets and joined by
union-find.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.components import components
from archivolt.llm.tables import WORD, as_long, doc_key, map_batches, may_hold, slot_filter
from archivolt.llm.words import Words, mix, n_grams, stretches
from archivolt.session import checkpoint as _written

#: Places of a signature and places of a band.  Two sets of similarity 0.85 miss
#: each other in all 21 bands with a chance of (1 - 0.85**3)**21 = 2e-9, of
#: similarity 0.8 with 3e-7.
PLACES, ROWS = 63, 3


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` and lets the shuffle files of what led to it go.

    Spark deletes them when the driver's collector finds their plans unused,
    which may be long after; there are many steps here, each with its own.
    """
    jvm = df.sparkSession._jvm
    out = _written(df)
    del df
    gc.collect()
    jvm.System.gc()
    return out


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin.

    A text with fewer than ``n`` words has its whole sequence as one shingle.
    """
    hashes, at = n_grams(words, n)
    count = np.diff(words.first)
    texts = [hashes]
    owners = [np.searchsorted(words.first, at, "right") - 1]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            sums = np.full(len(short), k, np.uint64)
            for j in range(k):
                sums = mix(sums) + words.hash[words.first[short] + j]
            texts.append(mix(sums))
            owners.append(short)
    hashes, owners = np.concatenate(texts), np.concatenate(owners)
    if len(texts) > 1:
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    first = np.searchsorted(owners, np.arange(len(count) + 1))
    for a, b in zip(first[:-1], first[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], np.searchsorted(owners[new], np.arange(len(count) + 1))


def super_minhash(elements: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """Signatures of the sets ``elements[first[i]:first[i + 1]]``, one row each; empty sets keep infinity."""
    sets = len(first) - 1
    signature = np.full((sets, places), np.inf)
    flat = signature.ravel()
    live = elements
    base = np.repeat(np.arange(sets), np.diff(first)) * places
    order = previous = None
    for j in range(places):
        draw = mix(live + np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        pick = j + (((draw >> np.uint64(40)) * np.uint64(places - j)) >> np.uint64(24)).astype(np.int64)
        value = j + (draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        if j == 0:
            place = previous = pick
        else:
            if j == 1:
                order = np.tile(np.arange(places, dtype=np.uint16), (len(live), 1))
                row = np.arange(len(live))
                order[row, previous], order[:, 0] = 0, previous
            row = np.arange(len(live))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, base + place, value)
        # A later rank is j + 1 at least: only sets with a larger value go on.
        open_sets = signature.max(axis=1) > j + 1
        go = open_sets[base // places]
        if not go.any():
            break
        if not go.all():
            live, base = live[go], base[go]
            order = order[go] if order is not None else None
            previous = previous[go]
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` places."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    sums = np.tile(np.arange(1, bits.shape[1] + 1, dtype=np.uint64), (len(bits), 1))
    for k in range(rows):
        sums = mix(sums) + bits[:, :, k]
    return mix(sums)


def _class_keys(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set, equal for equal sets."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(first))
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
        if len(full):
            out[full, k] = np.add.reduceat(mix(elements ^ np.uint64(salt)), first[full])
    out[:, 0] ^= mix(np.diff(first).astype(np.uint64))
    return out


def signatures(docs: DataFrame, n: int, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, class, doc_key, bands`` for each document.

    ``class`` is equal for equal sets; ``doc_key`` is :func:`tables.doc_key` of
    the row.  ``class`` and ``bands`` are null for an empty set.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, words in stretches(batch.column(1)):
            sets, first = shingle_sets(words, n)
            size = np.diff(first)
            bands = band_keys(super_minhash(sets, first, places), rows)
            empty = pa.array(size == 0)
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), as_long(bands.ravel()), mask=empty)
            ids, names = (batch.column(k).slice(lo, hi - lo) for k in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size), pc.if_else(empty, None, _binary(_class_keys(sets, first))), names, lists],
                ["doc_id", "n_shingles", "class", "doc_key", "bands"],
            )

    return map_batches(_slim(docs), work, "doc_id long, n_shingles long, class binary, doc_key long, bands array<long>")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), doc_key(docs).alias("doc_key"))


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in keys], pa.binary())


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``class, members`` of the classes in ``wanted (class, doc_key)``: sorted shingle hashes, 8 bytes each.

    One document speaks for a class.  The others are kept away early by a filter
    of fixed size and for certain by a join.
    """
    bits = docs.sparkSession.sparkContext.broadcast(slot_filter(wanted, "doc_key"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.column(2).to_numpy().view(np.uint64)
        texts = batch.column(1).filter(pa.array(may_hold(bits.value, names)))
        for _, _, words in stretches(texts):
            sets, first = shingle_sets(words, n)
            keys = _class_keys(sets, first)
            some = np.flatnonzero(np.diff(first))
            members = [sets[first[i]:first[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([_binary(keys[some]), pa.array(members, pa.binary())], ["class", "members"])

    found = map_batches(_slim(docs), work, "class binary, members binary")
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs (a, b)`` of classes whose full sets have 100 * intersection >= percent * union."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = 100 * shared >= percent * (len(both) - shared)
        yield batch.select([0, 1]).filter(pa.array(keep))

    sized = sets.withColumn("size", F.length("members"))
    of = lambda side: sized.select(F.col("class").alias(side), F.col("members").alias(f"set_{side}"), F.col("size").alias(f"size_{side}"))
    # Lengths first: they are short, and most wrong pairs differ in length.
    lengths = pairs.join(of("a").drop("set_a"), "a").join(of("b").drop("set_b"), "b")
    fit = lengths.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")).select("a", "b")
    whole = fit.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b")
    return map_batches(whole, work, "a binary, b binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every set on the left with every set on the right."""
    sizes = [len(x) for x in left + right]
    _, code, count = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    common = count[code] > 1
    owner, code = owner[common], np.unique(code[common], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = max(256, min(4096, (1 << 24) // len(sizes)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (lo, lo + width))
        part = np.zeros((len(sizes), width), np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        out += part[:len(left)] @ part[len(left):].T
    return out


#: Shingles of the sets on one side of a test of many sets against many, and of small buckets that share a task.
SIDE, PACK = 1 << 18, 1 << 16
#: Shingles of large buckets of one component that are tested as one, on the average.
BUNDLE = 64 * SIDE


def _links_between(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between the members of ``placed (key, class, root, main, out)`` that are ``out`` and those of their buckets in other components.

    Small buckets share a task.  Large ones with one main component are mostly
    the same members again, band after band: up to :data:`BUNDLE` shingles of
    them are tested as one.  Both sides are dealt into parts of about
    :data:`SIDE` shingles by hash, and a task gets one part of either; what is
    one part on both sides is shipped once.  Only links leave a task, never
    pairs.
    """
    sized = placed.join(sets.select("class", (F.length("members") / 8).cast("long").alias("size")), "class")
    total = checkpoint(sized.groupBy("key").agg(F.sum("size").alias("total"), F.first("main").alias("main")))
    small = F.col("total") < PACK // 2
    packs = 1 + (total.where(small).agg(F.sum("total").alias("all")).collect()[0][0] or 0) // PACK
    bundles = total.where(~small).groupBy("main").agg(F.ceil(F.sum("total") / BUNDLE).alias("bundles"))
    pack = F.when(small, F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.xxhash64("main", F.pmod(F.xxhash64("key"), F.col("bundles"))))
    packed = total.join(bundles, "main", "left").select("key", pack.alias("pack"))
    dealt = sized.join(packed, "key").groupBy(F.col("pack").alias("key"), "class").agg(F.first("size").alias("size"), F.first("root").alias("root"), F.max("out").alias("out"))
    dealt = checkpoint(dealt)
    parts = dealt.groupBy("key").agg(
        F.ceil(F.sum("size") / SIDE).alias("wide"), F.ceil(F.sum(F.when(F.col("out"), F.col("size"))) / SIDE).alias("tall")
    ).where("tall > 0")
    dealt = dealt.join(parts, "key")
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = dealt.where("out AND wide + tall > 2").select("key", part("tall").alias("i"), each("wide").alias("j"), "class", "root", F.lit(True).alias("left"), "out")
    right = dealt.select("key", each("tall").alias("i"), part("wide").alias("j"), "class", "root", F.lit(False).alias("left"), (F.col("out") & (F.col("wide") + F.col("tall") == 2)).alias("out"))

    def work(table: pa.Table) -> pa.Table:
        # Of what is shipped once, those that are out are the left side too.
        sides = [table.filter(table["out"]), table.filter(pc.invert(table["left"]))]
        names, roots, members = ([side[c].to_pylist() for side in sides] for c in ("class", "root", "members"))
        a, b = [], []
        if names[0] and names[1]:
            x, y = ([np.frombuffer(m, np.uint64) for m in side] for side in members)
            both = _shared(x, y).astype(np.int64)
            union = np.array([len(m) for m in x])[:, None] + np.array([len(m) for m in y]) - both
            number = {r: k for k, r in enumerate({*roots[0], *roots[1]})}
            left_root, right_root = (np.array([number[r] for r in side]) for side in roots)
            i, j = np.nonzero((100 * both >= percent * union) & (left_root[:, None] != right_root))
            # One link to each component is enough.
            _, once = np.unique(i * len(number) + right_root[j], return_index=True)
            a, b = [names[0][k] for k in i[once]], [names[1][k] for k in j[once]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    rows = left.unionByName(right).join(sets, "class")
    return rows.groupBy("key", "i", "j").applyInArrow(work, "a binary, b binary")


def _tops(links: DataFrame) -> DataFrame:
    """``node, root`` of the links ``(a, b)`` from each ``b`` to one ``a``: three steps up, all of the way in most groups.

    A class and its pivot's pivot are of one component; what is not yet seen to
    be costs tests, no links.
    """
    up = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(2):
        higher = up.select(F.col("node").alias("root"), F.col("root").alias("_higher"))
        up = checkpoint(up.join(higher, "root", "left").select("node", F.coalesce("_higher", "root").alias("root")))
    return up


def _outsiders(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, class, root, main, out`` of the buckets whose members lie in several components; ``out`` are those outside the main one."""
    placed = members.join(roots, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    per_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = per_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    return checkpoint(placed.join(mixed.select("key", F.col("most.root").alias("main")), "key").select("key", "class", "root", "main", (F.col("root") != F.col("main")).alias("out")))


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The :func:`signatures` of ``docs``, and ``class, low, root`` of each class.

    ``low`` is its smallest id; classes of one component have one root.

    No group is gathered and no group's pairs become rows.  Each class is first
    tested against the pivot that most of its buckets share; a bucket's pivot is
    the class whose buckets are fullest, the centre of a group of copies.  That
    joins most of a large group.  Members that then lie outside their bucket's
    main component are tested against all of it, see :func:`_links_between`.
    """
    signed = checkpoint(signatures(docs, n))
    full = signed.where("class IS NOT NULL")
    # Dealt by key once: the aggregate and the join below find it so.
    bands = full.select("class", F.explode("bands").alias("key")).repartition("key")
    # Buckets of one class have no pairs; short hashes of the classes tell.
    shared = bands.groupBy("key").agg(F.min(F.xxhash64("class")).alias("low"), F.max(F.xxhash64("class")).alias("high")).where("low <> high")
    members = checkpoint(bands.join(shared.select("key"), "key").distinct())
    classes = full.groupBy("class").agg(F.min("doc_id").alias("low"), F.min("doc_key").alias("doc_key"))
    del bands, shared
    wanted = checkpoint(classes.join(members.select("class").distinct(), "class", "left_semi").select("class", "doc_key"))
    sets = checkpoint(_sets(docs, wanted, n))

    counts = members.groupBy("key").agg(F.count("*").alias("n"))
    weights = members.join(counts, "key").groupBy("class").agg(F.sum("n").alias("weight"))
    pivots = members.join(weights, "class").groupBy("key").agg(F.max(F.struct("weight", "class")).alias("pivot"))
    votes = members.join(pivots, "key").where(F.col("class") != F.col("pivot.class")).groupBy("class", "pivot").agg(F.count("*").alias("n"))
    best = votes.groupBy("class").agg(F.max(F.struct("n", "pivot")).alias("best"))
    links = checkpoint(confirmed(best.select(F.col("best.pivot.class").alias("a"), F.col("class").alias("b")), sets, percent))
    roots = components(links)

    del counts, weights, pivots, votes, best
    links = checkpoint(links.unionByName(_links_between(_outsiders(members, roots), sets, percent)))
    roots = components(links)
    return signed, classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("root", "class").alias("root"))


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document.

    Two documents are linked when the sets of their distinct ``n``-word shingles
    have a similarity of ``percent`` in 100 or more; ``component_id`` is the
    smallest id that links lead to, ``kept`` says that it is the document's own.
    A text with fewer than ``n`` words has its whole sequence as one shingle.
    Texts that are null, empty or blank have no shingles, are linked with
    nothing and are kept.  A null id is passed over when the smallest is
    sought; in a group of null ids only, ``component_id`` is null and ``kept``
    true.  Repeated rows have one id and so the same answer.  Other columns are
    not read; an empty table gives no rows.
    """
    signed, grouped = _linked(docs, n, percent)
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = grouped.join(lows, "root").select("class", "component_id")
    return signed.join(answer, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group stays, that with the smallest id; all columns are kept.

    Rows are told apart by id and text (:func:`tables.doc_key`), so rows with
    one id or none and other texts are each kept or dropped with their own
    group.  A null id comes after all others; of repeated rows any one stays.
    Texts without words are no copies of each other and all stay.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    signed, grouped = _linked(docs, n, percent)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key")
    firsts = signed.where("class IS NOT NULL").groupBy("class").agg(F.min(own).alias("first"))
    kept = firsts.join(grouped, "class").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_key").alias(name))
    worded = F.coalesce(docs["text"].cast("string").rlike(WORD), F.lit(False))
    # The join and the choice among repeated rows share one shuffle of the texts.
    rows = docs.where(worded).withColumn(name, doc_key(docs)).join(kept, name, "left_semi").dropDuplicates([name])
    return rows.select(*docs.columns).unionByName(docs.where(~worded))

"""Nearest chunks by cosine distance: filtered, by name, hybrid, per chapter.

Exact search.  Questions are few and chunks are many, so a bounded block of
question vectors travels to the chunks: every task multiplies its Arrow
batches with that block and keeps only its own ``k`` best per question, which
a small window then merges.  No pair of question and chunk is ever a row.
More questions than one block holds are worked off block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from archivolt import fixed
from archivolt.functions.text import strip
from archivolt.operators.ordered import first_seen, joined_text, rows_of
from archivolt.session import checkpoint

# One block of questions: at most this many rows and bytes are sent to tasks.
BLOCK_ROWS = 2048
BLOCK_BYTES = 64 << 20
FILTERS = ("category", "chapter", "name_has")


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _cut(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["q", "distance", "id"], kind="stable")
    return found[found.groupby("q").cumcount() < k]


def _scan(corpus: DataFrame, block: pd.DataFrame, k: int, key: str) -> DataFrame:
    """Best ``k`` chunks of each question in ``block``, per task of the corpus."""
    units = _unit(block["embedding"])
    # Questions with the same filters share one mask and one multiplication.
    groups = [
        (dict(zip(FILTERS, f)), rows.index.to_numpy())
        for f, rows in block.reset_index(drop=True).fillna({c: "" for c in FILTERS}).groupby(list(FILTERS), sort=False)
    ]
    names = block[["query_id", "sub"]].reset_index(drop=True)
    schema = T.StructType([
        T.StructField("query_id", T.StringType()), T.StructField("sub", T.IntegerType()),
        T.StructField(key, corpus.schema[key].dataType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for frame in batches:
            found = [] if best is None else [best]
            for at in range(0, len(frame), 2048):
                found += _part(frame.iloc[at:at + 2048])
            if found:
                best = _cut(pd.concat(found, ignore_index=True), k)
        if best is not None and len(best):
            yield pd.DataFrame({
                "query_id": names["query_id"].to_numpy()[best["q"]], "sub": names["sub"].to_numpy()[best["q"]].astype("int32"),
                key: best["id"].to_numpy(), "distance": best["distance"].to_numpy()})

    def _part(frame: pd.DataFrame) -> list[pd.DataFrame]:
        out, vectors = [], _unit(frame["embedding"])
        ids = frame[key].to_numpy()
        for wanted, rows in groups:
            mask = np.ones(len(frame), dtype=bool)
            for column in ("category", "chapter"):
                if wanted[column]:
                    mask &= (frame[column] == wanted[column]).to_numpy(dtype=bool)
            if wanted["name_has"]:
                mask &= frame["name"].str.contains(wanted["name_has"], regex=False).fillna(False).to_numpy(dtype=bool)
            if not mask.any():
                continue
            distance = np.round(1.0 - units[rows] @ vectors[mask].T, 6) + 0.0
            keep = distance <= (np.partition(distance, k - 1, axis=1)[:, k - 1:k] if distance.shape[1] > k else np.inf)
            q, c = np.nonzero(keep)
            out.append(_cut(pd.DataFrame({"q": rows[q], "id": ids[mask][c], "distance": distance[q, c]}), k))
        return out

    wanted = {f["category"] for f, _ in groups}
    if "" not in wanted:
        # Every question names its category: other chunks need not be read.
        corpus = corpus.filter(F.col("category").isin(sorted(wanted)))
    return corpus.mapInPandas(run, schema)


def near_top_k(corpus: DataFrame, questions: DataFrame, k: int, key: str = "chunk_id", *, tables: int = 12, width: float = 0.6,
               seed: int = 1) -> DataFrame:
    """Like :func:`top_k` without filters, but only among chunks that share a bucket with the question.

    Random projections of unit vectors are cut in buckets of ``width``;
    ``tables`` of them are tried.  Approximate by choice: more tables or wider
    buckets find more.  Chunks and questions meet in a join on (table, bucket),
    so nothing is sent whole and a chunk far from all questions is never compared.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def hashed(rows: DataFrame, name: str, model=None):
        vectors = Normalizer(inputCol="_raw", outputCol="_unit", p=2.0).transform(
            rows.filter("embedding IS NOT NULL").select(F.col(name), array_to_vector(F.col("embedding").cast("array<double>")).alias("_raw")))
        model = model or BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_hash", numHashTables=tables, bucketLength=width, seed=seed).fit(vectors)
        cut = F.posexplode(F.transform("_hash", lambda h: vector_to_array(h)[0]))
        return model.transform(vectors).select(name, vector_to_array("_unit").alias(f"_{name}"), cut.alias("_table", "_bucket")), model

    left, model = hashed(questions.select(F.col("query_id").cast("string").alias("query_id"), "embedding").dropDuplicates(["query_id"]), "query_id")
    right, _ = hashed(corpus.select(key, "embedding"), key, model)
    # A pair that meets in several tables is compared once.
    pairs = left.join(right, ["_table", "_bucket"]).dropDuplicates(["query_id", key])
    dot = F.aggregate(F.zip_with("_query_id", f"_{key}", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", key, (F.round(1.0 - dot, 6) + 0.0).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, "distance")


def asked_once(questions: DataFrame) -> DataFrame:
    """``query_id, sub, embedding`` and the filters: a search asked twice is one search.

    Of different ones under one name the smallest counts, however many
    questions there are.
    """
    have = set(questions.columns)
    questions = questions.select(
        F.col("query_id").cast("string").alias("query_id"),
        (F.col("sub") if "sub" in have else F.lit(0)).cast("int").alias("sub"), "embedding",
        *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in FILTERS])
    same = F.min(F.struct("embedding", *FILTERS)).alias("_ask")
    return questions.groupBy("query_id", "sub").agg(same).select("query_id", "sub", "_ask.*")


def top_k(corpus: DataFrame, questions: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The ``k`` nearest chunks of every question: query_id, sub, rank, key, distance.

    ``questions`` holds query_id and embedding, and may hold ``sub`` (several
    searches of one question) and the filters ``category``, ``chapter`` and
    ``name_has``; a null filter is none.  Ties go to the smaller key.
    """
    have = set(questions.columns)
    questions = asked_once(questions)
    optional = {"category": "category", "chapter": "chapter", "name_has": "name"}
    used = [optional[c] for c in FILTERS if c in have]
    corpus = corpus.select(
        key, "embedding", *[F.col(c).cast("string").alias(c) for c in used])
    hits = None
    for block in _blocks(questions):
        if len(block):
            part = _scan(corpus, block, k, key)
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = corpus.select(F.lit("").alias("query_id"), F.lit(0).alias("sub"), key, F.lit(0.0).alias("distance")).limit(0)
    order = Window.partitionBy("query_id", "sub").orderBy("distance", key)
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "sub", "rank", key, "distance")
    # A few rows per question, used more than once from here on: written down,
    # so that the chunks are scanned once.
    return checkpoint(best)


def _bytes(block: pd.DataFrame) -> int:
    """What a block of questions takes, its vectors, names and filters."""
    words = sum(4 * int(block[c].dropna().str.len().sum()) for c in ("query_id", *FILTERS))
    return words + 8 * sum(len(v) for v in block["embedding"])


def _blocks(questions: DataFrame) -> Iterator[pd.DataFrame]:
    """Questions in blocks of a checked size.

    One look takes at most a block and one row more.  When that overflows the
    questions are divided by hash until every part fits.
    """
    todo = [(questions, 0)]
    while todo:
        part, depth = todo.pop()
        block = part.limit(BLOCK_ROWS + 1).toPandas()
        if len(block) <= 1 or len(block) <= BLOCK_ROWS and _bytes(block) <= BLOCK_BYTES:
            yield block
            continue
        # A different hash per level, so that halves halve again.
        half = F.pmod(F.xxhash64("query_id", "sub", F.lit(depth)), F.lit(2))
        todo += [(part.filter(half == 0), depth + 1), (part.filter(half == 1), depth + 1)]


def with_payload(hits: DataFrame, corpus: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """Hits with columns of their chunks; the chunks stay where they are."""
    return rows_of(corpus.select(key, *columns), hits, key)


# --- the kinds of search -------------------------------------------------------

def _plain_and_named(corpus: DataFrame, questions: DataFrame, k: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Plain hits of every question, and its hits by name in the order first seen: one scan of the chunks for both."""
    plain = questions.select(F.col("query_id").cast("string").alias("query_id"), F.lit(-1).alias("sub"), "embedding", F.lit(None).cast("string").alias("name_has"))
    named = questions.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode("keywords").alias("sub", "name_has"), "embedding").filter(
        F.length("name_has") >= fixed.MIN_KEYWORD_CHARS).select(*plain.columns)
    hits = top_k(corpus, plain.unionByName(named), k, key)
    first = first_seen(hits.filter("sub >= 0"), ["query_id", key], ["sub", "rank"])
    placed = Window.partitionBy("query_id").orderBy("sub", "rank")
    return hits.filter("sub < 0"), first.withColumn("position", F.row_number().over(placed))


def _named_else_plain(plain: DataFrame, named: DataFrame, key: str) -> DataFrame:
    missing = plain.join(named.select("query_id").distinct(), "query_id", "left_anti").withColumn("position", F.col("rank"))
    columns = ["query_id", "position", key, "distance"]
    return named.select(*columns, F.lit("name").alias("found_by")).unionByName(missing.select(*columns, F.lit("semantic").alias("found_by")))


def name_search(corpus: DataFrame, questions: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """Chunks of files whose name holds one of the question's keywords.

    Keyword by keyword, each chunk once where first seen; a question without
    any hit gets plain search.  ``questions`` also holds ``keywords``.
    """
    return _named_else_plain(*_plain_and_named(corpus, questions, k, key), key)


def hybrid_search(corpus: DataFrame, questions: DataFrame, k: int = fixed.HYBRID_RESULTS,
                  threshold: int = fixed.HYBRID_THRESHOLD, key: str = "chunk_id") -> DataFrame:
    """Plain search, unless its hits hold too little text and there are keywords."""
    asked = questions.withColumn("query_id", F.col("query_id").cast("string"))
    plain, named = _plain_and_named(corpus, asked, k, key)
    # A stored length spares the scan of all texts.
    length = F.col("n_chars") if "n_chars" in corpus.columns else F.length("text")
    sized = with_payload(plain, corpus.select(key, length.alias("_n")), ["_n"], key)
    total = sized.groupBy("query_id").agg(F.sum("_n").alias("_total"))
    verdict = asked.join(total, "query_id", "left").withColumn(
        "_keep", (F.coalesce("_total", F.lit(0)) >= threshold) | F.coalesce(F.size("keywords") == 0, F.lit(True))).select("query_id", "_keep").distinct()
    kept, other = (verdict.filter(F.col("_keep") == keep).select("query_id") for keep in (True, False))
    only = lambda hits, which: hits.join(which, "query_id", "left_semi")
    by_name = _named_else_plain(only(plain, other), only(named, other), key)
    return only(plain, kept).select("query_id", F.col("rank").alias("position"), key, "distance", F.lit("semantic").alias("found_by")).unionByName(
        by_name.select("query_id", "position", key, "distance", "found_by"))


def chapter_search(corpus: DataFrame, questions: DataFrame, chapters: int = 3, per_chapter: int = 3,
                   otherwise: int = 7, key: str = "chunk_id") -> DataFrame:
    """Hits per chapter for questions that name chapters, plain search for the rest; one scan of the chunks for both.

    ``questions`` also holds ``chapters`` (null or empty for none); only the
    first few chapters are searched, in order.
    """
    within = questions.select("query_id", "embedding", F.posexplode(F.slice("chapters", 1, chapters)).alias("sub", "chapter"))
    rest = questions.filter(F.coalesce(F.size("chapters"), F.lit(0)) <= 0).select(
        "query_id", "embedding", F.lit(-1).alias("sub"), F.lit(None).cast("string").alias("chapter"))
    found = top_k(corpus, within.unionByName(rest), max(per_chapter, otherwise), key)
    wanted = found.filter(F.col("rank") <= F.when(F.col("sub") < 0, otherwise).otherwise(per_chapter))
    placed = Window.partitionBy("query_id").orderBy("sub", "rank")
    return wanted.withColumn("found_by", F.when(F.col("sub") < 0, "semantic").otherwise("chapter")).withColumn(
        "position", F.row_number().over(placed)).select("query_id", "position", key, "distance", "found_by")


# --- hits to text ----------------------------------------------------------------

def context_block(position, name, chapter, text) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    suffix = F.when(F.coalesce(col(chapter), F.lit("")) != "", F.concat(F.lit(", "), col(chapter))).otherwise(F.lit(""))
    return F.concat(F.lit("\n--- Chunk "), col(position).cast("string"), F.lit(" (de: "), col(name), suffix,
                    F.lit(") ---\n"), col(text))


def assemble_context(hits: DataFrame) -> DataFrame:
    """One text per question from its hits (query_id, position, name, chapter, text)."""
    blocks = hits.withColumn("_block", context_block("position", "name", "chapter", "text"))
    return joined_text(blocks, ["query_id"], ["position"], "_block", "\n", "context")


def sources_used(hits: DataFrame) -> DataFrame:
    """Names behind a question's hits, each once, in the order first seen."""
    firsts = first_seen(hits, ["query_id", "name"], ["position"])
    return joined_text(firsts, ["query_id"], ["position"], "name", ", ", "sources")


# --- vectors -----------------------------------------------------------------------

def _hashed_words(df: DataFrame, text: str, dims: int) -> DataFrame:
    """Counts of signed places: the first 32 bits of a word's md5 choose its place, the next hexadecimal digit its sign."""
    from pyspark.ml.feature import CountVectorizerModel

    digest = lambda w: F.md5(w.cast("binary"))
    place = lambda d: F.concat((F.conv(F.substring(d, 1, 8), 16, 10).cast("long") % dims).cast("string"), F.when(F.substring(d, 9, 1) < "8", "+").otherwise("-"))
    words = F.split(F.lower(strip(text)), r"(?U)\W+")
    split = df.withColumn("_words", F.coalesce(F.transform(words, lambda w: place(digest(w))), F.array().cast("array<string>")))
    names = [f"{i}{sign}" for sign in "+-" for i in range(dims)]
    model = CountVectorizerModel.from_vocabulary(names, inputCol="_words", outputCol="_tf", minTF=1.0)
    return model.transform(split)


def word_weights(df: DataFrame, text: str = "text", dims: int = 256):
    """Weights of hashed words by their rarity in ``df`` (a fitted model of twice ``dims`` numbers)."""
    from pyspark.ml.feature import IDF

    return IDF(inputCol="_tf", outputCol="_weighted").fit(_hashed_words(df, text, dims))


def lexical_vectors(df: DataFrame, text: str = "text", dims: int = 256, out: str = "embedding", weights=None) -> DataFrame:
    """Unit vectors of hashed words, for use without a model.

    They compare words, not meaning.  A word adds 1 to its place, or takes 1
    away, as its md5 says, so that words that share a place do not add up.  Each
    row is hashed on its own: no pass over the corpus and no shuffle;
    ``weights`` of :func:`word_weights` (one pass) let rare words count for more.
    """
    from pyspark.ml.functions import vector_to_array

    if weights is None:
        # Words are never blank, so a blank may stand for what divides them.
        return df.withColumn(out, _signed_unit(dims)(F.regexp_replace(F.lower(strip(text)), r"(?U)\W+", " ")))
    both = weights.transform(_hashed_words(df, text, dims)).withColumn("_both", vector_to_array("_weighted"))
    signed = both.withColumn("_signed", F.zip_with(F.slice("_both", 1, dims), F.slice("_both", dims + 1, dims), lambda a, b: a - b))
    length = F.sqrt(F.aggregate("_signed", F.lit(0.0), lambda s, x: s + x * x))
    unit = signed.withColumn("_length", length)
    vector = F.transform("_signed", lambda x: F.when(F.col("_length") > 0, x / F.col("_length")).otherwise(x).cast("float"))
    return unit.withColumn(out, vector).drop("_words", "_tf", "_weighted", "_both", "_signed", "_length")


# Words whose digests a task remembers.
REMEMBERED = 1 << 18


def _signed_unit(dims: int):
    """A function from words, a blank between them, to the unit vector of their signed places; see :func:`_hashed_words`."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, int] = {}  # a place, plus dims where the sign is negative

        def place(word: str) -> int:
            digest = md5(word.encode("utf-8", "surrogatepass")).hexdigest()
            return int(digest[:8], 16) % dims + (0 if digest[8] < "8" else dims)

        def one(text: str | None) -> np.ndarray:
            words = [] if text is None else text.split(" ")
            for word in words:
                if word not in places:
                    places[word] = place(word)
            both = np.bincount([places[word] for word in words], minlength=2 * dims) if words else np.zeros(2 * dims)
            signed = (both[:dims] - both[dims:]).astype(np.float64)
            length = np.sqrt((signed * signed).sum())
            return (signed / length if length > 0 else signed).astype(np.float32)

        for part in texts:
            yield pd.Series([one(text) for text in part], dtype=object)
            if len(places) > REMEMBERED:
                places.clear()

    return unit


def model_vectors(df: DataFrame, make_model, text: str = "text", out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Vectors from a user's model: ``make_model()`` gives texts -> list of vectors."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [
        T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        model = None
        for frame in batches:
            model = model or make_model()
            texts = frame[text].tolist()
            vectors = [list(map(float, v)) for at in range(0, len(texts), batch_size) for v in model(texts[at:at + batch_size])]
            frame = frame.drop(columns=[out], errors="ignore")
            frame[out] = vectors
            yield frame[schema.names]

    return df.mapInPandas(run, schema)

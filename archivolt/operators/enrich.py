"""Batch calls to a user's model function, with errors as data and a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from archivolt.operators.ordered import first_seen
from archivolt.session import checkpoint


def _asked(client: Callable, prompts: list, places: list[int], answers: list, errors: list) -> None:
    """Fills in the answers to ``prompts``, whose rows are ``places``; a batch that fails is asked row by row."""
    try:
        got = list(client(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        for i, answer in zip(places, got):
            answers[i] = answer
    except Exception:  # noqa: BLE001 - each row keeps its own message
        for i, one in zip(places, prompts):
            try:
                answers[i] = client([one])[0]
            except Exception as exc:  # noqa: BLE001
                errors[i] = f"{type(exc).__name__}: {exc}"


def enrich(df: DataFrame, make_client: Callable[[], Callable[[list[str]], list[str]]], prompt: str,
           out: str = "answer", error: str = "error", batch_size: int = 64,
           partitions: int | None = None, keep_prompt: bool = True) -> DataFrame:
    """Adds the model's answer to ``prompt`` and an error column to every row.

    ``make_client`` runs once per task and gives a function from a list of
    prompts to a list of answers.  A batch that fails is tried again row by
    row, so one bad row costs only itself.  A null prompt is not asked.
    ``partitions`` spreads the calls evenly when the input is skewed; without
    ``keep_prompt`` prompts do not come back from the Python workers.
    """
    if partitions:
        df = df.repartition(partitions)
    return _enriched(df, lambda batch: [(None, np.arange(batch.num_rows))], {None: make_client}, prompt, out, error, batch_size, keep_prompt)


def _enriched(df: DataFrame, groups: Callable, clients: dict, prompt: str, out: str, error: str, batch_size: int, keep_prompt: bool) -> DataFrame:
    """``df`` with answer and error columns; ``groups`` deals the rows of an Arrow batch to ``clients``.

    Other columns stay as Arrow holds them, and prompts become Python strings
    one part at a time, so that a task holds little beside the batch itself.
    """
    kept = [f for f in df.schema.fields if f.name not in (out, error) and (keep_prompt or f.name != prompt)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])
    at = {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            prompts = batch.column(at[prompt])
            answers: list[str | None] = [None] * batch.num_rows
            errors: list[str | None] = [None] * batch.num_rows
            some = prompts.is_valid().to_numpy(zero_copy_only=False)
            for name, rows in groups(batch):
                rows = rows[some[rows]]
                if len(rows) and name not in made:
                    made[name] = clients[name]()
                for lo in range(0, len(rows), batch_size):
                    part = rows[lo:lo + batch_size].tolist()
                    _asked(made[name], prompts.take(pa.array(part)).to_pylist(), part, answers, errors)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[f.name]) for f in kept), pa.array(answers, pa.string()), pa.array(errors, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def enrich_by(df: DataFrame, clients: dict[str, Callable], model: str, prompt: str, out: str = "answer", error: str = "error", batch_size: int = 64,
              keep_prompt: bool = True) -> DataFrame:
    """:func:`enrich` where each row names the model in ``clients`` that is asked; a batch holds rows of one model."""
    place = df.columns.index(model)

    def groups(batch: pa.RecordBatch) -> list[tuple[str, np.ndarray]]:
        names = np.array(batch.column(place).to_pylist(), object)
        return [(name, np.flatnonzero(names == name)) for name in dict.fromkeys(names.tolist())]

    return _enriched(df, groups, clients, prompt, out, error, batch_size, keep_prompt)


def ask(df: DataFrame, make_client: Callable, prompt: str, out: str = "answer", error: str = "error", **options) -> DataFrame:
    """:func:`enrich` once and for all: only a row's number and its prompt go to the model, and the answers are written down."""
    numbered = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    asked = numbered.filter(F.col(prompt).isNotNull()).select("_row", prompt)
    answers = checkpoint(enrich(asked, make_client, prompt, out, error, keep_prompt=False, **options))
    return numbered.drop(out, error).join(answers, "_row", "left").drop("_row")


def per_row(fn: Callable[[str], str]) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A client factory from a function on one prompt."""
    return lambda: (lambda prompts: [fn(p) for p in prompts])


def with_cache(df: DataFrame, cache: DataFrame, make_client: Callable, prompt: str, *, key: str = "key",
               fingerprint: str = "fingerprint", result: str = "result", partitions: int | None = None) -> DataFrame:
    """Reuses a stored result when key and fingerprint match, else asks the model.

    A null prompt marks a row that is not worth asking about.  Rows carry
    ``origin``: ``cached``, ``new``, ``failed`` or ``omitted``.  Answers are
    written down, so that the model is asked once per row however often the
    result is used.
    """
    stored = cache.select(F.col(key), F.col(fingerprint).alias("_old"), F.col(result).alias("_stored"))
    hit = F.col("_old").isNotNull() & (F.col("_old") == F.col(fingerprint))
    looked = df.join(stored, key, "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    looked = looked.withColumn("_ask", F.when(~F.col("_hit"), F.col(prompt))).withColumn("_open", F.col("_ask").isNotNull())
    rest = [c for c in df.columns if c != prompt]
    asked = ask(looked.select(*rest, "_hit", "_stored", "_open", "_ask"), make_client, "_ask", "_new", "error", partitions=partitions)
    origin = (
        F.when(F.col("_hit"), "cached").when(~F.col("_open"), "omitted").when(F.col("error").isNull(), "new").otherwise("failed"))
    return asked.select(*rest, F.when(F.col("_hit"), F.col("_stored")).otherwise(F.col("_new")).alias(result), "error", origin.alias("origin"))


def updated_cache(cache: DataFrame, done: DataFrame, *, key: str = "key", fingerprint: str = "fingerprint",
                  result: str = "result") -> DataFrame:
    """The cache after a run: new results replace old ones, failures change nothing."""
    fresh = done.filter("origin = 'new'").select(key, fingerprint, result)
    return cache.join(fresh.select(key), key, "left_anti").select(key, fingerprint, result).unionByName(fresh)


def run_counts(done: DataFrame) -> DataFrame:
    """New, cached and omitted rows of a cached run."""
    return done.agg(*[
        F.count_if(F.col("origin") == name).alias(name) for name in ("new", "cached", "omitted", "failed")])


def insert_new(stored: DataFrame, found: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows of ``found`` whose key is new, each key once, first row first."""
    keyed = found.withColumn("_key", key).filter("_key <> ''")
    # Repeats go first, so that a key of many rows reaches the join as one.
    once = first_seen(keyed, ["_key"], order)
    return once.join(stored.select(key.alias("_key")), "_key", "left_anti").drop("_key")

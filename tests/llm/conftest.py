import pytest


@pytest.fixture()
def frame(spark):
    """A small table in more than one partition, with columns whose names operators use inside."""
    def make(rows, schema, extra=("_id", "label", "score", "size", "row", "key", "class", "kept", "_key")):
        df = spark.createDataFrame(rows, schema).repartition(3)
        names = {n.lower() for n in df.columns}
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit("x").alias(n) for n in extra if n not in names])

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(frame):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    return lambda rows: frame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)

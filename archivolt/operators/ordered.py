"""Order-dependent columns for groups of any size.

A plain window sends a whole group to one task.  When one conversation or
source may hold a third of all rows that task never ends, so each group is
cut in spans of the order column: work inside a span is a window keyed by
(group, span), and one small row per span carries the rest across.  The order
column is a whole number.  A row whose key or order is null is in no group: it
is kept, and its new columns are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from archivolt.session import checkpoint

SPAN = 1 << 16


def _span(order: str, span: int) -> Column:
    return F.expr(f"`{order}` div {span}")


def _grouped(keys: list[str], order: str) -> Column:
    found = F.col(order).isNotNull()
    for key in keys:
        found = found & F.col(key).isNotNull()
    return found


def positions(df: DataFrame, keys: list[str], order: str, out: str = "position", span: int = SPAN) -> DataFrame:
    """1-based place of every row in its group, by ``order`` (unique per group)."""
    cut = df.withColumn("_span", _span(order, span))
    counts = cut.filter(_grouped(keys, order)).groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order)
    return (
        cut.join(offsets, [*keys, "_span"], "left")
        .withColumn(out, F.when(_grouped(keys, order), F.col("_before") + F.row_number().over(inside)))
        .drop("_span", "_before")
    )


def running(df: DataFrame, keys: list[str], order: str, amount: str, out: str, span: int = SPAN) -> DataFrame:
    """Sum of ``amount`` over the rows of the group before the row, by ``order``; of equal orders any comes first.

    Without keys the whole table is the group.
    """
    cut = df.withColumn("_span", _span(order, span))
    sums = cut.filter(_grouped(keys, order)).groupBy(*keys, "_span").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(offsets, [*keys, "_span"], "left")
        .withColumn(out, F.when(_grouped(keys, order), F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))))
        .drop("_span", "_offset")
    )


def following(df: DataFrame, keys: list[str], order: str, columns: list[str], prefix: str = "next_",
              span: int = SPAN) -> DataFrame:
    """Adds the named columns of the next row of the group, null at its end."""
    cut = df.withColumn("_span", _span(order, span))
    row = F.struct(F.col(order), *[F.col(c) for c in columns])
    heads = cut.filter(_grouped(keys, order)).groupBy(*keys, "_span").agg(F.min_by(row, F.col(order)).alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_span")
    heads = heads.select(*keys, "_span", F.lead("_head").over(across).alias("_after"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order)
    near = cut.withColumn("_near", F.lead(row).over(inside)).join(heads, [*keys, "_span"], "left")
    found = F.when(_grouped(keys, order), F.coalesce("_near", "_after"))
    return near.select(*df.columns, *[found[c].alias(prefix + c) for c in columns])


def carried(df: DataFrame, keys: list[str], order: str, column: str, out: str, span: int = SPAN) -> DataFrame:
    """Last value of ``column`` that is not null, up to and with the row."""
    cut = df.withColumn("_span", _span(order, span))
    lasts = cut.filter(_grouped(keys, order)).groupBy(*keys, "_span").agg(
        F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*keys, "_span", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(lasts, [*keys, "_span"], "left")
        .withColumn(out, F.when(_grouped(keys, order), F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_before"))))
        .drop("_span", "_before")
    )


def newest(df: DataFrame, keys: list[str], order: str, n: int, out: str = "age") -> DataFrame:
    """The last ``n`` rows of each group, numbered from the newest.

    Spark cuts every map task to ``n`` rows per group before the shuffle, so
    a hot group arrives as a few rows per task.
    """
    latest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn(out, F.row_number().over(latest)).filter(F.col(out) <= n)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; the same row on every run."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


# Keys of at most so many bytes, written out, are sent to the rows they select.
BROADCAST_BYTES = 64 << 20


def sent_if_small(keys: DataFrame) -> DataFrame:
    """``keys``, to be sent to the rows they are joined with while their bytes fit; they are read twice."""
    size = keys.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*keys.columns)))), F.lit(0))).first()[0]
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def rows_of(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys`` (unique), joined with its columns.

    The keys are computed once and their bytes added up; while they fit, the
    rows, which may carry whole texts, stay where they are.
    """
    keys = checkpoint(keys)
    return rows.join(sent_if_small(keys), on)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often later steps use them.

    Spark moves filters below a projection by writing its expressions out
    again.  It does not do so below a generator, so the values pass through a
    one-element one.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def joined_text(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str,
                out: str = "text") -> DataFrame:
    """Texts of a group joined in order; only for groups of a bounded size."""
    row = F.struct(*order, F.col(text).alias("_t"))
    parts = F.array_sort(F.collect_list(row))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda r: r["_t"]), separator).alias(out))

"""Runs a registered query in Spark and its SQL in DuckDB and compares the two."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def _kind(name: str) -> str:
    name = name.lower().split("(")[0]
    return {"int": "integer", "long": "bigint", "string": "varchar"}.get(name, name)


def compare(spark, con, fn, sql: str, folder: str) -> list[str]:
    """Differences in columns, types and rows; an empty list is a match."""
    df = fn(spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_cols, want = _rows(names, rel.fetchall())
    types = {d[0]: _kind(str(d[1])) for d in rel.description}
    out = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    for f in df.schema.fields:
        if _kind(f.dataType.simpleString()) != types[f.name]:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    have, need = set(got), set(want)
    extra, missing = [r for r in got if r not in need], [r for r in want if r not in have]
    if extra or missing:
        out.append(f"{len(extra)} extra, {len(missing)} missing; extra {extra[:2]} missing {missing[:2]}")
    elif got != want and len(got) == len(want):
        out.append("multiplicities differ")
    return out

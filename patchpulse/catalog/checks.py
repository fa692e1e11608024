"""Side-by-side comparison of a registered query with its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item") and not isinstance(v, (list, str)):
        return _cell(v.item())
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    data = [tuple(_cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(data, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    a_cols, b_cols = sorted(spark_pdf.columns), sorted(sql_pdf.columns)
    if a_cols != b_cols:
        return f"columns {a_cols} vs {b_cols}"
    for c in a_cols:
        ka, kb = spark_pdf[c].dtype.kind, sql_pdf[c].dtype.kind
        if ka != kb and not spark_pdf[c].isna().any() and not sql_pdf[c].isna().any():
            return f"type of {c}: {spark_pdf[c].dtype} vs {sql_pdf[c].dtype}"
    a, b = rows(spark_pdf), rows(sql_pdf)
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            diff = {c: (p, q) for c, p, q in zip(a_cols, x, y) if p != q}
            key = dict(zip(a_cols, x))
            return f"row {str(key)[:400]} differs in {str(diff)[:400]}"
    return None

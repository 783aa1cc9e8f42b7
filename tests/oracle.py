"""Order-insensitive comparison of a query with its DuckDB SQL."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return float(v) if "float" in type(v).__name__ else int(v) if "int" in type(v).__name__ else str(v)


def rows(pdf) -> list[str]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return sorted(repr(tuple(map(plain, r))) for r in pdf.itertuples(index=False, name=None))

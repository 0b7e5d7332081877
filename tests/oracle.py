"""Compare a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def views(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def _text(v) -> str:
    """Nulls are alike, and a whole number is one whether its column has nulls, and so is of floats, or not."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_text, r)) for r in df.itertuples(index=False))

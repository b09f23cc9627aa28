"""Compare a query's rows with its SQL, order aside."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.12g}") + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return x
    return str(x)


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when names, kinds and rows agree, else a short account."""
    result = con.sql(sql)
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}"

    def kind(t: str) -> str:
        t = t.lower()
        for word, names in {
            "whole": ("int", "bigint", "smallint", "tinyint", "integer", "hugeint"),
            "real": ("double", "float"),
            "text": ("string", "varchar"),
        }.items():
            if t in names:
                return word
        return t

    kinds = {n: kind(t) for n, t in df.dtypes}
    theirs = {n: kind(str(t)) for n, t in zip(result.columns, result.types)}
    if kinds != theirs:
        return f"types {[(n, kinds[n], theirs[n]) for n in kinds if kinds[n] != theirs[n]]}"
    ours, sql_rows = _bag(df.columns, df.collect()), _bag(result.columns, result.fetchall())
    if ours == sql_rows:
        return ""
    extra, lacking = ours - sql_rows, sql_rows - ours
    return (
        f"{sum(ours.values())} rows vs {sum(sql_rows.values())}; "
        f"only here {sum(extra.values())} {list(extra)[:3]}; only there {sum(lacking.values())} {list(lacking)[:3]}"
    )

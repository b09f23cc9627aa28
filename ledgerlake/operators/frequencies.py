"""How often each value occurs in each column, and what follows from it.

One shuffle with map-side combining turns the columns asked for into (column,
text, n), from which modes are read. A value held by a large part of the rows is
one counter per task before it is shuffled. Distinct counts need no texts and no
counts: numbers are told apart as numbers, or by a sketch of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def as_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as the texts by which values are told apart."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType)]
    # Floats go the way their other statistics do, through double; 0.1 has one text then.
    wide = {c: F.col(f"`{c}`").cast("double") if c in fractional else F.col(f"`{c}`") for c in columns}
    return df.select(*[wide[c].cast("string").alias(c) for c in columns])


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, text, n); nulls are counted in the row with a NULL text."""
    columns = list(columns or df.columns)
    return as_texts(df, columns).unpivot([], columns, "column", "text").groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in fractional columns counts as missing everywhere."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in real else F.col(f"`{c}`") for c in df.columns])


def distinct_counts(df: DataFrame, error: float | None = None) -> dict[str, int]:
    """Different values of each column, nulls left out.

    Exact by default: values of all columns meet in one shuffle that combines
    first. With ``error`` each column has a mergeable sketch (HyperLogLog) of
    that relative standard deviation, and only sketches are moved.
    """
    if error is not None:
        row = df.agg(*[F.approx_count_distinct(f"`{c}`", error).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        return dict(zip(df.columns, row))
    cells = []
    for i, field in enumerate(df.schema.fields):
        value = F.col(f"`{field.name}`")
        whole = isinstance(field.dataType, T.IntegralType)
        real = isinstance(field.dataType, (T.FloatType, T.DoubleType))
        cell = F.struct(
            F.lit(i).alias("c"),
            (value if whole else F.lit(None)).cast("long").alias("whole"),
            (value if real else F.lit(None)).cast("double").alias("real"),
            (F.lit(None) if whole or real else value).cast("string").alias("text"),
        )
        cells.append(F.when(value.isNotNull(), cell))
    values = df.select(F.explode(F.array(*cells)).alias("v")).filter("v IS NOT NULL").select("v.*")
    counts = values.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {df.columns[r["c"]]: r["n"] for r in counts}
    return {c: found.get(c, 0) for c in df.columns}


def modes(
    frequencies: DataFrame, columns: Sequence[str], numeric: Sequence[str] = ()
) -> dict[str, str]:
    """Most frequent text per column, the smallest on ties; all-null columns are left out.

    Ties between the texts of ``numeric`` columns are settled by number.
    """
    counts = frequencies.filter(F.col("column").isin(list(columns)) & F.col("text").isNotNull())
    top = counts.groupBy("column").agg(F.max("n").alias("n"))
    number = F.when(F.col("column").isin(list(numeric)), F.col("text").try_cast("double"))
    # One row per column, so the broadcast is bounded by the table's width.
    best = (
        counts.join(F.broadcast(top), ["column", "n"])
        .groupBy("column")
        .agg(F.coalesce(F.min_by("text", number), F.min("text")).alias("text"))
    )
    return {r["column"]: r["text"] for r in best.collect()}


def by_column(values: dict[str, object], column: Column | str = "column") -> Column:
    """The value kept for the column named in each row: a literal map, which does not nest however wide the table."""
    column = F.col(column) if isinstance(column, str) else column
    if not values:
        return F.lit(None)
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]

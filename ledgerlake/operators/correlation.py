"""Pearson correlations of all pairs of columns by blocked cross products.

Each task multiplies its rows into four matrices over all columns: rows where
both are present, and the sums of values, squares and products over those rows.
Masks make them pairwise complete. Matrices are handed on in blocks, and the
blocks of all tasks are summed where they meet, one at a time. Values are taken
less their column's mean, so that the sums stay well conditioned.

A task holds 32 bytes per pair of columns: 32 MB for 1,000 columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.frequencies import numeric_columns
from ledgerlake.operators.selection import as_number

#: Columns of a block, and rows multiplied at once.
BLOCK, ROWS = 128, 4096
#: A spread below this share of the mean square is rounding.
_NOTHING = 1e-13


def _blocks(width: int) -> list[tuple[int, slice, slice]]:
    """The blocks on and above the diagonal."""
    cuts = [slice(a, min(a + BLOCK, width)) for a in range(0, width, BLOCK)]
    return [(n, cuts[i], cuts[j]) for n, (i, j) in enumerate((i, j) for i in range(len(cuts)) for j in range(i, len(cuts)))]


def _products(means: list[float]):
    """(block, sums): the task's sums for each block of pairs."""
    width, means = len(means), np.array(means)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sums, squares, products = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in some.columns], axis=1) - means
                here = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
                both += here.T @ here
                sums += x.T @ here
                squares += (x * x).T @ here
                products += x.T @ x
        parts = _blocks(width)
        held = [np.stack([both[r, c], sums[r, c], sums[c, r].T, squares[r, c], squares[c, r].T, products[r, c]]).tobytes() for _, r, c in parts]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in parts], pa.int32()), pa.array(held, pa.binary())], ["block", "sums"])

    return multiply


def _correlations(names: list[str]):
    """(column_a, column_b, correlation) of each block, whose rows come next to each other."""
    parts = {n: (r, c) for n, r, c in _blocks(len(names))}

    def of_block(block: int, total: np.ndarray) -> pa.RecordBatch:
        rows, columns = parts[block]
        n, x, y, xx, yy, xy = total.reshape(6, rows.stop - rows.start, -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = [s / n - (m / n) ** 2 for s, m in ((xx, x), (yy, y))]
            varies = (spread[0] > _NOTHING * xx / n) & (spread[1] > _NOTHING * yy / n)
            found = np.where(varies, (xy / n - x * y / n**2) / np.sqrt(spread[0] * spread[1]), np.nan)
        a, b = (i.reshape(-1) for i in np.meshgrid(range(rows.start, rows.stop), range(columns.start, columns.stop), indexing="ij"))
        value = np.where((a == b) & ~np.isnan(found.reshape(-1)), 1.0, np.clip(found.reshape(-1), -1, 1))
        if rows != columns:
            a, b, value = np.r_[a, b], np.r_[b, a], np.r_[value, value]
        listed = pa.array(names)
        return pa.RecordBatch.from_arrays([listed.take(pa.array(a)), listed.take(pa.array(b)), pa.array(value, from_pandas=True)], ["column_a", "column_b", "correlation"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(sums.as_buffer())
                if block == last:
                    total = total + own
                else:
                    if last is not None:
                        yield of_block(last, total)
                    last, total = block, own
        if last is not None:
            yield of_block(last, total)

    return add_up


def correlation_matrix(df: DataFrame) -> DataFrame:
    """(column_a, column_b, correlation): Pearson over rows where both are present.

    NULL where either column does not vary over those rows.
    """
    columns = numeric_columns(df)
    schema = "column_a string, column_b string, correlation double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    values = df.select(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    means = [m if m is not None and abs(m) < float("inf") else 0.0 for m in values.agg(*[F.avg(c) for c in values.columns]).first()]
    blocks = values.mapInArrow(_products(means), "block int, sums binary")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_correlations(columns), schema)

"""Exact quantiles of raw rows by radix selection.

Each column's values are counted in bins between its least and greatest value,
in one aggregate that combines before its shuffle, so a bin costs a row per
task. Only the bins that hold a wanted rank are refined, between the least and
greatest value found in them, until a bin holds one value or few rows are left
to fetch. Rows that are still in question are set aside once they are a small
part of the table, so later rounds no longer read it.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.staging import stage

#: Bins of a round over all intervals, and rows fetched in the end: bounds of what the driver takes.
MOST_BINS = 1 << 17
MOST_FETCHED = 1 << 16
#: Rows are set aside when no more than one in so many is in question.
SET_ASIDE = 16

_GREATEST = sys.float_info.max


def as_number(df: DataFrame, column: str) -> Column:
    """A numeric column as DOUBLE, NaN as missing."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None))


def extents(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """Rows with a value, least and greatest value of each column that has any."""
    if not columns:
        return {}
    cells = [F.struct(F.count(v), F.min(v), F.max(v)) for v in (as_number(df, c) for c in columns)]
    row = df.agg(*[cell.alias(f"c{i}") for i, cell in enumerate(cells)]).first()
    return {c: tuple(cell) for c, cell in zip(columns, row) if cell[0]}


@dataclass(frozen=True)
class _Interval:
    """The values of a column from ``low`` to ``high``: ``rows`` of them, ``before`` smaller ones."""

    column: str
    low: float
    high: float
    rows: int
    before: int
    wanted: tuple[int, ...]

    @property
    def settled(self) -> bool:
        return self.low == self.high

    def bin_of(self, value: Column, bins: int) -> Column:
        """Equal parts between the finite ends; infinite values have bins of their own."""
        low, high = max(self.low, -_GREATEST), min(self.high, _GREATEST)
        # The width may be beyond all doubles; its half is not.
        scale = 1.0 if high - low <= _GREATEST else 0.5
        place = F.floor((value * scale - F.lit(low * scale)) / F.lit(high * scale - low * scale) * bins)
        return F.when(value < low, -1).when(value > high, bins).otherwise(F.least(place, F.lit(bins - 1)).cast("int"))


def _explode_inside(df: DataFrame, source, intervals: Sequence[_Interval], bins: int) -> DataFrame:
    """(interval, bin, value) of the values inside the intervals."""
    cells = []
    for i, it in enumerate(intervals):
        value = source(i, it)
        inside = value.between(F.lit(it.low), F.lit(it.high))
        cells.append(F.when(inside, F.struct(F.lit(i).alias("interval"), it.bin_of(value, bins).alias("bin"), value.alias("value"))))
    return df.select(F.explode(F.array(*cells)).alias("c")).filter("c IS NOT NULL").select("c.*")


def _refined(intervals: Sequence[_Interval], binned: DataFrame) -> list[_Interval]:
    """The bins that hold wanted ranks, with the least and greatest value found there."""
    sizes = binned.groupBy("interval", "bin").agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
    found, before = [], [it.before for it in intervals]
    for r in sorted(sizes.collect(), key=lambda r: (r["interval"], r["bin"])):
        it, start = intervals[r["interval"]], before[r["interval"]]
        before[r["interval"]] += r["rows"]
        wanted = tuple(w for w in it.wanted if start <= w < start + r["rows"])
        if wanted:
            found.append(_Interval(it.column, r["low"], r["high"], r["rows"], start, wanted))
    return found


def _fetched(inside: DataFrame, intervals: Sequence[_Interval]) -> dict[tuple[str, int], float]:
    counts = inside.groupBy("interval", "value").agg(F.count(F.lit(1)).alias("n")).collect()
    found, before = {}, [it.before for it in intervals]
    for r in sorted(counts, key=lambda r: (r["interval"], r["value"])):
        it, start = intervals[r["interval"]], before[r["interval"]]
        before[r["interval"]] += r["n"]
        found.update({(it.column, w): r["value"] for w in it.wanted if start <= w < start + r["n"]})
    return found


def values_at(df: DataFrame, ranks: dict[str, Sequence[int]], extent: dict[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """The values that stand at the given ranks, counted from 0, in the order of each column."""
    found: dict[tuple[str, int], float] = {}
    rows = sum(extent[c][0] for c in ranks)
    open_ = [_Interval(c, extent[c][1], extent[c][2], extent[c][0], 0, tuple(sorted(set(w)))) for c, w in ranks.items()]
    table, source = df, lambda i, it: as_number(df, it.column)
    while True:
        found.update({(it.column, w): it.low for it in open_ if it.settled for w in it.wanted})
        open_ = [it for it in open_ if not it.settled]
        if not open_:
            return found
        left = sum(it.rows for it in open_)
        if left <= MOST_FETCHED:
            return found | _fetched(_explode_inside(table, source, open_, 1), open_)
        if left * SET_ASIDE <= rows:
            table = stage(_explode_inside(table, source, open_, 1).select("interval", "value"), "selected")
            numbers = {id(it): i for i, it in enumerate(open_)}
            origin = {(it.column, w): numbers[id(it)] for it in open_ for w in it.wanted}
            source = lambda i, it, origin=origin: F.when(F.col("interval") == origin[it.column, it.wanted[0]], F.col("value"))
            rows = left
        bins = max(16, MOST_BINS // len(open_))
        open_ = _refined(open_, _explode_inside(table, source, open_, min(bins, 1024)))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], extent: dict[str, tuple[int, float, float]] | None = None
) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation between neighbouring rows.

    One number per column and probability; columns without any value are left
    out. ``extent`` may pass rows, least and greatest value where they are known.
    """
    extent = extents(df, columns) if extent is None else {c: extent[c] for c in columns if c in extent}
    steps = {c: [p * (extent[c][0] - 1) for p in probabilities] for c in extent}
    ranks = {c: [r for s in own for r in (int(s), min(int(s) + 1, extent[c][0] - 1))] for c, own in steps.items()}
    at = values_at(df, ranks, extent)

    def between(column: str, step: float) -> float:
        first, second = at[column, int(step)], at[column, min(int(step) + 1, extent[column][0] - 1)]
        return first + (second - first) * (step - int(step)) if first != second else first

    return {c: [between(c, s) for s in own] for c, own in steps.items()}

"""Table profile: shape, per-column statistics, outliers, histograms, correlations.

Everything is read off the raw rows by aggregates that combine before they
shuffle: counts and moments in one row, quartiles by radix selection, outliers
in one row, histograms as a row per bin. Only exact distinct counts move values,
each different one once per task, and duplicates move a hash per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ledgerlake.errors import EmptyDataset
from ledgerlake.operators.correlation import correlation_matrix
from ledgerlake.operators.duplicates import duplicate_rows
from ledgerlake.operators.frequencies import by_column, distinct_counts, nan_as_null, numeric_columns
from ledgerlake.operators.selection import as_number, exact_quantiles
from ledgerlake.staging import together

HISTOGRAM_BINS = 10


def _frame(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A few statistics as a table."""
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass
class Profile:
    """Profile of a table; each part is computed when first asked for.

    ``distinct_error`` counts different values by sketches with that relative
    standard deviation, for tables too wide or too large for exact counts.
    """

    source: DataFrame
    distinct_error: float | None = None

    def __post_init__(self):
        self.source = nan_as_null(self.source)

    @cached_property
    def numeric(self) -> list[str]:
        return numeric_columns(self.source)

    @cached_property
    def _cells(self):
        """One row: the rows, the values of every column, and moments of the numeric ones."""
        parts = [F.count(F.lit(1)).alias("rows"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(self.source.columns)]]
        for i, c in enumerate(self.numeric):
            value = as_number(self.source, c)
            parts.append(F.struct(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).alias(f"m{i}"))
        return self.source.agg(*parts).first()

    @cached_property
    def row_count(self) -> int:
        return self._cells["rows"]

    @cached_property
    def value_counts(self) -> dict[str, int]:
        """How many cells of each column hold a value."""
        return {c: self._cells[f"n{i}"] for i, c in enumerate(self.source.columns)}

    @cached_property
    def moments(self) -> dict[str, tuple[float, float, float, float]]:
        """Least, greatest, mean and sample deviation of the numeric columns that hold a value."""
        rows = {c: self._cells[f"m{i}"] for i, c in enumerate(self.numeric)}
        return {c: (m["min"], m["max"], m["mean"], m["std"] or 0.0) for c, m in rows.items() if m["min"] is not None}

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.source).first()["duplicate_rows"]

    @cached_property
    def distinct(self) -> dict[str, int]:
        return distinct_counts(self.source, self.distinct_error)

    @cached_property
    def quartiles(self) -> dict[str, list[float]]:
        extent = {c: (self.value_counts[c], m[0], m[1]) for c, m in self.moments.items()}
        return exact_quantiles(self.source, self.numeric, [0.25, 0.5, 0.75], extent)

    @cached_property
    def _outlier_counts(self) -> dict[str, int]:
        parts = []
        for c, (q1, _, q3) in self.quartiles.items():
            value, reach = as_number(self.source, c), 1.5 * (q3 - q1)
            parts.append(F.count_if((value < q1 - reach) | (value > q3 + reach)))
        row = self.source.agg(*[p.alias(f"o{i}") for i, p in enumerate(parts)]).first() if parts else ()
        return dict(zip(self.quartiles, row))

    def require_rows(self) -> None:
        if not self.row_count:
            raise EmptyDataset("the table has no rows")

    def null_counts(self) -> DataFrame:
        """(column, null_count, null_percentage, unique_count)"""
        self.require_rows()
        rows = [(c, self.row_count - n, self.distinct[c]) for c, n in self.value_counts.items()]
        counts = _frame(self.source, rows, "column string, null_count long, unique_count long")
        percentage = F.round(F.col("null_count") / self.row_count * 100, 2)
        return counts.select("column", "null_count", percentage.alias("null_percentage"), "unique_count")

    def numeric_summary(self) -> DataFrame:
        """(column, min, max, mean, median, std_dev), rounded to four places."""
        rows = [(c, low, high, mean, self.quartiles[c][1], std) for c, (low, high, mean, std) in self.moments.items()]
        stats = _frame(self.source, rows, "column string, min double, max double, mean double, median double, std_dev double")
        return stats.select("column", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std_dev")])

    def outliers(self) -> DataFrame:
        """(column, q1, q3, value_count, outlier_count): values strictly beyond 1.5 quartile ranges."""
        rows = [(c, q[0], q[2], self.value_counts[c], self._outlier_counts[c]) for c, q in self.quartiles.items()]
        return _frame(self.source, rows, "column string, q1 double, q3 double, value_count long, outlier_count long")

    def missing_cells_pct(self) -> DataFrame:
        """One row: share of all cells that are missing, in percent."""
        self.require_rows()
        cells = self.row_count * len(self.value_counts)
        rows = _frame(self.source, [(cells - sum(self.value_counts.values()), cells)], "missing long, cells long")
        return rows.select(F.round(F.col("missing") / F.col("cells") * 100, 2).alias("missing_cells_pct"))

    def histograms(self, include_max: bool = True) -> DataFrame:
        """(column, bin, bin_start, bin_end, count): ten equal bins, empty ones left out.

        Without ``include_max`` rows at the maximum fall just past the last bin
        and are not shown.
        """
        low = {c: m[0] for c, m in self.moments.items()}
        width = {c: (m[1] - m[0]) / HISTOGRAM_BINS for c, m in self.moments.items()}
        cells = []
        for c in (c for c, w in width.items() if 0 < w < float("inf")):
            value = as_number(self.source, c)
            place = F.floor((value - F.lit(low[c])) / F.lit(width[c]))
            place = F.least(place, F.lit(HISTOGRAM_BINS - 1)) if include_max else place
            cells.append(F.when(value.isNotNull(), F.struct(F.lit(c).alias("column"), place.alias("bin"))))
        if not cells:
            return _frame(self.source, [], "column string, bin long, bin_start double, bin_end double, count long")
        binned = self.source.select(F.explode(F.array(*cells)).alias("c")).filter(f"c.bin BETWEEN 0 AND {HISTOGRAM_BINS - 1}").select("c.*")
        counts = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
        edge = lambda step: F.round(by_column(low).cast("double") + (F.col("bin") + step) * by_column(width).cast("double"), 2)
        return counts.select("column", "bin", edge(0).alias("bin_start"), edge(1).alias("bin_end"), "count")

    def correlations(self) -> DataFrame:
        return correlation_matrix(self.source)

    def columns(self) -> DataFrame:
        """One row per column with its type and every statistic that applies."""
        types = {f.name: f.dataType.simpleString() for f in self.source.schema.fields}
        self.require_rows()
        together(self.source.sparkSession, lambda: self.distinct, lambda: self._outlier_counts)
        # Both right sides hold one row per numeric column.
        return (
            self.null_counts()
            .withColumn("type", by_column(types))
            .join(F.broadcast(self.numeric_summary()), "column", "left")
            .join(F.broadcast(self.outliers().select("column", "outlier_count")), "column", "left")
            .select(
                "column",
                "type",
                "null_count",
                "null_percentage",
                "unique_count",
                "min",
                "max",
                "mean",
                "median",
                "std_dev",
                "outlier_count",
            )
        )

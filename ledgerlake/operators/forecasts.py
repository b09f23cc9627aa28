"""One ridge forecast per key: a series for every category, region or product.

The model is that of the whole history (:mod:`ledgerlake.operators.timeseries`),
for any number of keys at once. A key's normal equations are sums, taken for all
keys in one aggregate; equations of many keys are solved together in batches;
predictions, errors and forecasts are column expressions over one row per key.
Windows are per key and bounded by the months of the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.operators.timeseries import _BAND, _MIN_FEATURE_ROWS, _MIN_MONTHS, FEATURES, HORIZON
from ledgerlake.staging import stage

_PAIRS = list(combinations_with_replacement(range(len(FEATURES)), 2))
_SOLVED = "intercept double, " + ", ".join(f"b_{f} double" for f in FEATURES)


def continuous_months_by(monthly: DataFrame, key: str) -> DataFrame:
    """(key, month, sales) with every month between a key's first and last; missing months are 0."""
    known = monthly.select(key, F.make_date("year", "month", F.lit(1)).alias("month"), F.col("sales").cast("double"))
    ends = known.groupBy(key).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count(F.lit(1)).alias("sold"))
    months = ends.filter(F.col("sold") >= _MIN_MONTHS).select(key, F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))
    return months.join(known, [key, "month"], "left").select(key, "month", F.coalesce("sales", F.lit(0.0)).alias("sales"))


def lag_features_by(series: DataFrame, key: str, test_part: float = 0.2) -> DataFrame:
    """Lags of 1, 2, 3 and 12 months, the month number and ``is_test`` for the last part of a key's months.

    Keys with too few months that have all their lags are left out.
    """
    in_time = Window.partitionBy(key).orderBy("month")
    lags = [F.lag("sales", k).over(in_time).alias(f"lag_{k}") for k in (1, 2, 3, 12)]
    whole = series.select(key, "month", "sales", *lags, F.month("month").alias("month_num")).dropna(subset=["lag_12"])
    rows, place = F.count(F.lit(1)).over(Window.partitionBy(key)), F.row_number().over(in_time)
    split = whole.withColumns({"_rows": rows, "is_test": place > rows - F.ceil(rows * F.lit(test_part))})
    return split.filter(F.col("_rows") >= _MIN_FEATURE_ROWS).drop("_rows")


def _equations(train: DataFrame, key: str) -> DataFrame:
    """One row per key: rows, means, and the sums of the centred products of features and sales."""
    x = [F.col(f).cast("double") for f in FEATURES]
    rows = F.count(F.lit(1)).cast("double")
    sums = [(F.covar_pop(x[i], x[j]) * rows).alias(f"xx{i}_{j}") for i, j in _PAIRS]
    sums += [(F.covar_pop(v, "sales") * rows).alias(f"xy{i}") for i, v in enumerate(x)]
    return train.groupBy(key).agg(*[F.avg(v).alias(f"x{i}") for i, v in enumerate(x)], F.avg("sales").alias("y"), *sums)


def _solver(alpha: float):
    """Coefficients of many keys at once from their normal equations, each scaled to a unit diagonal."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(FEATURES)
        for batch in batches:
            column = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names) if i}
            matrix = np.empty((batch.num_rows, size, size))
            for i, j in _PAIRS:
                matrix[:, i, j] = matrix[:, j, i] = column[f"xx{i}_{j}"]
            matrix += alpha * np.eye(size)
            scale = 1 / np.sqrt(np.diagonal(matrix, axis1=1, axis2=2))
            right = np.stack([column[f"xy{i}"] for i in range(size)], axis=1) * scale
            solved = np.linalg.solve(matrix * scale[:, :, None] * scale[:, None, :], right[:, :, None])[:, :, 0] * scale
            means = np.stack([column[f"x{i}"] for i in range(size)], axis=1)
            intercept = column["y"] - (solved * means).sum(axis=1)
            columns = [batch.column(0), pa.array(intercept), *(pa.array(np.ascontiguousarray(solved[:, i])) for i in range(size))]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "intercept", *(f"b_{f}" for f in FEATURES)])

    return solve


def _predicted(lag: dict[str, Column]) -> Column:
    total = F.col("intercept")
    for name in FEATURES:
        total = total + F.col(f"b_{name}") * lag[name]
    return total


@dataclass(frozen=True)
class KeyedForecast:
    """Fitted series of all keys that have enough months; the others are not among them."""

    key: str
    series: DataFrame
    coefficients: DataFrame
    scored: DataFrame

    def metrics(self) -> DataFrame:
        """(key, mse, rmse, r2) on each key's test months."""
        error = F.avg(F.pow(F.col("sales") - F.col("prediction"), 2))
        rows = self.scored.filter("is_test").groupBy(self.key).agg(error.alias("mse"), F.var_pop("sales").alias("spread"))
        return rows.select(self.key, "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "spread")).alias("r2"))

    def forecast(self) -> DataFrame:
        """(key, month, sales, lower_bound, upper_bound) for the next months of each key.

        Each step feeds on the steps before it; a forecast is never below zero.
        """
        known = [f"_m{i}" for i in range(12)]
        back = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("month")))
        tail = self.series.withColumn("_back", back).filter("_back <= 12").groupBy(self.key)
        history = [F.max(F.when(F.col("_back") == 12 - i, F.col("sales"))).alias(n) for i, n in enumerate(known)]
        row = tail.agg(F.max("month").alias("_last"), *history).join(self.coefficients, self.key)
        residual = F.stddev_pop(F.col("sales") - F.col("prediction")).alias("_spread")
        row = row.join(self.scored.filter("NOT is_test").groupBy(self.key).agg(residual), self.key)
        for step in range(HORIZON):
            lags = {f"lag_{k}": F.col(known[-k]) for k in (1, 2, 3, 12)}
            lags["month_num"] = F.month(F.add_months("_last", step + 1))
            row = row.withColumn(f"_f{step}", F.greatest(F.lit(0.0), _predicted(lags)))
            known.append(f"_f{step}")
        steps = [F.struct(F.add_months("_last", i + 1).alias("month"), F.col(f"_f{i}").alias("sales")) for i in range(HORIZON)]
        rows = row.select(self.key, "_spread", F.inline(F.array(*steps)))
        reach = _BAND * F.col("_spread")
        return rows.select(self.key, "month", "sales", F.greatest(F.lit(0.0), F.col("sales") - reach).alias("lower_bound"), (F.col("sales") + reach).alias("upper_bound"))


def fit_by(monthly: DataFrame, key: str, alpha: float = 1.0) -> KeyedForecast:
    """``monthly`` holds (key, year, month, sales), one row per key and month with sales.

    A null key is a series of its own where the join keeps it; callers that have
    null keys should name them first.
    """
    series = stage(continuous_months_by(monthly, key), "months-by-key")
    split = stage(lag_features_by(series, key), "lags-by-key")
    solved = f"`{key}` {series.schema[key].dataType.simpleString()}, {_SOLVED}"
    coefficients = stage(_equations(split.filter("NOT is_test"), key).mapInArrow(_solver(alpha), solved), "coefficients")
    scored = split.join(coefficients, key).withColumn("prediction", _predicted({f: F.col(f) for f in FEATURES}))
    return KeyedForecast(key, series, coefficients, scored.select(*split.columns, "prediction"))

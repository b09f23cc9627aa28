"""Monthly series, lag features, ridge regression and a recursive forecast.

Works on one row per calendar month, so its windows are bounded by the length
of the history, however many sales there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.errors import NotEnoughData
from ledgerlake.staging import stage

FEATURES = ["lag_1", "lag_2", "lag_3", "lag_12", "month_num"]
HORIZON = 6
_MIN_MONTHS, _MIN_FEATURE_ROWS = 12, 6
_BAND = 1.96


def continuous_months(monthly: DataFrame) -> DataFrame:
    """(month, sales) with every month between the first and last; missing months are 0."""
    known = monthly.select(F.make_date("year", "month", F.lit(1)).alias("month"), F.col("sales").cast("double"))
    months = known.agg(F.min("month").alias("first"), F.max("month").alias("last")).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month")
    )
    return months.join(known, "month", "left").select("month", F.coalesce("sales", F.lit(0.0)).alias("sales"))


def lag_features(series: DataFrame) -> DataFrame:
    """Lags of 1, 2, 3 and 12 months and the month number; rows without all lags are dropped."""
    in_time = Window.orderBy("month")
    lagged = series.select(
        "month",
        "sales",
        *[F.lag("sales", k).over(in_time).alias(f"lag_{k}") for k in (1, 2, 3, 12)],
        F.month("month").alias("month_num"),
    )
    return lagged.dropna()


def ordered_split(features: DataFrame, test_part: float = 0.2) -> DataFrame:
    """Adds ``is_test``: true on the last part of the months, rounded up."""
    place = F.row_number().over(Window.orderBy("month"))
    rows = F.count(F.lit(1)).over(Window.partitionBy())
    return features.withColumn("is_test", place > rows - F.ceil(rows * F.lit(test_part)))


@dataclass(frozen=True)
class SalesModel:
    series: DataFrame
    scored: DataFrame
    coefficients: dict[str, float]
    intercept: float

    def _predict(self, lag: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for name in FEATURES:
            total = total + F.lit(self.coefficients[name]) * lag[name]
        return total

    def metrics(self) -> DataFrame:
        """(mse, rmse, r2) on the test months."""
        test = self.scored.filter("is_test")
        error = F.avg(F.pow(F.col("sales") - F.col("prediction"), 2))
        variance = F.var_pop("sales")
        return test.agg(
            F.round(error, 2).alias("mse"),
            F.round(F.sqrt(error), 2).alias("rmse"),
            F.round(1 - F.try_divide(error, variance), 4).alias("r2"),
        )

    def coefficient_table(self) -> DataFrame:
        rows = [(i, n, round(self.coefficients[n], 2)) for i, n in enumerate(FEATURES)]
        return self.series.sparkSession.createDataFrame(rows, "ord int, feature string, coefficient double")

    def forecast(self) -> DataFrame:
        """(month, sales, lower_bound, upper_bound) for the next months.

        Each step feeds on the steps before it; a forecast is never below zero.
        """
        tail = self.series.orderBy(F.desc("month")).limit(12)
        # One row: the last twelve months, oldest first.
        row = tail.agg(
            F.max("month").alias("last"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("month", "sales"))), lambda m: m["sales"]
            ).alias("history"),
        )
        known = [f"_m{i}" for i in range(12)]
        row = row.select("last", *[F.col("history")[i].alias(n) for i, n in enumerate(known)])
        for step in range(HORIZON):
            # lag_12 looks at the month one year before, which is still history.
            lags = {f"lag_{k}": F.col(known[-k]) for k in (1, 2, 3, 12)}
            lags["month_num"] = F.month(F.add_months("last", step + 1))
            row = row.withColumn(f"_f{step}", F.greatest(F.lit(0.0), self._predict(lags)))
            known.append(f"_f{step}")
        residual = F.col("sales") - F.col("prediction")
        spread = self.scored.filter("not is_test").agg(F.stddev_pop(residual).alias("spread")).first()["spread"]
        steps = F.array(
            *[
                F.struct(F.add_months("last", i + 1).alias("month"), F.col(f"_f{i}").alias("sales"))
                for i in range(HORIZON)
            ]
        )
        return row.select(F.inline(steps)).select(
            "month",
            "sales",
            F.greatest(F.lit(0.0), F.col("sales") - _BAND * F.lit(spread)).alias("lower_bound"),
            (F.col("sales") + _BAND * F.lit(spread)).alias("upper_bound"),
        )


def ridge(train: DataFrame, alpha: float = 1.0) -> tuple[dict[str, float], float]:
    """Least squares with ``alpha`` times the squared coefficients added.

    MLlib divides the loss by the row count and scales the label by its spread,
    so the penalty is restated in those terms.
    """
    facts = train.agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop("sales").alias("spread")).first()
    if not facts["spread"]:
        # A flat history is predicted by its level.
        level = train.agg(F.avg("sales").alias("level")).first()["level"]
        return dict.fromkeys(FEATURES, 0.0), level
    model = LinearRegression(
        featuresCol="features",
        labelCol="sales",
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=alpha * facts["spread"] / facts["rows"],
    ).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train))
    return dict(zip(FEATURES, model.coefficients.toArray().tolist())), model.intercept


def fit_sales_model(monthly: DataFrame) -> SalesModel:
    """``monthly`` holds (year, month, sales), one row per month with sales."""
    if monthly.count() < _MIN_MONTHS:
        raise NotEnoughData(f"a forecast needs {_MIN_MONTHS} months with sales")
    series = stage(continuous_months(monthly), "months")
    split = stage(ordered_split(lag_features(series)), "lags")
    if split.count() < _MIN_FEATURE_ROWS:
        raise NotEnoughData(f"a forecast needs {_MIN_FEATURE_ROWS} months that have all their lags")
    coefficients, intercept = ridge(split.filter("not is_test"))
    unscored = SalesModel(series, split, coefficients, intercept)
    scored = split.withColumn("prediction", unscored._predict({n: F.col(n) for n in FEATURES}))
    return SalesModel(series, scored, coefficients, intercept)

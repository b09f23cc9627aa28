"""Forecasts by key: closed form, and agreement with the model of a single series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.forecasts import fit_by
from ledgerlake.operators.timeseries import FEATURES, fit_sales_model


def monthly(spark, key, months, seed, gap=None):
    rng = np.random.default_rng(seed)
    rows = [(key, 2015 + i // 12, i % 12 + 1, float(1000 + 40 * i + 300 * np.sin(i / 2) + rng.normal(0, 50))) for i in range(months) if i != gap]
    return spark.createDataFrame(rows, "k string, year int, month int, sales double")


@pytest.fixture(scope="module")
def fitted(spark):
    rows = monthly(spark, "a", 48, 1).unionByName(monthly(spark, "b", 30, 2, gap=7)).unionByName(monthly(spark, "few", 11, 3))
    rows = rows.unionByName(monthly(spark, "flat", 40, 4).withColumn("sales", F.lit(5.0))).unionByName(monthly(spark, "short", 15, 5))
    return rows, fit_by(rows, "k")


def test_each_key_is_its_own_model(spark, fitted):
    rows, by = fitted
    forecasts = by.forecast().collect()
    assert {r["k"] for r in forecasts} == {"a", "b", "flat"} and len(forecasts) == 18
    found = {r["k"]: r for r in by.coefficients.collect()}
    metrics = {r["k"]: r for r in by.metrics().collect()}
    for key in ("a", "b"):
        alone = fit_sales_model(rows.filter(F.col("k") == key).drop("k"))
        assert [found[key][f"b_{f}"] for f in FEATURES] == pytest.approx([alone.coefficients[f] for f in FEATURES], rel=1e-6)
        assert found[key]["intercept"] == pytest.approx(alone.intercept, rel=1e-6)
        expected = {str(r["month"]): (r["sales"], r["lower_bound"], r["upper_bound"]) for r in alone.forecast().collect()}
        for r in (r for r in forecasts if r["k"] == key):
            assert (r["sales"], r["lower_bound"], r["upper_bound"]) == pytest.approx(expected[str(r["month"])], rel=1e-6)
        whole = alone.metrics().first()
        assert metrics[key]["rmse"] == pytest.approx(whole["rmse"], abs=0.01) and metrics[key]["r2"] == pytest.approx(whole["r2"], abs=1e-4)
    assert all(r["sales"] == r["lower_bound"] == r["upper_bound"] == 5.0 for r in forecasts if r["k"] == "flat")
    assert metrics["flat"]["r2"] is None


def test_coefficients_solve_the_normal_equations(fitted):
    _, by = fitted
    train = by.scored.filter("NOT is_test AND k = 'a'").toPandas()
    x, y = train[FEATURES].to_numpy(float), train["sales"].to_numpy()
    centred = x - x.mean(0)
    beta = np.linalg.solve(centred.T @ centred + np.eye(5), centred.T @ (y - y.mean()))
    row = by.coefficients.filter("k = 'a'").first()
    assert [row[f"b_{f}"] for f in FEATURES] == pytest.approx(beta.tolist(), rel=1e-8)


def test_no_rows_no_forecast(spark, fitted):
    by = fit_by(fitted[0].limit(0), "k")
    assert by.forecast().count() == by.metrics().count() == by.coefficients.count() == 0

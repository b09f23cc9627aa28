import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.errors import NotEnoughData
from ledgerlake.operators import classify, isolation, timeseries


def months(spark, values, start=(2020, 1)):
    rows = []
    for i, value in enumerate(values):
        year, month = divmod(start[0] * 12 + start[1] - 1 + i, 12)
        if value is not None:
            rows.append((year, month + 1, float(value)))
    return spark.createDataFrame(rows, "year int, month int, sales double")


def series_values(n=40):
    rng = np.random.default_rng(3)
    return (1000 + 200 * np.sin(np.arange(n) / 2) + rng.normal(0, 30, n)).round(2)


def test_missing_month_counts_zero(spark):
    series = timeseries.continuous_months(months(spark, [5, None, 7])).orderBy("month").collect()
    assert [(str(r["month"]), r["sales"]) for r in series] == [
        ("2020-01-01", 5.0), ("2020-02-01", 0.0), ("2020-03-01", 7.0),
    ]


def test_ridge_and_forecast_match_the_closed_form(spark):
    y = series_values()
    model = timeseries.fit_sales_model(months(spark, y))
    x = np.array([[y[i - 1], y[i - 2], y[i - 3], y[i - 12], i % 12 + 1] for i in range(12, 40)])
    target = y[12:]
    train = len(target) - int(np.ceil(len(target) * 0.2))
    centred = x[:train] - x[:train].mean(axis=0)
    beta = np.linalg.solve(centred.T @ centred + np.eye(5), centred.T @ (target[:train] - target[:train].mean()))
    level = target[:train].mean() - x[:train].mean(axis=0) @ beta
    assert list(model.coefficients.values()) == pytest.approx(beta, rel=1e-6)
    assert model.intercept == pytest.approx(level, rel=1e-6)

    errors = target[train:] - (x[train:] @ beta + level)
    metrics = model.metrics().first()
    assert metrics["mse"] == pytest.approx((errors**2).mean(), abs=0.01)
    spread = np.std(target[:train] - (x[:train] @ beta + level))
    known = list(y)
    for row in model.forecast().orderBy("month").collect():
        i = len(known)
        value = max(0.0, float(np.array([known[-1], known[-2], known[-3], known[-12], i % 12 + 1]) @ beta + level))
        known.append(value)
        assert row["sales"] == pytest.approx(value, rel=1e-6)
        assert row["upper_bound"] == pytest.approx(value + 1.96 * spread, rel=1e-6)
        assert 0 <= row["lower_bound"] <= row["sales"] <= row["upper_bound"]
    assert len(known) == 46


def test_history_too_short(spark):
    with pytest.raises(NotEnoughData):
        timeseries.fit_sales_model(months(spark, range(1, 12)))
    with pytest.raises(NotEnoughData):
        timeseries.fit_sales_model(months(spark, range(1, 18)))
    assert timeseries.fit_sales_model(months(spark, range(1, 19))).forecast().count() == 6


def test_flat_history(spark):
    model = timeseries.fit_sales_model(months(spark, [7] * 20))
    assert {round(r["sales"], 6) for r in model.forecast().collect()} == {7.0}


def customers(spark, n=60):
    people = spark.range(n).select(
        F.col("id").alias("customer_key"), F.col("id").cast("string").alias("customer_id"),
        F.lit("x").alias("customer_name"), F.element_at(F.array(F.lit("B"), F.lit("A"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("segment"),
        (F.col("id") * 2).alias("recency_days"), (F.col("id") % 7).alias("frequency"), (F.col("id") * 10).cast("decimal(28,2)").alias("monetary_value"),
        F.when(F.col("id") < n // 3, "Standard").when(F.col("id") % 2 == 0, "Gold").otherwise("Platinum").alias("customer_tier"),
    )
    facts = people.select("customer_key", *[F.col("monetary_value").alias(c) for c in ("sales", "discount", "profit")])
    return people, facts


def test_one_hot_drops_the_first(spark):
    encoded, names = classify.one_hot(customers(spark)[0], "segment")
    assert names == ["segment_B", "segment_C"]
    assert encoded.filter("segment = 'A' and segment_B + segment_C > 0").isEmpty()


def test_customer_model(spark):
    model = classify.fit_customer_model(*customers(spark))
    parts = {(r["is_high_value"], r["is_train"]): r["count"] for r in model.scored.groupBy("is_high_value", "is_train").count().collect()}
    assert parts == {(0, True): 14, (0, False): 6, (1, True): 28, (1, False): 12}
    assert sum(r["customers"] for r in model.confusion().collect()) == 18
    assert model.metrics().first()["accuracy"] > 0.8
    weights = [r["importance"] for r in model.importance().collect()]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1, abs=0.01)
    assert model.predictions().count() == 60


def test_classification_metrics_by_hand(spark):
    cells = spark.createDataFrame([(0, 0, 50), (0, 1, 10), (1, 0, 5), (1, 1, 35)], "actual int, predicted int, customers int")
    m = classify.classification_metrics(cells).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1_score"]) == (0.85, 0.7778, 0.875, 0.8235)
    none = spark.createDataFrame([(0, 0, 3), (0, 1, 0), (1, 0, 1), (1, 1, 0)], "actual int, predicted int, customers int")
    assert classify.classification_metrics(none).first()["precision"] == 0.0


def test_too_few_customers(spark):
    with pytest.raises(NotEnoughData):
        classify.fit_customer_model(*customers(spark, 10))
    people, facts = customers(spark)
    with pytest.raises(NotEnoughData):
        classify.fit_customer_model(people.withColumn("customer_tier", F.lit("Gold")), facts)


def lines(spark, n, strange=()):
    odd = F.col("fact_key").isin(list(strange))
    base = spark.range(n).withColumnRenamed("id", "fact_key")
    return base.select(
        "fact_key", F.lit("o").alias("order_id"), F.lit(1).alias("product_key"),
        F.when(odd, 1e6).otherwise(100 + F.randn(1) * 10).alias("sales"), F.lit(3).alias("quantity"),
        F.when(odd, 0.9).otherwise(F.rand(2) * 0.1).alias("discount"),
        F.when(odd, -1e6).otherwise(F.randn(3) * 5).alias("profit"),
    ), spark.createDataFrame([(1, "Pen")], "product_key int, product_name string")


# Of 60 rows two lie below the interpolated threshold.
@pytest.mark.parametrize("n, strange, rate", [(60, [7], 3.33), (5000, [11, 3000, 4999], 2.0), (30000, [5, 29999], 2.0)])
def test_planted_rows_are_the_strangest(spark, n, strange, rate):
    from ledgerlake.staging import stage

    facts, products = lines(spark, n, strange)
    found = isolation.detect_anomalies(stage(facts, "lines"), products)
    metrics = found.metrics().first()
    assert metrics["total_transactions"] == n
    assert metrics["anomaly_rate_pct"] == pytest.approx(rate, abs=0.1)
    lowest = found.scored.orderBy("anomaly_score").limit(len(strange)).collect()
    assert sorted(r["fact_key"] for r in lowest) == strange
    assert found.samples().filter("anomaly_score >= 0").isEmpty()


def test_every_tree_gets_its_sample(spark):
    for n in (300, 5000, 120_000):
        rows = spark.range(n).withColumnRenamed("id", "k")
        sizes = isolation.tree_samples(rows, "k", n, isolation.SAMPLE, 1).groupBy("tree").agg(
            F.count("k").alias("n"), F.countDistinct("k").alias("d")
        )
        assert sizes.filter("n = 256 and d = 256").count() == isolation.TREES


def test_too_few_lines(spark):
    with pytest.raises(NotEnoughData):
        isolation.detect_anomalies(*lines(spark, 49))


def test_average_path():
    assert isolation.average_path(np.array([1, 2])).tolist() == [0.0, 1.0]
    assert float(isolation.average_path(256)) == pytest.approx(10.244771, abs=1e-6)

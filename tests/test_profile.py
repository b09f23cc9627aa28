import pytest

from ledgerlake.errors import EmptyDataset
from ledgerlake.operators.profile import Profile
from ledgerlake.operators.quality import quality_scores


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_histogram_may_leave_out_the_maximum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    profile = Profile(df)
    assert [(r["bin"], r["count"]) for r in profile.histograms(include_max=False).orderBy("bin").collect()] == [(i, 1) for i in range(10)]
    full = profile.histograms().orderBy("bin").collect()
    assert full[9]["count"] == 2 and (full[9]["bin_start"], full[9]["bin_end"]) == (9.0, 10.0)


def test_value_on_the_bound_is_no_outlier(spark):
    # Quartiles 2 and 4, so the bounds are -1 and 7.
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (7.0,)], "x double")
    row = Profile(df).outliers().first()
    assert (row["q1"], row["q3"], row["outlier_count"]) == (2.0, 4.0, 0)
    more = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (7.5,)], "x double")
    assert Profile(more).outliers().first()["outlier_count"] == 1


def test_constant_empty_and_single_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, "t"), (2.0, 5.0, None, None)], "x double, c double, e double, s string")
    profile = Profile(df)
    cells = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.correlations().collect()}
    assert cells["x", "x"] == 1.0 and cells["x", "c"] is None and cells["c", "c"] is None and cells["e", "e"] is None
    columns = by(profile.columns(), "column")
    assert columns["e"]["null_count"] == 2 and columns["e"]["mean"] is None and columns["e"]["unique_count"] == 0
    assert columns["s"]["null_percentage"] == 50.0
    assert "c" not in [r["column"] for r in profile.histograms().collect()]
    one = Profile(df.limit(1)).numeric_summary().filter("column = 'x'").first()
    assert one["std_dev"] == 0.0 and one["median"] == 1.0


def test_correlation_uses_rows_where_both_are_present(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (9.0, None)], "a double, b double")
    cells = {(r["column_a"], r["column_b"]): r["correlation"] for r in Profile(df).correlations().collect()}
    assert cells["a", "b"] == pytest.approx(1.0)


def test_quality_of_a_small_table(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 1.0), ("2024-01-01", 1.0), ("01/02/2024", -1.0), (None, 2.0)], "order_date string, sales double"
    )
    scores = by(quality_scores(Profile(df)), "dimension")
    assert scores["completeness"]["score"] == 87.5
    assert scores["consistency"]["score"] == 66.67
    assert scores["validity"]["score"] == 75.0
    assert scores["uniqueness"]["score"] == 75.0
    assert scores["overall"]["status"] == "Needs Clean"


def test_empty_table(spark):
    with pytest.raises(EmptyDataset):
        Profile(spark.createDataFrame([], "x double")).null_counts()


def test_no_numeric_columns(spark):
    profile = Profile(spark.createDataFrame([("a",)], "s string"))
    assert profile.correlations().count() == 0 and profile.columns().count() == 1
    assert quality_scores(profile).filter("dimension = 'accuracy'").first()["score"] == 100.0


def test_wide_tables_can_be_looked_up(spark):
    from ledgerlake.operators.frequencies import by_column

    values = {f"c{i}": float(i) for i in range(1000)}
    rows = spark.createDataFrame([("c7",), ("c999",), ("none",)], "column string")
    assert [r[0] for r in rows.select(by_column(values)).collect()] == [7.0, 999.0, None]

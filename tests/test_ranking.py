import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.frequencies import modes, value_frequencies
from ledgerlake.operators.ranking import global_row_number, ntile_ends, ntile_scores, number_by_key, number_by_lead, rows_at
from ledgerlake.operators.selection import exact_quantiles
from ledgerlake.sources.dirt import inject_dirt
from ledgerlake.sources.testdata import sales_rows


@pytest.mark.parametrize("partitions", [1, 8])
def test_numbers_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
        rows = global_row_number(df, ["k"], "n", after=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert all(r["n"] == r["k"] + 6 for r in rows) and len(rows) == 1000


def test_rows_at_with_weights(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 4)], "v string, n int")
    found = rows_at(df, ["v"], [1, 3, 4, 5, 8], weight="n")
    assert [(r["position"], r["v"]) for r in found] == [(1, "a"), (3, "a"), (4, "b"), (5, "c"), (8, "c")]


@pytest.mark.parametrize("rows, sizes", [(7, [2, 2, 1, 1, 1]), (3, [1, 1, 1]), (5, [1] * 5), (12, [3, 3, 2, 2, 2])])
def test_tile_sizes(spark, rows, sizes):
    df = spark.range(rows).select(F.format_string("c%02d", "id").alias("c"), F.lit(1).alias("same"), "id")
    scored = ntile_scores(df, "c", {"t": F.col("id"), "u": F.col("same")}).orderBy("id").collect()
    expected = [i + 1 for i, n in enumerate(sizes) for _ in range(n)]
    assert [r["t"] for r in scored] == expected
    # Equal values are told apart by the key.
    assert [r["u"] for r in scored] == expected


def test_tile_ends():
    assert ntile_ends(7, 5) == [2, 4, 5, 6]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.25, 0.5, 0.75, 0, 1]) == {"x": [1.75, 2.5, 4.75, 1, 10]}


def test_modes(spark):
    df = spark.createDataFrame(
        [("b", 10, None), ("a", 9, None), ("b", 10, None), ("a", 9, None), ("c", 1, None)], "s string, n int, e string"
    )
    counts = value_frequencies(df)
    assert modes(counts, ["s", "n", "e"], numeric=["n"]) == {"s": "a", "n": "9"}


def test_quantiles_of_a_lopsided_column(spark):
    # One far value squeezes all others into a single bin.
    values = [float(i) for i in range(200)] + [50.0] * 300 + [1e9]
    df = spark.createDataFrame([(v, 7.0, -v) for v in values], "x double, same double, y double")
    got = exact_quantiles(df, ["x", "same", "y"], [0.02, 0.25, 0.5, 0.9, 0.999])
    for column, rows in {"x": values, "same": [7.0] * len(values), "y": [-v for v in values]}.items():
        expected = np.quantile(rows, [0.02, 0.25, 0.5, 0.9, 0.999])
        assert got[column] == pytest.approx(expected, rel=1e-12)


def test_no_values_no_quantiles(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5]) == {}


@pytest.mark.parametrize("most", [10**6, 40, 7, 1])
def test_numbers_by_lead(spark, most):
    """Whether days are whole buckets or split by the beginnings of a text; texts share a beginning, one repeats, some are null."""
    rng = np.random.default_rng(3)
    rows = [(20240101, f"ORD-2024-{int(i):05d}", int(i) % 7) for i in rng.integers(0, 300, 400)]
    rows += [(20240102, "same", i % 3) for i in range(60)] + [(20240102, None, 1), (20240102, "", 2), (20240102, "sam", 2)]
    rows += [(20240103, f"\u00e9{chr(97 + i)}" * (i % 3), i) for i in range(26)]
    expected = sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode(), r[2]))
    for partitions in (3, 5):
        df = spark.createDataFrame(rows, "day int, id string, x int").repartition(partitions)
        got = number_by_lead(df, ["day", "id", "x"], "n", most)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan.replace("rangepartitioning(day", "")
        numbered = sorted((r["n"], r["day"], r["id"], r["x"]) for r in got.collect())
        assert numbered == [(i + 1, *r) for i, r in enumerate(expected)]
    assert number_by_lead(df.limit(0), ["day", "id", "x"], "n").count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_numbers_by_key_sort_counts_only(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).withColumn("w", F.lit("wide"))
        df = df.select((F.col("k") / 3).cast("long").alias("lead"), "k", "w")
        numbered = number_by_key(df, ["lead", "k"], "n")
        rows = numbered.collect()
        assert "Sort [" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert all(r["n"] == r["k"] + 1 for r in rows) and len(rows) == 1000


def test_planted_copies_need_one_pass(spark, data):
    """Joins and scans are not gone through anew for the repeated rows."""
    plan = inject_dirt(sales_rows(spark, data), "l_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("l_extendedprice") > 0
    rows = inject_dirt(sales_rows(spark, data), "l_orderkey")
    counted = rows.groupBy("copy").count().collect()
    wanted = {0: sales_rows(spark, data).count(), 1: sales_rows(spark, data).filter("l_orderkey % 100 = 3").count()}
    assert {r["copy"]: r["count"] for r in counted} == wanted

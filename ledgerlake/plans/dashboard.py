"""Dashboard queries over the star schema.

Facts are summed per surrogate key before they meet a dimension. The sums
combine map-side, so neither a popular key nor a dimension too large to
broadcast makes the fact rows themselves move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlake.functions.values import period_label, short_name
from ledgerlake.plans.schema import TABLE_ROLES, Warehouse


def totals_by(
    facts: DataFrame, key: str, dimension: DataFrame, attributes: list[str], **measures: str
) -> DataFrame:
    """Sums of fact columns per dimension attributes; ``measures`` maps new names to fact columns."""
    per_key = facts.groupBy(key).agg(*[F.sum(c).alias(f"_{n}") for n, c in measures.items()])
    joined = per_key.join(dimension.select(key, *attributes), key)
    return joined.groupBy(*attributes).agg(*[F.sum(f"_{n}").alias(n) for n in measures])


def kpis(facts: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty fact table. ``total_orders`` is the summed quantity."""
    sums = facts.agg(
        F.sum("sales").cast("double").alias("revenue"),
        F.sum("profit").cast("double").alias("profit"),
        F.try_divide(F.sum("discount").cast("double"), F.count("discount")).alias("discount"),
        F.sum("quantity").alias("quantity"),
    )

    def or_zero(column: Column) -> Column:
        return F.coalesce(column, F.lit(0.0))

    margin = F.when(F.col("revenue") > 0, F.round(F.col("profit") / F.col("revenue") * 100, 2))
    return sums.select(
        or_zero(F.round("revenue", 2)).alias("total_revenue"),
        or_zero(F.round("profit", 2)).alias("total_profit"),
        or_zero(F.round("discount", 4)).alias("avg_discount"),
        F.coalesce("quantity", F.lit(0)).cast("bigint").alias("total_orders"),
        or_zero(margin).alias("profit_margin"),
    )


def monthly_totals(w: Warehouse) -> DataFrame:
    """(year, month, sales, profit); one row per calendar month."""
    return totals_by(w.fact_sales, "date_key", w.dim_time, ["year", "month"], sales="sales", profit="profit")


def monthly_totals_by(w: Warehouse, dim: DataFrame, key: str, attribute: str) -> DataFrame:
    """(attribute, year, month, sales); summed per pair of keys before any dimension is met."""
    pairs = w.fact_sales.groupBy("date_key", key).agg(F.sum("sales").alias("sales"))
    named = pairs.join(dim.select(key, attribute), key).join(w.dim_time.select("date_key", "year", "month"), "date_key")
    return named.groupBy(attribute, "year", "month").agg(F.sum("sales").alias("sales"))


def monthly_trend(w: Warehouse) -> DataFrame:
    label = period_label(F.col("year"), F.col("month"))
    return (
        monthly_totals(w)
        .orderBy("year", "month")
        .select(label.alias("period"), F.col("sales").cast("double"), F.col("profit").cast("double"))
    )


def _performance(totals: DataFrame, name: str) -> DataFrame:
    return totals.orderBy(F.desc("sales"), name).select(
        name, F.col("sales").cast("double"), F.col("profit").cast("double")
    )


def category_performance(w: Warehouse) -> DataFrame:
    totals = totals_by(w.fact_sales, "product_key", w.dim_products, ["category"], sales="sales", profit="profit")
    return _performance(totals, "category")


def region_performance(w: Warehouse) -> DataFrame:
    totals = totals_by(w.fact_sales, "geo_key", w.dim_geography, ["region"], sales="sales", profit="profit")
    return _performance(totals, "region")


def region_share(w: Warehouse) -> DataFrame:
    """Each region's part of all sales in percent (a window over one row per region)."""
    totals = totals_by(w.fact_sales, "geo_key", w.dim_geography, ["region"], sales="sales")
    overall = F.sum("sales").over(Window.partitionBy()).cast("double")
    share = F.round(F.col("sales").cast("double") / overall * 100, 2)
    return totals.select("region", F.col("sales").cast("double"), share.alias("share_pct"))


def top_products(w: Warehouse, count: int = 10) -> DataFrame:
    totals = totals_by(
        w.fact_sales, "product_key", w.dim_products, ["product_name"], sales="sales", profit="profit"
    )
    return (
        totals.orderBy(F.desc("sales"), "product_name")
        .limit(count)
        .select(
            short_name(F.col("product_name")).alias("product_name"),
            F.col("sales").cast("double"),
            F.col("profit").cast("double"),
        )
    )


def top_cities(w: Warehouse, count: int = 15) -> DataFrame:
    totals = totals_by(w.fact_sales, "geo_key", w.dim_geography, ["city", "state"], city_sales="sales")
    return (
        totals.orderBy(F.desc("city_sales"), "city", "state")
        .limit(count)
        .select("city", "state", F.col("city_sales").cast("double"))
    )


def average_discount(facts: DataFrame) -> DataFrame:
    return facts.agg(F.try_divide(F.sum("discount").cast("double"), F.count("discount")).alias("avg_discount"))


def _leader(totals: DataFrame, name: str) -> DataFrame:
    return totals.orderBy(F.desc("revenue"), name).limit(1)


def top_segment(w: Warehouse) -> DataFrame:
    """The segment with most sales, and how much."""
    totals = totals_by(w.fact_sales, "customer_key", w.dim_customers, ["segment"], revenue="sales")
    return _leader(totals, "segment").select("segment", F.round("revenue", 2).cast("double").alias("revenue"))


def top_region(w: Warehouse) -> DataFrame:
    totals = totals_by(w.fact_sales, "geo_key", w.dim_geography, ["region"], revenue="sales")
    return _leader(totals, "region").select("region", F.round("revenue", 2).cast("double").alias("revenue"))


def unprofitable_categories(w: Warehouse) -> DataFrame:
    totals = totals_by(w.fact_sales, "product_key", w.dim_products, ["category"], profit="profit")
    return totals.filter("profit < 0").select("category", F.col("profit").cast("double"))


def high_value_customers(w: Warehouse) -> DataFrame:
    return (
        w.dim_customers.filter("customer_tier = 'Platinum'")
        .orderBy(F.desc("monetary_value"), "customer_id")
        .select("customer_id", "customer_name", F.col("monetary_value").cast("double"), "customer_tier")
    )


def recent_months(w: Warehouse, count: int = 18) -> DataFrame:
    """The last months of the history (a top-k over one row per month)."""
    recent = monthly_totals(w).orderBy(F.desc("year"), F.desc("month")).limit(count)
    return recent.orderBy("year", "month").select(
        period_label(F.col("year"), F.col("month")).alias("period"), F.col("sales").cast("double")
    )


def summary(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table_name, role, exists, row_count); a table that is not there counts zero rows."""
    parts = []
    for name, table in tables.items():
        if table is None:
            counted = spark.range(1).select(F.lit(0).cast("bigint").alias("row_count"))
        else:
            counted = table.agg(F.count(F.lit(1)).alias("row_count"))
        names = [F.lit(name).alias("table_name"), F.lit(TABLE_ROLES.get(name)).cast("string").alias("role")]
        parts.append(counted.select(*names, F.lit(table is not None).alias("exists"), "row_count"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

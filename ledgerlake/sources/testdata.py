"""Sales rows derived from the order, customer and part tables of a test folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.operators.ranking import number_by_key
from ledgerlake.plans.schema import SALES_COLUMNS
from ledgerlake.sources.dirt import inject_dirt
from ledgerlake.sources.workbook import POSITION

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with what their parts add."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(*ROW_KEY, "l_quantity", "l_extendedprice", "l_discount")
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def sales_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line in the raw sales layout, with the line's own keys.

    Amounts are worked out in decimals and handed on as doubles, the way a
    loaded file would hold them.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    # What an order and a part add is joined to the few order rows and the narrow lines
    # first, so that an order line is shuffled by its part and by its order and no more.
    orders = (
        table("orders")
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_day"))
        .join(table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "o_day", "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    )
    lines = _lines(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.col("l_quantity").cast("int")
    discount = F.col("l_discount").cast("decimal(5,2)")
    revenue = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - discount)
    # The factor makes total profit of some categories negative.
    cost = quantity * F.col("p_retailprice").cast("decimal(12,2)") * F.lit("2.08").cast("decimal(3,2)")
    return lines.select(
        *ROW_KEY,
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_day").cast("string").alias("order_date"),
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
        F.lit("World").alias("country"),
        F.round(revenue, 2).cast("double").alias("sales"),
        quantity.alias("quantity"),
        discount.cast("double").alias("discount"),
        F.round(revenue - cost, 2).cast("double").alias("profit"),
    )


def clean_sales(spark: SparkSession, folder: str) -> DataFrame:
    return sales_rows(spark, folder).select(*SALES_COLUMNS)


def dirty_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales rows with planted faults, numbered in row order as a loaded file would be."""
    dirty = inject_dirt(sales_rows(spark, folder), "l_orderkey")
    return number_by_key(dirty, [*ROW_KEY, "copy"], POSITION).select(POSITION, *SALES_COLUMNS)

"""Columns of raw sales tables and of the star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlake.errors import SchemaMismatch

SALES_COLUMNS = [
    "order_id", "order_date", "customer_id", "customer_name", "segment", "product_id", "product_name",
    "category", "sub_category", "city", "state", "region", "country", "sales", "quantity", "discount", "profit",
]

#: What each table holds, as the summary shows it.
TABLE_ROLES = {
    "dim_customers": "one row per customer, with recency, frequency, value and tier",
    "dim_products": "one row per product, with its category",
    "dim_geography": "one row per city, state, region and country",
    "dim_time": "one row per day with sales",
    "fact_sales": "one row per dated sale, with its amounts and the keys of the other tables",
}


def require_sales_columns(raw: DataFrame) -> None:
    missing = [c for c in SALES_COLUMNS if c not in raw.columns]
    if missing:
        raise SchemaMismatch(f"raw table lacks: {', '.join(missing)}")


@dataclass(frozen=True)
class Warehouse:
    dim_customers: DataFrame
    dim_products: DataFrame
    dim_geography: DataFrame
    dim_time: DataFrame
    fact_sales: DataFrame
    # Where each table is written: a folder, or files.
    paths: dict[str, str | list[str]]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_ROLES}

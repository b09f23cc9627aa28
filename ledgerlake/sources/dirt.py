"""Planted faults in clean sales rows, for trying profiles and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def inject_dirt(sales: DataFrame, key: str) -> DataFrame:
    """Nulls, odd dates, outliers and repeated rows, chosen by an integer key.

    The same rows are hit on every run. Adds ``copy``: 1 on the repeated rows.
    """
    k = F.col(key)
    day = F.col("order_date")
    every: dict[str, Column] = {
        "segment": F.when(k % 41 != 0, F.col("segment")),
        "region": F.when(k % 53 != 4, F.col("region")),
        "order_date": F.when(k % 97 == 5, "2023-13-45")
        .when(k % 25 == 1, F.replace(day, F.lit("-"), F.lit("/")))
        .when(k % 25 == 2, F.concat_ws("-", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4)))
        .otherwise(day),
        "sales": F.when(k % 33 != 0, F.when(k % 601 == 7, F.col("sales") * 15).otherwise(F.col("sales"))),
        "profit": F.when(k % 50 != 0, F.when(k % 601 == 7, F.col("profit") * -12).otherwise(F.col("profit"))),
    }
    # Both copies come from one pass over the sales.
    copies = F.when(k % 100 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return sales.withColumns(every).withColumn("copy", F.explode(copies))

"""Filling gaps in a date column from the neighbouring rows, in row order.

Rows are grouped into blocks of 2**20 consecutive positions, so a window never
holds more than about a million rows. Only positions and values are written and
shuffled by block; of the whole rows, those with a gap meet their found value by
position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlake.staging import join_side, settled, stage

BLOCK_BITS = 20


def forward_then_backward(df: DataFrame, column: str, position: str) -> DataFrame:
    """Nulls take the last value before them, or else the first one after.

    ``position`` is a unique BIGINT giving the row order; ``column`` is a DATE,
    which keeps the per-block aggregate a hash aggregate.
    """
    # Rows that hold a value stay where they are; windows run over narrow rows of
    # position and value, which are read several times. Whole rows are worked out
    # anew in the end.
    df = settled(df, "to-fill")
    narrow = stage(df.select(F.col(position).alias("_at"), F.col(column).alias("_value")), "positions")
    rows = narrow.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    held = F.when(F.col("_value").isNotNull(), F.col("_at"))
    edges = rows.groupBy("_block").agg(F.min_by("_value", held).alias("_first"), F.max_by("_value", held).alias("_last"))
    # One row per million input rows: a block's gap is filled from the nearest
    # block that holds a value, found in one short ordered pass.
    # Looking back over rows in reverse order stands for looking ahead: a frame
    # that ends at the last row would be gone through anew for every row.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        "_block",
        F.last("_last", ignorenulls=True).over(earlier).alias("_carry_in"),
        F.last("_first", ignorenulls=True).over(later).alias("_carry_back"),
    )
    in_block = Window.partitionBy("_block")
    to_here = in_block.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    from_here = in_block.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_prior", F.last("_value", ignorenulls=True).over(to_here))
    near = near.withColumn("_next", F.last("_value", ignorenulls=True).over(from_here))
    gaps = near.filter(F.col("_value").isNull()).join(carried, "_block", "left")
    found = stage(gaps.select("_at", F.coalesce("_prior", "_carry_in", "_next", "_carry_back").alias("_found")), "fill-gaps")
    filled = df.filter(F.col(column).isNull()).join(join_side(found), F.col(position) == F.col("_at"), "left").withColumn(column, F.col("_found"))
    return df.filter(F.col(column).isNotNull()).select(*df.columns).unionByName(filled.select(*df.columns))

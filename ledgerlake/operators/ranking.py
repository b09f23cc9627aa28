"""Ranks and order statistics over a whole table without a one-task window.

``Window.orderBy`` with no partition pulls every row into one task. Here the
rows are range-partitioned by Spark's sort and written once with a position
``(slice << 33) + row in slice``; slices are in order, so one count per slice
turns positions into dense ranks. The order columns must tell all rows apart,
which also keeps a heavily repeated value from landing in one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.staging import stage

_POSITION = "_position"
_SLICE_BITS = 33


def _in_total_order(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return stage(df.sort(*order).withColumn(_POSITION, F.monotonically_increasing_id()), "ordered")


def _slice() -> Column:
    return F.shiftright(F.col(_POSITION), _SLICE_BITS)


def global_row_number(
    df: DataFrame, order: Sequence[Column | str], name: str, after: int = 0
) -> DataFrame:
    """Add dense numbers ``after + 1, after + 2, ...`` in the given total order."""
    ordered = _in_total_order(df, order).withColumn("_slice", _slice())
    sizes = ordered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sort partition, so this window and broadcast are bounded by
    # spark.sql.shuffle.partitions, not by the data.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    row_in_slice = F.col(_POSITION) - F.shiftleft(F.col("_slice"), _SLICE_BITS)
    return (
        ordered.join(F.broadcast(starts), "_slice")
        .withColumn(name, F.col("_start") + row_in_slice + 1 + F.lit(after))
        .select(*df.columns, name)
    )


def number_by_key(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense numbers 1, 2, ... in the order of ``order``, whose first column has no nulls and few rows per value.

    Only the counts per value of the first column are brought into order. They
    say where each value's numbers begin; the rest of the order is looked at
    inside a value. The join and the window share one distribution, by the
    first column, which ``df`` may have already.
    """
    key = order[0]
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    ordered = _in_total_order(counts, [key]).withColumn("_slice", _slice())
    inside = F.sum("_rows").over(Window.partitionBy("_slice").orderBy(_POSITION).rowsBetween(Window.unboundedPreceding, -1))
    # One row per sort partition.
    sizes = ordered.groupBy("_slice").agg(F.sum("_rows").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    starts = ordered.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(slices), "_slice")
    starts = starts.select(F.col(key).alias("_key"), (F.col("_before") + F.col("_inside")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order[1:]))
    return df.join(starts, F.col(key) == F.col("_key")).withColumn(name, (F.col("_start") + place).cast("long")).select(*df.columns, name)


def _common_prefix(first: str, last: str) -> int:
    return next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))


def _bucket(text: Column, depth: Column) -> Column:
    """The first characters of a text, in an order that has null before all texts."""
    return F.when(text.isNull(), "0").otherwise(F.concat(F.lit("1"), F.substring(text, F.lit(1), depth)))


def _split_depths(df: DataFrame, lead: str, second: str, counts: DataFrame, most: int) -> dict:
    """For leads with more than ``most`` rows, how many characters of ``second`` make their buckets small enough.

    Where the texts of a lead begin alike, the splitting starts behind that.
    Each round counts the leads still open, a row per bucket and task. A single
    text that has more rows stays one bucket.
    """
    found, depths = {}, {r[lead]: 0 for r in counts.filter(F.col("rows") > most).select(lead).collect()}
    while depths:
        depth = F.create_map(*[F.lit(x) for pair in depths.items() for x in pair])[F.col(lead)]
        inside = df.filter(F.col(lead).isin(list(depths))).groupBy(lead, _bucket(F.col(second), depth).alias("_bucket"))
        ends = [f(F.col(second)).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
        sizes = inside.agg(F.count(F.lit(1)).alias("rows"), *ends).filter((F.col("rows") > most) & (F.col("first") < F.col("last")))
        open_ = {}
        for r in sizes.groupBy(lead).agg(F.min_by(F.struct("first", "last"), "_bucket").alias("ends")).collect():
            open_[r[lead]] = max(_common_prefix(*r["ends"]), depths[r[lead]]) + 1
        found.update({k: d for k, d in depths.items() if k not in open_})
        depths = open_
    return {k: d for k, d in found.items() if d}


def number_by_lead(df: DataFrame, order: Sequence[str], name: str, most: int = 1 << 20) -> DataFrame:
    """Dense numbers 1, 2, ... in the order of ``order``, whose first column has few values, as a day.

    Rows are dealt by hash to buckets that follow each other in the order: one
    per value of the first column, or several by the beginnings of the second, a
    text, where a value has more than ``most`` rows. Counts per bucket, taken
    map-side, say where each bucket's numbers begin. So nothing is sorted as a
    whole or written before it is numbered. The first column has no nulls.
    """
    lead, second = order[0], order[1]
    counts = stage(df.groupBy(lead).agg(F.count(F.lit(1)).alias("rows")), "lead-counts")
    depths = _split_depths(df, lead, second, counts, most)
    depth = F.lit(0)
    if depths:
        depth = F.coalesce(F.create_map(*[F.lit(x) for pair in depths.items() for x in pair])[F.col(lead)], F.lit(0))
    before = (Window.unboundedPreceding, -1)
    # One row per value of the first column.
    starts = counts.select(lead, F.coalesce(F.sum("rows").over(Window.orderBy(lead).rowsBetween(*before)), F.lit(0)).alias("_start"))
    bucketed = df
    keys = [lead]
    if depths:
        keys = [lead, "_bucket"]
        bucketed = df.withColumn("_bucket", F.when(depth > 0, _bucket(F.col(second), depth)).otherwise(""))
        parts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        inside = F.coalesce(F.sum("rows").over(Window.partitionBy(lead).orderBy("_bucket").rowsBetween(*before)), F.lit(0))
        starts = stage(parts.join(starts, lead).select(*keys, (F.col("_start") + inside).alias("_start")), "bucket-starts")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order[1:]))
    return bucketed.join(starts, keys).withColumn(name, (F.col("_start") + place).cast("long")).select(*df.columns, name)


def rows_at(
    df: DataFrame,
    order: Sequence[Column | str],
    positions: Sequence[int],
    weight: str | None = None,
) -> list:
    """Rows standing at the given 1-based positions of the total order.

    With ``weight`` a row stands for that many equal rows. Returns one driver
    row per position, so ``positions`` must be a short list.
    """
    if not positions:
        return []
    spark = df.sparkSession
    share = F.col(weight) if weight else F.lit(1)
    ordered = _in_total_order(df, order).withColumn("_slice", _slice())
    sizes = ordered.groupBy("_slice").agg(F.sum(share).alias("rows")).orderBy("_slice").collect()

    targets, start = [], 0
    for size in sizes:
        targets += [(p, size["_slice"], start) for p in set(positions) if start < p <= start + size["rows"]]
        start += size["rows"]
    wanted = spark.createDataFrame(targets, "_target long, _slice long, _start long")

    so_far = Window.partitionBy("_slice").orderBy(_POSITION).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.filter(F.col("_slice").isin([t[1] for t in targets]))
        .withColumn("_upto", F.sum(share).over(so_far))
        .join(F.broadcast(wanted), "_slice")
        .filter(F.col("_target") <= F.col("_start") + F.col("_upto"))
        .filter(F.col("_target") > F.col("_start") + F.col("_upto") - share)
        .select(F.col("_target").alias("position"), *df.columns)
        .orderBy("position")
        .collect()
    )


def ntile_ends(rows: int, tiles: int) -> list[int]:
    """Position of the last row of every tile but the last; early tiles take the remainder."""
    small, extra = divmod(rows, tiles)
    return [t * small + min(t, extra) for t in range(1, tiles)]


def ntile_scores(
    df: DataFrame, key: str, rankings: dict[str, Column], tiles: int = 5
) -> DataFrame:
    """Add one NTILE column per ranking, each ordered by its expression, then ``key``.

    All rankings share one sort of narrow rows (ranking, value, key). Only the
    last row of each tile is needed: a row's tile is then one more than the
    number of tile ends before it, a comparison made where the row already is.
    """
    names = list(rankings)
    total = df.count()
    long = df.select(
        key,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ranking"), rankings[n].cast("decimal(38,4)").alias("value"))
                    for i, n in enumerate(names)
                ]
            )
        ).alias("_r"),
    ).select("_r.ranking", "_r.value", key)
    ends = [e for e in ntile_ends(total, tiles) if e > 0]
    positions = [i * total + e for i in range(len(names)) for e in ends]
    found = {r["position"]: r for r in rows_at(long, ["ranking", "value", key], positions)}

    def tile(i: int, name: str) -> Column:
        value = rankings[name].cast("decimal(38,4)")
        # Positions at 0 (fewer rows than tiles) lie before every row.
        passed = F.lit(1)
        for end in ends:
            last = found[i * total + end]
            limit = F.lit(last["value"]).cast("decimal(38,4)")
            beyond = (value > limit) | ((value == limit) & (F.col(key) > F.lit(last[key])))
            passed = passed + beyond.cast("int")
        return passed.cast("int").alias(name)

    return df.select("*", *[tile(i, n) for i, n in enumerate(names)])

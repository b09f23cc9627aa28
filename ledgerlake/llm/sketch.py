"""A fixed-size bit sketch of 64-bit keys, for leaving rows where they are that have no partner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: 2**SKETCH_BITS bits: 1 MB.
SKETCH_BITS = 23


def passes_sketch(rows: DataFrame, keys: DataFrame, key: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Adds ``routed``: false for rows whose ``key`` is certainly not among ``keys`` (one column, ``key``).

    The sketch has at most 2**(bits - 6) rows of two longs whatever the input,
    which is the bound of the broadcast. Where keys are many it lets more rows
    pass; callers must sort out those that have no partner after all.
    """
    place = F.shiftrightunsigned(key, 64 - bits)
    word = F.shiftright("_place", 6)
    mask = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = keys.withColumn("_place", place).groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    sketched = rows.withColumn("_place", place).withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    routed = F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))
    return sketched.withColumn("routed", routed).drop("_place", "_word", "_bits")

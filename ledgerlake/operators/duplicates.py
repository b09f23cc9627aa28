"""Repeated rows, found by hashes: whole rows move only where a hash may come twice.

64 bits of hash per row are counted, map-side first, and the hashes that come
more than once are written and marked in a sketch of bounded size. A row that
the sketch does not know stands alone and stays where it is; all others are
compared as a whole, so the result rests neither on hashes nor on the sketch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.staging import settled, stage

_HASHES = ["_row_hash"]
#: Bits of the sketch for each repeated hash, and at most: 4 MB, beyond which more and more lone rows are compared, too.
_BITS_EACH = 16
_MOST_BITS = 1 << 25


def _with_hashes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hashes pass over nulls, so which cells are null is hashed as well."""
    cells = [F.col(f"`{c}`") for c in columns]
    return df.withColumns({_HASHES[0]: F.xxhash64(*cells, *[cell.isNull() for cell in cells])})


def _repeated(hashed: DataFrame) -> DataFrame:
    counts = hashed.groupBy(*_HASHES).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    return stage(counts.select(*_HASHES), "repeated-hashes")


def _line_up(words: int):
    def line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.int64)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))], ["bits"])

    return line_up


def _may_repeat(hashed: DataFrame) -> Column:
    """Whether a row's hash may be among those that come more than once; never false for one that is."""
    repeated = _repeated(hashed)
    rows = repeated.count()
    if not rows:
        return F.lit(False)
    size = min(max(64, 1 << (rows * _BITS_EACH).bit_length()), _MOST_BITS)
    slot = F.col(_HASHES[0]).bitwiseAND(F.lit(size - 1))
    word, bit = F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")
    marks = repeated.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    # One row, of no more words than the sketch has.
    sketch = stage(marks.coalesce(1).mapInArrow(_line_up(size >> 6), "bits array<bigint>"), "repeated-sketch")
    return F.getbit(F.get(sketch.scalar(), word), bit) == 1


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier row (nulls equal each other)."""
    hashed = _with_hashes(settled(df, "to-compare"), df.columns)
    suspects = hashed.filter(_may_repeat(hashed))
    copies = suspects.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def first_copies(df: DataFrame, position: str, dropped: str = "_dropped") -> DataFrame:
    """The rows that equal no earlier one in anything but the position, with how many later copies each had."""
    data = [c for c in df.columns if c != position]
    hashed = _with_hashes(settled(df, "to-compare"), data)
    suspect = _may_repeat(hashed)
    alone = hashed.filter(~suspect).withColumn(dropped, F.lit(0).cast("long"))
    together = hashed.filter(suspect).groupBy(*[F.col(f"`{c}`") for c in data])
    first = together.agg(F.min(f"`{position}`").alias(position), (F.count(F.lit(1)) - 1).alias(dropped))
    columns = [F.col(f"`{c}`") for c in [*df.columns, dropped]]
    return alone.select(*columns).unionByName(first.select(*columns))

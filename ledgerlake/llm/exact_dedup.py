"""Exact duplicates by counting quotient filters and byte verification.

1. Every input partition builds a counting quotient filter of its texts' 64-bit
   fingerprints and sends it out in blocks of the quotient space.
2. Blocks of the same quotients are merged by sorted remainders, which loses
   nothing; fingerprints counted more than once come out. A copy held by a
   third of all rows is one slot per partition, so there is no hot block.
3. A fixed-size bit sketch of those fingerprints (its size is a parameter and
   does not follow the data) lets texts that occur once stay where they are.
   What passes the sketch but is unique is told apart by step 4.
4. Texts that pass are grouped by fingerprint *and text*: equality of the
   grouping key compares all bytes, and copies collapse before the shuffle.

Defined results: a null text counts as empty, so null and empty texts are
copies of each other; of equal texts the row with the largest doc_id stays
(null is smallest, and of rows that tie one stays); an empty table gives an
empty result; other columns are ignored by ``find_copies`` and kept by
``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.quotient_filter import QuotientFilter
from ledgerlake.llm.sketch import passes_sketch
from ledgerlake.llm.tables import named, text_of, whole_row, written

QUOTIENT_BITS = 24
BLOCK_BITS = 10


def _filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [QuotientFilter.of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), QUOTIENT_BITS) for b in batches if b.num_rows]
    if parts:
        cut = list(QuotientFilter.merged(parts).blocks(BLOCK_BITS))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in cut], pa.int64()), pa.array([f.pack() for _, f in cut], pa.binary())], ["block", "filter"]
        )


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, QuotientFilter] = {}
    for batch in batches:
        arrived: dict[int, list[QuotientFilter]] = {}
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            arrived.setdefault(block, [held[block]] if block in held else []).append(QuotientFilter.unpack(data))
        held.update({block: QuotientFilter.merged(filters) for block, filters in arrived.items()})
    for merged in held.values():
        several = merged.counts > 1
        if several.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(merged.slots[several].view(np.int64)), pa.array(merged.counts[several])], ["fp", "times"]
            )


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, times) of the 64-bit values of the one column that come more than once."""
    blocks = fingerprints.mapInArrow(_filter_blocks, "block long, filter binary")
    return blocks.repartition("block").mapInArrow(_merge_blocks, "fp long, times long")


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(named(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("fp", F.xxhash64("text"))
    narrow = written(
        texts.select("doc_id", "fp", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-narrow"
    )
    repeated = written(repeated_fingerprints(narrow.select("fp")), "exact-repeated")
    routed = passes_sketch(texts, repeated.select("fp"), "fp").filter("routed")
    same_bytes = routed.groupBy("fp", "text").agg(F.count(F.lit(1)).alias("group_size"))
    verified = (
        same_bytes.filter("group_size > 1")
        .select("fp", F.sha2("text", 256).alias("sha"), "group_size")
        .groupBy("fp", "sha")
        .agg(F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))))
    )
    stays = narrow.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "row")).alias("stays"))
    groups = written(verified.join(stays, ["fp", "sha"]).select("fp", "sha", "group_size", "stays"), "exact-groups")
    one = F.col("group_size").isNull()
    return narrow.join(groups, ["fp", "sha"], "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (one | (F.col("row") == F.col("stays.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; texts that occur once are not shuffled."""
    rows = docs.select(whole_row(docs).alias("row")).withColumn("text", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    repeated = written(repeated_fingerprints(rows.select("fp")), "exact-repeated")
    marked = passes_sketch(rows, repeated.select("fp"), "fp")
    order = F.struct(F.col("row").getField(doc_id), F.xxhash64("row"))
    groups = marked.filter("routed").groupBy("fp", "text").agg(F.max_by("row", order).alias("row"))
    return marked.filter("not routed").select("row").unionByName(groups.select("row")).select("row.*")

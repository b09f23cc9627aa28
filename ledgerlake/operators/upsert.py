"""Dimension tables that grow from run to run and keep their surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.operators.ranking import global_row_number
from ledgerlake.staging import stage


def one_per_key(rows: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per key; when a batch holds several variants the greatest one is taken.

    The variants are first brought together by a hash aggregate, which combines
    before its shuffle. Testing its count keeps the optimizer from merging the
    two steps into one that would sort every input row.
    """
    variants = rows.groupBy(*keys, *attributes).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 0")
    chosen = variants.groupBy(*keys).agg(F.max(F.struct(*attributes)).alias("_latest"))
    return chosen.select(*keys, "_latest.*")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Keys equal, with NULL equal to NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _with_new_keys(fresh: DataFrame, keys: Sequence[str], surrogate: str, after: int) -> DataFrame:
    return global_row_number(fresh, list(keys), surrogate, after)


def insert_absent(
    existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], surrogate: str | None, after: int | None = None
) -> DataFrame:
    """Stored rows unchanged, plus incoming rows whose key is not stored yet.

    New surrogate keys follow ``after``, or else the highest one of ``existing``.
    """
    if existing is None:
        return _with_new_keys(incoming, keys, surrogate, 0) if surrogate else incoming
    fresh = incoming.join(existing, same_keys(incoming, existing, keys), "left_anti")
    if surrogate:
        if after is None:
            after = existing.agg(F.max(surrogate).alias("key")).first()["key"] or 0
        fresh = _with_new_keys(fresh, keys, surrogate, after)
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(
    existing: DataFrame | None, incoming: DataFrame, key: str, attributes: Sequence[str], surrogate: str, after: int | None = None
) -> DataFrame:
    """As ``insert_absent``, but stored rows take the attributes of an incoming row with their key.

    The incoming rows are written first: they are met twice, and are often an
    aggregate of all raw rows.
    """
    if existing is None:
        return _with_new_keys(incoming, [key], surrogate, 0)
    incoming = stage(incoming, "incoming")
    news = incoming.select(
        F.col(key).alias("_key"), F.struct(*attributes).alias("_news")
    )
    seen = F.col("_key").isNotNull()
    updated = existing.join(news, existing[key] == news["_key"], "left").select(
        *[
            F.when(seen, F.col(f"_news.{c}")).otherwise(F.col(c)).alias(c) if c in attributes else F.col(c)
            for c in existing.columns
        ]
    )
    return insert_absent(updated, incoming, [key], surrogate, after)

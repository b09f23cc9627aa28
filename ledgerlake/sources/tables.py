"""Tables by name, kept as versions: a new write never touches one being read.

A version is a folder, or for keyed tables that grow a list of files by key
range. An update writes the ranges anew that a new or changed key falls into;
the next version lists these and the files that stay.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ledgerlake.errors import LedgerLakeError
from ledgerlake.operators.upsert import insert_absent, same_keys, upsert
from ledgerlake.sources.workbook import POSITION
from ledgerlake.staging import stage, stage_at

#: A row per file of each version: a folder without a range, or a file with its keys' ends, rows and highest surrogate.
_ENTRY = "name string, version bigint, path string, low string, high string, rows bigint, highest bigint"
_MANIFEST = f"{_ENTRY}, committed_at timestamp"
#: Rows of a file of a keyed table, about.
FILE_ROWS = 1 << 20
#: Files of a keyed table, about: where more were needed, they hold more rows, so that listing them does not grow with the table.
MOST_FILES = 1 << 10
_FILE = "_file"


def clean_identifier(name: str) -> str:
    """Trimmed, lower case, without semicolons and quotes; letters, digits and underscore only."""
    cleaned = re.sub("[;']", "", name.strip().lower())
    if not re.fullmatch(r"\w+", cleaned):
        raise LedgerLakeError(f"not a table name: {name!r}")
    return cleaned


class TableStore:
    """The tables of one schema, with a manifest naming each table's current version."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark = spark
        self._tables = f"{root.rstrip('/')}/{schema}"
        self._manifest = f"{root.rstrip('/')}/{schema}-manifest"

    def _commit(self, entries: list[tuple]) -> None:
        rows = self.spark.createDataFrame(entries, _ENTRY).withColumn("committed_at", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(self._manifest)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a new version, then make it the current one."""
        name = clean_identifier(name)
        version = time.time_ns()
        path = f"{self._tables}/{name}/{version}"
        written = stage_at(rows, path, "zstd")
        self._commit([(name, version, path, None, None, None, None)])
        return written

    def merge(
        self, name: str, incoming: DataFrame, keys: Sequence[str], attributes: Sequence[str], surrogate: str, file_rows: int = FILE_ROWS
    ) -> DataFrame:
        """Bring one row per key into a keyed table; only files whose range holds a new or changed key are written anew.

        The first key, a text, orders the files. Stored rows keep their
        surrogate; without ``attributes`` they stay as they are. The driver
        handles one manifest row per file of the table. A file has ``file_rows``
        rows, or as many as bring a large table to ``MOST_FILES`` files.
        """
        name = clean_identifier(name)
        incoming = stage(incoming, "incoming")
        files = sorted(self._files(name), key=lambda f: f["low"] or "")
        if any(f["rows"] is None for f in files):  # written whole so far
            return self._write_ranges(name, self._merged(self.find(name), incoming, keys, attributes, surrogate, None), keys[0], surrogate, [], [], file_rows)
        if not files:
            return self._write_ranges(name, insert_absent(None, incoming, keys, surrogate), keys[0], surrogate, [], [], file_rows)
        placed = _placed(incoming, keys[0], files)
        met = [r[_FILE] for r in placed.select(_FILE).distinct().collect()]
        stored = self.spark.read.parquet(*[files[i]["path"] for i in met]).select(*keys, *[F.col(c).alias(f"_old_{c}") for c in attributes])
        stored = stored.withColumn("_stored", F.lit(True))
        news = placed.join(stored, same_keys(placed, stored, keys), "left")
        differs = F.col("_stored").isNull()
        for c in attributes:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        touched = sorted(r[_FILE] for r in news.filter(differs).select(placed[_FILE]).distinct().collect())
        if not touched:
            return self.find(name)
        old = self.spark.read.parquet(*[files[i]["path"] for i in touched])
        own = placed.filter(F.col(_FILE).isin(touched)).drop(_FILE)
        merged = self._merged(old, own, keys, attributes, surrogate, max(f["highest"] for f in files))
        return self._write_ranges(name, merged, keys[0], surrogate, files, touched, file_rows)

    @staticmethod
    def _merged(old: DataFrame, incoming: DataFrame, keys: Sequence[str], attributes: Sequence[str], surrogate: str, after: int | None) -> DataFrame:
        if attributes:
            return upsert(old, incoming, keys[0], attributes, surrogate, after)
        return insert_absent(old, incoming, keys, surrogate, after)

    def _write_ranges(
        self, name: str, rows: DataFrame, lead: str, surrogate: str, files: list[Row], touched: list[int], file_rows: int
    ) -> DataFrame:
        """Write ``rows`` by range in place of the ``touched`` files; no new file reaches beyond the range of one of these."""
        version = time.time_ns()
        folder = f"{self._tables}/{name}/{version}"
        placed = stage(_placed(rows, lead, files), "ranges")
        count = placed.count()
        total = count + sum(f["rows"] for i, f in enumerate(files) if i not in touched)
        parts = max(len(touched), -(-count // max(file_rows, -(-total // MOST_FILES))), 1)
        placed.repartitionByRange(parts, _FILE, lead).sortWithinPartitions(_FILE, lead).write.partitionBy(_FILE).parquet(folder)
        written = self.spark.read.parquet(folder).select("*", F.col("_metadata.file_name").alias("_name"))
        ends = [F.min(lead).alias("low"), F.max(lead).alias("high"), F.count(F.lit(1)).alias("rows"), F.max(surrogate).alias("highest")]
        new = [(f"{folder}/{_FILE}={r[_FILE]}/{r['_name']}", *r[2:]) for r in written.groupBy(_FILE, "_name").agg(*ends).collect()]
        kept = [tuple(f[c] for c in ("path", "low", "high", "rows", "highest")) for i, f in enumerate(files) if i not in touched]
        self._commit([(name, version, *f) for f in [*kept, *new]])
        return self.find(name)

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(self._manifest)
        except AnalysisException:
            return self.spark.createDataFrame([], _MANIFEST)

    def _files(self, name: str) -> list[Row]:
        """The manifest rows of the current version."""
        mine = self.versions().filter(F.col("name") == clean_identifier(name))
        last = mine.agg(F.max("version").alias("version")).first()["version"]
        return [] if last is None else mine.filter(F.col("version") == last).collect()

    def path(self, name: str) -> str | list[str] | None:
        """The folder of the current version, or its files."""
        paths = [f["path"] for f in self._files(name)]
        return paths if len(paths) > 1 else paths[0] if paths else None

    def find(self, name: str) -> DataFrame | None:
        paths = [f["path"] for f in self._files(name)]
        return self.spark.read.parquet(*paths) if paths else None

    def scan(self, name: str, with_position: bool = False) -> DataFrame:
        """The table's current rows; the position column only on request."""
        rows = self.find(name)
        if rows is None:
            raise LedgerLakeError(f"table '{name}' not found")
        return rows if with_position else rows.drop(POSITION)


def _placed(rows: DataFrame, lead: str, files: list[Row]) -> DataFrame:
    """Adds the number of the file, in key order, whose range a row's key falls into; the first takes all before it."""
    if len(files) < 2:
        return rows.withColumn(_FILE, F.lit(0))
    lows = np.array([f["low"] for f in files[1:]], object)
    at = rows.columns.index(lead)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).fill_null("").to_numpy(zero_copy_only=False)
            numbers = np.searchsorted(lows, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, _FILE])

    return rows.mapInArrow(place, rows.withColumn(_FILE, F.lit(0)).schema)

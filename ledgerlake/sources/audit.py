"""Append-only records of ETL runs and cleaning operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlake.operators.cleaning import RULE_SCHEMA, Rule

_TEXT, _TIME = T.StringType(), T.TimestampType()

STEP_SCHEMA = T.StructType(
    [
        T.StructField("step", _TEXT),
        T.StructField("status", _TEXT),
        T.StructField("timestamp", _TEXT),
        T.StructField("logs", T.ArrayType(_TEXT)),
        T.StructField("error", _TEXT),
    ]
)
_RUN_SCHEMA = T.StructType(
    [
        T.StructField("id", _TEXT),
        T.StructField("event", T.IntegerType()),
        T.StructField("name", _TEXT),
        T.StructField("status", _TEXT),
        T.StructField("steps_completed", T.ArrayType(STEP_SCHEMA)),
        T.StructField("started_at", _TIME),
        T.StructField("recorded_at", _TIME),
    ]
)
_HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("dataset_name", _TEXT),
        T.StructField("operations", T.ArrayType(RULE_SCHEMA)),
        T.StructField("applied_at", _TIME),
    ]
)


class AuditLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._runs = f"{root.rstrip('/')}/etl_run_log"
        self._history = f"{root.rstrip('/')}/transformation_history"

    def _append(self, path: str, row: tuple, schema: T.StructType) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def run_event(self, run_id: str, event: int, name: str, status: str, steps: list, started_at, now) -> None:
        """A run's state is its latest event; nothing is updated in place."""
        rows = [tuple(step.get(f) for f in STEP_SCHEMA.names) for step in steps]
        self._append(self._runs, (run_id, event, name, status, rows, started_at, now), _RUN_SCHEMA)

    def runs(self) -> DataFrame:
        """Latest state of each run, newest first."""
        latest = F.max_by(F.struct("name", "status", "steps_completed", "started_at", "recorded_at"), "event")
        done = F.col("status").isin("COMPLETED", "FAILED")
        return (
            self._read(self._runs, _RUN_SCHEMA)
            .groupBy("id")
            .agg(latest.alias("last"))
            .select("id", "last.*")
            .withColumn("completed_at", F.when(done, F.col("recorded_at")))
            .drop("recorded_at")
            .orderBy(F.desc("started_at"))
        )

    def record_cleaning(self, dataset: str, rules: Sequence[Rule], now) -> None:
        self._append(self._history, (dataset, [r.as_row() for r in rules], now), _HISTORY_SCHEMA)

    def history(self, dataset: str) -> DataFrame:
        """Cleaning operations on a dataset, newest first."""
        return (
            self._read(self._history, _HISTORY_SCHEMA)
            .filter(F.col("dataset_name") == dataset)
            .select("operations", "applied_at")
            .orderBy(F.desc("applied_at"))
        )

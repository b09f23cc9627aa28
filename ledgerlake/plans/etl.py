"""The full run: check, clean, dimensions, facts, each step logged."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.errors import EtlFailed
from ledgerlake.functions.names import lower_case_columns
from ledgerlake.operators.cleaning import Rule, apply_rules, preview, recommend_rules, rules_list
from ledgerlake.operators.profile import Profile
from ledgerlake.plans.schema import TABLE_ROLES, Warehouse, require_sales_columns
from ledgerlake.plans.warehouse import GEOGRAPHY, PRODUCT, calendar, customers, facts, place_rows, product_rows
from ledgerlake.sources.audit import AuditLog
from ledgerlake.sources.tables import TableStore
from ledgerlake.sources.workbook import POSITION
from ledgerlake.staging import join_side, scratch

RAW, WAREHOUSE = "raw_imports", "warehouse"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Cleaned:
    logs: list[str]
    row_count: int
    preview: DataFrame
    rows: DataFrame


class Lake:
    """Raw tables, warehouse and audit records under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.raw = TableStore(spark, root, RAW)
        self.star = TableStore(spark, root, WAREHOUSE)
        self.audit = AuditLog(spark, root)

    def profile(self, table: str) -> Profile:
        return Profile(self.raw.scan(table))

    def recommendations(self, table: str) -> DataFrame:
        return recommend_rules(self.profile(table))

    def clean(
        self,
        table: str,
        rules: Sequence[Rule],
        preview_only: bool = False,
        formats: Sequence[str] | None = None,
    ) -> Cleaned:
        """Apply rules; unless only previewed, the result replaces the table and is recorded."""
        with nullcontext() if preview_only else scratch(self.spark):
            rows, logs = apply_rules(self.raw.scan(table, with_position=True), rules, POSITION, formats)
            if not preview_only:
                rows = self.raw.replace(table, rows)
        if not preview_only:
            self.audit.record_cleaning(table, rules, _now())
        return Cleaned(logs, rows.count(), preview(rows, POSITION), rows.drop(POSITION))

    def normalise_casing(self, table: str) -> None:
        """Lower-case the table's column names if any are not."""
        rows = self.raw.scan(table, with_position=True)
        lowered = lower_case_columns(rows)
        if lowered.columns != rows.columns:
            self.raw.replace(table, lowered)

    def warehouse(self) -> Warehouse | None:
        tables = {name: self.star.find(name) for name in TABLE_ROLES}
        if any(t is None for t in tables.values()):
            return None
        sides = {name: table if name == "fact_sales" else join_side(table) for name, table in tables.items()}
        return Warehouse(**sides, paths={n: self.star.path(n) for n in TABLE_ROLES})

    def _load_dimensions(self, rows: DataFrame) -> dict[str, DataFrame]:
        """Products and places are merged by key range; days are few, and customers' scores change with every load."""
        products = self.star.merge("dim_products", product_rows(rows), ["product_id"], PRODUCT, "product_key")
        places = self.star.merge("dim_geography", place_rows(rows), GEOGRAPHY, [], "geo_key")
        days = self.star.replace("dim_time", calendar(rows, self.star.find("dim_time")))
        people = self.star.replace("dim_customers", customers(rows, self.star.find("dim_customers")))
        return {"dim_products": products, "dim_geography": places, "dim_time": days, "dim_customers": people}

    def run(self, table: str, formats: Sequence[str] | None = None) -> list[dict]:
        """Clean the raw table and load the warehouse from it; returns the step log.

        Dimensions keep their keys from run to run, facts are rebuilt. A failed
        run is recorded and raised.
        """
        run_id, started, name = uuid.uuid4().hex, _now(), f"ETL Pipeline ({table})"
        steps: list[dict] = []
        events = itertools.count()

        def record(status: str) -> None:
            self.audit.run_event(run_id, next(events), name, status, steps, started, _now())

        def begin(step: str) -> None:
            steps.append({"step": step, "status": "IN_PROGRESS", "timestamp": _now().isoformat()})

        def finish(logs: list[str] | None = None) -> None:
            steps[-1].update(status="COMPLETED", **({"logs": logs} if logs is not None else {}))
            record("RUNNING")

        record("STARTING")
        try:
            self.normalise_casing(table)
            # Step names and states as the log shows them.
            begin("Validate Raw Schema")
            require_sales_columns(self.raw.scan(table))
            finish()

            begin("Run Recommendations & Auto-Clean")
            rules = rules_list(self.recommendations(table))
            cleaned = self.clean(table, rules, formats=formats)
            finish(cleaned.logs)

            begin("Generate Star Schema Dimensions")
            with scratch(self.spark):
                dims = self._load_dimensions(cleaned.rows)
            finish()

            begin("Populate Fact Sales")
            keyed = (dims[n] for n in ("dim_customers", "dim_products", "dim_geography"))
            with scratch(self.spark):
                self.star.replace("fact_sales", facts(cleaned.rows, *keyed))
            finish()
            record("COMPLETED")
        except Exception as problem:
            steps.append(
                {
                    "step": "ETL Pipeline Failed",
                    "status": "FAILED",
                    "error": str(problem),
                    "timestamp": _now().isoformat(),
                }
            )
            record("FAILED")
            raise EtlFailed(f"the run over '{table}' failed: {problem}") from problem
        return steps

"""Tables the named queries share, each written once per folder and session."""

from __future__ import annotations

import io
import zipfile
from functools import cached_property
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.operators.classify import CustomerModel, fit_customer_model
from ledgerlake.operators.cleaning import apply_rules, recommend_rules, rules_list
from ledgerlake.operators.forecasts import KeyedForecast, fit_by
from ledgerlake.operators.isolation import Anomalies, detect_anomalies
from ledgerlake.operators.profile import Profile
from ledgerlake.operators.timeseries import SalesModel, fit_sales_model
from ledgerlake.plans import dashboard
from ledgerlake.plans.etl import Lake
from ledgerlake.plans.schema import SALES_COLUMNS, Warehouse
from ledgerlake.plans.warehouse import build_warehouse
from ledgerlake.sources.testdata import clean_sales, dirty_sales
from ledgerlake.sources.workbook import POSITION
from ledgerlake.staging import new_path, scratch, stage, stage_at


class Folder:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def clean(self) -> DataFrame:
        return stage(clean_sales(self.spark, self.folder), "clean-sales")

    @cached_property
    def star(self) -> Warehouse:
        return build_warehouse(self.clean)

    @cached_property
    def dirty(self) -> DataFrame:
        """Raw rows with planted faults and their position."""
        with scratch(self.spark):
            return stage_at(dirty_sales(self.spark, self.folder), new_path(self.spark, "dirty-sales"), "zstd")

    @cached_property
    def profile(self) -> Profile:
        return Profile(self.dirty.drop(POSITION))

    @cached_property
    def cleaned(self) -> DataFrame:
        """The dirty rows after all recommended rules."""
        dirty, profile = self.dirty, self.profile
        with scratch(self.spark):
            rows, _ = apply_rules(dirty, rules_list(recommend_rules(profile)), POSITION)
            return stage_at(rows, new_path(self.spark, "cleaned-sales"), "zstd")

    @cached_property
    def lake(self) -> Lake:
        """A lake in which the dirty rows were imported and one full run was made."""
        lake = Lake(self.spark, new_path(self.spark, "lake"))
        lake.raw.replace("sales", self.dirty)
        lake.run("sales")
        return lake

    @cached_property
    def csv(self) -> str:
        """The dirty rows as semicolon-separated files with unnormalised headers."""
        path = new_path(self.spark, "csv")
        titles = [c.replace("_", " ").title() for c in SALES_COLUMNS]
        rows = self.dirty.select(*SALES_COLUMNS).toDF(*titles)
        rows.write.option("header", True).option("sep", ";").csv(path)
        return path

    @cached_property
    def monthly(self) -> DataFrame:
        return dashboard.monthly_totals(self.star).select("year", "month", F.col("sales").cast("double"))

    @cached_property
    def sales_model(self) -> SalesModel:
        return fit_sales_model(self.monthly)

    @cached_property
    def category_forecast(self) -> KeyedForecast:
        return fit_by(dashboard.monthly_totals_by(self.star, self.star.dim_products, "product_key", "category"), "category")

    @cached_property
    def customer_model(self) -> CustomerModel:
        return fit_customer_model(self.star.dim_customers, self.star.fact_sales)

    @cached_property
    def anomalies(self) -> Anomalies:
        return detect_anomalies(self.star.fact_sales, self.star.dim_products)


_folders: dict[tuple[str, str], Folder] = {}


def folder(spark: SparkSession, path: str) -> Folder:
    key = (spark.sparkContext.applicationId, str(path).rstrip("/"))
    if key not in _folders:
        _folders[key] = Folder(spark, key[1])
    return _folders[key]


_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(spark: SparkSession, root: str, name: str, rows: DataFrame) -> str:
    """A small table as a workbook of one sheet, so that the reader has one to read."""

    def cell(place: int, number: int, value: object) -> str:
        at = f'r="{chr(65 + place)}{number}"'
        return f"<c {at}><v>{value}</v></c>" if isinstance(value, int) else f'<c {at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    lines = [rows.columns, *rows.collect()]
    body = "".join(f'<row r="{i}">' + "".join(cell(p, i, v) for p, v in enumerate(line)) + "</row>" for i, line in enumerate(lines, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_SHEETS}" xmlns:r="{_LINKS}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEETS}"><sheetData>{body}</sheetData></worksheet>',
    }
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as book:
        for part, text in parts.items():
            book.writestr(part, text)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    out.write(bytearray(content.getvalue()))
    out.close()
    return f"{root}/{name}"

"""Delimited files and workbooks as raw tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerlake.errors import EmptyDataset, ImportFailed
from ledgerlake.functions.names import normalise_headers, table_name
from ledgerlake.functions.dates import RECOVERING_FORMATS, parse_date
from ledgerlake.sources.inference import as_type, infer_types, present
from ledgerlake.sources.workbook import POSITION, read_workbook
from ledgerlake.staging import stage

DATASET_FILES = "*.{csv,xlsx,xls}"
_BAD_ROW = "_bad_row"


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, size_bytes, modified_at); contents are not read, and files of no bytes are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", DATASET_FILES).load(folder)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Comma, unless the header line has none and holds a semicolon or else a tab."""
    first = spark.read.text(path).limit(1).first()
    header = first["value"] if first else ""
    if "," in header:
        return ","
    return ";" if ";" in header else "\t" if "\t" in header else ","


def _open_ended(delimiter: str) -> Column:
    """Whether a line, taken by itself, ends inside a quoted cell.

    A quote opens a cell only where the cell begins, so one inside a plain
    cell, as for inches, is no sign of a line break.
    """
    sep = re.escape(delimiter)
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    plain = rf'(?:[^"{sep}][^{sep}]*+)?'
    return F.col("value").rlike(rf'^(?:(?:{quoted}"[^{sep}]*+|{plain}){sep})*+{quoted}$')


def _broken_files(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    """The files in which some line ends inside quotes; a name per file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return [r["file"] for r in lines.filter(_open_ended(delimiter)).select("file").distinct().collect()]


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    delimiter: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Files with a header line. A given schema saves finding the types.

    Line breaks inside quotes are found; files that have any, or all with
    ``multiline``, are read in one task each, the others in splits. Rows with
    more cells than the header, and cells that do not fit a given schema, raise
    ``ImportFailed``; they are counted in the pass that finds the types.
    """
    delimiter = delimiter or sniff_delimiter(spark, path)
    broken = [] if multiline else _broken_files(spark, path, delimiter)

    def read(fields: T.StructType | None = None, paths: str | list[str] = path, whole: bool = multiline) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
        reader = reader.option("multiLine", whole).option("columnNameOfCorruptRecord", _BAD_ROW)
        return (reader.schema(fields) if fields is not None else reader).csv(paths)

    def rows_of(fields: T.StructType) -> DataFrame:
        if not broken:
            return read(fields)
        plain = read(fields).filter(~F.col("_metadata.file_path").isin(broken))
        return plain.unionByName(read(fields, broken, True))

    names = schema or T.StructType([T.StructField(c, T.StringType()) for c in read(None, broken or path, bool(broken) or multiline).columns])
    marked = rows_of(T.StructType([*names.fields, T.StructField(_BAD_ROW, T.StringType())]))
    bad = F.col(_BAD_ROW).isNotNull()
    if schema is None:
        # Of plain texts only rows with cells to spare; short rows end in nulls.
        bad = bad & F.col(f"`{names.names[-1]}`").isNotNull()
    cells = [F.col(f"`{c}`") for c in names.names]
    # Every column is asked for, or the reader would not look at all cells.
    asked = (F.count_if(bad), F.min(F.when(bad, F.col(_BAD_ROW))), F.count(F.coalesce(*[c.cast("string") for c in cells], F.col(_BAD_ROW))))
    if schema is None:
        texts = marked.select(*[present(c).alias(n) for c, n in zip(cells, names.names)], _BAD_ROW)
        types, found = infer_types(texts, names.names, *asked)
    else:
        found = marked.agg(*asked).first()
    if found[0]:
        raise ImportFailed(f"{found[0]} rows do not fit the columns, such as: {found[1]}")
    raw = rows_of(names)
    if schema is not None:
        return raw
    return raw.select(*[as_type(present(F.col(f"`{c}`")), t).alias(c) for c, t in types.items()])


def schema_report(df: DataFrame) -> DataFrame:
    """(column, type): INTEGER, FLOAT, BOOLEAN, TIMESTAMP or TEXT, for information only.

    A text column is called TIMESTAMP when all its values parse.
    """
    data = df.drop(POSITION)

    def kind(f: T.StructField) -> str:
        if isinstance(f.dataType, T.IntegralType):
            return "INTEGER"
        if isinstance(f.dataType, T.NumericType):
            return "FLOAT"
        if isinstance(f.dataType, T.BooleanType):
            return "BOOLEAN"
        return "TIMESTAMP" if isinstance(f.dataType, T.DatetimeType) else "TEXT"

    fields = data.schema.fields
    facts = []
    for field in fields:
        column = F.col(f"`{field.name}`")
        dates = F.lit(None)
        if kind(field) == "TEXT":
            dates = parse_date(column, RECOVERING_FORMATS, with_time=True)
            dates = F.coalesce(dates, *[parse_date(column, [f], with_time=True) for f in ("M/d/yyyy", "d/M/yyyy")])
        facts.append(F.struct(F.count(column).alias("values"), F.count(dates).alias("dates")))
    # One pass and one row for all columns.
    found = data.agg(*[fact.alias(f"c{i}") for i, fact in enumerate(facts)]).first() if fields else []
    rows = []
    for place, (field, fact) in enumerate(zip(fields, found)):
        label = kind(field) if fact["values"] else "TEXT"
        if label == "TEXT" and fact["values"] and fact["dates"] == fact["values"]:
            label = "TIMESTAMP"
        rows.append((place, field.name, label))
    return df.sparkSession.createDataFrame(rows, "ord int, column string, type string")


@dataclass(frozen=True)
class Imported:
    table: str
    rows: DataFrame
    row_count: int
    col_count: int
    schema: DataFrame


def import_file(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    delimiter: str | None = None,
    multiline: bool = False,
) -> Imported:
    """Load one file as a raw table with normalised headers and a row position."""
    filename = path.rstrip("/").split("/")[-1]
    if filename.endswith(".xls"):
        raise ImportFailed("only the .xlsx workbook format is supported")
    try:
        if filename.endswith(".xlsx"):
            loaded = read_workbook(spark, path)
        else:
            loaded = read_delimited(spark, path, schema, delimiter, multiline)
    except (EmptyDataset, ImportFailed):
        raise
    except Exception as problem:
        raise ImportFailed(f"could not read '{filename}': {problem}") from problem
    if POSITION not in loaded.columns:
        # The splits of one file are read in file order.
        loaded = loaded.withColumn(POSITION, F.monotonically_increasing_id())
    rows = stage(normalise_headers(loaded), "import")
    count = rows.count()
    if not count:
        raise EmptyDataset(f"'{filename}' holds no rows")
    return Imported(table_name(filename), rows, count, len(rows.columns) - 1, schema_report(rows))


def export_csv(df: DataFrame, path: str) -> None:
    """Header line, everything quoted, quotes escaped with a backslash, nulls written as null."""
    (
        df.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", "\\")
        .option("nullValue", "null")
        .csv(path)
    )

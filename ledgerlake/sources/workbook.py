"""First sheet of .xlsx workbooks, one task per workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlake.errors import EmptyDataset, ImportFailed
from ledgerlake.sources.inference import as_type, infer_types, present
from ledgerlake.staging import stage

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROW_SCHEMA = "file string, row bigint, cells map<int,string>"
# A sheet has at most 2**20 rows.
_SHEET_BITS = 21

# Row order of a loaded file. Kept beside the data columns, never among them.
POSITION = "ingest_pos"

# Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())
    }
    formats = root.find(f"{_MAIN}cellXfs")
    cells = [] if formats is None else list(formats)
    return {i for i, f in enumerate(cells) if int(f.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")[0].get(_REL_ID)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == sheet)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root]


def _cell_text(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind is None and int(cell.get("s", 0)) in dates:
        moment = pd.Timestamp("1899-12-30") + pd.to_timedelta(float(value.text), unit="D").round("s")
        return moment.strftime("%Y-%m-%d" if moment == moment.normalize() else "%Y-%m-%d %H:%M:%S")
    return value.text


def _sheet_rows(content: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared_texts(book), _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells = {}
                for place, cell in enumerate(row.findall(f"{_MAIN}c")):
                    reference = cell.get("r")
                    text = _cell_text(cell, shared, dates)
                    if text is not None:
                        cells[_column_index(reference) if reference else place] = text
                yield int(row.get("r", 0)), cells
                row.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            chunk = []
            for number, cells in _sheet_rows(content):
                chunk.append((path, number, cells))
                if len(chunk) == 5000:
                    yield pd.DataFrame(chunk, columns=["file", "row", "cells"])
                    chunk = []
            if chunk:
                yield pd.DataFrame(chunk, columns=["file", "row", "cells"])


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, cells by column number) of every workbook under the path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parse, _ROW_SCHEMA)


def header_names(cells: dict[int, str], widest: int) -> list[str]:
    """A name for every column up to the widest row: repeats are numbered, blank headers named by place."""
    names: list[str] = []
    for place in range(widest + 1):
        base = name = cells.get(place) or f"Unnamed: {place}"
        number = 0
        while name in names:
            number += 1
            name = f"{base}.{number}"
        names.append(name)
    return names


def _shown(cells: dict[int, str]) -> str:
    return "{" + ", ".join(f"{k} -> {v}" for k, v in sorted(cells.items())) + "}"


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks with the same header row, as one table typed by its values.

    Rows keep their order: workbooks by path, then rows by number.
    """
    cells = stage(workbook_cells(spark, path), "workbook").filter(F.size("cells") > 0)
    # One row per workbook.
    headers = cells.groupBy("file").agg(F.min("row").alias("_header"))
    headers = headers.withColumn("_book", F.row_number().over(Window.orderBy("file")) - 1)
    located = cells.join(headers, "file")
    top = located.filter("row = _header")
    header = top.filter("_book = 0").select("cells").first()
    if header is None:
        raise EmptyDataset("the workbook holds no rows")
    other = top.filter(F.map_from_entries(F.array_sort(F.map_entries("cells"))).cast("string") != _shown(header["cells"]))
    if (odd := other.select("file").first()) is not None:
        raise ImportFailed(f"the header row of {odd['file']} differs from that of the first workbook")
    widest = located.agg(F.max(F.array_max(F.map_keys("cells")))).first()[0]
    names = header_names(header["cells"], widest)
    texts = located.filter("row > _header").select(
        *[present(F.col("cells")[i]).alias(name) for i, name in enumerate(names)],
        (F.shiftleft(F.col("_book").cast("bigint"), _SHEET_BITS) + F.col("row")).alias(POSITION),
    )
    types, _ = infer_types(texts, [c for c in texts.columns if c != POSITION])
    return texts.select(*[as_type(F.col(f"`{c}`"), t).alias(c) for c, t in types.items()], POSITION)

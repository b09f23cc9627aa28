import os
import zipfile

import pytest

from ledgerlake.errors import EmptyDataset, ImportFailed, SchemaMismatch
from ledgerlake.functions.names import normalise_header, normalise_headers, table_name
from ledgerlake.sources import files


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def test_names(spark):
    assert normalise_header(" Sub-Category.X y ") == "sub_category_x_y"
    assert table_name("Store Sales-2024.v2.csv") == "store_sales_2024"
    with pytest.raises(SchemaMismatch):
        normalise_headers(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_delimiters(spark, tmp_path, sep):
    body = "Order ID|Order Date|Sales.Total|N|Flag|E\nA-1|2024-01-02|1.5|1|True|\nA-2|NA|2|2|False|\n"
    got = files.import_file(spark, write(tmp_path, "My Sales-1.csv", body.replace("|", sep)))
    assert got.table == "my_sales_1" and (got.row_count, got.col_count) == (2, 6)
    assert got.rows.drop("ingest_pos").dtypes == [
        ("order_id", "string"), ("order_date", "string"), ("sales_total", "double"), ("n", "bigint"),
        ("flag", "boolean"), ("e", "string"),
    ]
    assert [r["order_date"] for r in got.rows.orderBy("ingest_pos").collect()] == ["2024-01-02", None]
    kinds = {r["column"]: r["type"] for r in got.schema.collect()}
    assert kinds == {
        "order_id": "TEXT", "order_date": "TIMESTAMP", "sales_total": "FLOAT", "n": "INTEGER", "flag": "BOOLEAN", "e": "TEXT",
    }


def test_whole_numbers_with_gaps_become_double(spark, tmp_path):
    rows = files.read_delimited(spark, write(tmp_path, "x.csv", 'a,b\n1,"say ""hi"""\n,x\n3,y\n'))
    assert rows.dtypes[0] == ("a", "double") and rows.first()["b"] == 'say "hi"'


def test_given_schema(spark, tmp_path):
    from pyspark.sql import types as T

    path = write(tmp_path, "x.csv", "a,b\n1,2\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    assert [tuple(r) for r in files.read_delimited(spark, path, schema).collect()] == [("1", 2)]


def test_empty_and_unreadable(spark, tmp_path):
    with pytest.raises(EmptyDataset):
        files.import_file(spark, write(tmp_path, "e.csv", "a,b\n"))
    with pytest.raises(ImportFailed):
        files.import_file(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ImportFailed):
        files.import_file(spark, str(tmp_path / "old.xls"))


def test_listing(spark, tmp_path):
    write(tmp_path, "a.csv", "x\n1\n")
    write(tmp_path, "b.txt", "x\n")
    write(tmp_path, "c.xlsx", "zip")
    listed = {r["filename"]: r["size_bytes"] for r in files.list_datasets(spark, str(tmp_path)).collect()}
    assert listed == {"a.csv": 4, "c.xlsx": 3}


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {MAIN} xmlns:r="{RELS}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>',
        )
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Order Date</t></si><si><r><t>Sa</t></r><r><t>les</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        body = "".join(f'<row r="{i}">{cells}</row>' for i, cells in rows)
        book.writestr("xl/worksheets/first.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return str(path)


HEADER = (1, '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Name</t></is></c>')


def test_workbook(spark, tmp_path):
    rows = [
        HEADER,
        (2, '<c r="A2" s="1"><v>45292</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="str"><v>x</v></c>'),
        (4, '<c r="B4"><v>2</v></c><c r="C4" t="e"><v>#N/A</v></c>'),
    ]
    got = files.import_file(spark, workbook(tmp_path / "Book One.xlsx", rows))
    assert got.table == "book_one"
    assert [tuple(r) for r in got.rows.orderBy("ingest_pos").drop("ingest_pos").collect()] == [
        ("2024-01-01", 1.5, "x"), (None, 2.0, None),
    ]


def test_workbooks_without_rows(spark, tmp_path):
    with pytest.raises(EmptyDataset):
        files.import_file(spark, workbook(tmp_path / "h.xlsx", [HEADER]))
    with pytest.raises(EmptyDataset):
        files.import_file(spark, workbook(tmp_path / "n.xlsx", []))


def test_export(spark, tmp_path):
    path = str(tmp_path / "out")
    files.export_csv(spark.createDataFrame([('say "hi"', 1.5, None)], "a string, b double, c string").coalesce(1), path)
    part = next(p for p in os.listdir(path) if p.endswith(".csv"))
    with open(os.path.join(path, part), encoding="utf-8") as text:
        assert text.read().splitlines() == ['"a","b","c"', '"say \\"hi\\"","1.5","null"']


def test_rows_with_cells_to_spare_are_refused(spark, tmp_path):
    with pytest.raises(ImportFailed, match="3,4,5"):
        files.import_file(spark, write(tmp_path, "spare.csv", "a,b\n1,2\n3,4,5\n"))
    short = files.read_delimited(spark, write(tmp_path, "short.csv", "a,b\n1,2\n3\n"))
    assert [tuple(r) for r in short.collect()] == [(1, 2.0), (3, None)]


def test_line_breaks_inside_quotes(spark, tmp_path):
    rows = files.read_delimited(spark, write(tmp_path, "q.csv", 'a,b\n1,"two\nlines"\n2,x\n'))
    assert [tuple(r) for r in rows.collect()] == [(1, "two\nlines"), (2, "x")]


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path, monkeypatch):
    """An odd quote inside a plain cell breaks no line; a break in one file leaves the others splittable."""
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, "a.csv", 'a,b\n1,5" pipe\n2,"x ""y"", z"\n3,""\n4,"q"\n')
    write(folder, "b.csv", "a,b\n5,u\n6,v\n")
    assert files._broken_files(spark, str(folder), ",") == []
    write(folder, "c.csv", 'a,b\n7,"two\nlines, ""quoted""\nand three"\n8,w\n')
    assert [f.rsplit("/", 1)[1] for f in files._broken_files(spark, str(folder), ",")] == ["c.csv"]
    rows = files.read_delimited(spark, str(folder))
    assert {r["a"]: r["b"] for r in rows.collect()} == {
        1: '5" pipe', 2: 'x "y", z', 3: None, 4: "q", 5: "u", 6: "v", 7: 'two\nlines, "quoted"\nand three', 8: "w",
    }
    write(folder, "d.csv", "a,b\n9,s,t\n")
    with pytest.raises(ImportFailed, match="9,s,t"):
        files.read_delimited(spark, str(folder))


def test_open_ended_lines(spark):
    lines = {'1,"two': True, '"': True, 'a,"b ""c': True, '"a","b"': False, 'a,"b""': True, 'a,b"': False, '"x";"y': False, "": False, 'a,"b" c,"d': True, '1,5" x,"y"': False, 'a,"b,c': True, 'a,"",b': False}
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {r[0]: r[1] for r in df.select("value", files._open_ended(",")).collect()} == lines
    assert df.select(files._open_ended(";").alias("o"), "value").filter("o").count() == 2


def test_header_names():
    from ledgerlake.sources.workbook import header_names

    assert header_names({0: "a", 2: "a", 3: "b"}, 4) == ["a", "Unnamed: 1", "a.1", "b", "Unnamed: 4"]

import csv
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, workbooks

ROWS = [("1", "plain", None), ("2", "two\nlines, \"quoted\" <b>&amp;", "é世🎉"), ("3", None, " spaces "), ("4", "_x0041_ and \x01\r", "plain")]


def by_hand(path, members):
    with zipfile.ZipFile(path, "w") as book:
        for name, text in members.items():
            book.writestr(name, text)


def test_round_trip_and_csv(spark, tmp_path):
    df = spark.createDataFrame([r for r in ROWS if r[0] != "4"], "id string, a string, `b c` string")
    workbooks.write(df, str(tmp_path / "books"))
    with open(tmp_path / "same.csv", "w", newline="") as f:
        csv.writer(f).writerows([df.columns, *[["" if v is None else v for v in r] for r in df.collect()]])
    got, same = workbooks.sheet_rows(spark, str(tmp_path / "books")), readers.csv(spark, str(tmp_path / "same.csv"))
    assert got.columns == same.columns and sorted(map(repr, got.collect())) == sorted(map(repr, same.collect()))
    df = spark.createDataFrame(ROWS, "id string, a string, c string").withColumn("n", F.col("id").cast("int"))
    workbooks.write(df, str(tmp_path / "all"), "all", book_rows=1)
    assert sorted(tuple(r) for r in workbooks.sheet_rows(spark, str(tmp_path / "all"), "all").collect()) == [(*r, r[0]) for r in ROWS]
    assert workbooks.sheet_rows(spark, str(tmp_path / "all")).rdd.getNumPartitions() == 4


def test_cells_and_sheets(spark, tmp_path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda rows: f'<worksheet xmlns="{workbooks.MAIN}"><dimension ref="A1"/><sheetData>{rows}</sheetData></worksheet>'
    text = lambda ref, s: f'<c r="{ref}" t="inlineStr"><is><t>{s}</t></is></c>'
    head = "<row>" + text("A1", "id") + text("B1", "x") + text("D1", "X") + "</row>"
    body = (
        '<row r="2"><c r="A2"><v>3</v></c><c r="B2" t="s"><v>1</v></c><c r="AB2" t="b"><v>1</v></c></row><row r="3"><c r="B3"/></row>'
        '<row r="9"><c r="A9" t="str"><f>1+1</f><v>two</v></c><c r="D9" t="e"><v>#N/A</v></c><c r="C9" t="b"><v>0</v></c></row>'
    )
    strings = f'<sst xmlns="{workbooks.MAIN}"><si><t>zero</t></si><si><r><t>ri</t></r><r><t xml:space="preserve">ch </t></r><rPh sb="0" eb="1"><t>read</t></rPh></si></sst>'
    members = {
        "xl/workbook.xml": f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/worksheets/s1.xml": sheet(head + body),
        "xl/worksheets/s2.xml": sheet("<row>" + text("A1", "id") + text("B1", "other") + "</row><row>" + text("A2", "k") + text("B2", "o") + "</row>"),
        "xl/sharedStrings.xml": strings,
    }
    path = str(tmp_path / "hand.xlsx")
    by_hand(path, members)
    one = workbooks.sheet_rows(spark, path)
    assert one.columns == ["id", "x1", "_c2", "X3"]
    assert [tuple(r) for r in one.collect()] == [("3", "rich ", None, None), ("two", None, "FALSE", "#N/A")]
    assert [tuple(r) for r in workbooks.sheet_rows(spark, path, "Two").collect()] == [("k", "o")]
    both = workbooks.sheet_rows(spark, path, "*")
    assert both.rdd.getNumPartitions() == 2
    assert sorted(tuple(r)[:2] for r in both.collect()) == [("One", "3"), ("One", "two"), ("Two", "k")]
    with pytest.raises(Exception, match="no sheet 'Three'"):
        workbooks.sheet_rows(spark, path, "Three").collect()
    by_hand(path, {**members, "xl/worksheets/s1.xml": sheet(head + body.replace("<v>1</v>", "<v>7</v>", 1))})
    with pytest.raises(Exception, match="hand.xlsx"):
        workbooks.sheet_rows(spark, path).collect()
    (tmp_path / "hand.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="hand.xlsx"):
        workbooks.sheet_rows(spark, path).collect()


def test_many_rows_and_what_does_not_fit(spark, tmp_path):
    path = str(tmp_path / "many")
    workbooks.write(spark.range(0, 30_000, 1, 2).selectExpr("id", "concat('v', id % 100) AS v"), path, book_rows=10_000)
    back = workbooks.sheet_rows(spark, path)
    assert back.agg(F.count("*"), F.sum(F.col("id").cast("long")), F.count_distinct("v")).first()[:] == (30_000, 449_985_000, 100)
    long = spark.createDataFrame([("x" * 32_768,)], "a string")
    with pytest.raises(Exception, match="32767"):
        workbooks.write(long, str(tmp_path / "long"))
    assert not os.path.exists(tmp_path / "long") or not os.listdir(tmp_path / "long")
    with pytest.raises(Exception, match="nowhere"):
        workbooks.sheet_rows(spark, str(tmp_path / "nowhere")).collect()

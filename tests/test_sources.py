import io
import zipfile
from xml.etree import ElementTree

import pytest

from linkforge.sources import files, workbooks, xlsx


def test_csv_keeps_codes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("name,gtin\nolive oil,0012\n,\n")
    assert [tuple(r) for r in files.read_table(spark, str(path)).collect()] == [("olive oil", "0012"), (None, None)]
    with pytest.raises(ValueError):
        files.read_table(spark, "a.txt")


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1, 2.5, True, ["x"]), (None, 2, None, False, [])], "s string, i int, d double, b boolean, l array<string>")
    files.write_xlsx(df.coalesce(1), str(tmp_path / "out"))
    got = files.read_table(spark, str(next((tmp_path / "out").glob("*.xlsx"))))
    assert got.columns == ["s", "i", "d", "b", "l"]
    assert [tuple(r) for r in got.collect()] == [("a<b", "1", "2.5", "1", '["x"]'), (None, "2", None, "0", "[]")]


def test_xlsx_of_empty_tables_and_of_more_rows_than_a_sheet_holds(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "i int, s string")
    out = tmp_path / "out"
    files.write_xlsx(df.coalesce(1), str(out), most_rows=11)
    assert sorted(f.name for f in out.glob("*.xlsx")) == [f"part-0000{i}.xlsx" for i in range(3)]
    assert sorted(int(r.i) for r in files.read_table(spark, f"file://{out}").collect()) == list(range(25))
    files.write_xlsx(df.where("i < 0"), str(out))
    got = files.read_table(spark, str(out))
    assert got.columns == ["i", "s"] and got.collect() == [] and not list(out.glob("_new*"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b\n\"c\"", "001", [1, 2], None), ("", "2", [], "x")], "s string, code string, l array<int>, n string")
    files.write_csv(df.coalesce(1), str(tmp_path / "out.csv"))
    got = files.read_table(spark, str(tmp_path / "out.csv"))
    assert got.columns == ["s", "code", "l", "n"]
    assert sorted((r.s or "", r.code, r.l, r.n) for r in got.collect()) == [("", "2", "[]", "x"), ('a,b\n"c"', "001", "[1,2]", None)]


def test_column_letters():
    assert [xlsx.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(f"{xlsx.column_letters(n)}1") == n for n in range(800))


def test_workbooks(spark):
    summary = spark.createDataFrame([(50, 2, 5), (55, 1, 2)], "threshold int, groups_found long, products_in_groups long")
    rows = spark.createDataFrame([("G001", 50, 1, True)], "group_id string, threshold int, member_id long, in_group boolean")
    pairs = spark.createDataFrame([("a", "b", 80.0)], "left_name string, right_name string, confidence double")
    book = workbooks.explorer_workbook(summary, rows, pairs)
    assert list(xlsx.read_rows(book, "Summary"))[1] == ["50", "2", "5"]
    assert list(xlsx.read_rows(book, "Heatmap"))[1] == ["a", "0.0", "80.0"]
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    for text in parts.values():
        ElementTree.fromstring(text)
    groups = parts["xl/worksheets/sheet3.xml"]
    assert '<f>IF(AND(B2=Dashboard!$B$2,D2=TRUE),1,0)</f>' in groups and 'state="frozen"' in groups and '<col min="5" max="5"' in groups
    assert "COUNTIF(Groups!E2:E2,1)" in parts["xl/worksheets/sheet1.xml"] and "Summary!$B$2:$B$3" in parts["xl/charts/chart1.xml"]
    assert [r[0] for r in workbooks.percent_view(pairs, ["confidence"]).select("confidence").collect()] == ["80.00%"]
    assert len(list(xlsx.read_rows(workbooks.threshold_workbook(rows, summary), "Threshold Groups"))) == 2

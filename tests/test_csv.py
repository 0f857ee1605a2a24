"""CSV by RFC 4180: quotes, commas, line breaks, short and long lines, several files."""

from pyspark.sql import functions as F

from caremart.plans import reports as RP
from caremart.sources import csv as CSV

CELLS = ['said "hi", ok', "line one\nline two", ' "', "a,b\r\nc", '""', " spaces at both ends ", "\\", 'back\\"slash', "x", None,
         "é\U0001f600,\n\n\"", "'"]


def test_round_trip_of_any_cell(spark, tmp_path):
    rows = [(str(i), c, CELLS[-1 - i]) for i, c in enumerate(CELLS)]
    for parts in (1, 3):
        path = str(tmp_path / f"csv-{parts}")
        CSV.write_csv(spark.createDataFrame(rows, "id string, a string, b string").repartitionByRange(parts, F.col("id").cast("int")), path)
        back = CSV.read_contract_csv(spark, path, ["id", "a"], ["note"])
        assert back.columns == ["id", "a", "b", "note", "row_num"]
        got = back.orderBy("row_num").collect()
        assert [tuple(r)[:3] for r in got] == rows  # file order, over several files too
        assert len({r["row_num"] for r in got}) == len(rows)
        assert CSV.malformed_lines(spark, path).collect() == []


def test_short_and_long_lines_are_kept(spark, tmp_path):
    text = 'who,what,note\nA,"one\ntwo",x\nB,short\nC,"q ""q""",y\nD,long,z,more\n'
    (tmp_path / "x.csv").write_text(text)
    rows = CSV.read_contract_csv(spark, str(tmp_path), ["who"]).orderBy("row_num").collect()
    assert [(r["who"], r["what"], r["note"]) for r in rows] == [
        ("A", "one\ntwo", "x"), ("B", "short", None), ("C", 'q "q"', "y"), ("D", "long", "z")]
    bad = CSV.malformed_lines(spark, str(tmp_path)).orderBy("row_num").collect()
    assert [r["line"].strip() for r in bad] == ["B,short", "D,long,z,more"]
    assert [r["row_num"] for r in bad] == [rows[1]["row_num"], rows[3]["row_num"]]


def test_mapped_csv_keeps_quoted_cells(spark, tmp_path):
    (tmp_path / "tool.csv").write_text('individual id,raw value\n"A, 1","3\n"\n')
    got = CSV.read_mapped_csv(spark, str(tmp_path), {"who": "individual id", "score": "raw value"}).collect()
    assert [(r["who"], r["score"]) for r in got] == [("A, 1", "3\n")]


def test_report_csv_is_what_a_spreadsheet_reads(spark, tmp_path):
    import csv
    rows = [("Art, \"new\"", 1.5), ("two\nlines", 2.0)]
    RP.write_report_csv({"part": spark.createDataFrame(rows, "name string, cost double")}, str(tmp_path / "r"), single_file=True)
    file = next((tmp_path / "r" / "part").glob("*.csv"))
    with open(file, newline="") as f:
        assert list(csv.reader(f)) == [["name", "cost"], ['Art, "new"', "1.5"], ["two\nlines", "2.0"]]

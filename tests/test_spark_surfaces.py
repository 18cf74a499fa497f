from quern.functions import sql
from quern.sources import tables, workbooks
from quern.sources.rows import Report
from quern.streaming.files import convert_stream, watch


def test_data_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"2;3"\n')
    (tmp_path / "b.tsv").write_text("p\tq\n\nr\ts\n")
    (tmp_path / "c.jsonl").write_text('{"k":1}\n{"m":"v"}\n')
    (tmp_path / "d.xlsx").write_bytes(workbooks.write_xlsx([("A", [["x"], ["1"]]), ("B", [["y"]])], Report()))
    tables.register(spark)
    got = spark.read.format("quern-rows").option("path", str(tmp_path)).load()
    assert sorted((r.path[-5:], r.line, r.fields) for r in got.collect()) == sorted([("a.csv", 1, ["x", "y"]), ("a.csv", 2, ["1", "2;3"]), ("b.tsv", 1, ["p", "q"]), ("b.tsv", 3, ["r", "s"]), ("jsonl", 0, ["k", "m"]), ("jsonl", 1, ["1", ""]), ("jsonl", 2, ["", "v"])])
    book = spark.read.format("quern-workbook").option("path", str(tmp_path))
    assert [(r.part, r.fields) for r in book.load().orderBy("part", "line").collect()] == [("A", ["x"]), ("A", ["1"]), ("B", ["y"])]
    assert [r.fields for r in book.option("sheet", "B").load().collect()] == [["y"]]


def test_readers_through_spark(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"2\n3"\n')
    (tmp_path / "b.tsv").write_text("p\tq\n\nr\ts\n")
    (tmp_path / "c.jsonl").write_text('{"k":1}\n{"m":"v"}\n')
    (tmp_path / "d.xlsx").write_bytes(workbooks.write_xlsx([("A", [["x"], ["1"]]), ("B", [["y"]])], Report()))
    (tmp_path / "e.txt").write_text("no table")
    got = tables.read_rows(spark, str(tmp_path))
    assert sorted((r.path[-5:], r.line, r.fields) for r in got.collect()) == sorted([("a.csv", 1, ["x", "y"]), ("a.csv", 2, ["1", "2\n3"]), ("b.tsv", 1, ["p", "q"]), ("b.tsv", 3, ["r", "s"]), ("jsonl", 0, ["k", "m"]), ("jsonl", 1, ["1", ""]), ("jsonl", 2, ["", "v"])])
    assert [(r.part, r.fields) for r in tables.read_workbooks(spark, str(tmp_path)).orderBy("part", "line").collect()] == [("A", ["x"]), ("A", ["1"]), ("B", ["y"])]
    assert [r.fields for r in tables.read_workbooks(spark, str(tmp_path), "B").collect()] == [["y"]]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/big.csv").write_text("a,b\n" + '1,"x,y"\n\n' * 5000)
    lines = tables.read_lines(spark, str(tmp_path / "lines"))
    assert lines.count() == 5001 and {tuple(r.fields) for r in lines.collect()} == {("a", "b"), ("1", "x,y")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a":[1,"x"]}')
    for _ in range(2):  # a restart converts only what is new
        convert_stream(watch(spark, str(tmp_path / "in"), "*.json"), "json", "yaml", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        (tmp_path / "in/b.json").write_text("{}")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path[-6:], bytes(r.content)) for r in rows) == [("a.json", b"a:\n  - 1\n  - x\n"), ("b.json", b"{}\n")]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select float_text(1e-7D) f, entity_decode('&copy; &amp &lt;') e, percent_decode('a%C3%A9+b') p, markdown_to_html('*x*') m, html_to_text('<p>a<p>b') t, sniff_delimiter('a;b\n') d, float_text(null) n").first()
    assert tuple(row) == ("1e-7", "© &amp <", "aé+b", "<p><em>x</em></p>\n", "a\n\nb\n", ";", None)


def test_equal_texts_of_a_batch_are_worked_out_once():
    import pandas as pd

    from quern.functions.sql import FUNCTIONS, _over

    calls = []
    got = _over(lambda t: calls.append(t) or t.upper())(pd.Series(["a", None, "b", "a", float("nan")], dtype=object))
    assert got.tolist() == ["A", None, "B", "A", None] and calls == ["a", "b"]
    assert FUNCTIONS["float_text"][0](pd.Series([0.0, -0.0])).tolist() == ["0.0", "-0.0"]

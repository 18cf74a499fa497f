import numpy as np
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.operators import batch
from quern.operators.convert import convert
from quern.sources import images, pdf
from quern.sources.rows import Report


def test_stems():
    assert batch.part_stems(["a", "A", "a (2)", "", " x/y. ", "a"]) == ["a", "A (2)", "a (2) (2)", "Part 4", "x_y", "a (3)"]


def test_names_and_clashes(spark):
    files = spark.createDataFrame([("/d/a.csv",), ("/d/a.tsv",), ("/d/b.csv",), ("noext",)], "path string")
    got = [r[0] for r in files.select(batch.output_path(F.col("path"), "jpeg", "/out")).collect()]
    assert got == ["/out/d/a.jpg", "/out/d/a.jpg", "/out/d/b.jpg", "/out/noext.jpg"]
    assert [tuple(r) for r in batch.clashes(files, "json").collect()] == [("/d/a.json", 2)]


def test_parts_have_stems(spark):
    text = b"# A\n\n|x|\n|-|\n|1|\n\n# a\n\n|z|\n|-|\n|3|\n"
    got = batch.with_stems(convert(spark.createDataFrame([("t.md", bytearray(text)), ("bad", None)], "path string, content binary"), "markdown", "csv"))
    assert sorted((r.path, r.part_index, r.stem) for r in got.where("error is null").collect()) == [("t.md", 0, "A"), ("t.md", 1, "a (2)")] and got.count() == 3


def test_merge(spark):
    pages = [np.full((2, 3, 3), k, np.uint8) for k in (5, 9)]
    rows = [("x", 2, "b.bmp", bytearray(images.write_bmp(pages[1], Report()))), ("x", 1, "a.png", bytearray(images.write_png(pages[0], Report()))), ("y", 1, "c.csv", bytearray(b"a"))]
    got = {r.group: r for r in batch.merge_images(spark.createDataFrame(rows, "g string, o int, path string, content binary"), "g", "o").collect()}
    assert got["x"].pages == 2 and [int(pdf.read_image(bytes(got["x"].content), Report(), str(k + 1))[0, 0, 0]) for k in (0, 1)] == [5, 9]
    assert got["y"].content is None and "c.csv" in got["y"].error


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n")
    assert main(["convert", str(tmp_path / "a.csv"), str(tmp_path / "a.json")]) == 0
    assert (tmp_path / "a.json").read_text() == '[\n  {"x":"1","y":"2"},\n  {"x":"3"}\n]\n'
    assert main(["check", "html", "csv"]) == 0 and "html-to-markdown markdown-to-csv\tlossy" in capsys.readouterr().out
    assert main(["check", "z64", "csv"]) == 3 and main(["nonsense"]) == 4
    assert main(["convert", str(tmp_path / "none.csv"), str(tmp_path / "b.json")]) == 1
    assert main(["formats"]) == 0 and main(["paths"]) == 0 and capsys.readouterr().out.count("\n") == 38 + 1162

import numpy as np
import pytest

from quern.operators.convert import CONVERTERS, convert, convert_bytes, summary
from quern.plans.catalogue import edges
from quern.sources import events, images, jpeg, office, pdf, rows, trees, workbooks
from quern.sources.rows import Malformed, Report, Unsupported


def test_delimited():
    got = list(rows.parse_delimited('a,b\n1,"x ""q"" \n y"\n\n2,3"4\r\n"z"k,9'))
    assert [r for _, r in got] == [["a", "b"], ["1", 'x "q" \n y'], ["2", '3"4'], ["zk", "9"]]
    with pytest.raises(Malformed):
        list(rows.parse_delimited('a,"b\n'))
    assert rows.write_delimited([["a", "b,c", 'd"e', "f\ng"]]) == 'a,"b,c","d""e","f\ng"\n'
    assert rows.delimiter_of("a;b\n1;2\n") == ";"


def test_charsets():
    text = "日本語のテキスト、かなと漢字。\n"
    for codec in ("utf-8", "utf-8-sig", "utf-16", "shift_jis", "euc_jp", "iso2022_jp"):
        assert rows.decode(text.encode(codec)) == text
    assert rows.decode(b"a\0b") == "a\ufffdb"
    with pytest.raises(Malformed) as e:
        rows.decode(b"ok\ncaf\xe9 au lait\n")
    assert e.value.line == 2


def test_ragged():
    report = Report()
    got = list(rows.objects_of(rows.parse_delimited("a,b\n1\n1,2,3\n"), report))
    assert got == [{"a": "1"}, {"a": "1", "b": "2"}]
    assert len(report.warnings) == 1 and report.losses[0][:2] == (3, 3)


def test_json_rows():
    report = Report()
    header, body = rows.table_of(rows.parse_json('[{"a":1.50,"b":null},{"c":{"x":[1]}}]'), report)
    assert (header, list(body)) == (["a", "b", "c"], [["1.50", "", ""], ["", "", '{"x":[1]}']])
    for bad in ("[1,]", '{"a":NaN}', "[1] 2", '["\\ud800"]'):
        with pytest.raises(Malformed):
            rows.parse_json(bad)
    assert rows.dump_json(rows.parse_json('{"n":-2e3,"s":"\\u0001\\n"}')) == '{"n":-2e3,"s":"\\u0001\\n"}'


@pytest.mark.parametrize("x, text", [(1.5, "1.5"), (72.0, "72.0"), (123456789.0, "123456789.0"), (1e-7, "1e-7"), (1e21, "1e21"), (1e20, "100000000000000000000.0"), (-2.5e-9, "-2.5e-9")])
def test_float_text(x, text):
    assert rows.float_text(x) == text and float(text) == x


def test_yaml():
    report = Report()
    value = trees.parse_yaml("a: &x {p: 1, q: yes}\nb:\n  <<: *x\n  q: 010\nc: [1e3, 0x1F, ~, .5, '1']\nd: 2024-01-01\n", report)
    assert value == {"a": {"p": 1, "q": "yes"}, "b": {"p": 1, "q": 10}, "c": [1000.0, 31, None, 0.5, "1"], "d": "2024-01-01"}
    assert trees.parse_yaml(trees.dump_yaml(value), Report()) == value
    with pytest.raises(Malformed):
        trees.parse_yaml("a: 1\na: 2\n", Report())
    assert trees.parse_yaml("--- 1\n--- 2\n", report) == [1, 2]
    assert trees.parse_yaml("a: !!str 42\nb: !!int '7'\nc: !!float 1\nd: .inf\n", report) == {"a": "42", "b": 7, "c": 1.0, "d": "inf"}
    with pytest.raises(Malformed):
        trees.parse_yaml("a: !!int foo\n", report)
    odd = {"w": "yes", "m": "one\n two\n", "k": ["x\ny", "z\n\n", " lead\nin", "trail \nx"]}
    assert trees.dump_yaml(odd).startswith('w: "yes"\nm: |\n  one\n   two\nk:\n  - |-\n    x\n    y\n') and trees.parse_yaml(trees.dump_yaml(odd), report) == odd


def test_toml():
    report = Report()
    value = trees.parse_toml('a = 1\nd = 2024-01-01T00:00:00Z\n[t]\nu = [1, 2]\n[[t.v]]\nw = true\n', report)
    assert value == {"a": 1, "d": "2024-01-01T00:00:00Z", "t": {"u": [1, 2], "v": [{"w": True}]}}
    assert len(report.losses) == 1
    assert trees.parse_toml(trees.dump_toml(value, report), report) == value
    assert trees.dump_toml({"a": [1, None]}, report) == "a = [1]\n"
    with pytest.raises(Unsupported):
        trees.dump_toml([1], report)
    with pytest.raises(Malformed):
        trees.parse_toml("a = 99999999999999999999\n", report)


def test_xml():
    report = Report()
    value = trees.parse_xml("<c a='1'><b>x</b><b/><d>t &amp; u</d></c>", report)
    assert value == {"c": {"@a": "1", "b": ["x", None], "d": "t & u"}}
    assert trees.parse_xml(trees.dump_xml(value, report), report) == value
    assert trees.parse_xml("<m> text <b>x</b>\n tail <c/></m>", report) == {"m": {"b": "x", "c": None, "#text": "text tail"}}
    for bad in ("<a>", "<a/><b/>", "<a x='1' x='2'/>", "<a>&nope;</a>"):
        with pytest.raises(Malformed):
            trees.parse_xml(bad, report)


@pytest.mark.parametrize("kind", sorted(images.WRITERS))
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_images(kind, channels):
    image = np.random.default_rng(channels).integers(0, 256, (13, 17, channels), dtype=np.uint8)
    image[3:6] = image[3, 0]
    got = images.READERS[kind](images.WRITERS[kind](image, Report()), Report())
    want = {"pbm": (images.gray(images.flat(image)) >= 128) * np.uint8(255), "pgm": images.gray(images.flat(image)), "ppm": images.colour(images.flat(image))}
    if kind in want:
        assert (got == want[kind]).all()
    else:
        assert (got == (image if kind in ("png", "tiff", "pam", "ico") or kind == "tga" and channels == 1 else images.colour(image))).all()


def test_image_refusals():
    for kind, read in images.READERS.items():
        with pytest.raises((Malformed, Unsupported)):
            read(b"nothing of the kind", Report())
    assert images.downscale(np.full((4, 4, 3), 7, np.uint8), 2, 2).tolist() == [[[7] * 3] * 2] * 2


def test_icons():
    rgb = np.random.default_rng(2).integers(0, 256, (5, 3, 3), dtype=np.uint8)
    bmp = images.write_bmp(rgb, Report())
    mask = np.zeros((5, 4), np.uint8)
    mask[0, 0] = 0x80  # the bottom left pixel is clear
    part = bmp[14:22] + (10).to_bytes(4, "little") + bmp[26:] + mask.tobytes()
    small = images.write_png(rgb[:2, :2], Report())
    head = b"\0\0\2\0\2\0" + bytes([3, 5, 0, 0, 1, 0, 24, 0]) + len(part).to_bytes(4, "little") + (38).to_bytes(4, "little") + bytes([2, 2, 0, 0, 1, 0, 24, 0]) + len(small).to_bytes(4, "little") + (38 + len(part)).to_bytes(4, "little")
    got = images.read_ico(head + part + small, Report())
    assert (got[..., :3] == rgb).all() and got[4, 0, 3] == 0 and got[..., 3].sum() == 14 * 255
    big = images.read_ico(images.write_ico(np.full((600, 300, 3), 9, np.uint8), Report()), Report())
    assert big.shape == (256, 128, 3) and (big == 9).all()


MARKDOWN = """# Title *em* `c`

para one
two\\
three \\* **bold *x*** [l](http://a.b "t") ![i](s.png)

- a
- b
  - c

1. x

2. y

> q
> r

| a | b |
| :--- | ---: |
| 1 | 2\\|3 |

```py
x = 1
```

---

- [x] done
- [ ] not
"""


def test_markdown():
    blocks = events.read_markdown(MARKDOWN)
    assert [b[0] for b in blocks] == ["h", "p", "list", "list", "quote", "table", "code", "hr", "list"]
    assert events.read_markdown(events.write_markdown(blocks)) == blocks
    assert events.from_json(events.to_json(blocks)) == blocks
    html = events.write_html(blocks)
    assert "<h1>Title <em>em</em> <code>c</code></h1>" in html and '<ol>\n<li>\n<p>x</p>\n</li>' in html
    assert '<td align="right">2|3</td>' in html and 'class="language-py"' in html


@pytest.mark.parametrize("markdown, html", [("**a*b*c**", "<strong>a<em>b</em>c</strong>"), ("a_b_c", "a_b_c"), ("*a", "*a"), ("`` ` ``", "<code>`</code>"), ("<b>x</b>", "<b>x</b>"), ("&copy; \\&amp;", "© &amp;amp;"), ("[a]\n\n[a]: /u 't'", '<a href="/u" title="t">a</a>')])
def test_inlines(markdown, html):
    assert events.write_html(events.read_markdown(markdown)) == f"<p>{html}</p>\n"


@pytest.mark.parametrize(
    "markdown, html",
    [
        ("www.a.com/s?q=(b)))", '<a href="http://www.a.com/s?q=(b)">www.a.com/s?q=(b)</a>))'),
        ("(see ftp://a.b.)", '(see <a href="ftp://a.b">ftp://a.b</a>.)'),
        ("x.y-z@a.b. c@d.e-", '<a href="mailto:x.y-z@a.b">x.y-z@a.b</a>. c@d.e-'),
        ("www.a._b.c", "www.a._b.c"),
        ("<xmp> <em>", "&lt;xmp> <em>"),
        ("~~~~x~~~~ ~y~", "~~~~x~~~~ <del>y</del>"),
    ],
)
def test_extensions(markdown, html):
    assert events.write_html(events.read_markdown("z " + markdown)) == f"<p>z {html}</p>\n"


def test_footnotes():
    blocks = events.read_markdown("a[^n] b[^m] c[^n] d[^none]\n\n[^m]: two\n\n    more\n\n[^n]: one\n[^unused]: x\n")
    assert [b[:2] for b in blocks[1:]] == [("note", "n"), ("note", "m")]
    assert events.read_markdown(events.write_markdown(blocks)) == blocks and events.from_json(events.to_json(blocks)) == blocks
    assert events.write_text(blocks) == "a[1] b[2] c[1] d[^none]\n\n[1] one\n\n[2] two\n\n    more\n"
    html = events.write_html(blocks)
    assert 'id="fnref-n-2" data-footnote-ref>1</a>' in html and html.endswith("</li>\n</ol>\n</section>\n") and html.count("↩") == 3
    assert b"[1] two" in convert_bytes(b"a[^m]\n\n[^m]: two\n", [("markdown", "pdf"), ("pdf", "text")], {}, Report())[0][1]
    for kind in ("docx", "odt", "rtf"):
        there = convert_bytes(b"a[^m] *b*[^n]\n\n[^m]: two\n\n    more\n\n[^n]: three\n", [("markdown", kind), (kind, "markdown")], {}, Report())[0][1]
        assert there == b"a[^1] *b*[^2]\n\n[^1]: two\n\n    more\n\n[^2]: three\n", kind


def test_table_after_paragraph():
    assert [b[0] for b in events.read_markdown("1\n2\n| a | b |\n| --- | --- |\nd | e\n")] == ["p", "table"]


def test_html():
    page = "<html><head><title>x</title></head><body><nav><ul><li><a href='/x'>X</a></li><li>y</ul></nav><h1>T  t</h1><p>Shn. <p>In <i>a</i> b.<table><tr><td colspan=2>1<td>2<tr><td>3</table><script>var t='</p>';track(1)</script>&copy; end"
    text = events.write_markdown(events.read_html(page))
    assert text == "- [X](/x)\n- y\n\n# T t\n\nShn.\n\nIn *a* b.\n\n| 1 |  | 2 |\n| --- | --- | --- |\n| 3 |  |  |\n\n© end\n"


def test_text():
    assert events.write_html(events.read_text("a\r\nb\n\n \nc<")) == "<p>a\nb</p>\n<p>c&lt;</p>\n"


def test_workbooks():
    csv = b"n,d,t\n1.5,2024-08-08,hi\n007,TRUE,2024-08-08T14:35:00\n"
    for kind in ("xlsx", "ods"):
        book = convert_bytes(csv, [("csv", kind)], {}, Report())[0][1]
        assert convert_bytes(book, [(kind, "csv")], {}, Report())[0][1] == csv
    two = [("A", [["x"], ["1"]]), ("B", [["y"], ["2"]])]
    book = workbooks.write_xlsx(two, Report())
    assert workbooks.read_xlsx(book, Report()) == two
    assert convert_bytes(book, [("xlsx", "csv")], {"sheet": "B"}, Report())[0][1] == b"y\n2\n"
    with pytest.raises(Unsupported, match="A, B"):
        convert_bytes(book, [("xlsx", "csv")], {"sheet": "C"}, Report())


@pytest.mark.parametrize("kind", sorted(office.READERS))
def test_office(kind):
    blocks = events.read_markdown(MARKDOWN)
    got = office.READERS[kind](office.WRITERS[kind](blocks, Report()), Report())
    text = events.write_text(got)
    for part in ("Title em c", "para one", "- a", "1. x", "q", "1  2|3", "x = 1", "l (http://a.b)" if kind != "rtf" else "l"):
        assert part in text
    assert got[0][:2] == ("h", 1) and ("strong", [("text", "bold "), ("em", [("text", "x")])]) in got[1][1]
    with pytest.raises(Malformed):
        office.READERS[kind](b"nothing of the kind", Report())


def test_pdf():
    blocks = events.read_markdown("# Title\n\nOne two (three) \\\\ é\n\n" + "word " * 400 + "\n\n- item\n")
    made = pdf.write_text(blocks, Report())
    text = pdf.read_text(made, Report())
    assert text.startswith("Title\n\nOne two (three) \\ é\n\nword word") and text.rstrip().endswith("• item") and text.count("word") == 400
    again = pdf.read_blocks(made, Report())
    assert again[0] == ("h", 1, [("text", "Title")]) and again[1] == ("p", [("text", "One two (three) \\ é")])
    with pytest.raises(Malformed):
        pdf.read_text(b"no", Report())
    with pytest.raises(Unsupported):
        pdf.read_text(made, Report(), "9")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pdf_images(channels):
    image = np.random.default_rng(1).integers(0, 256, (9, 11, channels), dtype=np.uint8)
    assert (pdf.read_image(pdf.write_image(image, Report()), Report()) == image).all()


@pytest.mark.parametrize("channels", [1, 3])
def test_jpeg(channels):
    y, x = np.mgrid[0:37, 0:45]
    image = np.stack([(x * 5 + y) % 256, (y * 6) % 256, (x * 2 + y * 3) % 256][:channels], 2).astype(np.uint8)
    errors = []
    for quality in (30, 85, 100):
        made = jpeg.write(image, Report(), quality)
        got = jpeg.read(made, Report())
        assert got.shape == image.shape
        errors.append(np.abs(got.astype(int) - image).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1.2
    page = convert_bytes(made, [("jpeg", "pdf")], {}, Report())[0][1]
    assert made in page and (pdf.read_image(page, Report()) == got).all()
    with pytest.raises(Malformed):
        jpeg.read(made[: len(made) // 4], Report())


def test_converters_are_edges():
    assert set(CONVERTERS) <= {(a, b) for _, a, b, _ in edges()}


def test_convert(spark):
    files = spark.createDataFrame([("a.csv", bytearray(b"a,b\n1,2\n")), ("b.csv", bytearray(b'a\n"1\n')), ("c.csv", bytearray(b"a\n1,2\n")), ("d.csv", None)], "path string, content binary")
    got = {r.path: r for r in convert(files, "csv", "yaml").collect()}
    assert got["a.csv"].content == b'- a: "1"\n  b: "2"\n' and not got["a.csv"].losses
    assert got["b.csv"].error.kind == "malformed" and got["c.csv"].losses[0].column == 2
    assert summary(convert(files, "csv", "yaml")).first().asDict() == {"converted": 2, "lossy": 1, "failed": 2}
    parts = convert(spark.createDataFrame([("t.md", bytearray(b"# A\n\n|x|\n|-|\n|1|\n\n# B\n\n|z|\n|-|\n|3|\n"))], "path string, content binary"), "markdown", "csv").orderBy("part_index").collect()
    assert [(p.part_name, p.content) for p in parts] == [("A", b"x\n1\n"), ("B", b"z\n3\n")]
    assert convert(files.limit(1), "csv", "numbers").first().error.kind == "unsupported"


def test_html_references_without_semicolon_stay():
    read = lambda h: events.write_markdown(events.read_html(h))
    assert read("<p>a &amp;&amp;&amp</p>") == "a &&&amp\n"
    assert read("<p>a &amp;&am &nope; &ampx; &eacute; &#233; &copy 1</p>") == "a &&am \\&nope; \\&ampx; é é &copy 1\n"


def test_html_to_text_keeps_cut_references():
    assert events.write_text(events.read_html("<h1>x &amp;&amp</h1><p>&quot;y&quo &lt</p>")) == 'x &&amp\n\n"y&quo &lt\n'


@pytest.mark.parametrize("text", ["a b ", " a\n\tb", "x\n y  \nz\t", "see http://x.y*** now", "http://x.y ", "www.a.b_", "--- -", "a\n:-", "a\rb", "\xa0a\xa0"])
def test_text_survives_markdown(text):
    assert events.write_text(events.read_markdown(events.write_markdown(events.read_text(text)))) == text + "\n"


def test_simple_yaml_is_what_the_whole_parser_gives():
    same = ['a:\n  b: [1, 2.5, ~, true]\n  c: "x\\n"\n', "- a\n- - 1\n  - b: 0x1F\n    c:\n- d:\n  - {}\n", "a b: -2\n\nc: 1e3 \n"]
    for text in same:
        assert repr(trees._simple_yaml(text)) == repr(trees._whole_yaml(text, Report()))
    for text in ("a: b: c", "a: 1\na: 2", "a: x\n  y\n", "a: &x 1", "a: 'q'", "--- a", "a: .inf", "a: |\n  b", "a: [1, [2]]", "a:\tb", "", "- a\n b: c", 'a: "\\x41"'):
        with pytest.raises(trees._Unusual):
            trees._simple_yaml(text)


def test_paths_of_a_file_share_steps(monkeypatch):
    from quern.operators.convert import _TREE_READERS, attempt
    from quern.edge_queries import TREES

    calls = []
    for kind, read in list(_TREE_READERS.items()):
        monkeypatch.setitem(_TREE_READERS, kind, lambda t, r, kind=kind, read=read: calls.append(kind) or read(t, r))
    paths = [[("json", s)] * (s != "json") + [(s, t)] + [(t, "json")] * (t != "json") for s, t in TREES]
    for content in (b'{"e":{"k":"v","l":["a","b & <c>"]}}', b'{"a":null,"b":[1,2.50,{"c":[]}]}', b"[1]", b'{"k":"\\ud83d"}', b"{", None):
        calls.clear()
        seen: dict = {}
        shared = [attempt(content, hops, {}, seen=seen) for hops in paths]
        n = len(calls)
        alone = [attempt(content, hops, {}) for hops in paths]
        assert [(p, r.losses, r.warnings, e) for p, r, e in shared] == [(p, r.losses, r.warnings, e) for p, r, e in alone]
        assert n < len(calls) - n or content is None
    assert len(TREES) == 12


def test_yaml_of_trees_needs_no_whole_parser(monkeypatch):
    monkeypatch.setattr(trees, "_whole_yaml", None)
    made = convert_bytes(b'{"e":{"k":12,"s":"b & <c>","l":[1,"x y"]}}', [("json", "yaml"), ("yaml", "json")], {}, Report())
    assert made[0][1] == b'{"e":{"k":12,"s":"b & <c>","l":[1,"x y"]}}\n'


def test_documents_share_steps(monkeypatch):
    from quern.edge_queries import DOCUMENTS
    from quern.operators import convert as C

    calls = []
    for pair, f in list(C.CONVERTERS.items()):
        monkeypatch.setitem(C.CONVERTERS, pair, lambda c, o, r, pair=pair, f=f: calls.append(pair) or f(c, o, r))
    seen: dict = {}
    for s, t in DOCUMENTS:
        hops = [("text", s)] * (s != "text") + [(s, t)] + [(t, "text")] * (t != "text")
        assert C.attempt(b"a < b & c.\n\nTwo.\n", hops, {}, seen=seen)[0] == [("", b"a < b & c.\n\nTwo.\n")]
    assert calls.count(("text", "markdown")) == 1 and len(calls) < 3 * len(DOCUMENTS)

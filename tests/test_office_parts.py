"""Parts of Word, OpenDocument and RTF documents that other writers use."""

from quern.sources import events, office
from quern.sources.rows import Report
from quern.sources.workbooks import _zip

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def word(body, **parts):
    files = [("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")]
    files += [(f"word/{name}.xml", f"<w:{name} {W}>{inner}</w:{name}>") for name, inner in parts.items()]
    report = Report()
    return office.read_docx(_zip(files), report), report


def p(*runs, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(runs)}</w:p>"


def r(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def style(i, name, base="", props="", kind="paragraph"):
    return f'<w:style w:type="{kind}" w:styleId="{i}"><w:name w:val="{name}"/>' + (f'<w:basedOn w:val="{base}"/>' if base else "") + f"<w:rPr>{props}</w:rPr></w:style>"


def test_styles_build_on_others():
    styles = style("A", "a", "", "<w:b/>") + style("B", "b", "A", "<w:i/>") + style("C", "c", "B", '<w:b w:val="0"/>') + style("H", "heading 2", "A") + style("X", "x", "", "<w:strike/>", "character")
    pick = lambda s: f'<w:pStyle w:val="{s}"/>'
    blocks, _ = word(p(r("one"), props=pick("B")) + p(r("two"), props=pick("C")) + p(r("head"), props=pick("H")) + p(r("three", '<w:rStyle w:val="X"/>'), r(" four", '<w:b w:val="false"/>'), props=pick("A")), styles=styles)
    assert events.write_markdown(blocks) == "***one***\n\n*two*\n\n## head\n\n**~~three~~** four\n"


def test_fields_and_links():
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    code = lambda text: f"<w:r><w:instrText>{text}</w:instrText></w:r>"
    blocks, _ = word(
        p(r("see "), mark("begin"), code(' HYPERLINK "http://a.b/c" '), mark("separate"), r("here"), mark("end"), r(" page "), mark("begin"), code("PAGE"), mark("separate"), r("7"), mark("end"))
        + p('<w:fldSimple w:instr=" HYPERLINK \\l &quot;x&quot; ">' + r("there") + "</w:fldSimple>", mark("begin"), code("DATE"), r("lost"))
    )
    assert events.write_markdown(blocks) == "see [here](http://a.b/c) page 7\n\n[there](#x)\n"


def test_notes_comments_and_changes():
    note = lambda i, text: f'<w:footnote w:id="{i}">{p("<w:r><w:footnoteRef/></w:r>", r(text))}</w:footnote>'
    blocks, report = word(
        p(r("a"), '<w:r><w:footnoteReference w:id="5"/></w:r>', '<w:r><w:endnoteReference w:id="2"/></w:r>', '<w:r><w:commentReference w:id="0"/></w:r>', f"<w:del>{r('gone')}</w:del><w:ins>{r(' new')}</w:ins><w:moveFrom>{r('old')}</w:moveFrom><w:moveTo>{r(' moved')}</w:moveTo>")
        + '<w:sectPr><w:headerReference r:id="x"/></w:sectPr>',
        footnotes=note(5, "foot") + note(6, "unused"),
        endnotes=note(2, "end").replace("footnote", "endnote"),
    )
    assert events.write_markdown(blocks) == "a[^1][^2] new moved\n\n[^1]: foot\n\n[^2]: end\n"
    assert {x[2] for x in report.losses} == {"comments are dropped", "deleted text is dropped", "headers and footers are dropped"}


def test_boxes_formulas_and_tables():
    box = f"<w:r><mc:AlternateContent><mc:Choice><w:drawing><w:txbxContent>{p(r('inside'))}</w:txbxContent></w:drawing></mc:Choice><mc:Fallback><w:pict><w:txbxContent>{p(r('inside'))}</w:txbxContent></w:pict></mc:Fallback></mc:AlternateContent></w:r>"
    cell = lambda inner, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell(p(r('in')))}</w:tr></w:tbl>"
    table = f"<w:tbl><w:tr>{cell(p(r('a')), '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell(p(r('b')))}</w:tr><w:tr>{cell(p(r('hidden')), '<w:vMerge/>')}{cell(nested)}</w:tr></w:tbl>"
    blocks, report = word(p(r("out"), box) + p("<m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath>") + table)
    assert [b[0] for b in blocks] == ["p", "p", "p", "table"] and events.write_markdown(blocks[:3]) == "out\n\ninside\n\nx=1\n"
    assert blocks[3][2:] == ([[("text", "a")], [("text", "b")]], [[[], blocks[3][3][0][1]]]) and "in" in events._plain(blocks[3][3][0][1])
    assert "formulas become their text" in {x[2] for x in report.losses}


def test_rtf_notes_and_fields():
    report = Report()
    blocks = office.read_rtf(rb'{\rtf1\ansi a{\super\chftn}{\footnote\pard {\super\chftn} one\par two} b{\field{\*\fldinst HYPERLINK "http://x.y"}{\fldrslt link}} c{\annotation gone}\par d\par}', report)
    assert [b[0] for b in blocks] == ["p", "p", "note"] and events.write_text([blocks[2]]).split() == ["[1]", "one", "two"]
    assert events.write_markdown(blocks[:1]) == "a[^1] b[link](http://x.y) c\n"


def test_open_document_styles_boxes_and_comments():
    spaces = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("style", "style"), ("fo", "xsl-fo-compatible"), ("draw", "drawing"), ("svg", "svg-compatible")))
    styles = '<style:style style:name="A"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="B" style:parent-style-name="A"><style:text-properties fo:font-style="italic"/></style:style><style:style style:name="C" style:parent-style-name="B"><style:text-properties fo:font-weight="normal"/></style:style>'
    body = '<text:p><text:span text:style-name="B">x</text:span> <text:span text:style-name="C">y</text:span><office:annotation><text:p>no</text:p></office:annotation><draw:frame><draw:text-box><text:p>box</text:p></draw:text-box></draw:frame><draw:frame><draw:image/><svg:title>pic</svg:title></draw:frame></text:p>'
    report = Report()
    blocks = office.read_odt(_zip([("content.xml", f"<office:document-content {spaces}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>")]), report)
    assert events.write_markdown(blocks) == "***x*** *y* boxpic\n"
    assert {x[2] for x in report.losses} == {"comments are dropped", "pictures are dropped"}

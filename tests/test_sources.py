import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docsql.operators import tables
from docsql.plans import loading
from docsql.sources import delimited, files, markup

FILES = "table_id int, name string, source string, delimiter string, columns array<string>, column_types array<string>"
ROWS = "row_id bigint, table_id int, row_no bigint, row_text string, cells string"


def faults(spark, rows, kinds=("integer", "text"), delimiter=","):
    f = spark.createDataFrame([(1, "n", "s", delimiter, ["a", "b"], list(kinds))], FILES)
    r = spark.createDataFrame([(i, 1, i, t, "extra") for i, t in enumerate(rows)], ROWS)
    return {x["row_id"]: x["reason"] for x in delimited.row_faults(r, f).collect()}, [x["values"] for x in delimited.clean_rows(r, f).orderBy("row_id").collect()]


def test_faults(spark):
    bad, clean = faults(spark, ['1,x', '"2","a, ""b"""', '1,"open', '1,"a"b', "1", "1,2,3", "+1,x", "", None, '3,5" pipe', ' 4 ,"x\ny"'])
    assert bad == {2: "quoting", 3: "quoting", 4: "width", 5: "width", 6: "value", 7: "width", 8: "width"}
    assert clean == [["1", "x"], ["2", 'a, "b"'], ["3", '5" pipe'], ["4", "x\ny"]]


@pytest.mark.parametrize("kind, good, wrong", [
    ("integer", ["0", "-12", "2147483647"], ["012", "2147483648", "1.0", "１２", "-"]),
    ("numeric", ["1", "1.5", "-.5", "2e3", "1.0E-2"], ["5.", "1e", ".5e3", "NaN", "1.2.3"]),
    ("boolean", ["true", "FALSE"], ["yes", "1", "t"]),
    ("date", ["2024-02-29"], ["2025-02-29", "20250101", "2025-06-12 10:00"]),
    ("timestamp", ["2025-01-02 03:04", "2025-01-02T03:04:05.25"], ["2025-01-02", "2025-02-30 01:02", "10:45"]),
])
def test_cell_types(spark, kind, good, wrong):
    bad, _ = faults(spark, [f"{g}|x" for g in good + wrong], (kind, "text"), "|")
    assert set(bad) == set(range(len(good), len(good) + len(wrong)))


def test_faults_empty_unknown_and_long(spark):
    f = spark.createDataFrame([(1, "n", "s", ";", ["a"], ["text"])], FILES)
    r = spark.createDataFrame([], ROWS)
    assert delimited.row_faults(r, f).count() == 0 and delimited.clean_rows(r, f).count() == 0
    long = '"' + 'x""' * 5000 + '"'
    r = spark.createDataFrame([(1, 9, 1, "x", ""), (2, None, 1, "x", ""), (3, 1, 1, long, ""), (4, 1, 2, long[:-1], "")], ROWS)
    assert {x["row_id"]: x["reason"] for x in delimited.row_faults(r, f).collect()} == {1: "width", 2: "width", 4: "quoting"}


def test_inference(spark):
    df = spark.createDataFrame([("1", "9999999999", "1.5", "TRUE", "2024-02-29", "2024-01-01 10:00", "007", ""), ("-2", "3", "2e1", "false", "2024-03-01", "2024-01-01T10:00:01", "8", None)], "a string, b string, c string, d string, e string, f string, g string, h string")
    assert list(tables.infer_types(df).values()) == ["integer", "bigint", "numeric", "boolean", "date", "timestamp", "text", "text"]
    assert [t for _, t in tables.typed(df).dtypes] == ["int", "bigint", "double", "boolean", "date", "timestamp_ntz", "string", "string"]
    assert tables.header_names([" Name ", "", "name", None]) == ["Name", "column_2", "name 2", "column_4"]


def test_import_and_describe(spark):
    spark.sql("drop table if exists t_import")
    df = spark.createDataFrame([("1", "red", "2.50"), ("2", "red", "3.25"), ("3", "blue", ""), ("4", "blue", None)], "`Item No` string, Colour string, `Unit Price` string")
    assert tables.import_table(df, "t_import", comment="It's a table") == 4
    with pytest.raises(Exception):
        tables.import_table(df, "t_import")
    assert tables.import_table(df, "t_import", "append") == 8 and tables.import_table(df, "t_import", "replace") == 4
    assert dict(spark.table("t_import").dtypes) == {"item_no": "int", "colour": "string", "unit_price": "decimal(3,2)"}
    assert "values: 'blue', 'red'" in tables.describe(spark, "t_import")
    spark.sql("drop table t_import")


def test_html():
    title, text = markup.html_to_markdown("<title>T</title><nav>x</nav><main><h2>A</h2><p>b  c</p><ol start=3><li>one<li>two</ol><table><tr><th>h</th></tr><tr><td>1|2</td></tr></table><pre>x\n y</pre><p hidden>no</p></main><p>out</p>")
    assert title == "T" and "## A" in text and "3. one" in text and "4. two" in text and "| 1\\|2 |" in text and "```\nx\n y\n```" in text and "no" not in text and "out" not in text


def test_csv_and_text():
    assert files.parse_csv('a;b\n1;"x\n""y"""\n\n2;z') == [["a", "b"], ["1", 'x\n"y"'], ["2", "z"]]
    assert files.sniff_delimiter("a|b,c\n1|2,3\n1|2") == "|"
    assert files.decode("é€".encode("cp1252")) == "é€" and files.decode("\ufeffx".encode()) == "x" and files.decode(b"\xff\xfe" + "ä".encode("utf-16-le")) == "ä"
    assert markup.front_matter("---\ntitle: 'N'\n---\nbody") == ("N", "body") and markup.front_matter("# H\nx")[0] == "H"


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://w" xmlns:r="http://r"'


def test_office():
    docx = _zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'})
    assert files.detect_format("x", docx) == "docx"
    text = markup.docx_to_markdown(docx)
    assert text.startswith("## Top\n\ntext") and "gone" not in text and "| a |" in text
    xlsx = _zip({"xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>", "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row><c r="A2" s="1"><v>45000</v></c><c r="B2" t="e"><v>#N/A</v></c><c r="C2"><v>0.1</v></c></row></sheetData></worksheet>'})
    assert markup.xlsx_sheets(xlsx) == [("S", [["head", None, "TRUE"], ["2023-03-15", None, "0.1"]])]
    epub = _zip({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a" linear="no"/></spine></package>', "o/a.html": "<p>no</p>", "o/b.html": "<p>yes</p>"})
    assert markup.epub_to_markdown(epub) == ("Book", "yes")


def test_load_isolates_errors(spark):
    rows = [("a.txt", b"hello"), ("b.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("c.bin", b"\0\1"), ("d.json", b"{"), ("e.txt", b""), ("f.txt", None)]
    got = {r["path"]: r for r in files.load_binaries(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"]["content"] == "hello" and got["e.txt"]["content"] == "" and got["d.json"]["warnings"]
    assert all(got[p]["kind"] == "error" and got[p]["error"] for p in ("b.doc", "c.bin", "f.txt"))
    assert files.load_binaries(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert F is not None


def test_rows_without_and_with_shared_ids(spark):
    f = spark.createDataFrame([(1, ",", ["a", "b"], ["integer", "text"])], "table_id int, delimiter string, columns array<string>, column_types array<string>")
    rows = [(None, 1, 1, "x,y"), (None, 1, 2, "1,y"), (7, 1, 3, "x,y"), (7, 1, 4, "2,y"), (8, 1, 5, "x,z"), (8, 1, 5, "x,z"), (9, 1, 6, "3,q"), (9, 1, 6, "3,q")]
    r = spark.createDataFrame(rows, "row_id bigint, table_id int, row_no bigint, row_text string")
    bad = sorted(((x["row_id"], x["row_no"], x["reason"]) for x in delimited.row_faults(r, f).collect()), key=str)
    good = sorted(((x["row_id"], x["row_no"]) for x in delimited.clean_rows(r, f).collect()), key=str)
    assert bad == [(7, 3, "value"), (8, 5, "value"), (None, 1, "value")]
    assert good == [(7, 4), (9, 6), (9, 6), (None, 2)]


def test_entities_and_forgiving_xml():
    assert markup.decode_entities("&amp;&#65;&#x42;&Alpha;&amp &eacute;&#0;") == "&AB&Alpha;&amp é&#0;"
    assert markup.html_to_markdown("<p>a &Alpha; &lt;b&gt; &copy 1</p>")[1] == "a &Alpha; <b> &copy 1"
    t = markup.forgiving_xml("<?xml version='1.0'?><w:a x='1' w:y=2><b>one & two</c><![CDATA[<raw>]]></b><d/>tail")
    assert t.tag == "a" and t.attrib == {"x": "1", "y": "2"} and t[0].text == "one & two<raw>" and [c.tag for c in t] == ["b", "d"] and t[1].tail == "tail"


def test_package_reads_as_zipfile_does():
    def made(comment=b"", ahead=b"", names=("a.txt", "b/c.xml"), method=zipfile.ZIP_DEFLATED, big=False):
        out = io.BytesIO(ahead)
        out.seek(len(ahead))
        with zipfile.ZipFile(out, "w", method) as z:
            z.comment = comment
            for n in names:
                with z.open(n, "w", force_zip64=big) as f:
                    f.write(n.encode() * 50)
        return out.getvalue()

    for data in (made(), made(method=zipfile.ZIP_STORED), made(b"note"), made(ahead=b"PK\3\4 before"), made(names=("é.txt",)), made(names=()), made(big=True), made(method=zipfile.ZIP_BZIP2)):
        z, p = zipfile.ZipFile(io.BytesIO(data)), markup.Package(data)
        assert list(p.parts) == z.namelist() and all(p.read(n) == z.read(n) for n in z.namelist())
    data = made(method=zipfile.ZIP_STORED)
    for broken in (data.replace(b"a.txta.txt", b"a.txtA.txt", 1), data[:-30], b"PK\3\4"):
        with pytest.raises(zipfile.BadZipFile):
            markup.Package(broken).read("a.txt")


def test_parts_that_files_have_in_common_are_read_once(monkeypatch):
    seen, real = [], markup.ElementTree.fromstring
    monkeypatch.setattr(markup.ElementTree, "fromstring", lambda data: seen.append(data) or real(data))
    texts = [files.load_file(f"{k}.docx", loading._docx(k, "x", 3))[0]["content"] for k in (1001, 1002, 1003, 1004, 1005, 1006)]
    assert [t.split("\n")[0] for t in texts] == [f"# Part {k}" for k in range(1001, 1007)] and all("1. one\n2. two" in t for t in texts)
    assert len([d for d in seen if b"w:numbering" in d]) <= 1 and len([d for d in seen if b"w:styles" in d]) <= 2


def test_files_are_made_on_all_cores(spark):
    """However few row groups the table has."""
    assert loading.office_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

"""Queries that load files, which are made from the rows of tables, so that SQL knows what must come out."""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from docsql.operators import tables
from docsql.runtime import table, work_dir
from docsql.sources import files


def _dealt(s, d):
    """part, dealt out over the cores whatever its row groups: to make and read files takes far more than to move its rows."""
    return table(s, d, "part").select("p_partkey", "p_name", "p_size").repartition(4 * s.sparkContext.defaultParallelism)


def _texts(s, d):
    """Files of every text format, one row of `part` each: path and content."""
    p, k = table(s, d, "part"), F.col("p_partkey").cast("string")
    n, b, z = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    bytes_ = lambda t, charset="UTF-8": F.encode(t, charset)
    kinds = [
        ("md", bytes_(cat("---\ntitle: ", n, "\n---\n# Part ", k, "\n\nof ", b))),
        ("html", bytes_(cat("<html><head><title>", n, "</title><script>x</script></head><body><nav>menu</nav><main><h1>Part ", k, "</h1><p>", b, " &amp; &Alpha; &#65;", z, "</p><ul><li>x", k, "<li>y</ul><p hidden>no</p></main><footer>end</footer></body></html>"))),
        ("csv", bytes_(cat("name;text\n", n, ';"a ""', z, '""\nb"\n;\nlast;', b, "\n"))),
        ("tsv", bytes_(cat("name\tsize\n", n, "\t", z, "\n"))),
        ("json", bytes_(cat('[{"a":', z, '},{"b":"', n, '"}]'))),
        ("jsonl", bytes_(cat('{"a":{"b":[', z, "]}}\n"))),
        ("txt", bytes_(cat("café ", n), "ISO-8859-1")),
        ("log", bytes_(cat("ü ", n), "UTF-16")),
        ("doc", F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), bytes_(n))),
        ("bin", F.concat(F.unhex(F.lit("00010203")), bytes_(n))),
    ]
    made = F.array(*[F.struct(F.concat(F.lit(f"/in/{e}/part-"), k, F.lit(f".{e}")).alias("path"), c.alias("content")) for e, c in kinds])
    return p.select(F.explode(made).alias("f")).select("f.*")


def text_files(s, d):
    """S-1 to S-11, S-22, S-23, U-2: each format through its loader, errors beside"""
    r = files.load_binaries(_texts(s, d))
    return r.select("path", "kind", "title", "content", F.to_json("columns").alias("columns"), F.to_json(F.col("rows"), {"ignoreNullFields": "false"}).alias("cells"), F.col("error").isNotNull().alias("failed"), F.get_json_object("metadata", "$.file").alias("file"), F.get_json_object("metadata", "$.format").alias("format"))


def written_files(s, d):
    """S-4, S-22: files that were written, read from the shared folder"""
    folder = f"{work_dir(s)}/files-{uuid.uuid4().hex}"
    table(s, d, "supplier").select("s_name").repartition(4).write.text(folder)
    r = files.load_files(s, f"{folder}/*.txt")
    return r.where("kind = 'document'").select(F.explode(F.split("content", "\n")).alias("name"), (F.get_json_object("metadata", "$.modified") > "2020").alias("dated")).where("name <> ''")


@functools.lru_cache(1024)
def _part(name: str, body: str) -> tuple[bytes, bytes, bytes]:
    """A part of a zip file: name, fields of its header, deflated bytes. Many files have parts in common."""
    data, deflate = body.encode(), zlib.compressobj(wbits=-15)
    raw = deflate.compress(data) + deflate.flush()
    return name.encode(), struct.pack("<5H3L2H", 20, 0, 8, 0, 33, zlib.crc32(data), len(raw), len(data), len(name), 0), raw


def _zip(parts: dict[str, str]) -> bytes:
    out, heads, at = [], [], 0
    for name, head, raw in map(_part, parts, parts.values()):
        out += [b"PK\3\4", head, name, raw]
        heads += [b"PK\1\2\x14\0", head, bytes(10), struct.pack("<L", at), name]
        at += 30 + len(name) + len(raw)
    ends = b"".join(heads)
    return b"".join([*out, ends, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(parts), len(parts), len(ends), at, 0)])


_W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a" xmlns:p="http://p"'


def _docx(key: int, name: str, size: int) -> bytes:
    par = lambda text, style="", num="": f"<w:p><w:pPr>{style}{num}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    listed = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    body = par(f"Part {key}", '<w:pStyle w:val="H2"/>') + par(f"{name} &amp; more") + '<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>kept</w:t></w:r></w:p>' + par("one", num=listed) + par("two", num=listed) + f"<w:tbl><w:tr><w:tc>{par('h')}</w:tc></w:tr><w:tr><w:tc>{par(str(size))}</w:tc></w:tr></w:tbl>"
    styles = '<w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Mine"/><w:basedOn w:val="H"/></w:style>'
    numbers = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
    # every third file has a broken part, which must not fail it
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{styles}" + ("</w:styles>" if key % 3 else ""), "word/numbering.xml": f"<w:numbering {_W}>{numbers}</w:numbering>"})


def _xlsx(key: int, name: str, size: int) -> bytes:
    cells = f'<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>{45000 + size}</v></c><c r="C2" t="b"><v>{key % 2}</v></c></row><row><c r="A3" t="e"><v>#N/A</v></c><c r="C3"><v>{size}.25</v></c></row>'
    return _zip({
        "xl/workbook.xml": f'<workbook {_W}><sheets><sheet name="S{key}" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst><si><t>name</t></si><si><t>{name}</t></si></sst>", "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', "xl/worksheets/s.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
    })


def _epub(key: int, name: str, size: int) -> bytes:
    return _zip({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": f'<package><metadata><title>{name}</title></metadata><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/><item id="c" href="c.html"/></manifest><spine><itemref idref="b"/><itemref idref="a" linear="no"/><itemref idref="c"/></spine></package>',
        "o/a.html": "<p>no</p>", "o/b.html": f"<h1>Part {key}</h1>", "o/c.html": f"<p>size {size}</p>",
    })


def _pptx(key: int, name: str, size: int) -> bytes:
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda title, text: f'<p:sld {_W}><p:cSld><p:spTree>{shape("title", title)}{shape("body", text)}{shape("sldNum", "9")}</p:spTree></p:cSld></p:sld>'
    return _zip({
        "ppt/presentation.xml": f'<p:presentation {_W}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide(f"Part {key}", f"size {size}"), "ppt/slides/slide2.xml": slide(name, "opens"),
    })


def office_files(s, d):
    """S-12 to S-17, S-19, S-20, W-12: documents, sheets, books and slides"""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = zip(*b.slice(at, 1000).to_pydict().values())
                paths, contents = zip(*[(f"/in/{k}.{e}", made(k, n, z)) for k, n, z in rows for e, made in (("docx", _docx), ("xlsx", _xlsx), ("epub", _epub), ("pptx", _pptx))])
                yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    made = _dealt(s, d).mapInArrow(make, "path string, content binary")
    r = files.load_binaries(made)
    return r.select("path", "format", "ordinal", "title", "content", F.to_json("columns").alias("columns"), F.to_json(F.col("rows"), {"ignoreNullFields": "false"}).alias("cells"), "error")


def _glyph_runs(data: bytes) -> list[dict]:
    """A stand-in for a PDF decoder: the file is lines of page, y, size and text, each with a run a word."""
    rows = []
    for line in data.decode().split("\n")[1:]:
        page, y, size, text = line.split("|")
        x, page, y, size = 50.0, int(page), float(y), float(size)
        for word in text.split(" "):
            width = 5.0 * len(word)
            rows.append({"page": page, "seq": len(rows), "x": x, "y": y, "width": width, "size": size, "text": word})
            x += width + 3
    return rows


def _read_image(data: bytes) -> tuple[str, float]:
    confidence, _, text = data[8:].decode().partition("|")
    return text, float(confidence)


def scanned_files(s, d):
    """S-18, S-21, W-6, W-7, U-3: glyph runs as Markdown and images by a pluggable reader"""
    p = _dealt(s, d)
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    line = lambda page, y, size, *text: F.concat(F.lit(f"\n{page}|{y}|{size}|"), *text)
    pages = [F.lit("%PDF-1.7")]
    for n in (1, 2, 3, 4):
        pages += [line(n, 800, 9, F.lit("Yearly list of parts")), line(n, 790, 9, F.lit("for the stores")), line(n, 770, 18, F.lit(f"Chapter {n} of "), k), line(n, 740, 10, F.lit("The parts of this brand are counted every mor-")), line(n, 728, 10, F.lit("ning and once more before the evening begins")), line(n, 716, 10, F.lit("by those on duty.")), line(n, 704, 10, F.lit("Size "), z, F.lit(" is the usual one in all of the stores.")), line(n, 680, 10, F.lit("• " + ("north", "east", "south", "west")[n - 1])), line(n, 20, 9, F.lit(f"Page {n} of 4"))]
    pdf = F.encode(F.concat(*pages), "UTF-8")
    broken = F.encode(F.lit("%PDF-1.7\nbroken"), "UTF-8")
    image = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(F.concat(z, F.lit("| text "), k, F.lit(" ")), "UTF-8"))
    made = F.array(F.struct(F.concat(F.lit("/in/"), k, F.lit(".pdf")).alias("path"), F.when(F.col("p_partkey") % 5 == 4, broken).otherwise(pdf).alias("content")), F.struct(F.concat(F.lit("/in/"), k, F.lit(".png")).alias("path"), image.alias("content")))
    return files.load_binaries(p.select(F.explode(made).alias("f")).select("f.*"), _read_image, _glyph_runs).select("path", "kind", "content", F.col("error").isNotNull().alias("failed"), F.get_json_object("metadata", "$.format").alias("format"))


def imported_table(s, d):
    """K-1, T-5 of headers: text cells as a typed table with SQL names, imported, appended to and read back"""
    p = table(s, d, "part")
    cells = p.select(F.col("p_partkey").cast("string").alias("Part No"), F.col("p_name").alias("Name"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_size").cast("string")).alias("Size (cm)"), F.format_string("%d.%02d", F.col("p_size"), F.col("p_partkey") % 100).alias("unitPrice"), (F.col("p_size") > 20).cast("string").alias("Large?"), F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("Since"))
    name = f"parts_{uuid.uuid4().hex}"
    path = f"{work_dir(s)}/{name}"
    tables.import_table(cells, name, comment="parts", path=path)
    tables.import_table(cells.where(F.col("Part No") == "1"), name, "append", types=tables.infer_types(cells))
    out = s.read.schema(s.table(name).schema).parquet(path)
    s.sql(f"drop table {name}")
    return out


SQL: dict[str, str] = {
    "text_files": f"""with f as (select unnest(['md', 'html', 'csv', 'tsv', 'json', 'jsonl', 'txt', 'log', 'doc', 'bin']) as e, * from part)
        select '/in/' || e || '/part-' || p_partkey || '.' || e as path, case when e in ('doc', 'bin') then 'error' when e in ('csv', 'tsv', 'json') then 'table' else 'document' end as kind,
          case when e in ('md', 'html') then p_name when e not in ('doc', 'bin') then 'part-' || p_partkey || '.' || e end as title,
          case e when 'md' then '# Part ' || p_partkey || chr(10) || chr(10) || 'of ' || p_brand when 'html' then '# Part ' || p_partkey || chr(10) || chr(10) || p_brand || ' & &Alpha; A' || p_size || chr(10) || chr(10) || '- x' || p_partkey || chr(10) || '- y'
            when 'jsonl' then '-' || chr(10) || '  a:' || chr(10) || '    b:' || chr(10) || '      - ' || p_size when 'txt' then 'café ' || p_name when 'log' then 'ü ' || p_name end as content,
          case e when 'csv' then '["name","text"]' when 'tsv' then '["name","size"]' when 'json' then '["a","b"]' end as columns,
          case e when 'csv' then '[["' || p_name || '","a \\"' || p_size || '\\"\\nb"],["last","' || p_brand || '"]]' when 'tsv' then '[["' || p_name || '","' || p_size || '"]]' when 'json' then '[["' || p_size || '",null],[null,"' || p_name || '"]]' end as cells,
          e in ('doc', 'bin') as failed, 'part-' || p_partkey || '.' || e as file, case e when 'md' then 'markdown' when 'tsv' then 'csv' when 'txt' then 'text' when 'log' then 'text' when 'doc' then null when 'bin' then null else e end as format from f""",
    "written_files": "select s_name as name, true as dated from supplier",
    "office_files": """with f as (select unnest(['docx', 'xlsx', 'epub', 'pptx', 'pptx2']) as e, * from part)
        select '/in/' || p_partkey || '.' || e[1:4] as path, e[1:4] as format, (case e when 'pptx2' then 1 else 0 end)::int as ordinal, case e when 'docx' then p_partkey || '.docx' when 'xlsx' then 'S' || p_partkey when 'epub' then p_name when 'pptx' then p_name else 'Part ' || p_partkey end as title,
          case e when 'docx' then '# Part ' || p_partkey || chr(10) || chr(10) || p_name || ' & more' || chr(10) || chr(10) || 'kept' || chr(10) || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || '| h |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' |'
            when 'epub' then '# Part ' || p_partkey || chr(10) || chr(10) || 'size ' || p_size when 'pptx' then '## Slide 1: ' || p_name || chr(10) || chr(10) || '- opens' when 'pptx2' then '## Slide 2: Part ' || p_partkey || chr(10) || chr(10) || '- size ' || p_size end as content,
          case e when 'xlsx' then '["name","day","n"]' end as columns,
          case e when 'xlsx' then '[["' || p_name || '","' || (date '2023-03-15' + p_size) || '","' || case p_partkey % 2 when 1 then 'TRUE' else 'FALSE' end || '"],[null,null,"' || p_size || '.25"]]' end as cells, null::varchar as error from f""",
    "scanned_files": """with f as (select unnest(['pdf', 'png']) as e, * from part),
        c as (select p_partkey, array_to_string(list_transform(range(1, 5), lambda n: '# Chapter ' || n || ' of ' || p_partkey || chr(10) || chr(10) || 'The parts of this brand are counted every morning and once more before the evening begins by those on duty.' || chr(10) || chr(10) || 'Size ' || p_size || ' is the usual one in all of the stores.' || chr(10) || chr(10) || '- ' || ['north', 'east', 'south', 'west'][n]), chr(10) || chr(10)) as text from part)
        select '/in/' || p_partkey || '.' || e as path, case when e = 'pdf' and p_partkey % 5 = 4 then 'error' else 'document' end as kind, case when e = 'png' then case when p_size >= 30 then 'text ' || p_partkey else '' end when p_partkey % 5 < 4 then text end as content, e = 'pdf' and p_partkey % 5 = 4 as failed, case e when 'png' then 'image' else e end as format from f join c using (p_partkey)""",
    "imported_table": """select p_partkey::int as part_no, p_name as name, case when p_partkey % 7 > 0 then p_size end as size_cm, (p_size || '.' || lpad((p_partkey % 100)::varchar, 2, '0'))::decimal(4,2) as unit_price, p_size > 20 as large, ('2024-01-' || lpad((p_partkey % 28 + 1)::varchar, 2, '0'))::date as since from part cross join (select unnest(range(2)) as i) where i = 0 or p_partkey = 1""",
}
QUERIES = [text_files, written_files, office_files, scanned_files, imported_table]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL

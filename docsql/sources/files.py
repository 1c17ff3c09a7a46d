"""Files of many formats as documents and tables: one row a file in, one row a result out, errors kept beside.

Defined results: a file that cannot be read gives one row with its error and nothing else; an empty file gives one empty
document; a file over the size limit, of an unknown or a legacy format is an error.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.functions.structured import flat_records, iso_stamp, json_text
from docsql.operators.tables import header_names
from docsql.sources import glyphs, markup

MOST_BYTES = 100_000_000
# First bytes, and formats by ending.
MAGIC = [(b"%PDF-", "pdf"), (b"\x89PNG\r\n", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "legacy")]
MEMBERS = [("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx"), ("META-INF/container.xml", "epub")]
ENDINGS = {"md": "markdown", "markdown": "markdown", "mdx": "markdown", "html": "html", "htm": "html", "xhtml": "html", "csv": "csv", "tsv": "csv", "tab": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "txt": "text", "text": "text", "log": "text", "pdf": "pdf"}
RESULT = "path string, format string, kind string, ordinal int, title string, content string, columns array<string>, rows array<array<string>>, warnings array<string>, error string, metadata string"


def looks_like_text(data: bytes) -> bool:
    head = data[:8192]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return True
    return b"\0" not in head and sum(b < 9 or 13 < b < 32 for b in head) <= 0.02 * len(head)


def detect_format(name: str, data: bytes, package: markup.Package | None = None) -> str | None:
    """package: the parts of a zip file, where they were read."""
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image"
    if data.startswith(b"PK\x03\x04"):
        try:
            parts = package or markup.package(data)
        except zipfile.BadZipFile:
            return None
        return next((kind for member, kind in MEMBERS if member in parts), None)
    ending = name.rpartition(".")[2].lower()
    return ENDINGS.get(ending) or ("text" if looks_like_text(data) else None)


# windows-1252, whose five undefined bytes are control characters
_cp1252 = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in range(256))


def decode(data: bytes) -> str:
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return codecs.charmap_decode(data, "strict", _cp1252)[0]


def sniff_delimiter(text: str) -> str:
    """Of , tab ; | the one that stands most evenly in the first ten lines, outside quotes."""
    lines = [x for x in re.sub(r'"(?:[^"]|"")*"', "", text[:65536]).splitlines() if x.strip()][:10]
    if not lines:
        return ","
    score = {}
    for d in ",\t;|":
        n = [x.count(d) for x in lines]
        score[d] = min(n) * sum(x == n[0] for x in n) / len(n)
    return max(score, key=lambda d: (score[d], -",\t;|".index(d)))


def parse_csv(text: str, delimiter: str | None = None) -> list[list[str]]:
    csv.field_size_limit(MOST_BYTES)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or sniff_delimiter(text), quotechar='"', doublequote=True, strict=False)
    return [r for r in rows if any(c.strip() for c in r)]


def to_table(grid: list[list[str | None]]) -> tuple[list[str], list[list[str | None]]]:
    """(columns, rows): the first row names the columns; cells trimmed, empty ones null, short rows filled."""
    if not grid:
        return [], []
    width = max(map(len, grid))
    columns = header_names([*grid[0], *[None] * (width - len(grid[0]))])
    return columns, [[(c or "").strip() or None for c in [*r, *[None] * (width - len(r))]] for r in grid[1:]]


def records_table(records: list[dict]) -> tuple[list[str], list[list[str | None]]]:
    columns = list(dict.fromkeys(k for r in records for k in r))
    cell = lambda v: None if v is None or v == "" else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return columns, [[cell(r.get(c)) for c in columns] for r in records]


Ocr = Callable[[bytes], tuple[str, float]]
GlyphRuns = Callable[[bytes], list[dict]]


def load_file(path: str, data: bytes, ocr: Ocr | None = None, least_confidence: float = 30.0, glyph_runs: GlyphRuns | None = None) -> list[dict]:
    """Results of one file, as RESULT without its path. ocr: the text of an image and its confidence; below the least one it has none.
    glyph_runs: the runs of a PDF."""
    name = path.rsplit("/", 1)[-1]
    if len(data) > MOST_BYTES:
        raise ValueError(f"larger than {MOST_BYTES} bytes")
    parts = None
    if data.startswith(b"PK\x03\x04"):
        try:
            parts = markup.package(data)
        except zipfile.BadZipFile as x:
            raise ValueError("an unknown format") from x
    kind = detect_format(name, data, parts)
    if kind == "image" and ocr:
        said, confidence = ocr(data)
        sure = confidence >= least_confidence
        return [{"format": kind, "kind": "document", "ordinal": 0, "title": name, "content": said.strip() if sure else "", "warnings": [] if sure else ["no readable text"]}]
    if kind == "pdf" and glyph_runs and data.startswith(b"%PDF-"):
        told = {"format": kind, "ordinal": 0, "title": name, "warnings": []}
        try:
            return [told | {"kind": "document", "content": glyphs.markdown_of(glyph_runs(data))}]
        except Exception as x:  # noqa: BLE001 - whatever the decoder raises
            return [told | {"kind": "error", "error": f"{type(x).__name__}: {x}"}]
    if kind is None or kind in ("legacy", "pdf", "image"):
        raise ValueError({"legacy": "a legacy Office file", "pdf": "PDF needs a decoder of glyphs", "image": "an image needs OCR"}.get(kind, "an unknown format"))
    doc = lambda title, content, n=0, warnings=(): {"format": kind, "kind": "document", "ordinal": n, "title": title, "content": content, "warnings": list(warnings)}
    table = lambda title, columns, rows, n=0: {"format": kind, "kind": "table", "ordinal": n, "title": title, "columns": columns, "rows": rows}
    if kind == "docx":
        return [doc(name, markup.docx_to_markdown(parts))]
    if kind == "pptx":
        return [doc(title or f"{name} {n}", text, n - 1) for n, title, text in markup.pptx_slides(parts)]
    if kind == "xlsx":
        return [table(sheet, *to_table(rows), n) for n, (sheet, rows) in enumerate(markup.xlsx_sheets(parts)) if rows]
    if kind == "epub":
        title, text = markup.epub_to_markdown(parts)
        return [doc(title or name, text)]
    text = decode(data)
    if kind == "html":
        title, body = markup.html_to_markdown(text)
        return [doc(title or name, body)]
    if kind == "markdown":
        title, body = markup.front_matter(text)
        return [doc(title or name, body)]
    if kind == "csv":
        grid = parse_csv(text, "\t" if name.lower().endswith((".tsv", ".tab")) else None)
        return [table(name, *to_table(grid))]
    if kind in ("json", "jsonl"):
        try:
            value = [json.loads(x) for x in text.splitlines() if x.strip()] if kind == "jsonl" else json.loads(text)
        except ValueError as x:
            return [doc(name, text, warnings=[f"not valid JSON: {x}"])]
        return [table(name, *records_table(value))] if flat_records(value) else [doc(name, json_text(value))]
    return [doc(name, text)]


def load_files(spark: SparkSession, paths: str | list[str], ocr: Ocr | None = None, glyph_runs: GlyphRuns | None = None) -> DataFrame:
    """One row per document or table of each file, and one with the error of each file that cannot be read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content"))
    return load_binaries(files, ocr, glyph_runs)


def load_binaries(files: DataFrame, ocr: Ocr | None = None, glyph_runs: GlyphRuns | None = None) -> DataFrame:
    """The same for files (path, content, and, where known, modificationTime).

    glyph_runs decodes a PDF into runs (page, seq, x, y, width, size, text), from which its text is built; without it PDFs are errors,
    as images are without ocr. metadata tells format, file and, where known, when the file was modified.
    """
    return _stamped(_loaded(files, ocr, glyph_runs), files)


def _stamped(results: DataFrame, files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    if "modificationTime" not in files.columns:
        return results.withColumn("metadata", F.to_json(F.struct("format", name)))
    when = files.select("path", iso_stamp(F.col("modificationTime")).alias("modified"))
    return results.join(when, "path", "left").withColumn("metadata", F.to_json(F.struct("format", name, "modified"))).drop("modified")


def _loaded(files: DataFrame, ocr: Ocr | None, glyph_runs: GlyphRuns | None) -> DataFrame:
    text, texts = pa.string(), pa.list_(pa.string())
    schema = pa.schema([("path", text), ("format", text), ("kind", text), ("ordinal", pa.int32()), ("title", text), ("content", text), ("columns", texts), ("rows", pa.list_(texts)), ("warnings", texts), ("error", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    if data is None:
                        raise ValueError(f"larger than {MOST_BYTES} bytes, or missing")
                    out += [{"path": path} | r for r in load_file(path, data, ocr, glyph_runs=glyph_runs)]
                except Exception as x:  # noqa: BLE001 - a file's error must not end the others
                    out.append({"path": path, "kind": "error", "error": f"{type(x).__name__}: {x}"})
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("path", "content").mapInArrow(run, RESULT.removesuffix(", metadata string"))

"""Text of positioned glyph runs: lines, sizes, headings, paragraphs. Also the data of event streams.

glyphs: doc, page, seq, x, y, width, size, text. Every window stays within a page, or within the lines of a document.
`markdown` takes a table of them, `markdown_of` the runs of one document where they are read; both give the same text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsql.functions.detectors import BULLET, PAGE_NUMBER, is_page_number
from docsql.functions.numeric import percentiles
from docsql.functions.text import running_key

# Shares of the font size that part lines, cells and words, and what makes a heading.
LINE, CELL, WORD, HEADING, LONGEST_HEADING = 0.5, 0.8, 0.15, 1.15, 150
BODY, WIDER_GAP, SHORT, WIDTH_AT, NO_SPACING = 0.5, 1.4, 0.75, 0.75, 1.2


def lines(glyphs: DataFrame) -> DataFrame:
    """doc, page, line, text, size, x, y, end_x, cells: runs of one height joined, wide gaps between cells."""
    w = Window.partitionBy("doc", "page").orderBy("seq")
    last = lambda c: F.lag(c).over(w)
    g = glyphs.withColumn("new", (last("y").isNull() | (F.abs(F.col("y") - last("y")) > F.greatest("size", last("size")) * LINE)).cast("int"))
    g = g.withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy("doc", "page", "line").orderBy("seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(v)
    joint = F.when(gap > F.col("size") * CELL, "\t").when((gap > F.col("size") * WORD) & ~F.col("text").rlike(r"^\s") & ~F.lag("text").over(v).rlike(r"\s$"), " ").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat("joint", "text").alias("t"))))
    out = g.withColumn("joint", joint).groupBy("doc", "page", "line").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("raw"), F.max("size").alias("size"), F.min("x").alias("x"), F.min_by("y", "seq").alias("y"), F.max(F.col("x") + F.col("width")).alias("end_x"))
    cells = F.filter(F.transform(F.split("raw", "\t"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    return out.withColumn("cells", cells).where(F.size("cells") > 0).withColumn("text", F.array_join("cells", " ")).drop("raw")


def without_running(rows: DataFrame) -> DataFrame:
    """Lines without page numbers and without what stands at the edge of at least three pages and half of a document's."""
    up, down = Window.partitionBy("doc", "page").orderBy("line"), Window.partitionBy("doc", "page").orderBy(F.desc("line"))
    e = rows.withColumn("edge", (F.row_number().over(up) <= 2) | (F.row_number().over(down) <= 2)).withColumn("key", running_key(F.col("text")))
    pages = rows.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    often = e.where("edge").select("doc", "page", "key").distinct().groupBy("doc", "key").agg(F.count("*").alias("n")).join(pages, "doc").where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.5)))).select("doc", "key", F.lit(True).alias("often"))
    kept = e.join(often, ["doc", "key"], "left").where(~F.col("edge") | ~(is_page_number(F.col("text")) | F.coalesce("often", F.lit(False))))
    return kept.drop("edge", "key", "often")


def with_levels(rows: DataFrame) -> DataFrame:
    """Lines with `level`: 0 for text, 1 to 3 for headings by the rank of their size."""
    half = F.floor(F.col("size") * 2 + 0.5) / 2
    sized = rows.withColumn("half", half)
    weight = sized.groupBy("doc", "half").agg(F.sum(F.length("text")).alias("n"))
    body = weight.groupBy("doc").agg(F.max_by("half", F.struct("n", "half")).alias("body"))
    j = sized.join(body, "doc").withColumn("head", (F.col("size") / F.col("body") >= HEADING) & (F.length("text") <= LONGEST_HEADING))
    ranks = j.where("head").select("doc", "half").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("half"))))
    return j.join(ranks, ["doc", "half"], "left").withColumn("level", F.when(F.col("head"), F.least(F.lit(3), F.col("rank"))).otherwise(0)).drop("half", "head", "rank")


def line_measures(rows: DataFrame) -> DataFrame:
    """rows (of with_levels) with plain (a line of body text), gap to the line above, spacing (the usual gap between plain lines of the
    document) and full (the width that a quarter of its plain lines reach; null for fewer than three of them)."""
    w = Window.partitionBy("doc", "page").orderBy("line")
    g = rows.withColumn("plain", (F.abs(F.col("size") - F.col("body")) < BODY) & (F.size("cells") == 1)).withColumn("gap", F.lag("y").over(w) - F.col("y")).withColumn("__p", F.lag("plain").over(w))
    plain = g.where("plain").select("doc", (F.col("end_x") - F.col("x")).alias("width"))
    widths = percentiles(plain, ["doc"], "width", {"full": WIDTH_AT}).join(plain.groupBy("doc").agg(F.count("*").alias("__n")), "doc").where("__n >= 3").select("doc", "full")
    spacing = percentiles(g.where("plain and __p and gap > 0").select("doc", "gap"), ["doc"], "gap", {"spacing": 0.5})
    return g.join(spacing, "doc", "left").join(widths, "doc", "left").withColumn("spacing", F.coalesce("spacing", F.col("body") * NO_SPACING)).drop("__p")


def paragraphs(rows: DataFrame) -> DataFrame:
    """doc, text: Markdown of a document's lines.

    A block ends where the level of headings changes, before a wider gap or another column, a bullet or a number, before and
    after a row of cells, and after a short line that ends a sentence. Hyphens between blocks' lines are resolved; the first
    row of a table gets a rule; list items stand close.
    """
    w = Window.partitionBy("doc").orderBy("page", "line")
    before = lambda c: F.lag(c).over(w)
    m = line_measures(rows).withColumn("row", F.size("cells") > 1)
    m = m.withColumn("short", F.col("plain") & (F.col("end_x") - F.col("x") < F.col("full") * SHORT) & F.col("text").rlike(r"[.!?:;]$"))
    item = F.col("text").rlike(BULLET) | F.col("text").rlike(r"^\(?\d{1,2}[.)]\s")
    new = before("level").isNull() | F.col("row") | before("row") | (F.col("level") != before("level")) | ((F.col("level") > 0) & (F.abs(F.col("size") - before("size")) > BODY)) | (F.col("gap") > F.col("spacing") * WIDER_GAP) | (F.col("gap") < 0) | F.coalesce(before("short"), F.lit(False)) | item
    b = m.withColumn("block", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cell = F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    said = F.when(F.col("row"), F.concat(F.lit("| "), F.array_join(cell, " | "), F.lit(" |"))).otherwise(F.regexp_replace("text", BULLET, "- "))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", said.alias("t")))), lambda x: x["t"]), "\n")
    blocks = b.groupBy("doc", "block").agg(F.first("level").alias("level"), F.first("row").alias("row"), F.first(F.size("cells")).alias("width"), F.regexp_replace(F.regexp_replace(joined, r"(?<=[A-Za-zÀ-ÿ])-\n(?=[a-zà-ÿ])", ""), "\n", " ").alias("t"))
    v = Window.partitionBy("doc").orderBy("block")
    listed = F.col("t").rlike(r"^(- |\d{1,2}\. )")
    above = F.coalesce(F.lag("row").over(v), F.lit(False))
    tight = (F.col("row") & above) | (listed & ~F.col("row") & F.coalesce(F.lag(listed).over(v), F.lit(False)))
    text = F.concat(F.when(F.lag("block").over(v).isNull(), "").when(tight, "\n").otherwise("\n\n"), F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "))).otherwise(""), "t", F.when(F.col("row") & ~above, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width")))).otherwise(""))
    return blocks.withColumn("t", text).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "t"))), lambda x: x["t"]), "").alias("text"))


def markdown(glyphs: DataFrame) -> DataFrame:
    return paragraphs(with_levels(without_running(lines(glyphs))))


_END = r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z"  # what $ stands before in Spark
_space, _digits = re.compile(r"\s+", re.A), re.compile(r"\d+", re.A)
_SPACES, _ENDS = frozenset(" \t\n\r\f\v"), frozenset("\x85\u2028\u2029")
_blank, _closes = re.compile(r"\s" + _END, re.A), re.compile(r"[.!?:;]" + _END, re.A)
_number, _bullet, _item = re.compile(PAGE_NUMBER.replace("$", _END), re.A), re.compile(BULLET, re.A), re.compile(r"\(?\d{1,2}[.)]\s", re.A)
_hyphen, _listed = re.compile(r"(?<=[A-Za-zÀ-ÿ])-\n(?=[a-zà-ÿ])"), re.compile(r"- |\d{1,2}\. ", re.A)


@dataclass(slots=True)
class _Line:
    page: int
    cells: list[str]
    text: str
    size: float
    x: float
    y: float
    end_x: float
    level: int = 0
    plain: bool = False
    gap: float | None = None


def _ends_blank(text: str) -> bool:
    last = text[-1:]
    return last in _SPACES or last in _ENDS and bool(_blank.search(text[-3:]))


def _lines_of(runs: list[dict]) -> list[_Line]:
    found: list[tuple] = []
    page, y, last_y, last_size, last_end, last_text = None, 0.0, 0.0, 0.0, 0.0, None
    parts, size, x, end_x = [], 0.0, 0.0, 0.0
    for r in sorted(runs, key=itemgetter("page", "seq")):
        p, rx, ry, rsize, text = r["page"], r["x"], r["y"], r["size"], r["text"]
        end = rx + r["width"]
        if p != page or ry != last_y and abs(ry - last_y) > max(rsize, last_size) * LINE:
            if parts:
                found.append((page, parts, size, x, y, end_x))
            parts, page, size, x, y, end_x = [text or ""], p, rsize, rx, ry, end
        else:
            if text is not None:
                gap = rx - last_end
                if gap > rsize * WORD:
                    if gap > rsize * CELL:
                        parts.append("\t")
                    elif last_text is not None and text[:1] not in _SPACES and not _ends_blank(last_text):
                        parts.append(" ")
                parts.append(text)
            if rsize > size:
                size = rsize
            if rx < x:
                x = rx
            if end > end_x:
                end_x = end
        last_y, last_size, last_end, last_text = ry, rsize, end, text
    if parts:
        found.append((page, parts, size, x, y, end_x))
    out = []
    for page, parts, size, x, y, end_x in found:
        cells = []
        for c in "".join(parts).split("\t"):
            c = (c if "  " not in c and c.isprintable() else _space.sub(" ", c)).strip(" ")
            if c:
                cells.append(c)
        if cells:
            out.append(_Line(page, cells, " ".join(cells), size, x, y, end_x))
    return out


def _without_running(lines: list[_Line]) -> list[_Line]:
    pages = [list(g) for _, g in groupby(lines, key=lambda a: a.page)]
    key = lambda a: _digits.sub("#", a.text.lower())  # noqa: E731 - its blanks are single ones already
    edges = [{i: key(a) for i, a in enumerate(p) if i < 2 or i >= len(p) - 2} for p in pages]
    n = Counter(k for e in edges for k in set(e.values()))
    most = max(3, math.ceil(len(pages) * 0.5))
    return [a for p, e in zip(pages, edges) for i, a in enumerate(p) if i not in e or n[e[i]] < most and not _number.search(a.text)]


def _upto(values: list[float], share: float) -> float | None:
    return sorted(values)[min(len(values) - 1, math.floor(share * len(values)))] if values else None


def markdown_of(runs: list[dict]) -> str:
    """Markdown of one document's runs (page, seq, x, y, width, size, text); empty where they hold no text."""
    lines = _without_running(_lines_of(runs))
    if not lines:
        return ""
    half = lambda a: math.floor(a.size * 2 + 0.5) / 2
    weight: dict[float, int] = defaultdict(int)
    for a in lines:
        weight[half(a)] += len(a.text)
    body = max(weight, key=lambda h: (weight[h], h))
    is_head = lambda a: a.size / body >= HEADING and len(a.text) <= LONGEST_HEADING
    heads = {half(a) for a in lines if is_head(a)}
    rank = {h: min(3, i) for i, h in enumerate(sorted(heads, reverse=True), 1)}
    widths, gaps, above = [], [], None
    for a in lines:
        a.level = rank[half(a)] if is_head(a) else 0
        a.plain = abs(a.size - body) < BODY and len(a.cells) == 1
        if a.plain:
            widths.append(a.end_x - a.x)
        if above and above.page == a.page:
            a.gap = above.y - a.y
            if a.plain and above.plain and a.gap > 0:
                gaps.append(a.gap)
        above = a
    full = _upto(widths, WIDTH_AT) if len(widths) >= 3 else None
    spacing = _upto(gaps, 0.5) or body * NO_SPACING
    blocks: list[tuple[_Line, list[str]]] = []
    above = None
    for a in lines:
        row = len(a.cells) > 1
        goes_on = (
            above and not row and len(above.cells) == 1 and a.level == above.level and not (a.level > 0 and abs(a.size - above.size) > BODY)
            and a.gap is not None and 0 <= a.gap <= spacing * WIDER_GAP and not _bullet.match(a.text) and not _item.match(a.text)
            and not (above.plain and full is not None and above.end_x - above.x < full * SHORT and _closes.search(above.text))
        )
        said = "| " + " | ".join(c.replace("|", "\\|") for c in a.cells) + " |" if row else a.text if goes_on else _bullet.sub("- ", a.text)
        if goes_on:
            blocks[-1][1].append(said)
        else:
            blocks.append((a, [said]))
        above = a
    out, was_row, was_listed = [], False, False
    for a, said in blocks:
        t, row = said[0] if len(said) == 1 else _hyphen.sub("", "\n".join(said)).replace("\n", " "), len(a.cells) > 1
        listed = bool(_listed.match(t))
        if out:
            out.append("\n" if row and was_row or listed and not row and was_listed else "\n\n")
        out += ["#" * a.level + " " if a.level else "", t, "\n|" + " --- |" * len(a.cells) if row and not was_row else ""]
        was_row, was_listed = row, listed
    return "".join(out)


def event_data(body: Column) -> Column:
    """Data of each server-sent event: its data lines joined; events without data are left out."""
    events = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    data = F.transform(events, lambda e: F.array_join(F.transform(F.filter(F.split(e, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda d: d != "")


def ndjson_lines(body: Column) -> Column:
    """Lines of newline-delimited JSON, as variants; blank lines and those that are no JSON are left out."""
    lines = F.transform(F.split(body, "\r?\n"), lambda x: F.try_parse_json(F.trim(x)))
    return F.filter(lines, lambda v: v.isNotNull())

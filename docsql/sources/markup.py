"""HTML to Markdown, front matter, and office files, all with the standard library."""

from __future__ import annotations

import functools
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from html.parser import HTMLParser
from typing import TypeVar
from xml.etree import ElementTree

T = TypeVar("T")

# Elements that hold no text of the page, and elements that end a line.
DROPPED = {"script", "style", "noscript", "template", "nav", "aside", "svg", "iframe", "form", "button", "select", "canvas", "object"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "address", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "br"}
CHROME = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog"}
# The named characters that are decoded; others stay as they stand.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "",
    "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "minus": "−",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "deg": "°", "times": "×", "divide": "÷", "plusmn": "±",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "sect": "§", "para": "¶", "larr": "←", "rarr": "→", "harr": "↔",
    "le": "≤", "ge": "≥", "ne": "≠", "check": "✓", "aacute": "á", "agrave": "à", "acirc": "â", "auml": "ä", "aring": "å",
    "ccedil": "ç", "eacute": "é", "egrave": "è", "ecirc": "ê", "euml": "ë", "iacute": "í", "iuml": "ï", "ntilde": "ñ",
    "oacute": "ó", "ocirc": "ô", "ouml": "ö", "oslash": "ø", "uacute": "ú", "uuml": "ü", "szlig": "ß",
    "Aacute": "Á", "Auml": "Ä", "Eacute": "É", "Ouml": "Ö", "Uuml": "Ü", "Ntilde": "Ñ", "Ccedil": "Ç",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


_AMP = "\ue0a6"  # stands for & while a page is parsed, as the parser would decode names of its own
_entity = re.compile(r"&(?:#[xX](?P<hex>[0-9a-fA-F]+)|#(?P<dec>[0-9]+)|(?P<name>[A-Za-z][A-Za-z0-9]*));")


def decode_entities(text: str) -> str:
    """Numbered characters and those of ENTITIES, each closed by a semicolon; whatever else begins with & stays."""

    def one(m: re.Match) -> str:
        if m["name"]:
            return ENTITIES.get(m["name"], m[0])
        code = int(m["hex"], 16) if m["hex"] else int(m["dec"])
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    return _entity.sub(one, text)


@dataclass
class _List:
    ordered: bool
    n: int


@dataclass
class _Table:
    rows: list[list[str]] = field(default_factory=list)


class _Markdown(HTMLParser):
    def __init__(self, main: bool):
        super().__init__(convert_charrefs=True)
        self.main, self.inside = main, 0
        self.title, self.out, self.line = "", [], ""
        self.skip: list[str] = []
        self.lists: list[_List] = []
        self.tables: list[_Table] = []
        self.cell: list[str] | None = None
        self.pre = 0
        self.in_title = False
        self.open: list[str] = []

    def flush(self, gap: bool = False) -> None:
        text = self.line if self.pre else re.sub(r"[ \t\n\r\f]+", " ", self.line).strip()
        if text.strip():
            self.out.append(text)
        self.line = ""
        if gap and self.out and self.out[-1] != "":
            self.out.append("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag not in VOID:
            self.open.append(tag)
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or (a.get("role") or "") in CHROME or "display:none" in (a.get("style") or "").replace(" ", "")
        page_foot = tag in ("footer", "header") and not {"article", "main", "section"} & set(self.open[:-1])
        if tag in DROPPED or hidden or page_foot:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "title":
            self.in_title = True
        if tag in ("main", "article"):
            self.inside += 1
        if tag in BLOCKS and self.cell is None:
            self.flush(gap=tag in ("p", "table", "pre", "blockquote") or (tag in ("ul", "ol") and not self.lists))
        if tag[0] == "h" and tag[1:].isdigit():
            self.flush(gap=True)
            self.line = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            start = a.get("start") or "1"
            self.lists.append(_List(tag == "ol", int(start) if start.lstrip("-").isdigit() else 1))
        elif tag == "li":
            top = self.lists[-1] if self.lists else _List(False, 1)
            self.line = "  " * max(0, len(self.lists) - 1) + (f"{top.n}. " if top.ordered else "- ")
            top.n += 1
        elif tag == "table":
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables:
            self.cell = []
        elif tag == "pre":
            self.pre += 1
            self.out.append("```")
        elif tag == "code" and not self.pre:
            self.put("`")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag == "title":
            self.in_title = False
        if tag in ("td", "th") and self.cell is not None and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip().replace("|", "\\|"))
            self.cell = None
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop().rows if any(r)]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                self.out += ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * width, *["| " + " | ".join(r) + " |" for r in rows[1:]], ""]
        elif tag == "pre":
            self.out += [*self.line.strip("\n").split("\n"), "```", ""]
            self.line = ""
            self.pre = max(0, self.pre - 1)
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in BLOCKS and self.cell is None:
            self.flush(gap=tag in ("p", "blockquote") or tag[0] == "h" and tag[1:].isdigit() or (tag in ("ul", "ol") and len(self.lists) == 1))
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in ("main", "article"):
            self.inside = max(0, self.inside - 1)

    def put(self, text: str) -> None:
        if self.cell is not None:
            self.cell.append(text)
        else:
            lead = re.match(r" *(?:- |\d+\. )$", self.line)
            self.line += text.lstrip() if lead else text

    def handle_data(self, data: str) -> None:
        data = decode_entities(data.replace(_AMP, "&"))
        if self.in_title:
            self.title += data
        elif not self.skip and (self.inside or not self.main):
            self.put(data)


def html_to_markdown(html: str) -> tuple[str | None, str]:
    """(title, text): only the main part of a page where it names one."""
    p = _Markdown(bool(re.search(r"<(main|article)[\s>]", html, re.I)))
    p.feed(html.replace("&", _AMP))
    p.close()
    p.flush()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(p.out)).strip()
    return (re.sub(r"\s+", " ", p.title).strip() or None), text


def front_matter(text: str) -> tuple[str | None, str]:
    """(title, body) of Markdown: the title of its front matter, else of its first heading."""
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    title = None
    if m:
        t = re.search(r"^title:[ \t]*(.+?)[ \t]*$", m[1], re.M)
        title = t[1].strip("\"'") if t else None
        text = text[m.end() :]
    if not title:
        h = re.search(r"^# +(.+?)[ \t]*$", text, re.M)
        title = h[1] if h else None
    return title, text.strip()


SHARED = 32_768  # bytes of a part up to which what was read of it is kept, as files made from one template have many parts in common


def _inflated(raw: bytes, size: int) -> bytes:
    return zlib.decompressobj(-15).decompress(raw, size + 1)  # no more is unpacked than was announced, but for a byte that tells


_shared_bytes = functools.lru_cache(128)(_inflated)


class Package:
    """The parts of a zip file, by name. Plain archives are read here, others, and whatever is not as it should be, by zipfile."""

    def __init__(self, data: bytes):
        self.data, self.zip = data, None
        self.parts = self._directory()
        if self.parts is None:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.parts = dict.fromkeys(self.zip.namelist())

    def _directory(self) -> dict[str, tuple] | None:
        data, parts = self.data, {}
        if data[-22:-18] != b"PK\5\6" or len(data) < 22:
            return None
        disk, disk_at, here, entries, size, at, comment = struct.unpack("<4H2LH", data[-18:])
        if disk or disk_at or here != entries or comment or at + size != len(data) - 22:
            return None
        for _ in range(entries):
            if data[at : at + 4] != b"PK\1\2" or at + 46 > len(data):
                return None
            _, _, flags, method, _, _, crc, packed, full, name, extra, note, _, _, _, start = struct.unpack_from("<6H3L5H2L", data, at + 4)
            key = data[at + 46 : at + 46 + name]
            if extra or flags & ~0x80E or method not in (0, 8) or packed == 0xFFFFFFFF or full == 0xFFFFFFFF or not key.isascii() or b"\0" in key:
                return None
            parts[key.decode()] = method, crc, packed, full, start, key
            at += 46 + name + note
        return parts if at == len(data) - 22 else None

    def __contains__(self, name: str) -> bool:
        return name in self.parts

    def read(self, name: str) -> bytes:
        if self.zip is None:
            method, crc, packed, full, start, key = self.parts[name]
            head = self.data[start : start + 30]
            if head[:4] == b"PK\3\4" and len(head) == 30 and self.data[start + 30 : start + 30 + len(key)] == key:
                at = start + 30 + len(key) + int.from_bytes(head[28:30], "little")
                raw = self.data[at : at + packed]
                try:
                    out = raw if not method else (_shared_bytes if full <= SHARED else _inflated)(raw, full)
                except zlib.error:
                    out = None
                if out is not None and len(out) == full and zlib.crc32(out) == crc:
                    return out
            self.zip = zipfile.ZipFile(io.BytesIO(self.data))
        return self.zip.read(name)


def package(data: bytes | Package) -> Package:
    return data if isinstance(data, Package) else Package(data)


_markup = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[?!][^>]*>|<(?P<close>/)?(?P<tag>[A-Za-z_][\w:.-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(?P<empty>/)?>|(?P<text>[^<]+|<)", re.S)
_attribute = re.compile(r"([A-Za-z_][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def forgiving_xml(text: str) -> ElementTree.Element:
    """A tree of whatever is there: open elements are closed at the end, closing tags without an opening one are skipped, bare & and < are text."""
    root = ElementTree.Element("")
    path = [root]

    def say(t: str) -> None:
        top = path[-1]
        if len(top):
            top[-1].tail = (top[-1].tail or "") + t
        else:
            top.text = (top.text or "") + t

    for m in _markup.finditer(text):
        if m["raw"] is not None:
            say(m["raw"])
        elif m["text"] is not None:
            say(decode_entities(m["text"]))
        elif m["tag"]:
            name = m["tag"].rpartition(":")[2]
            if m["close"]:
                at = next((i for i in range(len(path) - 1, 0, -1) if path[i].tag == name), None)
                del path[at if at is not None else len(path) :]
                continue
            attrs = {k.rpartition(":")[2]: decode_entities(next((v for v in vs if v), "")) for k, *vs in _attribute.findall(m["attrs"])}
            new = ElementTree.SubElement(path[-1], name, attrs)
            if not m["empty"]:
                path.append(new)
    return root[0] if len(root) else root


def _tree(data: bytes) -> ElementTree.Element:
    """The tree of a part, its tags without namespaces; those of attributes stay. It may be shared, so nothing changes it."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return forgiving_xml(data.decode("utf-8-sig", "replace"))
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


_shared_tree = functools.lru_cache(128)(_tree)


def _shared(of: Callable[[ElementTree.Element | None], T]) -> Callable[[Package, str], T]:
    """What `of` makes of a part's tree, or of None where there is no such part; kept for parts that come again."""
    kept = functools.lru_cache(64)(lambda data: of(_tree(data)))

    def read(z: Package, name: str) -> T:
        if name not in z:
            return of(None)
        data = z.read(name)
        return kept(data) if len(data) <= SHARED else of(_tree(data))

    return read


def _xml(z: Package, name: str) -> ElementTree.Element | None:
    if name not in z:
        return None
    data = z.read(name)
    return _shared_tree(data) if len(data) <= SHARED else _tree(data)


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    if e is not None:
        for k, v in e.items():
            if k == name or k.endswith(name) and k[-len(name) - 1] == "}":
                return v
    return None


def _first(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        if e is None:
            return None
        e = e.find(name)
    return e


def _all(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return list(e.iter(name))


def _relations(z: Package, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = _xml(z, f"{folder}/_rels/{name}.rels")
    return {r.attrib["Id"]: posixpath.normpath(posixpath.join(folder, r.attrib["Target"])) if not r.attrib["Target"].startswith("/") else r.attrib["Target"][1:] for r in (rels if rels is not None else [])}


def _grid(rows: list[list[str]]) -> str:
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * width, *["| " + " | ".join(r) + " |" for r in rows[1:]]])


def _runs(p: ElementTree.Element) -> str:
    out = []

    def walk(e: ElementTree.Element) -> None:
        name = e.tag
        if name in ("del", "moveFrom"):
            return
        if name == "t":
            out.append(e.text or "")
        elif name in ("tab", "br", "cr"):
            out.append("\t" if name == "tab" else "\n")
        for c in e:
            walk(c)

    walk(p)
    return "".join(out)


@dataclass
class _Block:
    text: str
    listed: bool = False
    size: float = 0.0  # of its largest letters, in half points


@dataclass
class _Styles:
    """Paragraph styles: levels of headings and font sizes, each looked up along the styles that one is based on."""

    levels: dict[str | None, int] = field(default_factory=dict)
    sizes: dict[str | None, float] = field(default_factory=dict)
    based: dict[str | None, str | None] = field(default_factory=dict)
    usual: float = 22.0

    @classmethod
    def of(cls, root: ElementTree.Element | None) -> _Styles:
        out = cls()
        if root is None:
            return out
        default = _attr(next((x for d in _all(root, "rPrDefault") for x in _all(d, "sz")), None), "val")
        out.usual = float(default or 22)
        for style in _all(root, "style"):
            key, name = _attr(style, "styleId"), (_attr(_first(style, "name"), "val") or "").lower()
            level, named = _attr(_first(style, "pPr", "outlineLvl"), "val"), re.fullmatch(r"heading (\d)", name)
            out.levels[key] = int(level) + 1 if level and int(level) < 6 else int(named[1]) if named else 1 if name == "title" else 0
            out.sizes[key] = float(_attr(_first(style, "rPr", "sz"), "val") or 0)
            out.based[key] = _attr(_first(style, "basedOn"), "val")
        return out

    def _along(self, values: dict, key: str | None, otherwise: float) -> float:
        for _ in range(6):
            if values.get(key):
                return values[key]
            key = self.based.get(key)
        return otherwise

    def level(self, key: str | None) -> int:
        return int(self._along(self.levels, key, 0))

    def size(self, key: str | None) -> float:
        return self._along(self.sizes, key or "Normal", self.usual)


def _list_kinds(root: ElementTree.Element | None) -> dict[tuple[str | None, str | None], str]:
    """(list, level) to the format of its marks."""
    if root is None:
        return {}
    abstract = {_attr(a, "abstractNumId"): {_attr(v, "ilvl"): _attr(_first(v, "numFmt"), "val") or "bullet" for v in _all(a, "lvl")} for a in _all(root, "abstractNum")}
    return {(_attr(n, "numId"), level): kind for n in root if n.tag == "num" for level, kind in abstract.get(_attr(_first(n, "abstractNumId"), "val"), {}).items()}


_typed_number = re.compile(r"\s*(\d{1,3}|[a-zA-Z])[.)]?\t+")
_typed_bullet = re.compile(r"[•●▪◦‣■□➢►✓–*-]\s+")


def _by_size(blocks: list[_Block]) -> None:
    """Short paragraphs in letters larger than most of the text become headings, the largest first."""
    weight: dict[float, int] = {}
    for b in blocks:
        if b.size:
            weight[b.size] = weight.get(b.size, 0) + len(b.text)
    body = max(weight, key=lambda k: weight[k], default=0)
    heads = [b for b in blocks if body and b.size >= 1.15 * body and len(b.text) <= 150 and "\n" not in b.text]
    ranks = sorted({b.size for b in heads}, reverse=True)
    for b in heads:
        b.text = "#" * min(3, ranks.index(b.size) + 1) + " " + b.text


_styles, _kinds = _shared(_Styles.of), _shared(_list_kinds)


def docx_to_markdown(data: bytes | Package) -> str:
    z = package(data)
    body = _first(_xml(z, "word/document.xml"), "body")
    styles, kinds = _styles(z, "word/styles.xml"), _kinds(z, "word/numbering.xml")
    blocks: list[_Block] = []
    counters: dict[str | None, list[int]] = {}

    def paragraph(p: ElementTree.Element) -> _Block | None:
        raw = _runs(p)
        text = raw.strip()
        if not text:
            return None
        style, outline, num = _attr(_first(p, "pPr", "pStyle"), "val"), _attr(_first(p, "pPr", "outlineLvl"), "val"), _first(p, "pPr", "numPr")
        level = int(outline) + 1 if outline and int(outline) < 6 else styles.level(style)
        key = _attr(_first(num, "numId"), "val")
        if level:
            return _Block("#" * min(level, 6) + " " + re.sub(r"\n+", " ", text))
        if key and key != "0":
            depth = int(_attr(_first(num, "ilvl"), "val") or 0)
            n = counters.setdefault(key, [0] * 9)
            n[depth] += 1
            n[depth + 1 :] = [0] * (8 - depth)
            mark = f"{n[depth]}." if kinds.get((key, str(depth)), "bullet") not in ("bullet", "none") else "-"
            return _Block(f"{'  ' * depth}{mark} {text}", True)
        number = _typed_number.match(raw)
        if number:
            return _Block(f"{number[1]}. {raw[number.end() :].strip()}", True)
        if _typed_bullet.match(text):
            return _Block(_typed_bullet.sub("- ", text, count=1), True)
        sizes = [float(_attr(_first(r, "rPr", "sz"), "val") or styles.size(style)) for r in _all(p, "r") if "".join(t.text or "" for t in _all(r, "t")).strip()]
        return _Block(text, False, max(sizes, default=styles.size(style)))

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            name = c.tag
            if name == "p":
                new = paragraph(c)
                blocks.extend([new] if new else [])
            elif name == "tbl":
                grid = _grid([[" ".join(x for x in (re.sub(r"\s+", " ", _runs(p)).strip() for p in _all(cell, "p")) if x) for cell in row if cell.tag == "tc"] for row in c if row.tag == "tr"])
                blocks.extend([_Block(grid)] if grid else [])
            elif name in ("sdt", "sdtContent", "customXml", "ins"):
                walk(c)

    if body is not None:
        walk(body)
    _by_size(blocks)
    parts = [("\n" if b.listed and before is not None and before.listed else "\n\n") + b.text for before, b in zip([None, *blocks], blocks)]
    return "".join(parts)[2:]


def _shape_lines(shape: ElementTree.Element) -> list[str]:
    """Paragraphs of a shape. Those of a placeholder have bullets unless they say otherwise; numbers go on as long as they follow each other."""
    holder = next(iter(_all(shape, "ph")), None)
    bulleted = holder is not None and (_attr(holder, "type") or "body") not in ("title", "ctrTitle", "subTitle")
    counts: dict[int, int] = {}
    out = []
    for p in (c for t in _all(shape, "txBody") for c in t if c.tag == "p"):
        look = _first(p, "pPr")
        depth = int(_attr(look, "lvl") or 0)
        text = re.sub(r"\s+", " ", "".join(" " if r.tag == "br" else "".join(t.text or "" for t in _all(r, "t")) for r in p if r.tag in ("r", "fld", "br"))).strip()
        if _first(look, "buAutoNum") is not None:
            counts[depth] = counts.get(depth, 0) + 1
            mark = f"{counts[depth]}. "
        else:
            counts.pop(depth, None)
            mark = "- " if _first(look, "buChar") is not None or bulleted and _first(look, "buNone") is None else ""
        if text:
            out.append(("  " * depth if mark else "") + mark + text)
    return out


def _bare_lines(shape: ElementTree.Element) -> list[str]:
    return [re.sub(r"^ *(?:- |\d+\. )", "", x) for x in _shape_lines(shape)]


def pptx_slides(data: bytes | Package, notes: bool = True) -> list[tuple[int, str | None, str]]:
    """(number, title, text) of each slide in order of the presentation; slides without a title and any text are left out."""
    z = package(data)
    main = _xml(z, "ppt/presentation.xml")
    rels = _relations(z, "ppt/presentation.xml")
    order = [rels[i] for s in (_all(main, "sldId") if main is not None else []) if (i := next((v for k, v in s.attrib.items() if k.endswith("}id")), None)) in rels]
    if not order:
        order = sorted((n for n in z.parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out = []
    for n, part in enumerate(order, 1):
        slide = _xml(z, part)
        title, body = None, []
        for shape in (x for x in slide.iter() if x.tag in ("sp", "graphicFrame")) if slide is not None else []:
            kind = _attr(next(iter(_all(shape, "ph")), None), "type")
            if shape.tag == "graphicFrame":
                grid = _grid([["".join(t.text or "" for t in _all(c, "t")) for c in _all(r, "tc")] for r in _all(shape, "tr")])
                body += [grid] if grid else []
            elif kind in ("dt", "ftr", "sldNum"):
                continue
            elif kind in ("title", "ctrTitle") and title is None:
                title = " ".join(_bare_lines(shape)) or None
            else:
                body += _shape_lines(shape)
        said = [x for rel in _relations(z, part).values() if notes and "notesSlide" in rel for s in _all(_xml(z, rel), "sp") if _attr(next(iter(_all(s, "ph")), None), "type") == "body" for x in _bare_lines(s)]
        parts = [f"## Slide {n}" + (f": {title}" if title else ""), "\n".join(body), "Speaker notes: " + " ".join(said) if said else ""]
        if title or body or said:
            out.append((n, title, "\n\n".join(x for x in parts if x)))
    return out


def serial_date(serial: float, since_1904: bool = False) -> str:
    """A spreadsheet's day number as ISO date, time or both."""
    moment = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
    at = moment + timedelta(seconds=int(serial * 86400 + 0.5))
    if serial < 1 and not since_1904:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def xlsx_sheets(data: bytes | Package) -> list[tuple[str, list[list[str | None]]]]:
    """(name, rows) of each sheet; cells as text, null where empty or an error."""
    z = package(data)
    book = _xml(z, "xl/workbook.xml")
    rels = _relations(z, "xl/workbook.xml")
    strings = [("".join(t.text or "" for t in _all(s, "t"))) for s in (x for x in (_xml(z, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z else []) if x.tag == "si")]
    since_1904 = _attr(_first(book, "workbookPr"), "date1904") in ("1", "true")
    dates: set[int] = set()
    styles = _xml(z, "xl/styles.xml")
    if styles is not None:
        own = {int(f.attrib["numFmtId"]): f.attrib.get("formatCode", "") for f in _all(styles, "numFmt")}
        for i, xf in enumerate(list(found) if (found := _first(styles, "cellXfs")) is not None else []):
            code = int(xf.attrib.get("numFmtId", 0))
            plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(code, ""))
            if 14 <= code <= 22 or 45 <= code <= 47 or re.search(r"[dmyhs]", plain, re.I):
                dates.add(i)
    out = []
    for sheet in _all(book, "sheet"):
        root = _xml(z, rels.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), ""))
        rows: list[list[str | None]] = []
        for r in _all(root, "row") if root is not None else []:
            cells: dict[int, str | None] = {}
            for c in (x for x in r if x.tag == "c"):
                ref = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                col = 0
                for ch in ref[0] if ref else "":
                    col = col * 26 + ord(ch) - 64
                col = col - 1 if ref else len(cells)
                kind, v = c.attrib.get("t", "n"), _first(c, "v")
                raw = v.text if v is not None else None
                if kind == "s":
                    raw = strings[int(raw)] if raw is not None else None
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                elif kind == "e":
                    raw = None
                elif kind == "n" and raw is not None:
                    raw = serial_date(float(raw), since_1904) if int(c.attrib.get("s", 0)) in dates else f"{float(raw):.15g}"
                cells[col] = raw
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        out.append((sheet.attrib.get("name", ""), rows))
    return out


def epub_to_markdown(data: bytes | Package) -> tuple[str | None, str]:
    z = package(data)
    root = _attr(next(iter(_all(_xml(z, "META-INF/container.xml"), "rootfile"))), "full-path")
    opf = _xml(z, root)
    items = {i.attrib["id"]: posixpath.normpath(posixpath.join(posixpath.dirname(root), i.attrib["href"])) for i in _all(opf, "item")}
    chapters = [items[r.attrib["idref"]] for r in _all(opf, "itemref") if r.attrib.get("linear") != "no" and r.attrib["idref"] in items]
    title = next((t.text for t in _all(opf, "title") if t.text), None)
    return title, "\n\n".join(html_to_markdown(z.read(c).decode("utf-8", "replace"))[1] for c in chapters if c in z)

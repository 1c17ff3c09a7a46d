"""Layout of scanned pages: which lines are furniture, which words are broken over lines."""

from __future__ import annotations

import json
import re
from bisect import bisect_right

# What scanners take for what, as (read, meant). Their probabilities are estimated from the corpus.
CONFUSIONS = [
    ("@", "a"), ("†", "t"), ("c", "e"), ("!", "i"), ("5", "s"), ("0", "o"), ("1", "l"), ("ri", "n"), ("9", "g"), ("v", "u"), ("cl", "d"),
    ("b", "h"), ("vv", "w"), ("rn", "m"), ("$", "s"), ("8", "b"), ("ii", "ü"), ("m", "rn"), ("1", "i"), ("6", "b"), ("li", "h"), ("|", "l"), ("€", "e"), ("d", "cl"), ("ﬁ", "fi"), ("ﬂ", "fl"),
]
MARKS = "-­¬‐"

_fold_pairs = [("ri", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "ü"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl")]
_fold_chars = str.maketrans("e@†!1|i5$0hv896€", "catllllssobubgbc")
_roman = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_number = re.compile(r"\d{1,4}|[ivxlcdm]{1,9}", re.I)
_shape = re.compile(r"(?P<a>[\[(~–—\-|·*]*\s*(?:(?:page|seite|s|p|pag|pagina|página|pg|blatt|folio)\b\.?\s*)?)(?P<n>\d{1,4}|[ivxlcdm]{1,9})(?P<z>\s*(?:(?:/|of|von|de|sur|aus)\s*\d{1,4})?\s*[\])~–—\-|·*]*)", re.I)


_edge_number = re.compile(r"^\s*(?:\d+|[ivxlcdm]{1,9})\s+(?=\S)|\s+(?:\d+|[ivxlcdm]{1,9})\s*$")
_no_letter = re.compile(r"[^\w]|_")
_fold_pairs_folded = [(read.translate(_fold_chars), meant.translate(_fold_chars)) for read, meant in _fold_pairs]


def fold(text: str) -> str:
    """A key that is equal for a line and its misread copies: case, digits at the ends, marks and confusable characters are gone."""
    text = _edge_number.sub(" ", text.strip().lower()).translate(_fold_chars)
    for read, meant in _fold_pairs_folded:
        text = text.replace(read, meant)
    return _no_letter.sub("", text)


def _value(number: str) -> int | None:
    if number.isdigit():
        return int(number)
    n = number.lower()
    if not _roman.fullmatch(n):
        return None
    v = [_values[c] for c in n]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def is_scanned(content: str | None, metadata: str | None, source: str | None) -> bool:
    """Marked as such, or a page file whose text is broken into lines of a column's width."""
    if not content or not content.strip():
        return False
    try:
        meta = json.loads(metadata) if metadata else {}
    except ValueError:
        meta = {}
    meta = meta if isinstance(meta, dict) else {}
    if meta.get("ocr") is True:
        return True
    ending = source.rsplit(".", 1)[-1].lower() if source and "." in source else None
    if (meta.get("format") or ending or "pdf") not in ("pdf", "tif", "tiff", "png", "jpg", "jpeg", "scan"):
        return False
    lines = [x.strip() for x in content.split("\n") if x.strip()]
    return len(lines) >= 4 and max(map(len, lines)) <= 110 and sum(map(len, lines)) > 35 * len(lines) and sum(x[-1] not in ".!?:;" for x in lines) > 0.4 * len(lines)


def page_numbers(lines: list[str]) -> set[int]:
    """Lines that hold nothing but the page's number. Numbers that stand bare must count on from one page to the next."""
    shaped: dict[tuple[str, str, bool], list[tuple[int, int]]] = {}
    for i, raw in enumerate(lines):
        m = _shape.fullmatch(raw.strip("\f \t\r"))
        if m and (v := _value(m["n"])) is not None:
            key = (re.sub(r"\s", "", m["a"].lower()), re.sub(r"\d+", "#", re.sub(r"\s", "", m["z"].lower())), m["n"].isdigit())
            shaped.setdefault(key, []).append((i, v))
    found: set[int] = set()
    for (before, after, digits), rows in shaped.items():
        best = [1] * len(rows)
        back = [-1] * len(rows)
        # by value, the lines where longer and longer chains end: a row looks up three values, not all rows before it
        ends: dict[int, tuple[list[int], list[int]]] = {}
        for j, (lj, vj) in enumerate(rows):
            for d in (3, 2, 1):
                at, who = ends.get(vj - d, ([], []))
                k = bisect_right(at, lj - 4 * d) - 1
                if k >= 0 and best[who[k]] + 1 > best[j]:
                    best[j], back[j] = best[who[k]] + 1, who[k]
            at, who = ends.setdefault(vj, ([], []))
            if not who or best[j] > best[who[-1]]:
                at.append(lj)
                who.append(j)
        chain = max(range(len(rows)), key=lambda j: best[j])
        marked = bool(before or after)
        sure = {i for i, _ in rows if marked or not digits and len(lines[i].strip("\f \t\r")) > 1}
        edge = bool(sure) or digits and len(rows) == 1 and _at_edge(lines, rows[0][0])
        if best[chain] >= 2 or edge:
            while chain >= 0:
                found.add(rows[chain][0])
                chain = back[chain]
        found |= sure
    return found


def _at_edge(lines: list[str], i: int) -> bool:
    rest = [x for x in lines[i + 1 :] if x.strip()]
    return not rest or rest[0].startswith("\f") or lines[i].startswith("\f") or not any(x.strip() for x in lines[:i])


def running_lines(lines: list[str], title: str | None, numbers: set[int]) -> set[int]:
    """Headers and footers: lines that repeat, or that are the title, but for page numbers and misreadings."""
    keys: dict[str, list[int]] = {}
    width = max((len(x.strip()) for x in lines), default=0)
    name = fold(title) if title else ""
    found: set[int] = set()
    for i, raw in enumerate(lines):
        text = raw.strip("\f \t\r")
        if i in numbers or len(text) < 4:
            continue
        key = fold(text)
        if len(key) < 4:
            continue
        bare = re.sub(r"^\s*(?:\d+|[ivxlcdm]{1,9})\s+(?=\S)|\s+(?:\d+|[ivxlcdm]{1,9})\s*$", "", text, flags=re.I)
        if name and (key == name or len(key) >= 10 and name.startswith(key) and (bare[-1:] in ",;:-" or len(key) >= 0.9 * len(name))):
            found.add(i)
        keys.setdefault(key, []).append(i)
    for key, at in keys.items():
        texts = [re.sub(r"^\s*(?:\d+|[ivxlcdm]{1,9})\s+(?=\S)|\s+(?:\d+|[ivxlcdm]{1,9})\s*$", "", lines[i].strip("\f \t\r"), flags=re.I) for i in at]
        looks = sum(t[:1].isupper() or not t[:1].isalpha() for t in texts) * 2 > len(texts) and not any(lines[i].strip("\f \t\r")[-1] in ".!?" for i in at) and not any(t.startswith(("#", "*", "-", "•")) for t in texts)
        if not looks:
            continue
        apart = len(at) < 2 or min(b - a for a, b in zip(at, at[1:])) >= 5
        numbered = sum(lines[i].strip("\f \t\r") != t for i, t in zip(at, texts)) >= 2
        if len(at) >= 2 and apart and (numbered or any(len(lines[i].strip()) < 0.85 * width for i in at) or len(at) >= 3 or any(lines[i].startswith("\f") for i in at)):
            found |= set(at)
        elif len(at) == 1 and (lines[at[0]].startswith("\f") or at[0] == 0) and len(texts[0]) < 0.6 * width and re.search(r" [—–·|] ", texts[0]):
            found |= set(at)
    return found


_last = re.compile(rf"([^\W\d_]+)[{MARKS}]\s*$")
_first = re.compile(r"\s*([^\W\d_]+)")


def layout(content: str, title: str | None) -> tuple[list[str], set[int], set[int], list[tuple[int, int, str, str, str]]]:
    """Lines; indexes of running lines and of page numbers; broken words as (line, next line, start, mark, rest)."""
    lines = [x.rstrip("\r") for x in content.split("\n")]
    numbers = page_numbers(lines)
    running = running_lines(lines, title, numbers)
    text = [i for i, x in enumerate(lines) if i not in numbers and i not in running and x.strip()]
    broken = []
    for i, j in zip(text, text[1:]):
        a, b = _last.search(lines[i]), _first.match(lines[j].lstrip("\f"))
        if a and b:
            broken.append((i, j, a[1], lines[i].rstrip()[-1], b[1]))
    return lines, running, numbers, broken

"""Repair of text from scanned pages: a noisy channel over words, decoded by Viterbi per line.

Page furniture is found by layout (see pages.py). The language model is a bigram model over the records that are not
scanned, smoothed by the words' own probabilities: P(b | a) = (n(a, b) + PRIOR P(b)) / (n(a) + PRIOR). The channel are the
confusions of pages.CONFUSIONS, their probabilities estimated from the words of scanned pages that one confusion leads to a
known word. A word of a scanned line is a candidate for itself and for the known words that up to two confusions lead to,
or as many as it has digits and signs (up to MOST_SIGNS); what looks like a code is one only if no such word is known, and
codes that the other records hold count as words of their own. Every word is doubted, known ones too, when a candidate is
so likely by itself that its neighbours could decide for it (within OPEN, a log ratio, which is no matter of the corpus' size);
every line with such a word is decoded with Viterbi. A word broken over two lines is joined, or kept with its hyphen, by the
likelier of the two words.

Defined results: null and blank contents have no lines of any kind; repeated rows of an id count once (the one received
last); rows with a null id are ignored; metadata that is no JSON object says nothing; without scanned records, or without
others to learn from, only furniture and line breaks are judged; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.pages import CONFUSIONS, is_scanned, layout
from docsql.runtime import cut, one_per_key

OPEN = 4.0
PRIOR = 1000.0
UNSEEN = 0.002  # an unknown word counts as seen so often
ERRORS = 0.02  # share of misread places, divided among the confusions
MOST_EDITS = 2
MOST_SIGNS = 8  # a word of more digits and signs has no readings
FLUSH = 300_000

_OUTER = ".,;:?()[]{}\"'“”„«»‘’*•…"
_word = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_visible = re.compile(r"\S+").finditer
_code = re.compile(r"[a-z]?\d+[a-z]?-?\d*[a-z]?|[a-z]\d.*|.*\d.*\d.*\d.*|.*@.*[.@].*|https?:.*")
_digits = re.compile(r"(?<!\S)[^\s\d]*\d\S*")  # looked for at the beginnings of words only
_single = {read for read, _ in CONFUSIONS if len(read) == 1}
LINES = "id string, line_no int, kind string, text string, words array<string>, places array<int>, start string, mark string, rest string, next_line int"
_LINES = pa.schema([("id", pa.string()), ("line_no", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("words", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("start", pa.string()), ("mark", pa.string()), ("rest", pa.string()), ("next_line", pa.int32())])


def signs(word: str) -> list[int]:
    """Places of the characters that no known word has."""
    return [i for i, c in enumerate(word) if not (c.isalpha() or c in "-'’")]


def readable(word: str) -> bool:
    """False if no confusions lead from `word` to a word of letters."""
    at = signs(word)
    return len(at) <= MOST_SIGNS and all(word[i] in _single for i in at)


def tokens(line: str) -> list[tuple[int, str]]:
    """(place, word) of the words a scanner may have misread: lower case, without outer punctuation; codes and addresses that can be no word are none."""
    out = []
    for m in _visible(line):
        raw = m[0]
        word = raw.strip(_OUTER)
        if len(word) < 2:
            continue
        low = word.lower()
        if word.isalpha() or any(map(str.isalpha, word)) and not (_code.fullmatch(low) and not readable(low)):
            out.append((m.start() + raw.find(word), low))
    return out


def page_lines(docs: DataFrame) -> DataFrame:
    """The non-blank lines of scanned records (id, title, source, metadata, content), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, title, source, metadata, content in zip(*(b.column(c).to_pylist() for c in ("id", "title", "source", "metadata", "content"))):
                if not is_scanned(content, metadata, source):
                    continue
                lines, running, numbers, broken = layout(content, title)
                breaks = {i: (j, start, mark, rest) for i, j, start, mark, rest in broken}
                into = {j for _, j, *_ in broken}
                for i, line in enumerate(lines):
                    if not line.strip():
                        continue
                    row = {"id": id_, "line_no": i + 1, "kind": "running" if i in running else "page_number" if i in numbers else "text", "text": line}
                    if row["kind"] == "text":
                        found = tokens(line)
                        # the halves of a broken word are judged together, not as words
                        if i in breaks:
                            j, start, mark, rest = breaks[i]
                            begin = line.rstrip().rfind(" ") + 1
                            first = lines[j].lstrip("\f").lstrip().split()
                            start, rest = line.rstrip()[begin:-1].lstrip(_OUTER), first[0].rstrip(_OUTER) if first else rest
                            found = [t for t in found if t[0] < begin]
                            row |= {"start": start, "mark": mark, "rest": rest, "next_line": j + 1}
                        if i in into and found:
                            lead = len(line) - len(line.lstrip("\f").lstrip())
                            found = [t for t in found if t[0] > lead + 1]
                        row |= {"words": [w for _, w in found], "places": [p for p, _ in found]}
                    rows.append(row)
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, _LINES)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _LINES)

    return docs.select("id", "title", "source", "metadata", "content").mapInArrow(run, LINES)


def language_counts(docs: DataFrame) -> DataFrame:
    """(word, follower, n) of the records that are not scanned: a null follower counts the word itself, or a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Counter[str] = Counter()
        two: Counter[tuple[str, str]] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(w, None, n) for w, n in one.items()] + [(a, b, n) for (a, b), n in two.items()]
            one.clear()
            two.clear()
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 50_000]), (pa.string(), pa.string(), pa.int64()))], ["word", "follower", "n"])

        for b in batches:
            for source, metadata, content in zip(*(b.column(c).to_pylist() for c in ("source", "metadata", "content"))):
                if content and not is_scanned(content, metadata, source):
                    words = _word.findall(content.lower())
                    one.update(words)
                    codes = (c.strip(_OUTER) for c in _digits.findall(content.lower()))
                    one.update(c for c in codes if len(c) > 1 and any(x.isalpha() for x in c) and _code.fullmatch(c) and readable(c))
                    two.update(zip(words, words[1:]))
                    if len(two) + len(one) > FLUSH:
                        yield from flush()
        yield from flush()

    return docs.select("source", "metadata", "content").mapInArrow(run, "word string, follower string, n bigint").groupBy("word", "follower").agg(F.sum("n").alias("n"))


def readings(word: str, edits: int = MOST_EDITS) -> dict[str, tuple[list[int], int]]:
    """Words that `word` may have been. Word to (confusions, place of the first in `word`).

    All its digits and signs are undone, and as many confusions of letters as `edits` leaves.
    """
    must = signs(word)
    if not readable(word):
        return {}
    spots = [(i, k) for k, (read, _) in enumerate(CONFUSIONS) for i in range(len(word)) if word.startswith(read, i)]
    fixed = [[x for x in spots if x[0] == i] for i in must]
    free = sorted(x for x in spots if x[0] not in must)
    out: dict[str, tuple[list[int], int]] = {}
    for n in range(max(0, edits - len(must)) + 1):
        for some, forced in product(combinations(free, n), product(*fixed)):
            chosen = sorted((*some, *forced))
            if any(i + len(CONFUSIONS[k][0]) > j for (i, k), (j, _) in zip(chosen, chosen[1:])):
                continue
            made, at = [], 0
            for i, k in chosen:
                made += [word[at:i], CONFUSIONS[k][1]]
                at = i + len(CONFUSIONS[k][0])
            new = "".join(made) + word[at:]
            if chosen and new != word and new not in out:
                out[new] = ([k for _, k in chosen], chosen[0][0])
    return out


OPTION = "struct<score:double,candidate:string,place:int,p:double,n:double>"


def word_candidates(words: DataFrame, counts: DataFrame) -> tuple[DataFrame, float]:
    """word, n, options (score, candidate, place, p, n): for each distinct word; and the number of words counted.

    p is the log probability of the candidate, n its count, score the log of channel times probability; the word itself is
    always an option, at place -1.
    """
    one = counts.where("follower is null").select("word", "n")
    total = float(one.agg(F.sum("n")).collect()[0][0] or 0) or 1.0
    types = cut(words.join(one, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "p6-types")

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, new, ks, at) for w, edits in zip(b.column("word").to_pylist(), b.column("edits").to_pylist()) for new, (ks, at) in readings(w, edits).items()]
            for k in range(0, max(1, len(rows)), 20_000):
                part = rows[k : k + 20_000]
                cols = list(zip(*part)) if part else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32()))], ["word", "candidate", "confusions", "place"])

    def found(asked: DataFrame) -> DataFrame:
        made = asked.select("word", "edits").mapInArrow(generate, "word string, candidate string, confusions array<int>, place int")
        return cut(made.join(one.select(F.col("word").alias("candidate"), F.col("n").alias("m")), "candidate").join(types, "word"), "p6-readings")

    unknown = found(types.where("n = 0").withColumn("edits", F.lit(MOST_EDITS)))
    # the channel: how often each confusion alone explains an unknown word; at most as many rows as there are confusions
    seen = dict(unknown.where("size(confusions) = 1").groupBy(F.col("confusions")[0]).count().collect())
    every = sum(seen.values()) + len(CONFUSIONS)
    costs = [math.log(ERRORS * (seen.get(k, 0) + 1) / every) for k in range(len(CONFUSIONS))]
    log_p = F.array(*map(F.lit, costs))
    # a known word is doubted for as many confusions as even the most frequent word could outweigh
    most = float(one.agg(F.max("n")).collect()[0][0] or 1)
    edits = F.floor((math.log(most) - math.log(1 - ERRORS) + OPEN - F.log("n")) / -max(costs)).cast("int")
    known = unknown.unionByName(found(types.where("n > 0").withColumn("edits", F.least(edits, F.lit(MOST_EDITS))).where("edits > 0")))
    channel = F.aggregate("confusions", F.lit(0.0), lambda s, k: s + F.get(log_p, k))
    p = lambda n: F.log(F.greatest(F.col(n).cast("double"), F.lit(UNSEEN)) / total)
    kept = F.log(F.lit(1 - ERRORS)) + p("n")
    scored = known.withColumn("score", channel + p("m")).where(F.col("score") > kept - OPEN).select("word", F.struct("score", "candidate", "place", p("m").alias("p"), F.col("m").cast("double").alias("n")).alias("o"))
    best = scored.groupBy("word").agg(F.sort_array(F.collect_list("o"), asc=False).alias("others"))
    own = F.struct(kept.alias("score"), F.col("word").alias("candidate"), F.lit(-1).alias("place"), p("n").alias("p"), F.col("n").cast("double").alias("n")).cast(OPTION)
    return types.join(best, "word", "left").select("word", "n", F.concat(F.array(own), F.coalesce(F.col("others").cast(f"array<{OPTION}>"), F.array().cast(f"array<{OPTION}>"))).alias("options")), total


def decode(words: list[str], options: dict[int, list[tuple[float, str, int, float, float]]], pairs: dict[tuple[str, str], tuple[int, int]], total: float) -> list[tuple[str, int]]:
    """Likeliest (word, place of the first misreading or -1) at each position.

    pairs: counts of neighbours, and of the second of them; options as in word_candidates. A word that is not doubted is
    certain: what leads to it weighs by how likely it follows, and its own probability only where some pair is known, as
    otherwise it is the same for all.
    """
    states: list[tuple[float, tuple[str, int], int, float]] = []
    history: list[list[tuple[float, tuple[str, int], int, float]]] = []
    for i, w in enumerate(words):
        new = []
        follows = [m for x in states for _, m in [pairs.get((x[1][0], w), (0, 0))] if m]
        for score, candidate, place, p, n in options.get(i, [(0.0, w, -1, math.log(max(max(follows, default=0), UNSEEN) / total), 0.0)]):
            own = score - p if i in options else 0.0  # the channel
            into = [(s + own + math.log((pairs.get((c[0], candidate), (0, 0))[0] + PRIOR * math.exp(p)) / (before + PRIOR)), j) for j, (s, c, _, before) in enumerate(states)] or [(own + p, -1)]
            s, j = max(into)
            new.append((s, (candidate, place), j, n))
        history.append(new)
        states = new
    out = []
    j = max(range(len(states)), key=lambda k: states[k][0]) if states else -1
    for column in reversed(history):
        out.append(column[j][1])
        j = column[j][2]
    return out[::-1]


def _context(words: list[str], hits: set[int]) -> list[int]:
    """Positions of the words that stand beside each other once the codes between them are left out."""
    return [i for i, w in enumerate(words) if i in hits or not _code.fullmatch(w)]


def _decoded(lines: DataFrame, options: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """id, line_no, changes (place in the line, word read, word meant): the lines with misread words, decoded."""
    text = lines.where("kind = 'text' and size(words) > 0").select("id", "line_no", "words", "places")
    doubtful = options.where("size(options) > 1").select("word", "options")
    hits = text.select("id", "line_no", F.posexplode("words").alias("pos", "word")).join(doubtful, "word").groupBy("id", "line_no").agg(F.collect_list(F.struct("pos", "options")).alias("hits"))
    open_ = cut(text.join(hits, ["id", "line_no"]), "p6-open")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, no, words, hits_ in zip(*(b.column(c).to_pylist() for c in ("id", "line_no", "words", "hits"))):
                may = [[w] for w in words]
                at = {h["pos"] for h in hits_}
                for h in hits_:
                    may[h["pos"]] = [o["candidate"] for o in h["options"]]
                stay = _context(words, at)
                rows += {(id_, no, x, y) for i, j in zip(stay, stay[1:]) if i in at or j in at for x in may[i] for y in may[j]}
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["id", "line_no", "word", "follower"])

    near = open_.mapInArrow(neighbours, "id string, line_no int, word string, follower string")
    one = counts.where("follower is null").select(F.col("word").alias("follower"), F.col("n").alias("m"))
    met = near.join(counts.where("follower is not null"), ["word", "follower"]).join(one, "follower").groupBy("id", "line_no").agg(F.collect_list(F.struct("word", "follower", "n", "m")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"id": [], "line_no": [], "changes": []}
            for id_, no, words, places, hits_, pairs in zip(*(b.column(c).to_pylist() for c in ("id", "line_no", "words", "places", "hits", "pairs"))):
                opts = {h["pos"]: [(o["score"], o["candidate"], o["place"], o["p"], o["n"]) for o in h["options"]] for h in hits_}
                stay = _context(words, set(opts))
                best = decode([words[i] for i in stay], {n: opts[i] for n, i in enumerate(stay) if i in opts}, {(p["word"], p["follower"]): (p["n"], p["m"]) for p in pairs or []}, total)
                changes = [{"place": places[i], "word": words[i], "meant": c} for i, (c, at) in zip(stay, best) if at >= 0]
                if changes:
                    out["id"].append(id_)
                    out["line_no"].append(no)
                    out["changes"].append(changes)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.string()), ("line_no", pa.int32()), ("changes", pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string()), ("meant", pa.string())])))]))

    return open_.join(met, ["id", "line_no"], "left").mapInArrow(run, "id string, line_no int, changes array<struct<place:int,word:string,meant:string>>")


def judged_lines(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines as of page_lines(); changes as of _decoded(); breaks (id, line_no, next_line, hyphen, meant, first_line, second_line)."""
    docs = cut(one_per_key(records.select("id", "title", "source", "metadata", "content", "received_at"), "id", "received_at"), "p6-records")
    lines, counts = cut(page_lines(docs), "p6-lines"), cut(language_counts(docs), "p6-counts")
    broken = lines.where("start is not null").select("id", "line_no", "next_line", "start", "mark", "rest", F.lower(F.concat("start", "rest")).alias("joined"), F.lower(F.concat("start", F.lit("-"), "rest")).alias("kept"))
    words = lines.select(F.explode("words").alias("word")).unionByName(broken.select(F.col("joined").alias("word"))).unionByName(broken.select(F.col("kept").alias("word"))).distinct()
    options, total = word_candidates(words, counts)
    options = cut(options, "p6-options")
    best = options.select("word", F.sort_array("options", asc=False)[0].alias("best"))
    j = best.select(F.col("word").alias("joined"), F.col("best").alias("as_one"))
    k = best.select(F.col("word").alias("kept"), F.col("best").alias("as_two"))
    both = broken.join(j, "joined").join(k, "kept")
    lower = F.substring("rest", 1, 1) == F.lower(F.substring("rest", 1, 1))
    one = lower & (F.col("as_one.score") >= F.col("as_two.score"))
    hyphen = one | ((F.col("mark") != "-") & lower)
    chosen = F.when(one, F.col("as_one")).otherwise(F.col("as_two"))
    edge = F.length("start")
    breaks = both.select("id", "line_no", "next_line", hyphen.alias("hyphen"), one.alias("one"), chosen["candidate"].alias("meant"), (chosen["place"].between(0, edge - 1)).alias("first_line"), (chosen["place"] >= edge).alias("second_line"))
    return lines, _decoded(lines, options, counts, total), cut(breaks, "p6-breaks")


def noisy_lines(records: DataFrame) -> DataFrame:
    """(id, line_no, kind): the lines with noise; kind is running, page_number, hyphen or misread."""
    lines, changes, breaks = judged_lines(records)
    found = lines.where("kind <> 'text'").select("id", "line_no", "kind")
    for rows, kind in ((breaks.where("hyphen").select("id", "line_no"), "hyphen"), (changes.select("id", "line_no"), "misread"), (breaks.where("first_line").select("id", "line_no"), "misread"), (breaks.where("second_line").select("id", F.col("next_line").alias("line_no")), "misread")):
        found = found.unionByName(rows.withColumn("kind", F.lit(kind)))
    return found.distinct()


def repaired(records: DataFrame) -> DataFrame:
    """id, content: the text of each scanned record in continuous paragraphs, without furniture, line breaks and misreadings."""
    lines, changes, breaks = judged_lines(records)
    rows = lines.where("kind = 'text'").select("id", "line_no", "text").join(changes, ["id", "line_no"], "left").join(breaks.select("id", "line_no", "hyphen", "one", "meant"), ["id", "line_no"], "left")
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "changes", "hyphen", "one", "meant"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for id_, rows_ in zip(b.column("id").to_pylist(), b.column("lines").to_pylist()):
                ids.append(id_)
                texts.append(paragraphs(rows_))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "content"])

    return whole.mapInArrow(run, "id string, content string")


def _as(meant: str, read: str) -> str:
    return meant[:1].upper() + meant[1:] if read[:1].isupper() or read[:1] in "$8" and meant[:1] in "sb" and not read[:2].islower() else meant


def paragraphs(rows: list[dict]) -> str:
    """Lines with their changes as paragraphs: a new one begins after a gap at a sentence's end, or at an indented line."""
    out: list[str] = []
    pending, before, full = "", 0, True
    for r in rows:
        raw = r["text"].replace("\f", "")
        line = r["text"]
        for c in sorted(r["changes"] or [], key=lambda c: -c["place"]):
            a = c["place"]
            read = line[a : a + len(c["word"])]
            line = line[:a] + _as(c["meant"], read) + line[a + len(c["word"]) :]
        line = line.replace("\f", "").strip()
        if pending:
            rest = line.split(" ", 1)
            tail = re.search(rf"[{re.escape(_OUTER)}]*$", rest[0])[0]
            line = pending + tail + (" " + rest[1] if len(rest) > 1 else "")
        new = not pending and (not out or raw[:2] == "  " or r["line_no"] > before + 1 and full or line[:2] in ("* ", "- ", "• ") or line[:1] == "#")
        pending = ""
        if r["hyphen"] is not None:
            begin = line.rfind(" ") + 1
            head = re.match(rf"[{re.escape(_OUTER)}]*", line[begin:])[0]
            pending = head + _as(r["meant"], line[begin + len(head) :])
            line = line[:begin].rstrip()
        if new or not out:
            out.append(line)
        elif line:
            out[-1] = (out[-1] + " " + line) if out[-1] else line
        before, full = r["line_no"], line[-1:] in ".!?:" and not pending
    if pending:
        out.append(pending) if not out else out.__setitem__(-1, (out[-1] + " " + pending).strip())
    return "\n\n".join(x for x in out if x)

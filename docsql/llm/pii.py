"""Personal information inside free text: bootstrapped contextual extraction.

Seeds (names behind a courtesy title; numbers and street addresses of a well-known shape) induce lexical patterns, the
words before and behind them. Spark scores the graphs of patterns and instances in rounds: a pattern is as good as the share
of its instances that are known, an instance is accepted when good patterns agree on it. Instances are given names, and for
numbers their shapes. The patterns and given names that are left find identifiers that no seed shape covers, and names that
stand without any title.

The model is a table of all accepted names and patterns. One of up to BROADCAST_ENTRIES entries is sent to the workers; a
larger one stays a table, and each text is joined with the entries whose words it holds. Both ways give the same mentions.

Defined results: null texts, blank texts, and messages that are no JSON object with a text `content` hold no mentions;
repeated rows of an id count once; rows with a null id are ignored; mentions do not overlap (of two, the one that begins
first counts, then the longer); names beside which a pattern stands are at most 60 characters long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.runtime import cut, spread

ROUNDS = 3
GOOD_PATTERN, SURE_PATTERN, LEAST_SUPPORT = 0.6, 0.98, 3  # only a sure pattern finds names by itself
GOOD_INSTANCE = 0.3
GOOD_SHAPE = 0.9  # share of a number shape's places that good patterns must hold
BROADCAST_ENTRIES = 300_000  # about 30 MB
FLUSH = 200_000

# Courtesy titles, street words, and well-known shapes of numbers.
TITLES = ("ms.", "mr.", "mrs.", "dr.", "prof.", "herr", "frau", "mme", "m.", "sr.", "sra.", "mx.", "ms", "mr", "mrs", "dr")
_street = r"(?:[Ss]treet|[Ss]t|[Rr]oad|[Rr]d|[Ll]ane|[Ll]n|[Aa]venue|[Aa]ve|[Bb]oulevard|[Bb]lvd|[Dd]rive|[Dd]r|[Ww]ay|[Cc]lose|[Cc]ourt|[Cc]t|[Tt]errace|[Tt]er|[Rr]ow|[Ss]quare|[Ss]q|[Pp]lace|[Pp]l|[Gg]rove|[Cc]rescent|[Pp]arade|[Qq]uay|[Hh]ill|[Gg]reen|[Mm]ews|[Ww]alk)"
_house = r"\d{1,4}[a-z]?"
ADDRESS = re.compile(
    rf"(?<![\w.,/:-])(?:(?P<fr>{_house}(?: (?:bis|ter|quater))?,? (?:rue|avenue|place|quai|chemin|allée|impasse|boulevard|cours|route|sentier)\b(?: (?:de la |de l['’]|des |du |de |d['’])?[^\W\d_][\w'’-]*){{1,4}})"
    rf"|(?P<en>{_house}(?: [A-Za-z][a-z'’]+){{1,2}} {_street}\b\.?)"
    r"|(?P<de>[A-ZÄÖÜ][a-zäöüß-]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|markt|ring|steig|chaussee) \d{1,4}[a-z]?\b)"
    r"|(?P<es>(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrer|Ronda|Travesía|C/)(?: (?:de las |de los |de la |del |de )?[A-ZÁÉÍÓÚÑ][\w'-]+){1,4},? \d{1,4}))"
)
NUMBER = re.compile(
    r"(?<![\w.,/+:-])(?:(?P<identity>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?!\w)|[A-Z]\d{7}-?[A-Z](?!\w)|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3})"
    r"|(?P<phone>\+\d{1,3}(?: ?\(0\) ?\d{1,4})?(?:[ .-]?\d{2,6}){1,5}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|0\d(?: \d\d){4}|0\d{2,4} \d{3,4} \d{4}|0\d{2,4}/\d{5,9}|0\d{2,4}[ /]\d{3,8}-\d{1,4}|[2-9]\d{2}[2-9]\d{6})"
    r"|(?P<other>[A-Z]{0,3}[ -]?\d[\d ./()-]{4,18}\d(?:-?[A-Z])?))(?![\w/@]|[.,-]\d|-[A-Z])"
)
_given = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?"
_family = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+)*|[A-ZÀ-ÖØ-Þ]{2,}(?:-[A-ZÀ-ÖØ-Þ]{2,})*)"
NAME = re.compile(rf"(?<![\w@.+-])(?:(?P<g>{_given})(?: [A-Z]\.)*[ \n](?P<f>{_family})|(?P<f2>{_family}),[ \n](?P<g2>{_given})(?: [A-Z]\.)?|(?P<i>[A-Z]\.)(?: [A-Z]\.)* (?P<f3>{_family}))(?![\w@]|[.+-]\w)")
_lower = re.compile(r"(?P<g>[^\W\d_]+(?:-[^\W\d_]+)?)(?: [a-z]\.)?[ \n](?P<f>[^\W\d_]+(?:-[^\W\d_]+)*)(?![\w@]|[.+-]\w)")
_at = re.compile(r"@| ?\[at\] ?| ?\(at\) ?", re.I)
_host = re.compile(r" ?[^\W_](?:[\w-]*\w)?(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[^\W_](?:[\w-]*\w)?)+", re.I)
_before = re.compile(r"(\S+)\s+(\S+)\s*[(<\"']?$|(\S+)\s*[(<\"']?$")
_after = re.compile(r"\s*([,;:)]?\s*\S+(?:\s+\S+)?)")


def _left(text: str, at: int) -> str:
    """The two words before a place, in lower case, digits as #; a pattern key."""
    words = text[max(0, at - 40) : at].split()
    if len(text[max(0, at - 40) : at]) == 40 and words:
        words = words[1:] or words
    return re.sub(r"\d+", "#", " ".join(words[-2:]).lower())


def _right(text: str, at: int) -> str:
    """The words behind a place, three at most and whole ones only."""
    window = text[at : at + 40]
    words = window.split(maxsplit=3)
    if len(words) <= 3 and at + 40 < len(text) and not window[-1:].isspace() and not text[at + 40].isspace():
        words = words[:-1]
    return re.sub(r"\d+", "#", " ".join(words[:3]).lower())


def _local(text: str, at: int) -> tuple[int, int] | None:
    """(start, end) of the local part of an address whose sign stands at `at`, however long; a blank may part them."""
    end = at - (text[at - 1 : at] == " ")
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
        start -= 1
    while start < end and not text[start].isalnum():
        start += 1
    return (start, end) if start < end and (text[end - 1].isalnum() or text[end - 1] == "_") else None


def emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _at.finditer(text):
        host = _host.match(text, m.end())
        if not host:
            continue
        local = _local(text, m.start())
        if local and (m[0] != "@" or (local[1] < m.start()) == (host[0][0] == " ")):
            yield local[0], host.end()


@dataclass
class Model:
    given: dict[str, float] = field(default_factory=dict)
    left: dict[str, dict[str, float]] = field(default_factory=dict)  # kind to pattern to score
    right: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, float]]) -> Model:
        """rows: (kind, key, score), where kind is given, right, or left: and the kind of what stands behind."""
        m = cls()
        for kind, key, score in rows:
            if kind == "given":
                m.given[key] = score
            elif kind == "right":
                m.right[key] = score
            else:
                m.left.setdefault(kind.removeprefix("left:"), {})[key] = score
        return m

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for g in self.given:
            a.add_word(g.lower(), ("given", len(g)))
        for p in (p for p, score in self.left.get("person", {}).items() if score >= SURE_PATTERN):
            a.add_word(p + " ", ("left", len(p) + 1))
        for p in self.right:
            a.add_word(" " + p, ("right", len(p) + 1))
        a.make_automaton()
        return a


_has_number = re.compile(r"\d[\d ./()+-]{4,}[\dA-Z]|[A-Z]{2}\d|\d (?:bis|ter)|\d{1,4}[a-z]?,? [A-Za-z]|[a-zß.] \d").search


class Finder:
    def __init__(self, model: Model):
        self.model = model
        self.words = model.automaton() if model.given or model.left.get("person") or model.right else None
        self.given = {g.lower() for g in model.given}

    def numbers(self, text: str) -> Iterator[tuple[int, int, str]]:
        for m in NUMBER.finditer(text):
            kind = m.lastgroup
            if kind == "other":
                if sum(c.isdigit() for c in m[0]) < 6:
                    continue
                left = _left(text, m.start())
                last = left.rsplit(" ", 1)[-1]
                kind = next((k for k in ("phone", "identity") if left in self.model.left.get(k, {}) or last in self.model.left.get(k, {})), None)
                if not kind:
                    continue
            yield m.start() + (len(m[0]) - len(m[0].lstrip())), m.end(), kind

    def addresses(self, text: str) -> Iterator[tuple[int, int, str]]:
        for m in ADDRESS.finditer(text):
            if m.lastgroup == "en" and not re.match(r"\d+[a-z]? [A-Z]", m[0]):
                if not re.match(r"\.?,? (?:in )?[A-Z]|,", text[m.end() : m.end() + 12]) and _left(text, m.start()) not in self.model.left.get("address", {}):
                    continue
            end = m.end()
            tail = re.compile(r"\.?(?: Apt \d+)?(?:, \d{1,3}[ºª°] [A-Z])?(?:,| in)? (?:\d{5} )?[A-ZÀ-Þ][a-zà-ÿ]+(?:,? [A-Z]{1,2}\d? \d[\dA-Z]{2,4})?").match(text, end)
            yield m.start(), tail.end() if tail else end, "address"

    def persons(self, text: str) -> Iterator[tuple[int, int, str]]:
        if self.words is None:
            return
        low = text.lower()
        if len(low) != len(text):  # a few capitals grow when lowered
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        starts: set[int] = set()
        for end, (kind, n) in self.words.iter(low):
            a, z = end - n + 1, end + 1
            if kind == "given":
                if (a and (low[a - 1].isalnum() or low[a - 1] in "_@+")) or (z < len(low) and (low[z].isalnum() or low[z] in "_@+")):
                    continue
                starts.add(a)
            elif kind == "left":
                if not a or not low[a - 1].isalnum():
                    starts.add(-z)
            elif z == len(low) or low[z].isspace():
                starts.add(-max(0, a - 60) or 0)
                for m in NAME.finditer(text, max(0, a - 60), a):
                    if m.end() == a or text[m.end() : a].strip() == "":
                        yield m.start(), m.end(), "person"
        for s in sorted(starts, key=abs):
            if s < 0:  # behind a pattern
                at = -s
                while at < len(text) and text[at] in " (<\"'":
                    at += 1
                found = self._list(text, low, at)
            else:  # at a given name
                found = self._name(text, low, s)
                if found:
                    # a list may go on: names parted by semicolons
                    found = [found, *self._more(text, low, found[1])]
            for f in found or []:
                yield (*f, "person")

    def _title(self, text: str, at: int) -> int:
        m = re.compile(r"(?:[A-Za-z]{1,4}\.?|Herr|Frau) ").match(text, at)
        if not m or m[0].strip().lower() not in TITLES:
            return at
        if m[0].lower() == "m. ":  # a title before a whole name, an initial before a family name
            whole = NAME.match(text, m.end())
            return m.end() if whole and not whole["i"] else at
        return m.end()

    def _list(self, text: str, low: str, at: int) -> list[tuple[int, int]]:
        at = self._title(text, at)
        m = NAME.match(text, at)
        if m:
            first = (m.start(), m.end())
        else:
            w = _lower.match(low, at)
            if not w or w["g"] not in self.given:
                return []
            first = (w.start(), w.end())
        return [first, *self._more(text, low, first[1])]

    def _more(self, text: str, low: str, at: int) -> list[tuple[int, int]]:
        out = []
        while text[at : at + 2] in ("; ", ";\n"):
            m = NAME.match(text, self._title(text, at + 2))
            if not m:
                break
            out.append((m.start(), m.end()))
            at = m.end()
        return out

    def _name(self, text: str, low: str, at: int) -> tuple[int, int] | None:
        """The name around a given name that begins at `at`."""
        m = NAME.match(text, at)
        if m and m["g"]:
            return m.start(), m.end()
        # family name first
        back = re.compile(rf"(?<![\w@.+-]){_family}, ?\n?$").search(text, max(0, at - 60), at)
        if back:
            m = NAME.match(text, back.start())
            if m and m["g2"] and m.end() >= at + 2:
                return m.start(), m.end()
        if m is None and text[at].islower() or m and not m["g"]:
            w = _lower.match(low, at)
            hyphened = at and text[at - 1] in "-."
            if w and not hyphened and w["g"] in self.given and len(w["f"]) > 3 and not text[w.end() : w.end() + 1] == "@":
                left = _left(text, at)
                if text[w.start("f")].islower() and (left in self.model.left.get("person", {}) or left.split(" ")[-1:] and left.split(" ")[-1] in self.model.left.get("person", {})):
                    return w.start(), w.end()
        return None

    def mentions(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind), in order, not overlapping."""
        if not text:
            return []
        found: list[tuple[int, int, str]] = []
        if "@" in text or "at]" in text or "at)" in text or "AT" in text:
            found += [(a, z, "email") for a, z in emails(text)]
        if _has_number(text):
            found += self.addresses(text)
            found += self.numbers(text)
        fixed = sorted(found)
        found += self.persons(text)
        rank = {"email": 0, "address": 1, "identity": 2, "phone": 3, "person": 4}
        taken: list[tuple[int, int, str]] = []
        # mail and street addresses first: names within them are no cases of their own
        for group in (fixed, [f for f in found if f[2] == "person"]):
            for a, z, k in sorted(set(group), key=lambda f: (f[0], rank[f[2]], -f[1])):
                if not any(a < y and x < z for x, y, _ in taken):
                    taken.append((a, z, k))
        return sorted(taken)


def texts_of(ingest: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, record_id, body): contents, and raw messages, which the finder decodes."""
    a = spread(ingest.select("id", "content")).where("id is not null and content is not null").select(F.lit("ingest_documents.content").alias("field"), F.col("id").alias("record_id"), F.col("content").alias("body"))
    b = spread(messages.select("id", "message")).where("id is not null and message is not null").select(F.lit("messages.message").alias("field"), F.col("id").cast("string").alias("record_id"), F.col("message").alias("body"))
    return a.unionByName(b)


def body_text(field_: str, body: str) -> str | None:
    if field_ != "messages.message":
        return body
    try:
        m = json.loads(body)
    except ValueError:
        return None
    c = m.get("content") if isinstance(m, dict) else None
    return c if isinstance(c, str) else None


def observations(texts: DataFrame) -> DataFrame:
    """(kind, left, right, first, n): what stands where: names with their given name, numbers with their shape (kind `number`: an unknown one), addresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, str, str]] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*k, n) for k, n in seen.items()]
            seen.clear()
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 50_000]), (*[pa.string()] * 4, pa.int64()))], ["kind", "left", "right", "first", "n"])

        for b in batches:
            for f, body in zip(b.column("field").to_pylist(), b.column("body").to_pylist()):
                text = body_text(f, body)
                if not text:
                    continue
                for m in NAME.finditer(text):
                    given = m["g"] or m["g2"]
                    seen["person", _left(text, m.start()), _right(text, m.end()), (given or m["i"]).lower()] += 1
                if _has_number(text):
                    for m in NUMBER.finditer(text):
                        if m.lastgroup != "other" or sum(c.isdigit() for c in m[0]) >= 6:
                            seen["number" if m.lastgroup == "other" else m.lastgroup, _left(text, m.start()), "", re.sub(r"\d", "#", m[0].strip())] += 1
                    for m in ADDRESS.finditer(text):
                        seen["address", _left(text, m.start()), "", ""] += 1
            if len(seen) > FLUSH:
                yield from flush()
        yield from flush()

    return texts.select("field", "body").mapInArrow(run, "kind string, left string, right string, first string, n bigint").groupBy("kind", "left", "right", "first").agg(F.sum("n").alias("n"))


def _people(seen: DataFrame) -> DataFrame:
    """kind, key, score: given names and the patterns around names, by rounds of seeds to patterns to instances."""
    people = seen.where("kind = 'person'")
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("pattern")), F.struct(F.lit("l").alias("side"), F.col("last").alias("pattern")), F.struct(F.lit("r").alias("side"), F.col("right").alias("pattern")))
    edges = cut(people.select(F.explode(F.array_distinct(sides)).alias("s"), "first", "n").select("s.*", "first", "n").where("pattern <> ''").groupBy("side", "pattern", "first").agg(F.sum("n").alias("n")), "p3-edges")
    full = edges.where("length(first) > 2")  # an initial is no instance
    titled = F.element_at(F.split("pattern", " "), -1).isin(*TITLES)
    known = cut(full.where((F.col("side") == "l") & titled).select("first").distinct(), "p3-known")
    every = cut(people.groupBy("first").agg(F.sum("n").alias("total")), "p3-total")
    patterns = None
    for _ in range(ROUNDS):
        marked = full.join(known.withColumn("known", F.lit(1)), "first", "left")
        score = marked.groupBy("side", "pattern").agg((F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("score"), F.sum("n").alias("support"), F.count_distinct(F.when(F.col("known") == 1, F.col("first"))).alias("instances"))
        patterns = cut(score.where((F.col("score") >= GOOD_PATTERN) & (F.col("support") >= LEAST_SUPPORT) & (F.col("instances") >= 2)), "p3-patterns")
        met = full.join(patterns.select("side", "pattern", "score"), ["side", "pattern"]).groupBy("first").agg(F.sum(F.when(F.col("side") == "l", F.col("n")).otherwise(0)).alias("inside"), F.count_distinct("side", "pattern").alias("agree"))
        known = cut(met.join(every, "first").where((F.col("agree") >= 2) & (F.col("inside") >= GOOD_INSTANCE * F.col("total"))).select("first").unionByName(known).distinct(), "p3-known")
    names = full.join(known, "first").groupBy(F.col("first").alias("key")).agg(F.sum("n").cast("double").alias("score")).withColumn("kind", F.lit("given"))
    plain = patterns.where(~F.col("pattern").contains("#"))
    left = plain.where("side = 'l'").select(F.lit("left:person").alias("kind"), F.col("pattern").alias("key"), "score")
    right = plain.where((F.col("side") == "r") & F.col("pattern").contains(" ") & ~F.col("pattern").contains(". ") & (F.col("score") >= SURE_PATTERN)).select(F.lit("right").alias("kind"), F.col("pattern").alias("key"), "score")
    return names.select("kind", "key", "score").unionByName(left).unionByName(right)


def _numbers(seen: DataFrame) -> DataFrame:
    """kind, key, score: the patterns before numbers and addresses, by the same rounds; instances are the shapes of numbers."""
    kinds = ("phone", "identity", "address")
    edges = seen.where("kind <> 'person'").select("kind", "first", "n", F.explode(F.array_distinct(F.array("left", "last"))).alias("pattern")).groupBy("kind", "first", "pattern").agg(F.sum("n").alias("n"))
    edges = cut(edges, "p3-numbers")
    every = edges.where("kind = 'number'").groupBy("first").agg(F.sum("n").alias("total"))
    known = edges.where("false").select("first", F.col("kind").alias("told"))
    good = None
    for _ in range(ROUNDS):
        marked = edges.join(known, "first", "left").withColumn("told", F.when(F.col("kind") != "number", F.col("kind")).otherwise(F.col("told")))
        by = marked.groupBy("pattern").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("told") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
        best = by.select("pattern", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in kinds])).alias("b")).where((F.col("b.n") >= LEAST_SUPPORT) & (F.col("b.n") >= 9 * (F.col("total") - F.col("b.n"))))
        good = cut(best.where(~F.col("pattern").contains("#") & F.col("pattern").rlike(r"\S \S|\w[:.]$")).select("pattern", F.col("b.k").alias("k"), (F.col("b.n") / F.col("total")).alias("score")), "p3-good")
        met = edges.where("kind = 'number'").join(good, "pattern").groupBy("first", "k").agg(F.sum("n").alias("inside"), F.count("*").alias("agree"))
        known = cut(met.join(every, "first").where((F.col("agree") >= 2) & (F.col("inside") >= LEAST_SUPPORT) & (F.col("inside") >= GOOD_SHAPE * F.col("total"))).select("first", F.col("k").alias("told")), "p3-shapes")
    return good.select(F.concat(F.lit("left:"), "k").alias("kind"), F.col("pattern").alias("key"), "score")


def train(texts: DataFrame) -> DataFrame:
    """kind, key, score of all accepted names and patterns: seeds to patterns to instances, ROUNDS times, as joins and aggregates over the observations."""
    seen = cut(observations(texts), "p3-observations").withColumn("last", F.element_at(F.split("left", " "), -1))  # patterns of one and of two words
    return cut(_people(seen).unionByName(_numbers(seen)), "p3-model")


_finders: dict[str, Finder] = {}


def _finder(shared: Broadcast) -> Finder:
    """The finder of a model, by the model's own name: workers outlive a broadcast, so the address of its value names nothing."""
    name, rows = shared.value
    if name not in _finders:
        _finders.clear()
        _finders[name] = Finder(Model.of(rows))
    return _finders[name]


_chains = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def lookup_keys(text: str) -> set[str]:
    """Every key of a model that a finder may look up in a text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = low.split()
    keys = {" ".join(words[i:j]) for i in range(len(words)) for j in (i + 2, i + 3)}
    for i, w in enumerate(words):
        for a in range(len(w)):
            if not a or not w[a - 1].isalnum():
                keys |= {w[a:], w[a:] + " " + words[i + 1]} if i + 1 < len(words) else {w[a:]}
    starts = {m.start() for pattern in (NUMBER, ADDRESS) for m in pattern.finditer(text)}
    for m in _chains.finditer(low):
        parts = m[0].split("-")
        keys |= {"-".join(parts[i:j]) for i in range(len(parts)) for j in (i + 1, i + 2)}
        starts.add(m.start())
        starts |= {m.start() + k + 1 for k, c in enumerate(m[0]) if c == "-"}
    for at in starts:
        left = _left(text, at)
        keys |= {left, left.rsplit(" ", 1)[-1]}
    return keys


def _found(texts: DataFrame, give: Callable[[Finder, str, str, str], list[tuple]], columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Rows that `give` makes of the mentions of each text (field, record_id, body), with the model of all texts."""
    model = train(texts)
    names = [c for c, _ in columns]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows) if rows else [[]] * len(columns), columns)], names)

    if model.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        shared = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in model.collect()]))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared)
            for b in batches:
                yield batch([row for f, i, body in zip(*(b.column(c).to_pylist() for c in ("field", "record_id", "body"))) for row in give(finder, f, i, body)])

        return texts.mapInArrow(whole, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, mark, body in zip(*(b.column(c).to_pylist() for c in ("field", "mark", "body"))):
                keys = sorted(lookup_keys(body_text(f, body) or ""))
                yield pa.RecordBatch.from_arrays([pa.array([mark] * len(keys), pa.string()), pa.array(keys, pa.string())], ["mark", "key"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, i, body, entries in zip(*(b.column(c).to_pylist() for c in ("field", "record_id", "body", "entries"))):
                rows += give(Finder(Model.of((e["kind"], e["key"], e["score"]) for e in entries or [])), f, i, body)
            yield batch(rows)

    # a text is told by its hash; entries come to it over a join, in which the keys of hot words are split by Spark
    marked = texts.withColumn("mark", F.md5(F.concat_ws(" ", "field", "body")))
    asked = marked.select("field", "mark", "body").mapInArrow(ask, "mark string, key string").distinct()
    held = asked.join(model, "key").groupBy("mark").agg(F.collect_list(F.struct("kind", "key", "score")).alias("entries"))
    return marked.join(held, "mark", "left").select("field", "record_id", "body", "entries").mapInArrow(apart, schema)


def mentions(ingest: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, record_id, kind, start_at): every mention of a person or an identifier."""

    def give(finder: Finder, f: str, i: str, body: str) -> list[tuple]:
        return [(f, i, kind, a) for a, _, kind in finder.mentions(body_text(f, body))]

    columns = [("field", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("start_at", pa.int32())]
    return _found(texts_of(ingest, messages), give, columns, "field string, record_id string, kind string, start_at int").distinct()


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    for a, z, kind in reversed(found):
        text = f"{text[:a]}[{kind.upper()}]{text[z:]}"
    return text


def redacted(ingest: DataFrame, messages: DataFrame) -> DataFrame:
    """(field, record_id, text): the texts with a placeholder for every mention; null where a message has no text. Rows of an id with one text count once."""

    def give(finder: Finder, f: str, i: str, body: str) -> list[tuple]:
        text = body_text(f, body)
        return [(f, i, text and redact(text, finder.mentions(text)))]

    columns = [("field", pa.string()), ("record_id", pa.string()), ("text", pa.string())]
    out = _found(texts_of(ingest, messages), give, columns, "field string, record_id string, text string")
    # repeated rows are told by their hashes, so that no text is compared
    return out.groupBy("field", "record_id", F.md5("text").alias("__m")).agg(F.first("text").alias("text")).drop("__m")

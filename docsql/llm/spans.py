"""Long exact spans shared between records.

Suffixes are taken at anchors only: of every SPAN - GRAM + 1 neighbouring grams the one of least hash is an anchor, so
two texts that share SPAN characters share an anchored gram inside them, wherever the span stands. An anchored gram is
the prefix that assigns the suffixes behind it to a group. In a group of up to IN_MEMORY suffixes these are sorted; their
longest common prefixes give the internal nodes of the group's suffix tree, and below each node the texts before the anchors,
read backwards, give a second tree. Where both depths together reach SPAN, the members of a node share a stretch: a deep
node. Prefixes of larger groups grow to SPAN characters, at each of the places the anchor can have within a span; a
suffix is then in as many groups, and such a group is a deep node as it is. Stretches of neighbouring anchors overlap and
are put together, so they come out whole, however long.

A deep node is a set of documents, named by its members, so the nodes of one long stretch fall together before any pair
is made. Sets of two are pairs; larger ones are paired in blocks.

Texts that are equal are one class, searched once; a class of more than COPIES_IN_PAIRS copies stands in pairs by its
first member, with which each of its copies is paired. Defined results: null texts and texts shorter than the span share
nothing; repeated rows of an id with one text count once; rows with a null id are ignored; ids are bigint; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsql.runtime import cut

SPAN, GRAM = 200, 100
IN_MEMORY = 2000  # suffixes of a group that becomes one tree: 2,000 times 300 characters
BLOCK = 1000  # documents of a set paired in one piece of work
COPIES_IN_PAIRS = 1000
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1_000_000


class _Powers:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, inverse))
        return cls.up[:n], cls.down[:n]


def window_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` characters."""
    n = len(chars)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = _Powers.of(n)
    total = np.r_[np.uint64(0), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up)]
    h = (total[size:] - total[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = take(x[:-step], x[step:])
        have += step
    return x


def anchors(texts: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, gram hash) of the anchors of texts of at least `span` characters."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    if len(chars) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(chars, gram)
    width = span - gram + 1
    lowest = _sliding(h, width, np.minimum)
    inside = np.arange(len(lowest)) + span <= end[owner[: len(lowest)]]
    lowest = np.where(inside, lowest, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.r_[pad, lowest, pad], width, np.maximum)
    at = np.flatnonzero((reach == h) & (reach > 0))
    doc = owner[at]
    return doc, at - (end - size)[doc], h[at]


def _anchor_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(), b.column("text").to_pylist()
            a = 0
            while a < len(texts):
                z, n = a, 0
                while z < len(texts) and (z == a or n + len(texts[z]) <= _CHUNK):
                    n += len(texts[z])
                    z += 1
                doc, pos, h = anchors(texts[a:z], span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(ids[a:z][doc]), pa.array(pos.astype(np.int32))], ["gram", "doc_id", "pos"])
                a = z

    return docs.mapInArrow(run, "gram bigint, doc_id bigint, pos int")


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the internal nodes of a tree of sorted strings, whose neighbours share `shared` characters."""
    open_: list[tuple[int, int]] = []  # (depth, first)
    for i, depth in enumerate([*shared, -1]):
        first = i
        while open_ and open_[-1][0] > depth:
            d, first = open_.pop()
            yield first, i, d
        if depth >= 0 and (not open_ or open_[-1][0] < depth):
            open_.append((depth, first))


def deep_nodes(group: list[tuple[int, int, str, str]], span: int) -> Iterator[tuple[list[int], int, int]]:
    """(members, back, ahead) of the deep nodes of a group of suffixes (doc, pos, text before the anchor reversed, suffix).

    All members of a node share `back` characters before their anchors and `ahead` behind, and not all of them share more.
    Members with equal contexts are one leaf; a node is told only when it has more than one document.
    """
    leaves: dict[tuple[str, str], list[int]] = {}
    for i, (_, _, before, suffix) in enumerate(group):
        leaves.setdefault((suffix, before), []).append(i)
    keys = sorted(leaves)
    whole = lambda at: [i for k in at for i in leaves[keys[k]]]
    several = lambda members: len({group[i][0] for i in members}) > 1
    for k, (suffix, before) in enumerate(keys):
        if len(suffix) + len(before) >= span and several(whole([k])):
            yield whole([k]), len(before), len(suffix)
    shared = [_common(a[0], b[0]) for a, b in zip(keys, keys[1:])]
    for first, last, ahead in _intervals(shared):
        behind = sorted(range(first, last + 1), key=lambda k: keys[k][1])
        common = [_common(keys[i][1], keys[j][1]) for i, j in zip(behind, behind[1:])]
        if ahead + max(common) < span:
            continue
        for a, z, back in _intervals(common):
            part = behind[a : z + 1]
            # where all of them share more behind the anchor, a node further down tells them
            if back + ahead >= span and min(shared[min(part) : max(part)]) == ahead:
                members = whole(part)
                if several(members):
                    yield members, back, ahead


def shared_nodes(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """For docs (doc_id, text) with unequal texts: node, doc_id, start, length. The documents of a node have `length`
    characters in common, from their starts on; a node is named by its documents."""
    long = docs.where(F.length("text") >= span)
    marks = cut(_anchor_rows(long, span, gram), "p10-anchors")
    stat = marks.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("gram", (F.col("n") > IN_MEMORY).alias("large"))
    shared = marks.join(stat, "gram").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "gram", "large")).alias("marks"))
    texts = long.join(shared, "doc_id").select("doc_id", "text", "marks")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, marks_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "marks"))):
                out = [(m["gram"], doc, m["pos"], text[max(0, m["pos"] - span + gram) : m["pos"]][::-1], text[m["pos"] : m["pos"] + span], m["large"]) for m in marks_]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()))], ["gram", "doc_id", "pos", "before", "suffix", "large"])

    around = cut(texts.mapInArrow(contexts, "gram bigint, doc_id bigint, pos int, before string, suffix string, large boolean"), "p10-suffixes")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: list[tuple] = []

        def tell() -> None:
            for members, back, ahead in deep_nodes(group, span):
                names = np.unique(np.array([group[i][0] for i in members], np.int64))
                node = xxhash.xxh128_digest(names.tobytes())
                out.extend((node, group[i][0], group[i][1] - back, back + ahead) for i in members)

        def rows() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["node", "doc_id", "start", "length"])
            out.clear()
            return r

        for b in batches:
            for g, *rest in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "pos", "before", "suffix"))):
                if g != key:
                    tell()
                    key, group = g, []
                    if len(out) > 50_000:
                        yield rows()
                group.append(tuple(rest))
            yield rows()
        tell()
        yield rows()

    small = around.where("not large").repartition("gram").sortWithinPartitions("gram")
    nodes = small.mapInArrow(trees, "node binary, doc_id bigint, start bigint, length bigint")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two hashes of every run of `span` characters around the anchors, from the characters themselves."""
        for b in batches:
            for doc, pos, before, suffix in zip(*(b.column(c).to_pylist() for c in ("doc_id", "pos", "before", "suffix"))):
                chars = np.frombuffer((before[::-1] + suffix).encode("utf-32-le", "surrogatepass"), np.uint32)
                h = window_hashes(chars, span)
                if len(h):
                    other = window_hashes(chars.astype(np.uint64) * chars.astype(np.uint64) + np.uint64(12345), span)
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(np.full(len(h), doc)), pa.array(pos - len(before) + np.arange(len(h), dtype=np.int64))], ["h", "g", "doc_id", "start"])

    wide = cut(around.where("large").mapInArrow(windows, "h bigint, g bigint, doc_id bigint, start bigint").distinct(), "p10-windows")
    sets = wide.select("h", "g", "doc_id").distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    sets = sets.where("n > 1").select("h", "g", F.unhex(F.md5(F.concat_ws(" ", "n", "lo", "hi", "x", "y"))).alias("node"))
    return nodes.unionByName(wide.join(sets, ["h", "g"]).select("node", "doc_id", "start", F.lit(span).cast("bigint").alias("length")))


def node_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_a, doc_b), the smaller id first, of the documents of each node (node, doc_id), each pair once."""
    members = cut(nodes.select("node", "doc_id").distinct(), "p10-nodes")
    size = members.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_a"), F.max("doc_id").alias("doc_b"))
    two = size.where("n = 2").select("doc_a", "doc_b")
    # larger sets in blocks: a document goes to every block, and meets the ones that the block holds
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = members.join(size.where("n > 2").select("node", blocks.alias("blocks")), "node")
    all_ = large.select("node", F.col("doc_id").alias("doc_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = large.select("node", F.col("doc_id").alias("doc_b"), F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("bigint")).cast("int").alias("block"))
    return two.unionByName(all_.join(own, ["node", "block"]).where("doc_a < doc_b").select("doc_a", "doc_b")).distinct()


def text_classes(docs: DataFrame) -> DataFrame:
    """doc_id, first (smallest id with the same text), copies: of the rows with a text."""
    one = docs.where("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("__h")).distinct()
    classes = one.groupBy("__h").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return one.join(classes, "__h").select("doc_id", "first", "copies")


def _distinct_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    copies = classes.where("doc_id != first").select("doc_id")
    return docs.where("doc_id is not null").select("doc_id", "text").join(copies, "doc_id", "left_anti")


def expand_copies(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (doc_a, doc_b) of first members as pairs of all members of their classes, smaller id first; see COPIES_IN_PAIRS."""
    many = classes.where(F.col("copies").between(2, COPIES_IN_PAIRS)).select("first", "doc_id")
    wide = pairs
    for side in ("doc_a", "doc_b"):
        m = many.select(F.col("first").alias(side), F.col("doc_id").alias("__m"))
        wide = wide.join(m, side, "left").withColumn(side, F.coalesce("__m", side)).drop("__m")
    return wide.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))


def copy_pairs(classes: DataFrame) -> DataFrame:
    """Pairs within the classes of equal texts: all, or of a class of more than COPIES_IN_PAIRS its first with each other."""
    many = classes.where("copies > 1")
    a, b = many.select(F.col("first"), F.col("doc_id").alias("doc_a"), "copies").where(F.col("copies") <= COPIES_IN_PAIRS), many.where(F.col("copies") <= COPIES_IN_PAIRS).select("first", F.col("doc_id").alias("doc_b"))
    star = many.where((F.col("copies") > COPIES_IN_PAIRS) & (F.col("doc_id") != F.col("first"))).select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    return a.join(b, "first").where("doc_a < doc_b").select("doc_a", "doc_b").unionByName(star)


def sharing_pairs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_a, doc_b), the smaller id first: documents with at least `span` characters in a row in common."""
    docs = docs.where(F.length("text") >= span)
    classes = cut(text_classes(docs), "p10-classes")
    pairs = node_pairs(shared_nodes(_distinct_texts(docs, classes), span))
    return expand_copies(pairs, classes).unionByName(copy_pairs(classes))


def _stretches(docs: DataFrame, classes: DataFrame, span: int) -> DataFrame:
    """doc_id, start, finish: the stretches of first members of `classes` that stand elsewhere, overlapping ones put together."""
    parts = shared_nodes(_distinct_texts(docs, classes), span).groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("length")).alias("finish"))
    w = Window.partitionBy("doc_id").orderBy("start")
    upto = F.max("finish").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("__new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int"))
    runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "__run").agg(F.min("start").alias("start"), F.max("finish").alias("finish")).drop("__run")


def shared_stretches(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, start, length: every stretch of a text that stands word for word in other documents, in one piece.

    A stretch may come from several others, each of which shares at least `span` characters of it; of a text with copies
    the whole is one stretch.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text").where(F.length("text") >= span).distinct()
    classes = cut(text_classes(docs), "p10-classes")
    own = _stretches(docs, classes, span).withColumnRenamed("doc_id", "first")
    single = classes.where("copies = 1").join(own, "first").select("doc_id", "start", (F.col("finish") - F.col("start")).alias("length"))
    whole = docs.join(classes.where("copies > 1").select("doc_id"), "doc_id").select("doc_id", F.lit(0).cast("bigint").alias("start"), F.length("text").cast("bigint").alias("length"))
    return single.unionByName(whole)


def shared_shares(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_chars, shared_chars, share: how much of each document stands in another one, in spans of at least `span` characters."""
    docs = docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    classes = cut(text_classes(docs.where(F.length("text") >= span)), "p10-classes")
    covered = _stretches(docs, classes, span).groupBy("doc_id").agg(F.sum(F.col("finish") - F.col("start")).alias("c"))
    of_first = classes.join(covered.withColumnRenamed("doc_id", "first"), "first", "left")
    n = F.length("text")
    known = docs.select("doc_id", F.coalesce(n, F.lit(0)).alias("n_chars")).join(of_first, "doc_id", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).cast("bigint")
    return known.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))

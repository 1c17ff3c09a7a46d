"""Splitting of oversized texts at natural boundaries by recursive bisection.

Line ends are unified and blanks at both ends removed. A text over its limit is cut at the strongest boundary in the
middle half (headings, then paragraphs, lines, sentences, words; ties by nearness to the middle; where there is none, at
the boundary nearest to the middle, and at the middle itself if the segment has none at all), and each half that is longer than the limit minus the overlap is cut again. Then every piece but the
first gets the `overlap` characters before it, so no piece exceeds the limit and each repeats the end of the one before.

Defined results: null and blank texts give no pieces; a text within its limit gives one; an overlap of more than half the
limit counts as half of it; a limit that is null or below 1 is the default, a null or negative overlap too; repeated rows
of an id count once (the one received last); rows with a null id are ignored; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsql.runtime import one_per_key

SIZE, OVERLAP = 1200, 150  # fixed values: the defaults of the chunk options

_ends = [(5, re.compile(r"\n(?=#{1,6}[ \t])")), (4, re.compile(r"\n[ \t]*\n[ \t\n]*")), (3, re.compile(r"\n")), (2, re.compile(r"[.!?…][\"'’”)\]]*[ \t]+|[。！？][\"'’”)\]」』]*[ \t]*")), (1, re.compile(r"[ \t\n]+"))]


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may stand, ascending, and their strengths."""
    best: dict[int, int] = {}
    for strength, pattern in reversed(_ends):
        for m in pattern.finditer(text):
            best[m.end()] = strength
    at = np.array(sorted(best), np.int64)
    return at, np.array([best[a] for a in at.tolist()], np.int64)


def cuts(text: str, size: int, overlap: int) -> list[int]:
    """Ascending cut places, 0 and the length included, at most size - overlap apart (size, if there is only one piece)."""
    if len(text) <= size:
        return [0, len(text)]
    at, strength = boundaries(text)
    most = max(1, size - overlap)
    done, todo = [0], [(0, len(text))]
    while todo:
        a, z = todo.pop()
        if z - a <= most:
            done.append(z)
            continue
        middle, quarter = (a + z) // 2, (z - a) // 4
        lo, hi = np.searchsorted(at, [max(a + 1, middle - quarter), min(z - 1, middle + quarter) + 1])
        cut = middle
        if hi > lo:
            s = strength[lo:hi]
            near = at[lo:hi][s == s.max()]
            cut = int(near[np.abs(near - middle).argmin()])
        else:
            lo, hi = np.searchsorted(at, [a + 1, z])  # none in the middle half: the nearest of the whole segment
            if hi > lo:
                cut = int(at[lo:hi][np.abs(at[lo:hi] - middle).argmin()])
        todo += [(cut, z), (a, cut)]
    return done


def normalized(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"^[ \t\n]++|(?<![ \t\n])[ \t\n]++$", "")


def split_texts(docs: DataFrame, options: DataFrame) -> DataFrame:
    """id, size, overlap, kind (null: within the limit; plain; run: holds a word over the limit), starts, pieces.

    docs: id, collection, content, received_at. options: collection, size, overlap, one row per collection.
    """
    rows = one_per_key(docs.select("id", "collection", "content", "received_at"), "id", "received_at")
    asked = options.where("collection is not null").groupBy(F.col("collection").alias("__c")).agg(F.max("size").alias("__s"), F.max("overlap").alias("__o"))
    size = F.when(F.col("__s") >= 1, F.col("__s")).otherwise(SIZE)
    overlap = F.when(F.col("__o") >= 0, F.col("__o")).otherwise(OVERLAP)
    joined = rows.join(asked, rows["collection"] == asked["__c"], "left").select("id", normalized("content").alias("text"), size.cast("int").alias("size"), F.least(overlap, F.floor(size / 2)).cast("int").alias("overlap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, starts, pieces = [], [], []
            for text, size, overlap in zip(*(b.column(c).to_pylist() for c in ("text", "size", "overlap"))):
                if not text:
                    kinds.append(None)
                    starts.append([])
                    pieces.append([])
                    continue
                at = cuts(text, size, overlap)
                first = [max(0, a - overlap) if a else 0 for a in at[:-1]]
                starts.append(first)
                pieces.append([text[a:z] for a, z in zip(first, at[1:])])
                kinds.append(None if len(at) == 2 else "run" if max(map(len, re.split(r"[ \t\n]", text))) > size else "plain")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("size"), b.column("overlap"), pa.array(kinds, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(pieces, pa.list_(pa.string()))],
                ["id", "size", "overlap", "kind", "starts", "pieces"],
            )

    return joined.mapInArrow(run, "id string, size int, overlap int, kind string, starts array<int>, pieces array<string>")


def oversized(docs: DataFrame, options: DataFrame) -> DataFrame:
    """(id, kind) of the texts that had to be split."""
    return split_texts(docs, options).where("kind is not null").select("id", "kind")


def pieces(docs: DataFrame, options: DataFrame) -> DataFrame:
    """id, ordinal, start_at, piece: all pieces, in order."""
    s = split_texts(docs, options)
    return s.select("id", F.posexplode(F.arrays_zip("starts", "pieces")).alias("ordinal", "p")).select("id", "ordinal", F.col("p.starts").alias("start_at"), F.col("p.pieces").alias("piece"))

"""Byte-level BPE encoding of a whole corpus with numpy.

Texts are cut into pieces by the vocabulary's public pattern. Distinct pieces of a batch go, bucketed by length, into
padded integer matrices; in every round each row merges its leftmost pair of minimum rank, found by a hashed pair
table, and the matrix is compacted by one column. Pieces longer than LONG bytes merge all occurrences of their minimum
pair in a round: a merged token only takes part in pairs of higher rank, which PairTable checks, so the ids are equal.

Defined results: a null or an empty text gives an empty list; blank texts are encoded as they are; special tokens in a
text are ordinary text. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from docsql.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LONG = 256
CACHE_PIECES = 200_000  # pieces remembered per worker; only speed depends on it

# Fixed value: the white space of Unicode and the public piece pattern of this vocabulary.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

NONE = np.int32(1 << 30)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class PairTable:
    """Open-addressing hash table from a pair of ids to merge rank and merged id."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray, start: np.ndarray):
        self.start = start
        self.bits = max(8, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        self.merged = np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(todo), bool)
            win[first] = True
            put = todo[free & win]
            self.keys[slot[put]], self.ranks[slot[put]], self.merged[slot[put]] = keys[put], ranks[put], merged[put]
            todo = todo[~(free & win)]
            slot[todo] = np.where(self.keys[slot[todo]] >= 0, (slot[todo] + 1) & (size - 1), slot[todo])
        made = {int(m): int(r) for m, r in zip(merged, ranks)}
        self.nested = all(made.get(int(k) >> 20, -1) < r and made.get(int(k) & 0xFFFFF, -1) < r for k, r in zip(keys, ranks))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and slot of each pair; a pair with a negative id or without a merge has rank NONE."""
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        miss = (held != keys) & (held >= 0)
        while miss.any():
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            miss = miss & (held != keys) & (held >= 0)
        rank = np.where((held == keys) & (left >= 0) & (right >= 0), self.ranks[slot], NONE)
        return rank, slot

    @classmethod
    def load(cls, path: str = VOCABULARY) -> PairTable:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        start = np.array([vocab[s] for s in byte_symbols()], np.int32)
        return cls(keys, np.arange(len(pairs), dtype=np.int32), merged, start)


def _merge_long(piece: bytes, table: PairTable) -> np.ndarray:
    ids = table.start[np.frombuffer(piece, np.uint8)]
    while len(ids) > 1:
        rank, slot = table.find(ids[:-1], ids[1:])
        least = rank.min()
        if least == NONE:
            break
        at = np.flatnonzero(rank == least)
        if table.nested:
            run = np.cumsum(np.r_[True, np.diff(at) > 1])
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
        else:
            at = at[:1]
        ids[at] = table.merged[slot[at]]
        ids = np.delete(ids, at + 1)
    return ids


def _merge_bucket(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    length = np.array([len(p) for p in pieces])
    width = int(length.max())
    ids = np.full((len(pieces), width), -1, np.int32)
    ids[np.arange(width) < length[:, None]] = table.start[np.frombuffer(b"".join(pieces), np.uint8)]
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
    rows = np.arange(len(pieces))
    while len(rows):
        if ids.shape[1] < 2:
            least, at, slot = np.full(len(rows), NONE), None, None
        else:
            rank, slot = table.find(ids[:, :-1], ids[:, 1:])
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
        done = least == NONE
        for r in np.flatnonzero(done):
            out[rows[r]] = ids[r][ids[r] >= 0]
        live = ~done
        rows = rows[live]
        if not len(rows):
            break
        ids, at, slot = ids[live], at[live], slot[live]
        n = np.arange(len(rows))
        ids[n, at] = table.merged[slot[n, at]]
        take = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, take + (take > at[:, None]), 1)
    return out


def merge_pieces(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if len(p) > LONG:
            out[i] = _merge_long(p, table)
        elif p:
            buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
    for at in buckets.values():
        for k in range(0, len(at), 4096):
            for i, ids in zip(at[k : k + 4096], _merge_bucket([pieces[i] for i in at[k : k + 4096]], table)):
                out[i] = ids
    return out


class Encoder:
    """Encodes lists of texts; remembers pieces it has met."""

    def __init__(self, table: PairTable):
        self.table, self.split = table, regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.flat, self.offset = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) > CACHE_PIECES:
            self._clear()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self.split(t)
                counts[i] = len(found)
                pieces += found
        get = self.code.get
        new = [p for p in dict.fromkeys(pieces) if get(p) is None]
        if new:
            for p in new:
                self.code[p] = len(self.code)
            self.parts += merge_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.table)
            self.flat = np.concatenate([self.flat, *self.parts[len(self.offset) - 1 :]])
            sizes = [len(x) for x in self.parts[len(self.offset) - 1 :]]
            self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces)), counts

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        codes, counts = self._codes(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(self.offset)[codes])])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts in it."""
        codes, counts = self._codes(texts)
        size = np.diff(self.offset)[codes]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.arange(total[-1]) + np.repeat(self.offset[codes] - total[:-1], size)]
        return flat, total[np.concatenate([[0], np.cumsum(counts)])]


_encoders: dict[str, Encoder] = {}


def _shared(spark: SparkSession, path: str) -> Broadcast:
    """The pair table with a name of its own: workers outlive a broadcast, so the address of its value names nothing."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, PairTable.load(path)))


def _encoder(shared: Broadcast) -> Encoder:
    name, table = shared.value
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(table)
    return _encoders[name]


def encode_ids(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """docs without `text`, with `ids`. The pair table (50,000 merges at most, about 3 MB) is broadcast."""
    shared = _shared(docs.sparkSession, path)
    keep = [c for c in docs.columns if c not in (text, "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                s = b.slice(k, 1000)
                flat, offset = enc.encode(s.column(text).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in keep], ids], [*keep, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([docs.schema[c] for c in keep]).add("ids", ArrayType(IntegerType()))
    return spread(docs.select(*keep, text)).mapInArrow(run, schema)


def token_counts(docs: DataFrame, text: str = "text", path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """docs without `text`, with its number of tokens."""
    shared = _shared(docs.sparkSession, path)
    keep = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                s = b.slice(k, 1000)
                n = pa.array(enc.lengths(s.column(text).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in keep], n], [*keep, out])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([docs.schema[c] for c in keep]).add(out, LongType())
    return spread(docs.select(*keep, text)).mapInArrow(run, schema)

"""Benchmark decontamination by SimHash over item-sized windows.

A document leaks an item if some window of as many words as the item has (the whole document
if it is shorter) has a weighted-shingle similarity of 0.75 or more with it: 5-word shingles
weigh as often as they occur, and the similarity is the sum of the smaller weights over the
sum of the greater.

Windows get 64-bit SimHash fingerprints of their shingles. Fingerprints are looked up in a
multi-index: 8 blocks of 8 bits, with every value within 2 bits of an item's block entered;
two fingerprints at most 23 bits apart agree in some block up to 2 bits (8 * 3 > 23), so the
index finds all of them. Those within the radius are verified exactly on their shingles.

Two exact bounds spare work: an item that shares no shingle with a document can't be leaked
by it, and a window similar enough has 6/7 of its places on shingles of the benchmark, which
running sums tell for all windows at once. So clean documents cost one look-up per shingle.

The benchmark is dealt into slices of bounded size by a hash; each is broadcast and all
documents pass it. Documents are read whole, each row by itself.

Nulls and empty texts leak nothing and are leaked by nothing; items of one to four words are
one shingle. Repeated items are each reported, repeated documents each get their leaks. Of an
item's windows the most similar is reported, the first of several.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumeria.llm.frames import by_chunk
from plumeria.llm.words import SHINGLE_WORDS, mix, shingle_hashes, word_hashes

RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
NEAR = RADIUS // BLOCKS
SLICE_ITEMS = 16_384
SLICE_CHARS = 8 << 20
_SKETCH_BITS = 22
_BITS = np.arange(64, dtype=np.uint64)
_SIGN = np.uint64(0xB5297A4D3F84D5B5)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """One row of 64 numbers, 1 or -1, for each shingle."""
    return ((mix(shingles ^ _SIGN)[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)


def _packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def simhash(shingles: np.ndarray) -> np.uint64:
    return _packed(_signs(shingles).sum(axis=0, dtype=np.int64)[None, :])[0]


def _flips() -> np.ndarray:
    """All patterns of at most NEAR set bits in a block."""
    return np.array([sum(1 << b for b in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), k)], dtype=np.uint8)


@dataclass(frozen=True)
class Group:
    """Up to 64 items of one length, and for each block value a bit mask of the items near it."""

    items: np.ndarray
    prints: np.ndarray
    masks: np.ndarray

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and item of all pairs within the radius."""
        found = np.zeros(len(prints), dtype=np.uint64)
        for block in range(BLOCKS):
            found |= self.masks[block, ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64(255)).astype(np.int64)]
        window, item = np.nonzero((found[:, None] >> np.arange(len(self.items), dtype=np.uint64)) & np.uint64(1))
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], self.items[item[close]]


class Slice:
    """A part of the benchmark, ready to be searched."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        words, starts = word_hashes(texts)
        shingles, at = shingle_hashes(words, starts)
        self.ids = ids
        self.lengths = np.diff(starts)
        self.bags = [np.unique(shingles[a:b], return_counts=True) for a, b in zip(at, at[1:])]
        self.sizes = np.diff(at)
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        order = np.lexsort((self.lengths[owner], shingles))
        pairs = np.unique(np.stack([shingles[order], self.lengths[owner][order].astype(np.uint64)]), axis=1) if len(owner) else np.zeros((2, 0), np.uint64)
        self.shingles, first = np.unique(pairs[0], return_index=True)
        #: The lengths of the items that hold a shingle, and where they begin.
        self.shingle_lengths, self.length_starts = pairs[1].astype(np.int64), np.append(first, pairs.shape[1])
        self.sketch = np.zeros(1 << _SKETCH_BITS, dtype=bool)
        self.sketch[(self.shingles >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)] = True
        self.groups: dict[int, list[Group]] = {}
        flips = _flips()
        for length in np.unique(self.lengths[self.lengths > 0]).tolist():
            own = np.flatnonzero(self.lengths == length)
            self.groups[length] = []
            for k in range(0, len(own), 64):
                items = own[k : k + 64]
                prints = np.array([simhash(shingles[at[i] : at[i + 1]]) for i in items], dtype=np.uint64)
                masks = np.zeros((BLOCKS, 1 << BLOCK_BITS), dtype=np.uint64)
                for bit, value in enumerate(prints):
                    for block in range(BLOCKS):
                        near = (int(value) >> (block * BLOCK_BITS) & 255) ^ flips
                        masks[block, near] |= np.uint64(1 << bit)
                self.groups[length].append(Group(items, prints, masks))

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """The place of each shingle among the benchmark's, -1 if it isn't there."""
        out = np.full(len(shingles), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.sketch[(shingles >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)])
        if len(maybe):
            where = np.minimum(np.searchsorted(self.shingles, shingles[maybe]), len(self.shingles) - 1)
            right = self.shingles[where] == shingles[maybe]
            out[maybe[right]] = where[right]
        return out

    def leaks(self, shingles: np.ndarray, hits: np.ndarray, lengths: np.ndarray, width: int) -> dict[int, tuple[float, int]]:
        """Of one document with shingles of `width` words: each leaked item, its similarity and the first word."""
        found: dict[int, tuple[float, int]] = {}
        running = np.concatenate(([0], np.cumsum(hits >= 0)))
        signs = None
        for length in lengths.tolist():
            size = max(length - width + 1, 1)
            own = min(size, len(shingles))
            # The smaller weights must sum to 3/7 of both sums.
            full = running[own:] - running[:-own] if own < len(running) else running[:0]
            starts = np.flatnonzero(7 * full >= 3 * (own + size))
            if not len(starts):
                continue
            if signs is None:
                signs = np.concatenate((np.zeros((1, 64), dtype=np.int32), np.cumsum(_signs(shingles), axis=0, dtype=np.int32)))
            prints = _packed(signs[starts + own] - signs[starts])
            for group in self.groups[length]:
                for window, item in zip(*group.near(prints)):
                    start = int(starts[window])
                    values, counts = np.unique(shingles[start : start + own], return_counts=True)
                    _, i, j = np.intersect1d(values, self.bags[item][0], assume_unique=True, return_indices=True)
                    both = int(np.minimum(counts[i], self.bags[item][1][j]).sum())
                    if 4 * both >= 3 * (own + size - both):
                        similar = both / (own + size - both)
                        if similar > found.get(int(item), (0.0, 0))[0]:
                            found[int(item)] = similar, start
        return found

    def search(self, texts: pa.Array) -> list[dict[int, tuple[float, int]]]:
        """The leaks of every text."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(texts))]
        words, starts = word_hashes(texts)
        short = sorted(n for n in self.groups if n < SHINGLE_WORDS)
        for width in [*short, SHINGLE_WORDS]:
            shingles, at = shingle_hashes(words, starts, width)
            hits = self.hits(shingles)
            seen = np.concatenate(([0], np.cumsum(hits >= 0)))
            for row in np.flatnonzero(seen[at[1:]] > seen[at[:-1]]):
                own = hits[at[row] : at[row + 1]]
                told = np.unique(own[own >= 0])
                lengths = np.unique(np.concatenate([self.shingle_lengths[self.length_starts[k] : self.length_starts[k + 1]] for k in told]))
                # Shorter items are whole shingles and have a pass of their own width.
                lengths = lengths[lengths == width] if width < SHINGLE_WORDS else lengths[lengths >= SHINGLE_WORDS]
                for item, leak in self.leaks(shingles[at[row] : at[row + 1]], own, lengths, width).items():
                    if leak[0] > out[row].get(item, (0.0, 0))[0]:
                        out[row][item] = leak
        return out


def slices(benchmark: DataFrame) -> list[Slice]:
    """The benchmark in parts of at most about 16,384 items and 8 million characters each."""
    items = benchmark.select("item_id", "text").where(F.length(F.trim("text")) > 0)
    n, chars = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, math.ceil(2 * n / SLICE_ITEMS), math.ceil(2 * (chars or 0) / SLICE_CHARS))
    out = []
    for k in range(parts):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
        out.append(Slice(table.column("item_id").to_pylist(), table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())))
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """The documents with an array of their leaks (item_id, similarity, start: the window's first word)."""
    id_type = benchmark.schema["item_id"].dataType
    leak = T.StructType([T.StructField("item_id", id_type), T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType())])
    kind = to_arrow_type(T.ArrayType(leak))
    docs = docs.drop(name).withColumn(name, F.array().cast(T.ArrayType(leak)))
    schema = docs.schema

    def search(shared):
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            at = part.schema.get_field_index(name)
            found = shared.value.search(part.column("text"))
            made = [
                [*before, *({"item_id": shared.value.ids[k], "similarity": s, "start": w} for k, (s, w) in sorted(leaks.items()))]
                for before, leaks in zip(part.column(at).to_pylist(), found)
            ]
            columns = [*part.columns[:at], pa.array(made, kind), *part.columns[at + 1 :]]
            return pa.RecordBatch.from_arrays(columns, part.schema.names)

        return work

    for part in slices(benchmark):
        docs = docs.mapInArrow(by_chunk(search(docs.sparkSession.sparkContext.broadcast(part))), schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start: one row for each leaked item of a document."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.similarity", "leak.start")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing."""
    return with_leaks(docs, benchmark, "_leaks").where(F.size("_leaks") == 0).drop("_leaks")

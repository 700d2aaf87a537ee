"""Exact repeats of 13 words and more across documents, found by recompression.

Every text's words are recompressed: a run of equal symbols gets a name made of the symbol and
the run's length, and each pair of a "left" and a "right" symbol, which a bit of their names
tells, gets a name made of both; this is repeated on the names. A name is a 64-bit fingerprint
of what it stands for, so equal stretches get equal names in every task without a common
table. For each symbol the words that its name and bounds depend on are known (its support):
wherever those words stand, in whatever surroundings, there is that symbol.

A Spark round tells which names stand in several documents. A window of 13 words that holds the
whole support of a name of a single document can't stand in another one and is out; windows
without such a symbol, say in long runs of one word, just stay in. A second round verifies the
windows left: by 96 bits of fingerprint it finds the least document of each window's words. A
word goes if a window that covers it also starts in a document with a smaller id.

How it scales: documents are dealt to chunks of bounded size when they are first read, and kept
with their chunk in the scratch folder. A chunk asks buckets of names and windows, each of its
names or windows once, however often it has them; answers are a bit each. So a passage that
stands in a third of all documents is one entry of its bucket for each chunk. Buckets grow in
number with the input. Texts are shuffled twice, to meet their chunk's answers. Nothing but
counts reaches the driver, nothing is broadcast, nothing is capped.

Nulls: a null text has no words; a null id is larger than any (ids are compared as 64-bit
numbers, ids of another type by their order; a null counts as the largest 64-bit number).
Empty texts keep nothing. Repeated rows and rows of one id: neither is smaller, so they don't
remove from each other. Ties don't arise, as all windows are judged on the input. An empty
table gives no rows. Other columns of the input, whatever their names, are not read. A text is
worked on as a whole, so the longest must fit a task's memory some twenty times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumeria.llm.merkle import numbered
from plumeria.llm.words import chunks, mix, powers, word_spans
from plumeria.session import scratch_folder

WINDOW_WORDS = 13
#: Levels of recompression; runs are named in the first, pairs in all.
LEVELS = 3
#: Text of a chunk, and text whose names share a bucket, at least; buckets of large inputs hold more, up to the last.
CHUNK_BYTES = 1 << 22
BUCKET_BYTES, MANY_BUCKETS, MOST_BUCKET_BYTES = 1 << 24, 1 << 12, 1 << 29
LEAST_BUCKETS = 8
#: What lies outside of a document, before and behind it.
_BEFORE, _BEHIND = -(1 << 40), 1 << 40
_BYTE = np.random.default_rng(20250117).integers(1, 1 << 63, 256, dtype=np.uint64)
_LENGTH, _RUN, _PAIR, _SIDE, _CHECK = (np.uint64(x) for x in np.random.default_rng(7).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1))
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts; begin, end and fingerprint of every word as it is written; the first word of each text and the number of words."""
    data, begin, end, starts = word_spans(texts)
    if not len(begin):
        return data, begin, end, np.zeros(0, dtype=np.uint64), starts
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return data, begin, end, mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _LENGTH), starts


class Symbols:
    """The symbols of some documents' words: name, document, and support (first word, word behind the last)."""

    def __init__(self, name: np.ndarray, doc: np.ndarray) -> None:
        self.name, self.doc = name, doc
        self.low = np.arange(len(name))
        self.high = self.low + 1

    def _before(self, at: np.ndarray) -> np.ndarray:
        """Where the support of the symbol before each of these begins."""
        there = np.maximum(at - 1, 0)
        return np.where((at > 0) & (self.doc[there] == self.doc[at]), self.low[there], _BEFORE)

    def _behind(self, at: np.ndarray) -> np.ndarray:
        """Where the support of the symbol behind each of these ends."""
        there = np.minimum(at + 1, len(self.doc) - 1)
        return np.where((at + 1 < len(self.doc)) & (self.doc[there] == self.doc[at]), self.high[there], _BEHIND)

    def runs(self) -> None:
        """Equal neighbours become one symbol. That a run is not longer depends on both its neighbours."""
        if not len(self.name):
            return
        fresh = np.ones(len(self.name), dtype=bool)
        fresh[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(self.name)) - 1
        length = (last - first + 1).astype(np.uint64)
        low, high = self._before(first), self._behind(last)
        self.name = np.where(length > 1, mix(self.name[first] * _RUN + length), self.name[first])
        self.doc, self.low, self.high = self.doc[first], low, high

    def pairs(self, level: int) -> None:
        """A left symbol and a right one behind it become one. A left symbol that stays alone depends on what follows, a right one on what precedes."""
        if not len(self.name):
            return
        right = (mix(self.name + _SIDE * np.uint64(level + 1)) >> np.uint64(40)) & np.uint64(1) == 1
        paired = np.zeros(len(self.name), dtype=bool)
        paired[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(len(self.name), dtype=bool)
        second[1:] = paired[:-1]
        at = np.flatnonzero(~second)
        both, right = paired[at], right[at]
        joined = mix(mix(self.name[at] + np.uint64(level + 1)) * _PAIR + self.name[np.minimum(at + 1, len(self.name) - 1)])
        low = np.where(~both & right, self._before(at), self.low[at])
        high = np.where(both | ~right, self._behind(at), self.high[at])
        self.name, self.doc, self.low, self.high = np.where(both, joined, self.name[at]), self.doc[at], low, high


def recompressed(words_: np.ndarray, starts: np.ndarray, window: int = WINDOW_WORDS, levels: int = LEVELS) -> Symbols:
    """The symbols whose support fits a window."""
    made = Symbols(words_, np.repeat(np.arange(len(starts) - 1), np.diff(starts)))
    made.runs()
    for level in range(levels):
        made.pairs(level)
    fits = made.high - made.low <= window
    made.name, made.doc, made.low, made.high = made.name[fits], made.doc[fits], made.low[fits], made.high[fits]
    return made


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and where each value is among them."""
    return np.unique(values, return_inverse=True)


def _edges(sorted_: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted fingerprints begins, and the last ends."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    return np.searchsorted((sorted_ >> shift).astype(np.int64), np.arange(buckets + 1))


class Chunk:
    """What a chunk of documents asks of the buckets, made anew, and alike, from its texts whenever needed."""

    def __init__(self, texts: pa.Array, order: np.ndarray, window: int) -> None:
        # Rows of a chunk arrive in any order; names and windows are asked in the order of their fingerprints.
        self.window = window
        self.data, self.begin, self.end, self.words, self.starts = words(texts)
        self.order = order
        self.symbols = recompressed(self.words, self.starts, window)
        self.names, self.which = _grouped(self.symbols.name)

    def several(self) -> np.ndarray:
        """Which names stand in several of the chunk's documents."""
        least, most = np.full(len(self.names), _BEHIND), np.full(len(self.names), -1)
        np.minimum.at(least, self.which, self.symbols.doc)
        np.maximum.at(most, self.which, self.symbols.doc)
        return least < most

    def windows(self, shared: np.ndarray) -> None:
        """Finds the windows that may stand in several documents, by the names that do."""
        n, k = len(self.words), self.window
        doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        alone = ~shared[self.which]
        out = np.zeros(n + 2, dtype=np.int64)
        # A window from p holds a support if p is at most its first word and p + k at least its end.
        np.add.at(out, np.maximum(self.symbols.high[alone] - k, 0), 1)
        np.add.at(out, self.symbols.low[alone] + 1, -1)
        at = np.flatnonzero(np.cumsum(out[: max(n - k + 1, 0)]) == 0) if n >= k else np.zeros(0, dtype=np.int64)
        at = at[doc[at] == doc[at + k - 1]] if len(at) else at
        up, down = powers(n + 1)

        def sums(values: np.ndarray) -> np.ndarray:
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values * up[:n], out=total[1:])
            return mix((total[at + k] - total[at]) * down[at])

        self.at, self.window_doc = at, doc[at] if len(at) else at
        self.hashes, self.of = _grouped(sums(self.words))
        check = np.zeros(len(self.hashes), dtype=np.uint64)
        # Windows of one chunk that agree in 64 bits are taken as equal.
        check[self.of] = sums(mix(self.words ^ _CHECK))
        self.check = (check >> np.uint64(32)).astype(np.uint32)
        self.least = np.full(len(self.hashes), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, self.order[self.window_doc])

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which words go, by the windows that stand in a document smaller than any of the chunk's."""
        hit = smaller[self.of] | (self.least[self.of] < self.order[self.window_doc])
        cover = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(cover, self.at[hit], 1)
        np.add.at(cover, self.at[hit] + self.window, -1)
        return np.cumsum(cover[:-1]) > 0

    def kept(self, gone: np.ndarray) -> pa.Array:
        """Each document's words that stay, joined by one space."""
        keep = np.flatnonzero(~gone)
        length = self.end[keep] - self.begin[keep] + 1
        at = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(length)))
        source = np.arange(at[-1]) + np.repeat(self.begin[keep] - at[:-1], length)
        out = self.data[np.minimum(source, max(len(self.data) - 1, 0))] if len(self.data) else np.zeros(0, dtype=np.uint8)
        out[at[1:] - 1] = 32
        bounds = at[np.searchsorted(keep, self.starts)]
        whole = out.tobytes()
        return pa.array([whole[a : max(b - 1, a)].decode() for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.string())


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(column), f.type) for column, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _bits(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes()


def _told(answers: pa.Table, edges: np.ndarray, step: int) -> np.ndarray:
    """The answers of all buckets to one of the chunk's two questions, in the order of the asking."""
    out = np.zeros(int(edges[-1]), dtype=bool)
    for row in answers.to_pylist():
        if row["step"] == step:
            a, b = edges[row["bucket"]], edges[row["bucket"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=b - a)
    return out


_ANSWER = "chunk long, step int, bucket int, bits binary"
_ANSWERED = pa.schema([("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("least", pa.binary())])


def _deal(id_field: pa.Field, buckets: int, window: int, chunk_bytes: int):
    """Gives every row its chunk, and adds the chunk's question: names, and whether several of its documents have them."""
    schema = pa.schema([("chunk", pa.int64()), id_field, ("_order", pa.int64()), ("text", pa.string()), ("bucket", pa.int32()), ("names", pa.binary()), ("several", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            own = [pa.array(np.full(n, number), pa.int64()), table.column(id_field.name), table.column("_order"), table.column("text")]
            yield from pa.table([*own, *(pa.nulls(n, f.type) for f in list(schema)[4:])], schema=schema).to_batches()
            texts = table.column("text").combine_chunks()
            chunk = Chunk(texts, np.zeros(n, dtype=np.int64), window)
            edges, several = _edges(chunk.names, buckets), chunk.several()
            asked = [
                (number, None, None, None, int(k), chunk.names[a:b].astype(np.uint32).tobytes(), _bits(several[a:b]))
                for k, (a, b) in enumerate(zip(edges, edges[1:]))
                if a < b
            ]
            yield from _rows(schema, asked).to_batches()
            number += 1

        for batch in batches:
            for part in chunks(batch, "text", chunk_bytes):
                held.append(part)
                size += part.column("text").nbytes
                if size >= chunk_bytes:
                    yield from closed()
                    held.clear()
                    size = 0
        if held:
            yield from closed()

    return run


def _shared_names(table: pa.Table) -> pa.Table:
    """Of one bucket: for every chunk, which of its names stand in several documents."""
    names = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("names")]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=len(n)).astype(bool) for x, n in zip(table.column("several"), names)]
    of = np.unique(np.concatenate(names), return_inverse=True)[1]
    shared = np.bincount(of) > 1
    shared[of[np.concatenate(several)]] = True
    at = np.cumsum([0, *map(len, names)])
    bucket = table.column("bucket")[0].as_py()
    return _rows(_ANSWERED, [(c, 0, bucket, _bits(shared[of[a:b]])) for c, a, b in zip(table.column("chunk").to_pylist(), at, at[1:])])


def _smaller(table: pa.Table) -> pa.Table:
    """Of one bucket: for every chunk, which of its windows stand in a document smaller than any of the chunk's that has them."""
    def all_(column: str, kind: type) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(column)]

    parts = all_("hashes", np.uint64)
    hashes, checks, least = np.concatenate(parts), np.concatenate(all_("checks", np.uint32)), np.concatenate(all_("least", np.int64))
    order = np.lexsort((least, checks, hashes))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    first = np.empty(len(order), dtype=np.int64)
    first[order] = least[order][fresh][np.cumsum(fresh) - 1]
    at = np.cumsum([0, *map(len, parts)])
    bucket = table.column("bucket")[0].as_py()
    return _rows(_ANSWERED, [(c, 1, bucket, _bits(first[a:b] < least[a:b])) for c, a, b in zip(table.column("chunk").to_pylist(), at, at[1:])])


def _ask_windows(buckets: int, window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _ASKED.empty_table()
        docs = docs.combine_chunks()
        chunk = Chunk(docs.column("text").combine_chunks(), np.asarray(docs.column("_order")), window)
        chunk.windows(_told(answers, _edges(chunk.names, buckets), 0))
        number, edges = docs.column("chunk")[0].as_py(), _edges(chunk.hashes, buckets)
        asked = [
            (number, int(k), chunk.hashes[a:b].tobytes(), chunk.check[a:b].tobytes(), chunk.least[a:b].tobytes())
            for k, (a, b) in enumerate(zip(edges, edges[1:]))
            if a < b
        ]
        return _rows(_ASKED, asked)

    return run


def _keep(id_field: pa.Field, buckets: int, window: int):
    schema = pa.schema([id_field, ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.combine_chunks()
        chunk = Chunk(docs.column("text").combine_chunks(), np.asarray(docs.column("_order")), window)
        chunk.windows(_told(answers, _edges(chunk.names, buckets), 0))
        gone = chunk.removed(_told(answers, _edges(chunk.hashes, buckets), 1))
        total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(gone)))
        removed = total[chunk.starts[1:]] - total[chunk.starts[:-1]]
        return pa.table([docs.column(id_field.name), pa.array(np.diff(chunk.starts), pa.int64()), pa.array(removed, pa.int64()), chunk.kept(gone)], schema=schema)

    return run


def _with_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and the id's place in the order of ids, as a number."""
    rows = docs.select("doc_id", "text")
    most = F.lit(np.iinfo(np.int64).max)
    if isinstance(docs.schema["doc_id"].dataType, _INTEGERS):
        return rows.withColumn("_order", F.coalesce(F.col("doc_id").cast("long"), most))
    ids = numbered(rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct(), [], ["_id"])
    placed = rows.join(ids.select("_id", F.col("place").alias("_order")), F.col("doc_id") == F.col("_id"), "left")
    return placed.select("doc_id", "text", F.coalesce("_order", most).alias("_order"))


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Of every row: doc_id, n_words, n_removed, and kept_text, the words that stay joined by one space."""
    spark = docs.sparkSession
    rows = _with_order(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(max(BUCKET_BYTES, size // MANY_BUCKETS), MOST_BUCKET_BYTES)
    buckets = 1 << (max(LEAST_BUCKETS, size // share) - 1).bit_length()
    id_type = docs.schema["doc_id"].dataType
    id_field = pa.field("doc_id", to_arrow_type(id_type))
    kind = id_type.simpleString()
    path = scratch_folder(spark, "repeats")
    dealt = rows.mapInArrow(
        _deal(id_field, buckets, window, chunk_bytes), f"chunk long, doc_id {kind}, _order long, text string, bucket int, names binary, several binary"
    )
    dealt.write.parquet(path)
    kept = spark.read.parquet(path)
    texts = kept.where("bucket IS NULL").select("chunk", "doc_id", "_order", "text")
    asked = kept.where("bucket IS NOT NULL").select("chunk", "bucket", "names", "several")
    names = scratch_folder(spark, "repeats-names")
    asked.groupBy("bucket").applyInArrow(_shared_names, _ANSWER).write.parquet(names)
    shared = spark.read.parquet(names)
    windows = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        _ask_windows(buckets, window), "chunk long, bucket int, hashes binary, checks binary, least binary"
    )
    smaller = windows.groupBy("bucket").applyInArrow(_smaller, _ANSWER)
    answers = shared.unionByName(smaller)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _keep(id_field, buckets, window), f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    )


def digests(docs: DataFrame) -> DataFrame:
    """without_repeats() with a hash of the kept text in its place."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

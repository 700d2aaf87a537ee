"""Alignment of two tokenizers over a corpus, with the corpus-wide counts of aligned tokens.

Every text is cut by a byte-level tokenizer (A, of a text with a space before it) and by a piece
tokenizer (B, which puts that space itself). Where tokens of both end at one byte, a group of
tokens ends, and the two tokens that end there are linked. How often a pair of ids is linked is
counted over the corpus:

- The first pass aligns all texts; a task hands on its distinct pairs with their counts.
- The distinct pairs, cut into slices by their B id, get a minimal perfect hash each: levels of
  bits in which a pair that is alone on its place owns it, the others go on to the next level;
  a pair's number is the rank of its bit. The pairs lie in a table in that order, so that a
  number's pair can be verified.
- Counts become dense vectors, indexed by the hash, one for each slice and group of tasks. The
  vectors of a slice are summed up a tree, eight by eight.
- The second pass aligns all texts anew and looks up each link's count, with the tables
  broadcast as long as they hold at most `broadcast_pairs` pairs. Of more, the first slices are
  broadcast with the second pass; links to other slices go on, as numbers, to passes that
  broadcast the next ones. All tables have the same bound, and every link is looked up once.

Both tokenizers' files reach the tasks by a broadcast of at most `MOST_FILE_BYTES` each.

Texts are cut at single spaces between other characters. No token of A crosses such a place, as
a space before a word belongs to the word; none of B does if no piece has a space behind another
character, which is checked (else texts stay whole). So every text's tokens are those of its
segments, each with a space before it, and a task aligns a segment that it has met before only
once, as long as it holds it.

Nulls and empty texts have no tokens, and zeros everywhere; so have texts whose tokens of A or
B don't spell the text (B can't tell U+2581 from a space). Strings of special tokens inside
texts are plain text. Repeated rows count as often as they are there. Ties: all of a B id's
pairs with the highest count are its best. An empty table gives no rows. Other columns of the
input, whatever their names, are not read. A text is aligned as a whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumeria.llm.frames import by_chunk
from plumeria.llm.words import chunks, mix, text_bytes
from plumeria.session import cut_lineage, scratch_folder

#: Where the public tokenizers are, for the registered query.
FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_FILE_BYTES = 1 << 26
#: Pairs of a slice; a slice holds all pairs of its B ids.
SLICE_PAIRS = 1 << 17
#: Pairs whose table is broadcast at once, at 17 bytes each.
BROADCAST_PAIRS = 1 << 22
#: Links that a task collects before it makes them distinct, and distinct pairs of one row.
HELD_LINKS, ROW_PAIRS = 1 << 20, 1 << 16
FAN = 8
#: Partial counts that share a dense vector, for each of its places.
SHARED = 4
#: Places of a level of the hash for each of its pairs.
SPREAD = 2
_B_BITS = 32
#: Text worked on at once, and segments that a task holds.
TEXT_BYTES = 1 << 20
HELD_SEGMENTS = 1 << 19
#: Segments that are cut as one text.
JOINED = 64

# How byte-level vocabularies cut texts into words, as published with them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself, the others, in order, as characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Spelling:
    """The bytes and the decimal digits of every token id."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.length = np.array([len(x) for x in spelled], dtype=np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        digits = np.char.mod("%d", np.arange(len(spelled))).astype("S")
        self.digits = digits.view(np.uint8).reshape(len(spelled), -1)
        self.n_digits = np.char.str_len(digits)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - length), length)]


class ByteTokenizer:
    """A, from a byte-level BPE's JSON file."""

    def __init__(self, file: bytes) -> None:
        described = json.loads(file)
        model, special = described["model"], {x["content"] for x in described["added_tokens"]}
        vocab, characters = model["vocab"], _byte_of_character()
        spelled = {i: bytes(characters[c] for c in token) for token, i in vocab.items() if token not in special}
        named = [spelled.get(i, b"") for i in range(max(max(vocab.values()), *(x["id"] for x in described["added_tokens"]), 0) + 1)]
        self.spelling = Spelling(named)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        before = described["pre_tokenizer"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not described["normalizer"]
        plain = plain and not model.get("dropout") and not model.get("ignore_merges")
        if plain and all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges)) and len(spelled) == 256 + len(merges):
            # Ids in the order of the merges: then ids are ranks, and the faster library cuts alike.
            import tiktoken

            coder = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks={x: i for i, x in spelled.items()}, special_tokens={})
            self.ids = lambda text: np.asarray(coder.encode_to_numpy(text, disallowed_special=()), dtype=np.int64)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_buffer(file)
            own.encode_special_tokens = True
            self.ids = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class PieceTokenizer:
    """B, from a piece model file."""

    def __init__(self, file: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.spelling = Spelling([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.int64) for x in self.model.encode(texts, num_threads=1)]


_READY: dict[str, Segments] = {}


def _ready(files: tuple[str, bytes, bytes]) -> Segments:
    """The tokenizers of these files, made once in a process."""
    name, a, b = files
    if name not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _READY[name] = Segments(ByteTokenizer(a), PieceTokenizer(b))
    return _READY[name]


def tokenizer_files(spark: SparkSession, byte_file: str, piece_file: str) -> Broadcast:
    files = []
    for path in (byte_file, piece_file):
        with open(path, "rb") as f:
            files.append(f.read(MOST_FILE_BYTES + 1))
        if len(files[-1]) > MOST_FILE_BYTES:
            raise ValueError(f"{path} has more than {MOST_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast((hashlib.sha256(b"".join(files)).hexdigest(), *files))


class Aligned:
    """The tokens of some texts, one after the other, and where they end together."""

    def __init__(self, texts: pa.Array, a: ByteTokenizer, b: PieceTokenizer, joined: bool = False) -> None:
        """`joined`: the texts may be cut as one, as no token crosses a space between two of them."""
        n = len(texts)
        data, offsets = text_bytes(texts)
        plain = ["" if x is None else x for x in texts.to_pylist()]
        # The bytes of all texts that have any, each with its space.
        size = np.diff(offsets)
        size = size + (size > 0)
        own = self._joined(plain, size, a, b) if joined and n else None
        if own is None:
            lists = [a.ids(" " + x) if x else _NO_IDS for x in plain], [y if x else _NO_IDS for x, y in zip(plain, b.ids(plain))]
            own = [(np.concatenate([*ids, _NO_IDS]), np.array([len(x) for x in ids], dtype=np.int64)) for ids in lists]
        sides = []
        good = size > 0
        for (flat, counts), spelling in zip(own, (a.spelling, b.spelling)):
            length = spelling.length[flat]
            bounds = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(counts)))
            fits = good & (_per_text(length, bounds) == size)
            spelled = spelling.joined(flat[np.repeat(fits, counts)])
            begin = np.cumsum(np.where(fits, size, 0)) - np.where(fits, size, 0)
            # What the text says there: its bytes, moved on by the space.
            expected = np.full(len(spelled), 32, dtype=np.uint8)
            inner = np.ones(len(spelled), dtype=bool)
            inner[begin[fits]] = False
            expected[inner] = data[np.repeat(fits, np.diff(offsets))]
            wrong = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(spelled != expected)))
            good = fits & (wrong[begin + np.where(fits, size, 0)] == wrong[begin])
            sides.append((flat, counts, length))
        kept = []
        for flat, counts, length in sides:
            pick = np.repeat(good, counts)
            kept.append((flat[pick], np.where(good, counts, 0), np.cumsum(length[pick])))
        (self.a, self.n_a, end_a), (self.b, self.n_b, end_b) = kept
        self.last_a = np.isin(end_a, end_b, assume_unique=True)
        self.last_b = np.isin(end_b, end_a, assume_unique=True)
        of_a = np.repeat(np.arange(n), self.n_a)
        self.n_links = np.bincount(of_a[self.last_a], minlength=n)
        self.good = good
        self.spelling = a.spelling, b.spelling

    @staticmethod
    def _joined(plain: list[str], size: np.ndarray, a: ByteTokenizer, b: PieceTokenizer) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids and counts of both sides, or None if a token crosses the end of a text."""
        lines = [" ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        ends, out = np.cumsum(size), []
        for ids, spelling in ((a.ids(" " + " ".join(lines)), a.spelling), (np.concatenate(b.ids(lines)), b.spelling)):
            reached = np.cumsum(spelling.length[ids])
            upto = np.searchsorted(reached, ends, side="right")
            if not len(ids) or reached[-1] != ends[-1] or not np.array_equal(reached[upto - 1], ends):
                return None
            out.append((ids, np.diff(upto, prepend=0)))
        return out

    def links(self) -> np.ndarray:
        """The linked ids of each place where tokens end together, as one number."""
        return (self.a[self.last_a] << _B_BITS) | self.b[self.last_b]

    def groups(self) -> list[str]:
        """Of each text: `a1,a2|b1;a3|b2,b3`."""
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        before_b = np.searchsorted(group_b, np.arange(n + 1))
        upto_a = np.searchsorted(group_a, np.arange(n + 1), side="right")
        place_a = np.arange(len(self.a)) + before_b[group_a]
        place_b = np.arange(len(self.b)) + upto_a[group_b]
        total = len(self.a) + len(self.b)
        length, mark = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.uint8)
        sides = ((self.a, place_a, self.last_a, self.spelling[0], "|"), (self.b, place_b, self.last_b, self.spelling[1], ";"))
        for ids, place, last, spelling, end in sides:
            length[place] = spelling.n_digits[ids]
            mark[place] = np.where(last, ord(end), ord(","))
        ends = np.cumsum(length + 1)
        begin = ends - length - 1
        out = np.zeros(ends[-1] if total else 0, dtype=np.uint8)
        out[ends - 1] = mark
        for ids, place, _, spelling, _ in sides:
            for k in range(spelling.digits.shape[1]):
                there = spelling.n_digits[ids] > k
                out[begin[place[there]] + k] = spelling.digits[ids[there], k]
        bounds = np.concatenate((np.zeros(1, dtype=np.int64), ends))[np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(self.n_a + self.n_b)))]
        whole = out.tobytes().decode("ascii")
        return [whole[x : max(y - 1, x)] for x, y in zip(bounds.tolist(), bounds[1:].tolist())]


_NO_IDS = np.zeros(0, dtype=np.int64)
#: A space between other characters.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Segments:
    """Aligns texts by their segments, and holds what it has found for some of them."""

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer) -> None:
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # Of each segment: tokens of A and of B, links, whether the tokens spell it, and whether it may stand between spaces; then all links.
        self.told = np.zeros((0, 5), dtype=np.int64)
        self.links = _NO_IDS

    def _meet(self, segments: list[str]) -> None:
        plain, odd = [], []
        for x in segments:
            (plain if x and x == x.strip() and "▁" not in x else odd).append(x)
        self._add(plain, self.b.cuts)
        self._add(odd, False)

    def _add(self, segments: list[str], plain: bool) -> None:
        if not segments:
            return
        made = Aligned(pa.array(segments, pa.large_string()), self.a, self.b, plain)
        self.number.update(zip(segments, range(len(self.number), len(self.number) + len(segments))))
        self.groups += made.groups()
        self.told = np.concatenate((self.told, np.stack((made.n_a, made.n_b, made.n_links, made.good, np.full(len(segments), plain)), axis=1)))
        self.links = np.concatenate((self.links, made.links()))

    def _numbers(self, segments: list[str]) -> np.ndarray:
        fresh = [x for x in dict.fromkeys(segments) if x not in self.number]
        self._meet(fresh)
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))

    def align(self, texts: pa.Array) -> Texts:
        if len(self.number) > HELD_SEGMENTS:
            self.forget()
        whole = [x or "" for x in texts.to_pylist()]
        cut = [x.split(" ") if x else [] for x in whole]
        numbers = self._numbers([x for segments in cut for x in segments])
        bounds = np.cumsum([0, *map(len, cut)])
        # Where a space has another space or the end of the text beside it, the text is cut with more care.
        odd = np.flatnonzero(_per_text(1 - self.told[numbers, 4], bounds)).tolist()
        if odd:
            parts = [numbers[x:y] for x, y in zip(bounds, bounds[1:])]
            again = [_CUT.split(whole[k]) if self.b.cuts else [whole[k]] for k in odd]
            found = np.split(self._numbers([x for segments in again for x in segments]), np.cumsum([*map(len, again)])[:-1])
            for k, own in zip(odd, found):
                parts[k] = own
            numbers, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return Texts(self, numbers, bounds)


class Texts:
    """The alignment of some texts, put together from that of their segments."""

    def __init__(self, known: Segments, segments: np.ndarray, bounds: np.ndarray) -> None:
        told = known.told[segments]
        good = _per_text(1 - told[:, 3], bounds) == 0
        self.n_a, self.n_b, self.n_links = (np.where(good, _per_text(told[:, k], bounds), 0) for k in range(3))
        self._known, self._bounds, self._good = known, bounds, good
        # Segments of texts whose tokens don't spell them count for nothing.
        self._segments, self._counted = segments, np.repeat(good, np.diff(bounds))

    def links(self) -> np.ndarray:
        """The linked ids of each place where tokens end together, as one number."""
        segments = self._segments[self._counted]
        n = self._known.told[segments, 2]
        begin = np.cumsum(self._known.told[:, 2]) - self._known.told[:, 2]
        ends = np.cumsum(n)
        return self._known.links[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[segments] - (ends - n), n)]

    def groups(self) -> list[str]:
        """Of each text: `a1,a2|b1;a3|b2,b3`."""
        at, one = self._segments.tolist(), self._known.groups.__getitem__
        return [";".join(map(one, at[x:y])) if good else "" for x, y, good in zip(self._bounds.tolist(), self._bounds[1:].tolist(), self._good.tolist())]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _count(files: Broadcast):
    """The distinct pairs of a task, with their counts, in rows of bounded size."""
    schema = pa.schema([("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ready(files.value)
        pairs, counts, held = _NO_IDS, _NO_IDS, []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, of = np.unique(np.concatenate([pairs, *held]), return_inverse=True)
            return found, np.bincount(of, np.concatenate([counts, np.ones(size)]), len(found)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pairs), ROW_PAIRS):
                part = [pa.array([x[k : k + ROW_PAIRS]], f.type) for x, f in zip((pairs, counts), schema)]
                yield pa.RecordBatch.from_arrays(part, schema=schema)

        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                held.append(known.align(part.column("text")).links())
                size += len(held[-1])
                if size >= HELD_LINKS:
                    pairs, counts = merged()
                    held.clear()
                    size = 0
                    if len(pairs) >= HELD_LINKS:
                        yield from rows()
                        pairs, counts = _NO_IDS, _NO_IDS
        pairs, counts = merged()
        yield from rows()

    return run


class PerfectHash:
    """A minimal perfect hash of distinct numbers: levels of bits, and the rank of a number's bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(bits)))

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        while len(left):
            size = SPREAD * len(left) + 1
            place = cls._places(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate([*bits, np.zeros(0, dtype=bool)]))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; some number, or -1, for others."""
        out, left, at = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = at + self._places(keys[left], level, size)
            own = self.bits[place]
            out[left[own]] = self.rank[place[own]]
            left, at = left[~own], at + size
        return out

    def packed(self) -> tuple[bytes, bytes]:
        return np.array(self.sizes, dtype=np.int64).tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        of = np.frombuffer(sizes, dtype=np.int64).tolist()
        return cls(of, np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=sum(of)).astype(bool))


def _hashed(table: pa.Table) -> pa.Table:
    """The hash of one slice's pairs, and the pairs in the order of their numbers."""
    keys = np.asarray(table.column("pair"))
    made = PerfectHash.of(keys)
    order = np.empty_like(keys)
    order[made.numbers(keys)] = keys
    sizes, bits = made.packed()
    return pa.table({"slice": table.column("slice")[:1], "sizes": pa.array([sizes], pa.binary()), "bits": pa.array([bits], pa.binary()), "keys": pa.array([order.tobytes()], pa.binary())})


_VECTOR = pa.schema([("slice", pa.int64()), ("node", pa.int64()), ("counts", pa.binary())])


def _vector(slice_: int, node: int, counts: np.ndarray) -> pa.Table:
    return pa.table([pa.array([slice_], pa.int64()), pa.array([node // FAN], pa.int64()), pa.array([counts.tobytes()], pa.binary())], schema=_VECTOR)


def _dense(hashes: pa.Table, rows: pa.Table) -> pa.Table:
    """The counts of one group of tasks for one slice, as a vector; hands it to the node above."""
    own = hashes.to_pylist()[0]
    keys = np.frombuffer(own["keys"], dtype=np.int64)
    counts = np.zeros(len(keys), dtype=np.int64)
    pairs = np.asarray(rows.column("pair"))
    at = PerfectHash.unpacked(own["sizes"], own["bits"]).numbers(pairs)
    if len(at) and not np.array_equal(keys[at], pairs):
        raise ValueError("a pair is not in its slice's hash")
    np.add.at(counts, at, np.asarray(rows.column("n")))
    return _vector(own["slice"], own["node"], counts)


def _summed(table: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("counts"))
    return _vector(table.column("slice")[0].as_py(), table.column("node")[0].as_py(), counts)


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds which pairs have the highest count of their B id; all of a B id's pairs are in one slice."""
    for batch in batches:
        best = []
        for packed, told in zip(batch.column("keys"), batch.column("counts")):
            b = np.frombuffer(packed.as_buffer(), dtype=np.int64) & ((1 << _B_BITS) - 1)
            counts = np.frombuffer(told.as_buffer(), dtype=np.int64)
            _, of = np.unique(b, return_inverse=True)
            most = np.zeros(len(b), dtype=np.int64)
            np.maximum.at(most, of, counts)
            best.append(np.packbits(counts == most[of]).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.binary())], names=[*batch.schema.names, "best"])


def pair_tables(texts: DataFrame, files: Broadcast, slice_pairs: int = SLICE_PAIRS) -> tuple[DataFrame, int, int]:
    """slice, sizes, bits, keys, counts, best of every slice of the linked pairs; the number of slices, and of pairs."""
    spark = texts.sparkSession
    path = scratch_folder(spark, "alignment-pairs")
    texts.select("text").mapInArrow(_count(files), "pairs array<long>, counts array<long>").withColumn("part", F.monotonically_increasing_id()).write.parquet(path)
    partial = spark.read.parquet(path)
    each = partial.select("part", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("part", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    distinct = cut_lineage(each.select("pair").distinct())
    n = distinct.count()
    slices = max(1, -(-n // slice_pairs))
    # The low bits are the B id, so a slice has all pairs of its B ids.
    slice_ = F.pmod(F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)), F.lit(slices))
    made = distinct.withColumn("slice", slice_).groupBy("slice").applyInArrow(_hashed, "slice long, sizes binary, bits binary, keys binary")
    hashes = scratch_folder(spark, "alignment-hashes")
    made.write.parquet(hashes)
    hashes = spark.read.parquet(hashes)
    total = partial.agg(F.sum(F.size("pairs"))).first()[0] or 0
    groups = max(1, int(total / (SHARED * max(n, 1))))
    rows = each.select(slice_.alias("slice"), F.pmod(F.xxhash64("part"), F.lit(groups)).alias("node"), "pair", "n")
    dealt = hashes.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    vectors = dealt.groupBy("slice", "node").cogroup(rows.groupBy("slice", "node")).applyInArrow(_dense, "slice long, node long, counts binary")
    nodes = -(-groups // FAN)
    while nodes >= 1 and groups > 1:
        vectors = vectors.groupBy("slice", "node").applyInArrow(_summed, "slice long, node long, counts binary")
        groups, nodes = nodes, -(-nodes // FAN)
    tables = hashes.join(vectors.select("slice", "counts"), "slice").select("slice", "sizes", "bits", "keys", "counts")
    rated = scratch_folder(spark, "alignment-tables")
    tables.mapInArrow(_rated, "slice long, sizes binary, bits binary, keys binary, counts binary, best binary").write.parquet(rated)
    return spark.read.parquet(rated), slices, n


class Tables:
    """Some slices' pairs with their counts."""

    def __init__(self, rows: list[dict], slices: int) -> None:
        self.slices, self.held = slices, {}
        for row in rows:
            keys = np.frombuffer(row["keys"], dtype=np.int64)
            best = np.unpackbits(np.frombuffer(row["best"], dtype=np.uint8), count=len(keys)).astype(bool)
            self.held[row["slice"]] = PerfectHash.unpacked(row["sizes"], row["bits"]), keys, np.frombuffer(row["counts"], dtype=np.int64), best

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, whether it is its B id's highest, and whether the pair is in a slice held here."""
        counts, best, known = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool), np.zeros(len(pairs), dtype=bool)
        of = (pairs & ((1 << _B_BITS) - 1)) % self.slices
        for k in np.unique(of).tolist():
            if k in self.held:
                hash_, keys, told, rated = self.held[k]
                own = np.flatnonzero(of == k)
                at = hash_.numbers(pairs[own])
                if not np.array_equal(keys[at], pairs[own]):
                    raise ValueError("a pair was not counted: the texts changed between the passes")
                counts[own], best[own], known[own] = told[at], rated[at], True
        return counts, best, known


_MADE: dict[str, Tables] = {}


def _tables(shared: tuple[str, list[dict], int]) -> Tables:
    """The tables of a broadcast, unpacked once in a process; those of an earlier one are let go."""
    name, rows, slices = shared
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Tables(rows, slices)
    return _MADE[name]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _answered(pairs: np.ndarray, bounds: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: its links with the highest counts, the sum of its links' counts, and the links to look up elsewhere."""
    found, of = np.unique(pairs, return_inverse=True)
    counts, best, known = tables.look_up(found)
    missing = ~known[of]
    if missing.any():
        at = _per_text(missing, bounds)
        cuts = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(at)))
        packed = pairs[missing]
        left = [packed[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    else:
        left = [b""] * (len(bounds) - 1)
    return _per_text(best[of], bounds), _per_text(counts[of], bounds), left


def _align(id_field: pa.Field, files: Broadcast, shared: Broadcast):
    schema = pa.schema([id_field, *((c, pa.int64()) for c in _COUNTS), ("groups", pa.large_string()), ("left", pa.large_binary())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = _ready(files.value).align(part.column("text"))
        bounds = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(made.n_links)))
        n_best, count_sum, left = _answered(made.links(), bounds, _tables(shared.value))
        columns = [made.n_a, made.n_b, made.n_links, made.n_links, n_best, count_sum]
        told = [pa.array(made.groups(), pa.large_string()), pa.array(left, pa.large_binary())]
        return pa.RecordBatch.from_arrays([part.column(id_field.name), *(pa.array(c, pa.int64()) for c in columns), *told], schema=schema)

    return by_chunk(work, most=TEXT_BYTES)


def _look_further(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.as_py() for x in batch.column("left")]
            bounds = np.cumsum([0, *(len(x) // 8 for x in packed)])
            n_best, count_sum, left = _answered(np.frombuffer(b"".join(packed), dtype=np.int64), bounds, _tables(shared.value))
            told = {"n_best": n_best, "count_sum": count_sum}
            columns = [pa.array(np.asarray(batch.column(c)) + told[c], pa.int64()) if c in told else batch.column(c) for c in batch.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left, batch.schema.field("left").type)], schema=batch.schema)

    return run


def alignments(docs: DataFrame, byte_file: str, piece_file: str, *, broadcast_pairs: int = BROADCAST_PAIRS, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """Of every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups, `a1,a2|b1;a3|b2,b3`."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    files = tokenizer_files(spark, byte_file, piece_file)
    tables, slices, _ = pair_tables(texts, files, slice_pairs)
    sizes = sorted((r["slice"], r["n"]) for r in tables.select("slice", F.expr("octet_length(keys) div 8").alias("n")).collect())
    parts, held = [[]], 0
    for k, n in sizes:
        if held and held + n > broadcast_pairs:
            parts.append([])
            held = 0
        parts[-1].append(k)
        held += n
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, groups string, left binary"
    made = None
    for k, part in enumerate(parts):
        # Bounded by broadcast_pairs, or one slice.
        rows = tables.where(F.col("slice").isin(part)).toArrow().to_pylist() if part else []
        shared = spark.sparkContext.broadcast((scratch_folder(spark, "tables"), rows, slices))
        if made is None:
            made = texts.mapInArrow(_align(pa.field("doc_id", to_arrow_type(id_type)), files, shared), schema)
        else:
            path = scratch_folder(spark, "alignment-left")
            made.write.parquet(path)
            made = spark.read.parquet(path).mapInArrow(_look_further(shared), schema)
    return made.drop("left")


def digests(docs: DataFrame, byte_file: str = f"{FOLDER}/{BYTE_FILE}", piece_file: str = f"{FOLDER}/{PIECE_FILE}") -> DataFrame:
    """alignments() with a hash of the groups in their place; '' without tokens."""
    made = alignments(docs, byte_file, piece_file)
    return made.select("doc_id", *_COUNTS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))

"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: every task cuts the n-grams of its texts into slices by hash and sends each slice
once, packed; a slice's reducer adds the counts up, so no n-gram is a row and none is hot.

The filter is cut into slices, and each slice's reducer builds its own part, as large as its
steps need: an n-gram whose count reaches the j-th step of a growing scale is stored once for
each of the steps 1 to j, and a reader probes steps upwards until one is missing.

A filter that surely fits into `filter_bits` is broadcast whole, and every task probes it. The
parts of a larger one stay where they are built: texts are kept in chunks of bounded size, all
chunks, also those of held-out texts, send their n-grams to the slices, each slice builds the
same part from the same counts and answers every chunk by probing it, and a chunk puts the
answers back to its tokens. Both ways read the same bits, so scores don't depend on
`filter_bits`; no n-gram is left out at either size.

Scoring: a word's probability mixes its share after two words, after one, and overall
(Jelinek-Mercer). Mixture weights depend on how often the context was seen and are fitted by
expectation-maximisation over all training tokens, each taken out of its own counts: tokens
are added up by context classes and by the ratios of their shares in steps of a quarter
factor 2, so the driver gets at most (CLASSES * (RATIOS + 1)) ** 2 numbers at any size.
Numerators use a step's least count and denominators its greatest, so shares sum to 1 at most.

The base score (unigrams, add one) uses exact counts: beside a filter, those of the most
frequent words come broadcast and the others by a join on word fingerprints.

A null or empty text is one end token. A null id counts as the empty text in the split.
Repeated rows count each. An empty training set gives probability 1 / 2 to every token.
Words are known by 64-bit fingerprints, n-grams by their slice and 32 bits: as slices hold
about `SLICE_CHARS` of text at any size, an n-gram shares its name with another of its slice
with a chance under 1 in 1,000, less often than a probe of the filter errs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.frames import by_chunk, id_remainder
from plumeria.llm.words import chunks, mix, word_hashes
from plumeria.session import cut_lineage

#: Fixed values of the contract.
FOLDS, HELD_OUT = 7, 2

ORDER = 3
FILTER_BITS = 1 << 28
#: Bits that a stored step sets, all in one 64-bit word, and filter bits that are kept for it.
PROBES = 5
ROOM = 12
STEP = 1.15
LEAST_SLICES = 256
SLICE_CHARS = 8 << 20
PACKED = 4
#: N-grams that a counting task holds before it sends them on.
HELD_GRAMS = 3 << 20
#: Bytes of text of a chunk; one longer text is a chunk alone.
HELD_BYTES = 6 << 20
#: Words whose exact counts are broadcast.
TOP_WORDS = 1 << 20
#: Context classes; steps of a factor 2, least exponent and number of the ratios by which tokens are added up.
CLASSES = 20
RATIO_STEPS, LEAST_RATIO, RATIOS = 4, -48, 192

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_UNI, _PAIR, _STEP_SALT = np.uint64(0x6C62272E07BB0143), np.uint64(0x9FB21C651E98DF25), np.uint64(0x9E3779B97F4A7C15)


def count_scale(step: float = STEP, most: float = 2.0**62) -> np.ndarray:
    """Counts 1, 2, 3, ... that grow by `step` at least; the last is beyond any count."""
    scale = [1]
    while scale[-1] < most:
        scale.append(max(scale[-1] + 1, int(scale[-1] * step)))
    return np.array(scale, dtype=np.float64)


SCALE = count_scale()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, one end after each text; where each text begins."""
    words, starts = word_hashes(texts)
    starts = starts + np.arange(len(starts))
    out = np.full(starts[-1], END, dtype=np.uint64)
    inner = np.ones(starts[-1], dtype=bool)
    inner[starts[1:] - 1] = False
    out[inner] = words
    return out, starts


def grams(found: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For every token: its unigram, bigram and trigram; then the bigram and the unigram before it."""
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[starts[:-1]] = BEGIN
    second = np.empty_like(found)
    second[1:] = before[:-1]
    second[starts[:-1]] = BEGIN
    pair = lambda a, b: mix(a * _PAIR + b)
    context = pair(second, before)
    return [mix(found ^ _UNI), pair(before, found), pair(context, found), context, mix(before ^ _UNI)]


def _low(values: np.ndarray) -> np.ndarray:
    return values & np.uint64((1 << 8 * PACKED) - 1)


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // PACKED, 8), dtype=np.uint8)
    wide[:, :PACKED] = np.frombuffer(data, dtype=np.uint8).reshape(-1, PACKED)
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def _counter(slices: int):
    """Counts the n-grams of a task; sends them on when it holds many."""
    schema = pa.schema([("slice", pa.int64()), ("gram_order", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def sent(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {c: [] for c in schema.names}
        for order, arrays in enumerate(held, 1):
            if not arrays:
                continue
            found, counts = np.unique(np.concatenate(arrays), return_counts=True)
            edges = np.searchsorted(found >> np.uint64(64 - (slices - 1).bit_length()), np.arange(slices + 1, dtype=np.uint64))
            # Words are sent whole, as their exact counts are looked up by fingerprint.
            pack = (lambda x: x.astype("<u8").tobytes()) if order == 1 else _pack
            for k in np.flatnonzero(np.diff(edges)):
                part, n = found[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]]
                once = n == 1
                for c, v in zip(schema.names, (int(k), order, pack(part[once]), pack(part[~once]), n[~once].astype("<u4").tobytes())):
                    rows[c].append(v)
            arrays.clear()
        yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        size = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                found, starts = tokens(part.column("text"))
                made = grams(found, starts)
                for k in range(ORDER):
                    held[k].append(made[k])
                # Contexts at the beginning of a text are counted as if they were tokens, above order 1.
                first = starts[:-1]
                held[1] += [made[3][first], made[4][first]]
                size += ORDER * len(found)
                if size >= HELD_GRAMS:
                    yield from sent(held)
                    size = 0
        yield from sent(held)

    return run


def places(values: np.ndarray, step: int, words: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of a slice, and the bits in it, that a step of each value sets or probes."""
    key = mix(values + np.uint64(int(_STEP_SALT) * step % (1 << 64)))
    bits = np.uint64(1) << (key & np.uint64(63))
    for _ in range(PROBES - 1):
        key >>= np.uint64(6)
        bits |= np.uint64(1) << (key & np.uint64(63))
    return (key >> np.uint64(6)) % np.asarray(words, dtype=np.uint64), bits


def _add_up(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    values, counts = [], []
    unpack = (lambda x: np.frombuffer(x, dtype="<u8").astype(np.uint64)) if order == 1 else _unpack
    for once, more, n, o in zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts", "gram_order"))):
        if o == order:
            values += [unpack(once), unpack(more)]
            counts += [np.ones(len(values[-2]), dtype=np.int64), np.frombuffer(n, dtype="<u4").astype(np.int64)]
    if not values:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found, at = np.unique(np.concatenate(values), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _part(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The part of the filter that holds a slice's n-grams: values and counts by order."""
    steps = [np.searchsorted(SCALE, n, side="right") for _, n in counted]
    words = np.zeros(1 + ROOM * sum(int(s.sum()) for s in steps) // 64, dtype=np.uint64)
    for (values, _), top in zip(counted, steps):
        values = _low(values)
        for step in range(1, int(top.max(initial=0)) + 1):
            values, top = values[top >= step], top[top >= step]
            np.bitwise_or.at(words, *places(values, step, len(words)))
    return words


def _build_slice(table: pa.Table) -> pa.Table:
    """One slice's part of the filter, its words and their counts."""
    counted = [_add_up(table, order) for order in range(1, ORDER + 1)]
    found, counts = counted[0]
    return pa.table(
        {
            "slice": pa.array([table.column("slice")[0].as_py()], pa.int64()),
            "bits": pa.array([_part(counted).astype("<u8").tobytes()], pa.binary()),
            "words": pa.array([found.view(np.int64)], pa.list_(pa.int64())),
            "counts": pa.array([counts], pa.list_(pa.int64())),
        }
    )


@dataclass(frozen=True)
class Filter:
    """Parts of the filter as 64-bit words; level() says up to which step a value is stored.

    `starts` tells where the part of each of the slices begins and where the last ends. With one
    slice, values are looked up in that part whatever slice they belong to.
    """

    data: np.ndarray
    slices: int
    starts: np.ndarray

    def stored(self, values: np.ndarray, step: int) -> np.ndarray:
        own = values >> np.uint64(64 - (self.slices - 1).bit_length()) if self.slices > 1 else np.zeros(len(values), dtype=np.uint64)
        base, words = self.starts[:-1].astype(np.uint64)[own], np.diff(self.starts)[own]
        at, bits = places(_low(values), step, words)
        return self.data[base + at] & bits == bits

    def level(self, values: np.ndarray) -> np.ndarray:
        """Most values are missing at once; the others are probed once for each distinct value."""
        levels = np.zeros(len(values), dtype=np.int64)
        known = np.flatnonzero(self.stored(values, 1))
        found, at = np.unique(values[known], return_inverse=True)
        own = np.ones(len(found), dtype=np.int64)
        live, step = np.arange(len(found)), 1
        while len(live):
            step += 1
            live = live[self.stored(found[live], step)]
            own[live] = step
        levels[known] = own[at]
        return levels


@dataclass(frozen=True)
class Model:
    """What workers need: the filter if there is one, totals, weights by context class, exact counts of frequent words."""

    filter: Filter | None
    train_tokens: int
    vocabulary: int
    pair_weight: np.ndarray
    triple_weight: np.ndarray
    top_words: np.ndarray
    top_counts: np.ndarray

    @property
    def cells(self) -> int:
        """What an overall share is out of: training tokens, and one more for every word and for the unknown."""
        return self.train_tokens + self.vocabulary + 1

    def shares(self, made: list[np.ndarray], less: int = 0) -> tuple[np.ndarray, ...]:
        """Of every token: overall share, share after one word, after two, and both context classes.

        `less` is taken off every count: 1 takes a training token out of its own counts.
        """
        uni, pair, triple = (self.filter.level(g) for g in made[:3])
        return self.shares_of(uni, pair, triple, self._before(uni, made[4], made[0]), self._before(pair, made[3], made[1]), less)

    def shares_of(self, uni: np.ndarray, pair: np.ndarray, triple: np.ndarray, before: np.ndarray, context: np.ndarray, less: int = 0) -> tuple[np.ndarray, ...]:
        """The same from levels: of the three n-grams, of the word before and of the two words before."""
        least = lambda level: np.maximum(np.where(level > 0, SCALE[np.maximum(level, 1) - 1], 0) - less, 0)
        most = lambda level: np.maximum(np.where(level > 0, SCALE[level] - 1, 0) - less, 0)
        one = (least(uni) + 1) / self.cells
        two = np.minimum(least(pair) / np.maximum(most(before), 1), 1)
        three = np.minimum(least(triple) / np.maximum(most(context), 1), 1)
        klass = lambda level: np.minimum(np.where(most(level) > 0, 1 + np.log2(np.maximum(most(level), 1)).astype(np.int64), 0), CLASSES - 1)
        return one, two, three, klass(before), klass(context)

    def _before(self, level: np.ndarray, wanted: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Levels of what stands before each token: known from the token before, but for a text's first."""
        out = np.empty_like(level)
        out[1:] = level[:-1]
        first = np.ones(len(level), dtype=bool)
        first[1:] = wanted[1:] != own[:-1]
        out[first] = self.filter.level(wanted[first])
        return out

    def log10(self, made: list[np.ndarray]) -> np.ndarray:
        if not self.train_tokens:
            return np.full(len(made[0]), np.log10(0.5))
        return self.mixed(*self.shares(made))

    def mixed(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, before: np.ndarray, context: np.ndarray) -> np.ndarray:
        w2, w3 = self.pair_weight[before], self.triple_weight[context]
        return np.log10(w3 * three + (1 - w3) * (w2 * two + (1 - w2) * one))


def _tally(one: np.ndarray, two: np.ndarray, three: np.ndarray, before: np.ndarray, context: np.ndarray) -> np.ndarray:
    """What the weights need of each token, as one number: both classes, and the steps of two and three over one.

    `one` is a count that is not yet divided by the cells, so a step does not depend on the totals.
    """

    def step(share: np.ndarray) -> np.ndarray:
        ratio = np.floor((np.log2(np.maximum(share, 1e-300) / one) - LEAST_RATIO) * RATIO_STEPS)
        return np.where(share > 0, np.clip(ratio, 0, RATIOS - 1) + 1, 0).astype(np.int64)

    return ((before * CLASSES + context) * (RATIOS + 1) + step(two)) * (RATIOS + 1) + step(three)


def _weights(tally: np.ndarray, n: np.ndarray, cells: float) -> tuple[np.ndarray, np.ndarray]:
    """By class, the weights of bigrams and of trigrams under which all training tokens are likeliest."""
    rest, three = np.divmod(tally, RATIOS + 1)
    rest, two = np.divmod(rest, RATIOS + 1)
    before, context = np.divmod(rest, CLASSES)
    ratio = lambda step: np.where(step > 0, cells * 2.0 ** ((step - 0.5) / RATIO_STEPS + LEAST_RATIO), 0)
    pair = _maximise(np.ones(len(n)), ratio(two), before, n)
    return pair, _maximise(pair[before] * ratio(two) + (1 - pair[before]), ratio(three), context, n)


def _maximise(one: np.ndarray, two: np.ndarray, klass: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """By class, the weight of `two` against `one` under which the n tokens are likeliest; class 0 has none."""
    weight = np.full(CLASSES, 0.3)
    weight[0] = 0
    total = np.bincount(klass, n, CLASSES)
    for _ in range(rounds):
        w = weight[klass]
        mine = w * two / np.maximum(w * two + (1 - w) * one, 1e-300)
        weight = np.where(total > 0, np.bincount(klass, n * mine, CLASSES) / np.maximum(total, 1), weight)
    return np.minimum(weight, 0.999)


def _slices(chars: int) -> int:
    return max(LEAST_SLICES, 1 << (chars // SLICE_CHARS).bit_length())


def fit(docs: DataFrame, slices: int = LEAST_SLICES, top_words: int = TOP_WORDS) -> tuple[Model, DataFrame]:
    """The model of the training documents, with a filter, and a table of all words (slice, words, counts)."""
    train = docs.where(id_remainder("doc_id", FOLDS) != HELD_OUT).select("doc_id", "text")
    counted = train.select("text").mapInArrow(_counter(slices), "slice long, gram_order int, once binary, more binary, counts binary")
    built = counted.groupBy("slice").applyInArrow(_build_slice, "slice long, bits binary, words array<bigint>, counts array<bigint>")
    built = cut_lineage(built)
    vocabulary = built.select("slice", "words", "counts")
    parts = built.select("slice", "bits").toArrow()
    held = {k: np.frombuffer(part.as_buffer(), dtype="<u8") for k, part in zip(parts.column("slice").to_pylist(), parts.column("bits"))}
    # A slice without n-grams is one empty word.
    held = [held.get(k, np.zeros(1, dtype=np.uint64)) for k in range(slices)]
    data, starts = np.concatenate(held), np.cumsum([0, *map(len, held)])
    del parts, held
    totals = built.select(
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("counts").cast("long").alias("v")
    ).agg(F.sum("n"), F.sum("v"))
    train_tokens, distinct = (x or 0 for x in totals.first())
    top, counts = _top(vocabulary, distinct, top_words)
    model = Model(Filter(data, slices, starts), train_tokens, distinct, np.zeros(CLASSES), np.zeros(CLASSES), top, counts)
    return _mixture(model, train) if train_tokens else model, vocabulary


def word_counts(vocabulary: DataFrame) -> DataFrame:
    """word (fingerprint), n: exact training counts."""
    return vocabulary.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def _top(vocabulary: DataFrame, distinct: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of all words, or of those above the least count that keeps them `most` at most."""
    words = word_counts(vocabulary)
    if distinct > most:
        tiers = words.groupBy(F.floor(F.log2("n") * 4).alias("tier")).count().collect()
        kept, least = 0, 0
        for tier in sorted(tiers, reverse=True):
            kept += tier["count"]
            if kept > most:
                least = tier["tier"] + 1
                break
        words = words.where(F.floor(F.log2("n") * 4) >= least)
    found = words.toArrow()
    word, n = np.asarray(found.column("word")).view(np.uint64), np.asarray(found.column("n"))
    order = np.argsort(word)
    return word[order], n[order]


def _mixture(model: Model, train: DataFrame) -> Model:
    """Fits the weights on all training tokens, each taken out of its own counts."""
    shared = train.sparkSession.sparkContext.broadcast(replace(model, train_tokens=0, vocabulary=0))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found, n = np.unique(_tally(*shared.value.shares(grams(*tokens(part.column("text"))), less=1)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["tally", "n"])

    return _fitted(model, train.select("text").mapInArrow(by_chunk(work), "tally long, n long"))


def _fitted(model: Model, tallies: DataFrame) -> Model:
    """The model with the weights that its added-up tokens (tally, n) make likeliest."""
    found = tallies.groupBy("tally").agg(F.sum("n").alias("n")).toArrow()
    tally, n = np.asarray(found.column("tally")), np.asarray(found.column("n"))
    # Sums depend on the order; rows come in any.
    order = np.argsort(tally)
    pair, triple = _weights(tally[order], n[order].astype(np.float64), model.cells)
    return replace(model, pair_weight=pair, triple_weight=triple)


def scores(docs: DataFrame, filter_bits: int = FILTER_BITS, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text."""
    blanks = F.length("text") - F.length(F.translate("text", " \t\n\v\f\r", ""))
    train = docs.where(id_remainder("doc_id", FOLDS) != HELD_OUT)
    chars, blank, rows = (x or 0 for x in train.agg(F.sum(F.length("text")), F.sum(blanks), F.count("*")).first())
    # A text has at most a word more than blanks, and an end; a token adds 3 n-grams and the beginning of a text 2, each a
    # step at most; every slice is rounded up to a word.
    steps = ORDER * (blank + 2 * rows) + 2 * rows
    slices = _slices(chars)
    if ROOM * steps + 64 * slices <= filter_bits:
        return _scores_by_filter(docs, slices, top_words)
    return _scores_by_shuffle(docs, slices)


def _scores_by_filter(docs: DataFrame, slices: int, top_words: int) -> DataFrame:
    model, vocabulary = fit(docs, slices, top_words)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        found, starts = tokens(part.column("text"))
        made = grams(found, starts)
        count, hit = _look_up(m, made[0])
        sums = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  every text has its end token
        columns = [
            part.column("doc_id"), pa.array(np.diff(starts), pa.int64()), pa.array(sums((count > 0).astype(np.int64)), pa.int64()),
            pa.array(sums(np.log10(count + 1.0)), pa.float64()), pa.array(sums(m.log10(made)), pa.float64()),
            *_rare(made[0], starts, ~hit),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "_base", "score", "_words", "_times"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(
        by_chunk(work), f"doc_id {id_type}, n_tokens long, n_known long, _base double, score double, _words array<bigint>, _times array<int>"
    )
    if model.vocabulary > len(model.top_words):
        scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
        words = scored.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_row", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
        rare = words.join(word_counts(vocabulary), "word").groupBy("_row").agg(
            F.sum("times").alias("_rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_rare_base")
        )
        scored = scored.join(rare, "_row", "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("_rare_known", F.lit(0)))
        scored = scored.withColumn("_base", F.col("_base") + F.coalesce("_rare_base", F.lit(0.0)))
    cells = float(np.log10(model.cells))
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * cells).alias("base_score"),
        "score",
    )


def _written(batch: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as compressed bytes, as they are kept and shuffled."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as stream:
        stream.write(batch)
    return out.getvalue().to_pybytes()


def _read(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's texts; those of training texts and of held-out ones are kept apart."""
    number = TaskContext.get().partitionId() << 32
    held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def sent(train: bool) -> pa.RecordBatch:
        nonlocal number
        number += 1
        data = _written(pa.Table.from_batches(held[train]).combine_chunks())
        held[train], size[train] = [], 0
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "train": [train], "data": [data]})

    for batch in batches:
        for part in chunks(batch, "text", HELD_BYTES // 2):
            for train in (True, False):
                own = part.filter(pc.invert(part.column("held_out")) if train else part.column("held_out"))
                if not own.num_rows:
                    continue
                if held[train] and size[train] + own.nbytes > HELD_BYTES:
                    yield sent(train)
                held[train].append(own)
                size[train] += own.nbytes
    for train in (True, False):
        if held[train]:
            yield sent(train)


def _put(values: np.ndarray, order: int) -> bytes:
    """Sorted distinct n-grams of a slice as gaps: bytes of equal weight side by side, as many as the widest gap needs.

    Only the highest bytes are far from random, so only these are compressed.
    """
    values = values if order == 1 else _low(values)
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return int(values[0]).to_bytes(8, "little") + len(values).to_bytes(4, "little") + bytes([width]) + planes[:-1].tobytes() + zlib.compress(planes[-1].tobytes(), 1)


def _take(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    first, n = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:12], "little")
    width, at = data[12], 13 + n * (data[12] - 1)
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[: width - 1] = np.frombuffer(data[13:at], dtype=np.uint8).reshape(width - 1, n)
    planes[width - 1] = np.frombuffer(zlib.decompress(data[at:]), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64) + np.uint64(first)


def _put_bytes(numbers: np.ndarray, width: int = 8) -> bytes:
    """Numbers, most of them small, in compressed bytes of equal weight side by side."""
    return zlib.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width].tobytes(), 1)


def _take_bytes(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<i8").reshape(-1)


@dataclass(frozen=True)
class _Grams:
    """The distinct n-grams of one order in a chunk, in the order in which slices get them."""

    values: np.ndarray
    counts: np.ndarray
    edges: np.ndarray
    single: np.ndarray
    at: np.ndarray | None

    @staticmethod
    def of(found: np.ndarray, order: int, slices: int, train: bool, inverse: bool = False) -> _Grams:
        """By slice, those that occur once and then the others; those of held-out texts count as once.

        Above order 1 n-grams are known, and ordered, by their slice and lowest bits.
        """
        if order > 1:
            top = np.uint64(64 - (slices - 1).bit_length())
            found = (found >> top << top) | _low(found)
        values, *at, counts = np.unique(found, return_inverse=inverse, return_counts=True)
        if not train:
            counts[:] = 1
        own = values >> np.uint64(64 - (slices - 1).bit_length())
        place = 2 * own + (counts > 1).astype(np.uint64)
        order = np.argsort(place, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        edges = np.searchsorted(place[order], 2 * np.arange(slices + 1, dtype=np.uint64))
        return _Grams(values[order], counts[order], edges, counts[order] == 1, back[at[0]] if inverse else None)


def _all_grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """grams() of texts; where each begins; and by order all n-grams that a slice is asked for."""
    found, starts = tokens(texts)
    made = grams(found, starts)
    first = starts[:-1]
    # Contexts at the beginning of a text are counted as if they were tokens, above order 1.
    return made, starts, [made[0], np.concatenate([made[1], made[3][first], made[4][first]]), made[2]]


def _asked(slices: int):
    """What every chunk sends to the slices."""
    schema = pa.schema([("slice", pa.int64()), ("chunk", pa.int64()), ("train", pa.bool_()), ("gram_order", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, train, data in zip(batch.column("chunk").to_pylist(), batch.column("train").to_pylist(), batch.column("data")):
                for order, asked in enumerate(_all_grams(_read(data).column("text").combine_chunks())[2], 1):
                    g = _Grams.of(asked, order, slices, train)
                    rows: dict[str, list] = {c: [] for c in schema.names}
                    for k in np.flatnonzero(np.diff(g.edges)):
                        v, n, once = (x[g.edges[k] : g.edges[k + 1]] for x in (g.values, g.counts, g.single))
                        for c, x in zip(schema.names, (int(k), chunk, train, order, _put(v[once], order), _put(v[~once], order), _put_bytes(n[~once]))):
                            rows[c].append(x)
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Builds a slice's part of the filter; answers every chunk with probed levels, of words with counts too; to one the totals."""
    columns = [table.column(c).to_pylist() for c in ("chunk", "train", "gram_order", "once", "more", "counts")]
    asked, counted = [], []
    for order in range(1, ORDER + 1):
        own = [r for r in zip(*columns) if r[2] == order]
        values, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for _, train, _, once, more, n in own:
            single = _take(once)
            values.append(np.concatenate([single, _take(more)]))
            counts.append(np.concatenate([np.full(len(single), int(train)), _take_bytes(n)]))
        ends = np.cumsum([0, *map(len, values[1:])])
        distinct, at = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
        asked.append(([r[0] for r in own], ends, distinct, at, total))
        # N-grams of held-out texts alone are asked for, not stored.
        counted.append((distinct[total > 0], total[total > 0]))
    words = _part(counted)
    part = Filter(words, 1, np.array([0, len(words)]))
    rows: list[tuple] = []
    slice_ = table.column("slice")[0].as_py()
    for order, (chunks_, ends, distinct, at, total) in enumerate(asked, 1):
        # A level of 255 stands for counts above 10 ** 15.
        told = np.minimum(part.level(distinct), 255)
        if order == 1:
            # A word's level is that of its count, but where the filter errs.
            told = total << 8 | told - np.minimum(np.searchsorted(SCALE, total, side="right"), 255)
        # The totals of a slice go with its first answer.
        totals = (int(total.sum()), int((total > 0).sum())) if order == 1 else (0, 0)
        for chunk, a, b in zip(chunks_, ends, ends[1:]):
            rows.append((chunk, slice_, order, _put_bytes(told[at[a:b]], 8 if order == 1 else 1), *totals))
            totals = (0, 0)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["chunk", "slice", "gram_order", "answer", "tokens", "words"])


def _with_contexts(uni: np.ndarray, pair: np.ndarray, triple: np.ndarray, starts: np.ndarray, first_context: np.ndarray, first_before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Levels of n-grams, and of what stands before each token: known from the token before, but for a text's first."""
    context, before = np.empty_like(pair), np.empty_like(uni)
    context[1:], before[1:] = pair[:-1], uni[:-1]
    context[starts[:-1]], before[starts[:-1]] = first_context, first_before
    return uni, pair, triple, before, context


def _put_back(slices: int):
    """Of a chunk and its answers: its texts with their base scores and the levels of their tokens; its tally; totals."""
    none = np.zeros(0, dtype=np.uint64)
    # Without totals: tallies do not depend on them.
    model = Model(None, 0, 0, np.zeros(CLASSES), np.zeros(CLASSES), none, none)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, train = _read(left.column("data")[0]), left.column("train")[0].as_py()
        made, starts, asked = _all_grams(texts.column("text").combine_chunks())
        right = right.sort_by("slice")
        told = []
        for order, found in enumerate(asked, 1):
            own = right.filter(pc.equal(right.column("gram_order"), order))
            answers = np.concatenate([_take_bytes(a, 8 if order == 1 else 1) for a in own.column("answer").to_pylist()])
            told.append(answers[_Grams.of(found, order, slices, train, inverse=True).at])
        n, rows = len(made[0]), len(starts) - 1
        count = told[0] >> 8
        uni = np.minimum(np.searchsorted(SCALE, count, side="right"), 255) + (told[0] & 255)
        levels = [uni, told[1][:n], told[2]]
        # The two contexts at the beginning of a text: of two tokens and of one.
        first = told[1][n : n + rows], told[1][n + rows :]
        tally, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if train:
            tally, times = np.unique(_tally(*model.shares_of(*_with_contexts(*levels, starts, *first), less=1)), return_counts=True)
        sums = lambda x: pa.array(np.add.reduceat(x, starts[:-1]))  # noqa: E731  every text has its end token
        at = pa.array(starts, pa.int64())
        columns = {"n_tokens": pa.array(np.diff(starts), pa.int64()), "n_known": sums((count > 0).astype(np.int64)), "_base": sums(np.log10(count + 1.0))}
        columns |= {f"_level{k}": pa.LargeListArray.from_arrays(at, pa.array(x.astype(np.uint8))) for k, x in enumerate(levels)}
        columns |= {"_context": pa.array(first[0]), "_before": pa.array(first[1])}
        out = texts.drop_columns("text")
        for c, x in columns.items():
            out = out.append_column(c, x)
        return pa.table(
            {
                "data": pa.array([_written(out.combine_chunks())], pa.binary()),
                "tally": pa.array([tally], pa.list_(pa.int64())),
                "n": pa.array([times], pa.list_(pa.int64())),
                "tokens": pa.array([pc.sum(right.column("tokens")).as_py()], pa.int64()),
                "words": pa.array([pc.sum(right.column("words")).as_py()], pa.int64()),
            }
        )

    return run


def _scores_by_shuffle(docs: DataFrame, slices: int) -> DataFrame:
    """Scores of a corpus whose filter may not fit into a broadcast: every chunk asks the parts of the filter."""
    texts = docs.select("doc_id", "text", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    kept = cut_lineage(texts.mapInArrow(_chunked, "chunk long, train boolean, data binary"))
    asked = kept.mapInArrow(_asked(slices), "slice long, chunk long, train boolean, gram_order int, once binary, more binary, counts binary")
    answers = asked.groupBy("slice").applyInArrow(_answer, "chunk long, slice long, gram_order int, answer binary, tokens long, words long")
    put = kept.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    put = cut_lineage(put.applyInArrow(_put_back(slices), "data binary, tally array<bigint>, n array<bigint>, tokens long, words long"))
    train_tokens, distinct = (x or 0 for x in put.agg(F.sum("tokens"), F.sum("words")).first())
    none = np.zeros(0, dtype=np.uint64)
    model = Model(None, train_tokens, distinct, np.zeros(CLASSES), np.zeros(CLASSES), none, none)
    if train_tokens:
        model = _fitted(model, put.select(F.explode(F.arrays_zip("tally", "n")).alias("t")).select("t.tally", "t.n"))
    cells = float(np.log10(model.cells))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                part = _read(data).combine_chunks().to_batches()[0]
                n_tokens = np.asarray(part.column("n_tokens"))
                starts = np.concatenate([[0], np.cumsum(n_tokens)])
                score = np.log10(0.5) * n_tokens
                if model.train_tokens:
                    levels = [np.asarray(part.column(f"_level{k}").flatten()).astype(np.int64) for k in range(ORDER)]
                    levels = _with_contexts(*levels, starts, np.asarray(part.column("_context")), np.asarray(part.column("_before")))
                    score = np.add.reduceat(model.mixed(*model.shares_of(*levels)), starts[:-1])
                columns = {c: part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")}
                columns["train_tokens"] = pa.array(np.full(len(n_tokens), model.train_tokens), pa.int64())
                columns["base_score"] = pa.array(np.asarray(part.column("_base")) - n_tokens * cells)
                columns["score"] = pa.array(score)
                yield pa.RecordBatch.from_pydict(columns)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return put.select("data").mapInArrow(work, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _look_up(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact counts of the words that are among the frequent, else 0, and whether they are."""
    if not len(model.top_words):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    found, at = np.unique(words, return_inverse=True)
    place = np.minimum(np.searchsorted(model.top_words, found), len(model.top_words) - 1)
    hit = model.top_words[place] == found
    return np.where(hit, model.top_counts[place], 0)[at], hit[at]


def _rare(words: np.ndarray, starts: np.ndarray, rare: np.ndarray) -> list[pa.Array]:
    """Of each text the distinct words outside the broadcast counts, and how often each occurs."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[rare]
    words = words[rare]
    order = np.lexsort((words, rows))
    rows, words = rows[order], words[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])
    at = np.flatnonzero(first)
    offsets = pa.array(np.searchsorted(rows[at], np.arange(len(starts))), pa.int32())
    values = words[at].view(np.int64), np.diff(np.append(at, len(rows))).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]

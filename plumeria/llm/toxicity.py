"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs and pairs with one word
between, in 2**18 places. FTRL-proximal keeps, for every place, a sum of gradients and a
learning rate of its own; L1 keeps a weight at zero until the evidence exceeds it, so what
is left is a short list of weights, at most one for each place: that bounds the broadcast.

Fitting reads a sample of the labelled rows, `sample_rows` in expectation, chosen by a hash
of the id. Their features are made in parallel; the descent itself is one task over them, in
the order of that hash. Scores read every word of every text.

A null or empty text has no features and gets the intercept's score, as has a model without
labelled rows (score 0.25). Repeated labels of a document count once, as the highest; null
labels teach nothing. Rows are scored one by one, so repeated rows get equal scores; a column
that already has the score's name is replaced. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumeria.llm.frames import bounded_broadcast, by_chunk, id_remainder
from plumeria.llm.words import mix, word_hashes

#: Fixed values of the contract.
FOLDS, HELD_OUT = 5, 0

BITS = 18
PLACES = 1 << BITS
SAMPLE_ROWS = 16_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
_PAIR, _SKIP, _ORDER = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47), np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Weights:
    """Weights of the places, as far as they aren't zero, and the intercept."""

    places: np.ndarray
    values: np.ndarray
    intercept: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of every word, pair and skip pair, repeats included."""
    words, starts = word_hashes(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(starts))
    out_rows, out = [rows], [words]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = rows[gap:] == rows[:-gap] if len(rows) > gap else np.zeros(0, dtype=bool)
        first, second = words[: len(same)][same], words[len(words) - len(same) :][same]
        out_rows.append(rows[: len(same)][same])
        out.append(mix(first * _ORDER + second + salt))
    return np.concatenate(out_rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << BITS | places)
    return both >> BITS, both & (PLACES - 1)


class Ftrl:
    """Per-coordinate FTRL-proximal for log loss over binary features; the last place is the intercept."""

    def __init__(self) -> None:
        self.z = np.zeros(PLACES + 1)
        self.n = np.zeros(PLACES + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == PLACES, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        before = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - before) / ALPHA * w


def _examples(part: pa.RecordBatch) -> pa.RecordBatch:
    rows, places = distinct(*features(part.column("text")))
    ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
    packed = pa.array([places[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([part.column("_order"), part.column("toxic"), packed], ["_order", "toxic", "places"])


def _learn(table: pa.Table) -> pa.Table:
    """Learns from all examples, in the order of a hash of the ids, several times over."""
    model = Ftrl()
    table = table.sort_by([("_order", "ascending"), ("places", "ascending")])
    labels, packed = table.column("toxic").to_pylist(), [x for c in table.column("places").chunks for x in c]
    for _ in range(EPOCHS):
        for label, places in zip(labels, packed):
            model.learn(np.append(np.frombuffer(places.as_buffer(), dtype=np.int32), PLACES), label)
    w = model.weights(np.arange(PLACES + 1))
    kept = np.flatnonzero(w)
    return pa.table({"place": pa.array(kept, pa.int64()), "weight": pa.array(w[kept], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Weights:
    """Learns from the labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(id_remainder("_id", FOLDS) != HELD_OUT)
    total = known.agg(F.count("*"), F.sum("toxic")).first()
    share = min(1.0, sample_rows / max(1, total[0]))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 40))
    known = known.withColumn("_order", draw).where(F.col("_order") < F.lit(int(share * (1 << 40))))
    known = bounded_broadcast(known, int(share * total[0]))
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).select("_order", "toxic", "text")
    examples = rows.mapInArrow(by_chunk(_examples), "_order long, toxic int, places binary")
    # One task, as each step needs the one before; its rows are bounded by the sample.
    learned = examples.groupBy(F.lit(0).alias("_all")).applyInArrow(_learn, "place long, weight double").toArrow()
    places, values = (np.asarray(learned.column(c)) for c in ("place", "weight"))
    base = ((total[1] or 0) + 0.5) / (total[0] + 2)
    intercept = values[places == PLACES].sum() if (places == PLACES).any() else np.log(base / (1 - base))
    return Weights(places[places < PLACES], values[places < PLACES].astype(np.float32), float(intercept))


def score(docs: DataFrame, model: Weights, name: str = "toxicity") -> DataFrame:
    """The documents with the model's probability for each whole text."""
    dense = np.zeros(PLACES, dtype=np.float32)
    dense[model.places] = model.values
    shared = docs.sparkSession.sparkContext.broadcast(dense)
    intercept = model.intercept
    docs = docs.drop(name)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        weights = shared.value
        rows, places = features(part.column("text"))
        told = weights[places] != 0
        rows, places = distinct(rows[told], places[told])
        sums = np.bincount(rows, weights[places], part.num_rows) + intercept
        return part.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64()))

    return docs.mapInArrow(by_chunk(work), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return found.select(
        "doc_id",
        (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

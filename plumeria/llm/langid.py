"""Language identification of documents that may mix languages.

Every language is a distribution over hashed byte trigrams inside words, counted over all
training texts. A document is a mixture: expectation-maximisation estimates the share of
each language, then languages are taken in the order of their shares as long as the
likelihood of the refitted mixture gains more than a penalty that grows with the logarithm
of the text's length. The prediction is the language with the largest share in the chosen
set, the score is that share.

The model is one row of 2**16 numbers per language, which bounds the broadcast by the number
of languages. Tasks send their counts once per language, cut into segments, so a language
with most of the rows is no large group.

A null text, or one without a letter, is `und` with score 0 and no languages; so is every
text if nothing was learned. A null lang teaches nothing; a null id counts as the empty text
in the split. Ties go to the language that sorts first. Rows are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumeria.llm.frames import by_chunk, id_remainder
from plumeria.llm.words import chunks, text_bytes

#: Fixed values of the contract.
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"

BITS = 16
PLACES = 1 << BITS
SEGMENTS = 16
SMOOTHING = 0.5
ROUNDS, REFIT_ROUNDS = 10, 6
#: Each further language must raise the log-likelihood by this times the logarithm of the number of trigrams.
PENALTY = 4.0
LEAST_SHARE = 0.02

_SPACE = 32
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[:65] = _MAP[91:97] = _MAP[123:128] = _SPACE
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of every trigram whose middle belongs to a word; texts are padded with spaces."""
    data, offsets = text_bytes(texts)
    lengths = np.diff(offsets)
    padded = np.full(len(data) + len(lengths) + 1, _SPACE, dtype=np.uint8)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    at = np.arange(len(data)) + rows + 1
    padded[at] = _MAP[data]
    inner = padded[at] != _SPACE
    at, rows = at[inner], rows[inner]
    code = padded[at - 1].astype(np.uint32) << 16 | padded[at].astype(np.uint32) << 8 | padded[at + 1]
    return rows, (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    data, offsets = text_bytes(texts)
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(map(str.isalpha, texts[int(k)].as_py()))
    return found


@dataclass(frozen=True)
class Languages:
    """Names in order, and for each place and language the trigram's probability."""

    names: list[str]
    chances: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(PLACES, dtype=np.int64))
    for batch in batches:
        for part in chunks(batch, "text"):
            langs = part.column("lang").dictionary_encode()
            rows, places = trigrams(part.column("text"))
            of = np.asarray(langs.indices)[rows]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                sums[lang] += np.bincount(places[of == k], minlength=PLACES)
    rows = [(lang, k, piece.tobytes()) for lang, n in sums.items() for k, piece in enumerate(np.split(n, SEGMENTS))]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary()))], ["lang", "segment", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("counts"))
    return pa.table({"lang": table.column("lang")[:1], "segment": table.column("segment")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame) -> Languages:
    """Learns from texts and languages of the documents outside the held-out fold."""
    train = docs.where((id_remainder("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull()).select("text", "lang")
    counts = train.mapInArrow(_count, "lang string, segment int, counts binary")
    table = counts.groupBy("lang", "segment").applyInArrow(_sum, "lang string, segment int, counts binary").toArrow()
    found: dict[str, np.ndarray] = {}
    for lang, segment, piece in zip(*(c.to_pylist() for c in table.columns)):
        found.setdefault(lang, np.zeros((SEGMENTS, PLACES // SEGMENTS)))[segment] = np.frombuffer(piece, dtype=np.int64)
    names = sorted(found)
    if not names:
        return Languages([], np.zeros((PLACES, 0), dtype=np.float32))
    n = np.stack([found[x].reshape(-1) for x in names], axis=1) + SMOOTHING
    return Languages(names, (n / n.sum(axis=0)).astype(np.float32))


def _mixtures(rows: np.ndarray, chances: np.ndarray, times: np.ndarray, total: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds of expectation-maximisation, and each text's log-likelihood."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    own = rows[starts]
    for _ in range(rounds):
        joint = chances * shares[rows]
        joint *= (times / joint.sum(axis=1))[:, None]
        shares = shares.copy()
        shares[own] = np.add.reduceat(joint, starts, axis=0) / total[own, None]
    likely = np.log((chances * shares[rows]).sum(axis=1)) * times
    return shares, np.bincount(rows, likely, len(shares))


def shares_of(texts: pa.Array, model: Languages) -> np.ndarray:
    """For each text the share of every language, 0 for those outside the chosen set and for `und`."""
    n, width = len(texts), len(model.names)
    out = np.zeros((n, width), dtype=np.float32)
    rows, places = trigrams(texts)
    told = has_letter(texts)
    keep = told[rows]
    both, times = np.unique(rows[keep] << BITS | places[keep], return_counts=True)
    if not width or not len(both):
        return out
    rows, places = both >> BITS, both & (PLACES - 1)
    chances, times = model.chances[places], times.astype(np.float32)
    total = np.bincount(rows, times, n).astype(np.float32)
    shares, _ = _mixtures(rows, chances, times, total, np.full((n, width), 1 / width, dtype=np.float32), ROUNDS)
    order = np.argsort(-shares, axis=1, kind="stable")
    # The best single language, then one more at a time for texts that gain enough.
    single = np.zeros_like(shares)
    np.put_along_axis(single, order[:, :1], 1, axis=1)
    best, (_, likely) = single, _mixtures(rows, chances, times, total, single, 0)
    live = total > 0
    for size in range(2, width + 1):
        live = live & (np.take_along_axis(shares, order[:, size - 1 : size], axis=1)[:, 0] >= LEAST_SHARE)
        if not live.any():
            break
        pick = live[rows]
        start = np.zeros_like(shares)
        np.put_along_axis(start, order[:, :size], np.take_along_axis(shares, order[:, :size], axis=1), axis=1)
        start[~live] = single[~live]
        start /= start.sum(axis=1, keepdims=True)
        tried, gained = _mixtures(rows[pick], chances[pick], times[pick], total, start, REFIT_ROUNDS)
        better = live & (gained - likely > PENALTY * np.log(np.maximum(total, 2)))
        best, likely = np.where(better[:, None], tried, best), np.where(better, gained, likely)
        live = better
    out[total > 0] = best[total > 0]
    return out


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """The documents with lang_pred, score, langs and lang_shares; columns of these names are replaced."""
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("langs", T.ArrayType(T.StringType())), ("lang_shares", T.ArrayType(T.DoubleType()))]
    docs = docs.drop(*(name for name, _ in added))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        shares = shares_of(part.column("text"), m).astype(float)
        order = np.argsort(-shares, axis=1, kind="stable")
        sets = [[(m.names[k], s[k]) for k in o if s[k] > 0] for o, s in zip(order, shares)]
        columns = [
            pa.array([s[0][0] if s else UNKNOWN for s in sets], pa.string()),
            pa.array([min(1.0, s[0][1]) if s else 0.0 for s in sets], pa.float64()),
            pa.array([[x for x, _ in s] for s in sets], pa.list_(pa.string())),
            pa.array([[float(x) for _, x in s] for s in sets], pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *(name for name, _ in added)])

    return docs.mapInArrow(by_chunk(work), T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in added)]))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs for every document."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "langs")

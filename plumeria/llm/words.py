"""Word and shingle fingerprints of whole Arrow text columns, without a loop over rows.

Words are the runs of bytes that are no ASCII white space (space, tab to carriage
return), after lower-casing A-Z. UTF-8 never uses these bytes inside another
character, so splitting bytes equals splitting code points. A word's fingerprint is
a 64-bit polynomial in its bytes, mixed with its length; a shingle's is mixed from
those of its words in order. Fingerprints depend on nothing but the text, so they
agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 1 << 21
#: Bytes whose words are named at once; one longer word is named alone.
PIECE_BYTES = (1 << 16) - 1
_BASE = 0x9E3779B97F4A7C15 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_PLACE = np.random.default_rng(19991231).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = [_powers(PIECE_BYTES + 1)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2 ** 64."""
    if n > len(_POWERS[0][0]):
        _POWERS[0] = _powers(1 << (n - 1).bit_length())
    return _POWERS[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_bytes(texts)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts; begin and end of every word in them; the first word of each text and the number of words."""
    data, offsets = text_bytes(texts)
    solid = np.empty(len(data) + 1, dtype=bool)
    solid[:-1] = ~_SPACE[data]
    solid[-1] = False
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = solid[bounds]
    begin = np.flatnonzero(first)
    last = solid[:-1] & ~solid[1:]
    inner = bounds[bounds > 0]
    last[inner - 1] = solid[inner - 1]
    end = np.flatnonzero(last) + 1
    return data, begin, end, np.searchsorted(begin, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and the first word of each text and the number of words."""
    data, begin, end, starts = word_spans(texts)
    out = np.empty(len(begin), dtype=np.uint64)
    a = 0
    while a < len(begin):
        # A word's fingerprint does not depend on its place, so pieces may begin at any word.
        b = max(a + 1, int(np.searchsorted(end, begin[a] + PIECE_BYTES, side="right")))
        piece, first, last = data[begin[a] : end[b - 1]], begin[a:b] - begin[a], end[a:b] - begin[a]
        # Powers for one very long word are not kept.
        up, down = (powers if len(piece) <= PIECE_BYTES else _powers)(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_LOWER[piece] * up[: len(piece)], out=total[1:])
        out[a:b] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    return out, starts


def shingle_hashes(words: np.ndarray, starts: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-word shingles in order, and where each text's begin.

    A text of 1 to n - 1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(starts)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(at[-1], dtype=np.uint64)
    long = counts >= n
    if long.any():
        # The k-th shingle of a text begins at its k-th word.
        row = np.repeat(np.arange(len(counts)), np.where(long, made, 0))
        place = np.arange(len(row)) - np.repeat(np.cumsum(np.where(long, made, 0)) - np.where(long, made, 0), np.where(long, made, 0))
        word = starts[row] + place
        total = np.full(len(word), n, dtype=np.uint64)
        for k in range(n):
            total += mix(words[word + k] + _PLACE[k]) * _PLACE[k]
        out[at[row] + place] = mix(total)
    for row in np.flatnonzero((counts > 0) & ~long):
        part = words[starts[row] : starts[row + 1]]
        place_hash = mix(part + _PLACE[: len(part)]) * _PLACE[: len(part)]
        out[at[row]] = mix(place_hash.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
    return out, at

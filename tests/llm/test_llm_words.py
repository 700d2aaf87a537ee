"""Words and shingles of byte columns against the regular expression."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeria.llm import words
from plumeria.llm.words import chunks, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles_of(text, n=5):
    w = words_of(text)
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAbÉé \t\n\x0b\x1c 漢", max_size=30), max_size=8))
def test_words_and_shingles_follow_the_expression(texts):
    words, starts = word_hashes(pa.array(texts, pa.string()))
    shingles, at = shingle_hashes(words, starts)
    seen = {}
    for k, text in enumerate(texts):
        own = words[starts[k] : starts[k + 1]].tolist()
        assert len(own) == len(words_of(text))
        assert all(seen.setdefault(w, h) == h for w, h in zip(words_of(text), own))
        assert len(shingles[at[k] : at[k + 1]]) == len(shingles_of(text))
        assert all(seen.setdefault(s, h) == h for s, h in zip(shingles_of(text), shingles[at[k] : at[k + 1]].tolist()))
    assert len(set(seen.values())) == len(seen)


def test_chunks_hold_all_rows_in_order_and_bounded_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 30, 2, 2, 9)]})
    parts = list(chunks(batch, "text", 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 10 for p in parts)


def test_sliced_columns_start_anywhere():
    texts = pa.array(["one two", None, "", "three", "four five six"])
    whole, starts = word_hashes(texts)
    part, part_starts = word_hashes(texts.slice(3))
    assert part.tolist() == whole[starts[3] :].tolist() and part_starts.tolist() == [0, 1, 4]


def test_fingerprints_do_not_depend_on_the_place(monkeypatch):
    """Pieces of few bytes, words longer than a piece, and bytes of several units give the same fingerprints."""
    texts = pa.array(["A b\tcc  " + "é" * 50 + " b", None, "", "x" * 300 + " a", "  "])
    whole, starts = words.word_hashes(texts)
    monkeypatch.setattr(words, "PIECE_BYTES", 7)
    pieces, same = words.word_hashes(texts)
    assert (whole == pieces).all() and (starts == same).all()
    assert whole[0] == whole[-1] and whole[1] == whole[4] and len(set(whole.tolist())) == 5

"""Repeated windows against comparing all windows of small texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumeria.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs):
    found = {}
    big = 1 << 63
    number = {i: k for k, i in enumerate(sorted({d[0] for d in docs if d[0] is not None}))}
    words = [(number.get(i, big), WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            found[key] = min(found.get(key, big), i)
    out = []
    for (doc_id, _), (i, w) in zip(docs, words):
        gone = set()
        for p in range(len(w) - 12):
            if found[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def fixture(seed=5, n=60):
    random.seed(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "\U0001f600", "Case", "case", "a,b"]
    text = lambda n: [random.choice(words) for _ in range(n)]
    passages = [text(random.randrange(10, 70)) for _ in range(12)]
    passages += [["run"] * k for k in (6, 12, 13, 14, 30)] + [["x", "y"] * 12, ["x", "y", "z"] * 9, ["b"] + ["a"] * 12, ["a"] * 12 + ["b"]]
    docs = []
    for k in range(n):
        made = []
        for _ in range(random.randrange(5)):
            made += text(random.randrange(0, 25)) + random.choice(passages)
        space = random.choice([" ", "\n", " \t ", "\x0b", "\x0c\r"])
        docs.append((k * 7 % n, space.join(made) + random.choice(["", " ", "\n"])))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), docs[3], docs[3], (None, docs[4][1]), (None, docs[4][1]), (205, docs[5][1]), (-1, docs[6][1])]
    docs += [(300 + k, " ".join(["same"] * 40)) for k in range(3)] + [(400 + k, " ".join(passages[0] + passages[0])) for k in range(3)]
    return docs


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("chunk_bytes", [repeats.CHUNK_BYTES, 700])
def test_equals_comparing_all_windows(spark, seed, chunk_bytes):
    docs = fixture(seed)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, chunk string, bucket int").repartition(3)
    got = repeats.without_repeats(frame, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(docs)))


def test_ids_of_text_by_their_order(spark):
    docs = [(None if i is None else f"id{i:05d}" if i >= 0 else "", t) for i, t in fixture(9)]
    got = repeats.without_repeats(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs)))


def test_other_windows(spark):
    docs = [(1, "a b c d e f"), (2, "x b c d y"), (3, "c d e")]
    got = {r.doc_id: r.kept_text for r in repeats.without_repeats(spark.createDataFrame(docs, "doc_id int, text string"), window=3).collect()}
    assert got == {1: "a b c d e f", 2: "x y", 3: ""}


def test_an_empty_table_has_no_rows(spark):
    assert repeats.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_very_long_text_and_a_passage_of_all_documents(spark):
    random.seed(1)
    long = " ".join(f"v{random.randrange(50000)}" for _ in range(200_000))
    passage = " ".join(f"p{k}" for k in range(55))
    docs = [(0, long), (1, "start " + long[300_000:700_000] + " end")] + [(k, f"a{k} {passage} b{k}") for k in range(2, 400)]
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), chunk_bytes=1 << 14).collect()}
    assert got[0].n_removed == 0 and got[0].kept_text == long
    assert got[1].n_removed >= len(long[300_000:700_000].split()) - 2
    assert got[2].n_removed == 0 and all(got[k].kept_text == f"a{k} b{k}" for k in range(3, 400))


def test_equal_windows_hold_equal_symbols():
    """A symbol whose support lies in a window is there wherever the window's words stand."""
    random.seed(2)
    for _ in range(200):
        inner = [random.choice("abc") for _ in range(13)]
        texts = [" ".join([random.choice("abc") for _ in range(random.randrange(9))] + inner + [random.choice("abc") for _ in range(random.randrange(9))]) for _ in range(2)]
        found = []
        for text in texts:
            *_, words, starts = repeats.words(pa.array([text]))
            at = next(p for p in range(len(words) - 12) if text.split()[p : p + 13] == inner)
            made = repeats.recompressed(words, starts)
            inside = (made.low >= at) & (made.high <= at + 13)
            found.append(sorted(zip(made.name[inside].tolist(), (made.low[inside] - at).tolist())))
        assert found[0] == found[1]


def test_most_windows_hold_a_symbol(folder):
    texts = pq.read_table(f"{folder}/documents.parquet").column("text").combine_chunks()
    *_, words, starts = repeats.words(texts)
    made = repeats.recompressed(words, starts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    cover = np.zeros(len(words) + 1, dtype=int)
    np.add.at(cover, np.maximum(made.high - 13, 0), 1)
    np.add.at(cover, made.low + 1, -1)
    at = np.flatnonzero(doc[: len(words) - 12] == doc[12:])
    assert (np.cumsum(cover)[at] > 0).mean() > 0.9 and len(made.name) < 0.5 * len(words)

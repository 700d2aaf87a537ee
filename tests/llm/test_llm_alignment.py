"""Alignments against walking both token lists, and the perfect hash by itself."""

import hashlib
import os
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumeria.llm import alignment

BYTE, PIECE = (os.path.join(alignment.FOLDER, x) for x in (alignment.BYTE_FILE, alignment.PIECE_FILE))
EXTRA = [
    (9001, None),
    (9002, ""),
    (9003, " "),
    (9004, "a▁b"),
    (9005, "<s> <|endoftext|> </s> é\U0001f600\0x <0x41>"),
    (9006, "x" * 3000),
    (9007, "\t\n  a  b "),
    (9007, "\t\n  a  b "),
    (None, "Hello world"),
    (9008, "don't WE'LL 12345 ½ \r\n\r\n x ก็ 日本語"),
]


def ends(spelled):
    return np.cumsum([len(x) for x in spelled]).tolist()


def brute(rows):
    a_, b_ = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_.encode_special_tokens = True
    byte = alignment._byte_of_character()
    cut, counts, best = [], Counter(), Counter()
    for i, text in rows:
        a = a_.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_.encode(text) if text else []
        spelled_a = [bytes(byte[c] for c in a_.id_to_token(x)) for x in a]
        spelled_b = [bytes([int(b_.id_to_piece(x)[3:5], 16)]) if b_.is_byte(x) else b_.id_to_piece(x).replace("▁", " ").encode() for x in b]
        groups, links, x, y = [], [], 0, 0
        if text and b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            ends_a, ends_b = ends(spelled_a), ends(spelled_b)
            for end in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
                links.append((a[p - 1], b[q - 1]))
                x, y = p, q
        else:
            a = b = []
        counts.update(links)
        cut.append((i, len(a), len(b), ";".join(groups), links))
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, n_a, n_b, len(l), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), g) for i, n_a, n_b, g, l in cut]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").limit(60).select("doc_id", "text").unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string"))


@pytest.mark.parametrize("limits", [{}, {"broadcast_pairs": 300, "slice_pairs": 200}])
def test_equals_walking_both_lists(spark, docs, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(alignment, "SHARED", 0.01)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    frame = docs.selectExpr("*", "'x' AS slice", "1 AS pair", "2 AS node", "3 AS left", "4 AS n_a").repartition(12)
    got = alignment.alignments(frame, BYTE, PIECE, **limits)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_digests(spark, docs):
    expected = {(r[0], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert {(r.doc_id, r.groups_sha256) for r in alignment.digests(docs).collect()} == expected


def test_tables_hold_every_pair(spark, docs):
    tables, slices, n = alignment.pair_tables(docs, alignment.tokenizer_files(spark, BYTE, PIECE), 200)
    held = alignment.Tables([r.asDict() for r in tables.collect()], slices)
    counts = sum(int(c.sum()) for _, _, c, _ in held.held.values())
    assert sum(len(k) for _, k, _, _ in held.held.values()) == n
    assert counts == sum(r[4] for r in brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 50, 20000))
    made = alignment.PerfectHash.of(keys)
    assert sorted(made.numbers(keys).tolist()) == list(range(len(keys)))
    again = alignment.PerfectHash.unpacked(*made.packed())
    assert np.array_equal(again.numbers(keys), made.numbers(keys))
    assert len(made.bits) < 5 * len(keys)


def test_a_pair_that_was_not_counted_fails():
    keys = np.array([1, 2, 3], dtype=np.int64)
    made = alignment.PerfectHash.of(keys)
    order = np.empty_like(keys)
    order[made.numbers(keys)] = keys
    sizes, bits = made.packed()
    row = {"slice": 0, "sizes": sizes, "bits": bits, "keys": order.tobytes(), "counts": keys.tobytes(), "best": b"\xff"}
    with pytest.raises(ValueError, match="not counted"):
        alignment.Tables([row], 1).look_up(np.array([7], dtype=np.int64))


def test_both_libraries_cut_alike():
    a, own = alignment.ByteTokenizer(open(BYTE, "rb").read()), Tokenizer.from_file(BYTE)
    own.encode_special_tokens = True
    for start in range(0, 0x3000, 7):
        text = " ".join(f"x{chr(c)}y 1{chr(c)} {chr(c)}{chr(c)}\n" for c in range(start, start + 7))
        assert a.ids(" " + text).tolist() == own.encode(" " + text, add_special_tokens=False).ids


def test_long_files_and_empty_tables(spark, tmp_path, monkeypatch):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    monkeypatch.setattr(alignment, "MOST_FILE_BYTES", 1000)
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        alignment.tokenizer_files(spark, BYTE, PIECE)


def test_texts_without_tokens_stay_apart():
    a, b = alignment.ByteTokenizer(open(BYTE, "rb").read()), alignment.PieceTokenizer(open(PIECE, "rb").read())
    made = alignment.Aligned(pa.array([None, "a", "a▁", "", "b c"]), a, b)
    told = SimpleNamespace(groups=made.groups(), n=made.n_links.tolist())
    assert told.groups[0] == told.groups[2] == told.groups[3] == "" and told.n[0] == told.n[2] == told.n[3] == 0 and told.n[1] == 1 and told.n[4] == 2

"""Leaks against comparing every window."""

import random
from collections import Counter

import pytest
from test_llm_words import shingles_of, words_of

from plumeria.llm import decontaminate


def brute(docs, items):
    out = []
    for i, text in docs:
        for j, item in items:
            bag, size, n = Counter(shingles_of(item)), len(shingles_of(item)), len(words_of(item))
            w = words_of(text)
            if not size or not w:
                continue
            best = (0.0, 0)
            for start in range(max(len(w) - n, 0) + 1):
                window = Counter(shingles_of(" ".join(w[start : start + n])))
                both, every = sum((bag & window).values()), sum((bag | window).values())
                if 4 * both >= 3 * every and both / every > best[0]:
                    best = both / every, start
            if best[0]:
                out.append((i, j, best[0], best[1]))
    return out


def fixture():
    random.seed(11)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: [random.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate((15, 15, 22, 22, 30, 41, 57, 8, 5))]
    items += [(20, "a b a b a b a b a b"), (21, "Short one"), (22, "single"), (23, None), (24, " "), (25, items[0][1]), (None, " ".join(text(18)))]
    docs = []
    for k, (_, item) in enumerate(items):
        w = words_of(item)
        for change in range(4):
            passage = list(w)
            for _ in range(change):
                if passage:
                    passage[random.randrange(len(passage))] = random.choice(words)
            docs.append((len(docs), " ".join(text(random.randrange(60)) + passage + text(random.randrange(60))).upper()))
        docs.append((len(docs), " ".join(w[: max(1, 7 * len(w) // 8)])))
        docs.append((len(docs), " ".join(w[: len(w) // 2] + text(30) + w[len(w) // 2 :])))
    docs += [(500, "a b a b a b a b a b a b a b"), (501, None), (502, ""), (None, docs[0][1]), (0, docs[6][1]), docs[0]]
    return docs, items


@pytest.mark.parametrize("many", [False, True])
def test_leaks_equal_all_windows(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 8)
    docs, items = fixture()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = sorted((tuple(r) for r in decontaminate.leaks(frame, bench).collect()), key=key)
    assert found == sorted(brute(docs, items), key=key)
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns
    leaking = {(i, t) for i, t in docs if brute([(i, t)], items)}
    assert sorted((tuple(r)[:2] for r in clean.collect()), key=str) == sorted((d for d in docs if d not in leaking), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).collect() == []
    assert decontaminate.leaks(docs.limit(0), none).collect() == []
    assert decontaminate.clean(docs, none).count() == 1


def test_blocks_find_everything_within_the_radius():
    random.seed(3)
    prints = [random.getrandbits(64) for _ in range(40)]
    flips = set(decontaminate._flips().tolist())
    for value in prints:
        for _ in range(40):
            other = value
            for bit in random.sample(range(64), decontaminate.RADIUS):
                other ^= 1 << bit
            assert any(((value ^ other) >> (8 * b) & 255) in flips for b in range(decontaminate.BLOCKS))

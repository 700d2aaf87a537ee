"""The Jaccard join against comparing all pairs."""

import random

import pytest
from test_llm_words import shingles_of

from plumeria.llm import jaccard

SCHEMA = "doc_id long, text string, node string"


def brute(rows):
    """(doc_id, size, component, links) of every row."""
    sets = [set(shingles_of(t)) for _, t in rows]
    link = [[bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets]
    part = list(range(len(rows)))
    for _ in rows:
        part = [min(part[j] for j in range(len(rows)) if i == j or link[i][j]) for i in range(len(rows))]
    ids = lambda p: [i for k, (i, _) in enumerate(rows) if part[k] == p and i is not None]
    out = []
    for k, (i, _) in enumerate(rows):
        least = min(ids(part[k]), default=None) if sets[k] else i
        out.append((i, len(sets[k]), least, sum(link[k]) - bool(sets[k])))
    return out


def fixture(seed=3):
    random.seed(seed)
    word = lambda: random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(random.randrange(40))
    rows = []
    for size in (3, 6, 9, 12, 30, 80, 200):
        base = [word() for _ in range(size)]
        for copy in range(8):
            text = list(base)
            for _ in range(copy // 2):
                text[random.randrange(size)] = word()
            rows.append(" ".join(text))
    hot = [word() for _ in range(60)]
    rows += [" ".join(hot[:k] + [word()] + hot[k + 1 :]) for k in range(0, 60, 2)]
    passage = " ".join(word() for _ in range(25))
    rows += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(15)]
    rows += [None, "", " \n", "ONE two", "one TWO", "a b c d", rows[0], rows[0]]
    rows = [(100 - k, t) for k, t in enumerate(rows)]
    # Ids that are repeated, for equal and other texts, and null ids.
    return rows + [rows[5], (rows[0][0], rows[40][1]), (None, rows[20][1]), (None, "lonely words that nobody else has said"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("tight", [False, True])
def test_join_equals_all_pairs(spark, monkeypatch, tight):
    if tight:
        # Small bounds take the paths that large groups take.
        for name, value in {"BLOCK_SETS": 4, "COLUMNS": 16, "LEAST_COMMON": 4, "REPORTED": 2, "HELD_KEYS": 50, "PAIRS_PER_KEY": 0, "ROUNDS": 2, "LONG_LIST": 5, "BLOCK_LIST": 3}.items():
            monkeypatch.setattr(jaccard, name, value)
    rows = fixture()
    found = jaccard.jaccard_components(frame(spark, rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert jaccard.jaccard_components(empty).collect() == []
    assert jaccard.one_of_each(empty).columns == empty.columns


def test_one_row_of_each_component_stays(spark):
    rows = fixture()
    left = jaccard.one_of_each(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "node"]
    kept = [tuple(r)[:2] for r in left.collect()]
    judged = list(zip(rows, brute(rows)))
    assert sum(not shingles_of(t) for _, t in kept) == sum(not shingles_of(t) for _, t in rows)
    sets = [set(shingles_of(t)) for _, t in kept]
    assert not any(a and b and 100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    # Nothing goes without a partner that stays.
    for (i, t), (_, n, least, links) in judged:
        assert (i, t) in kept or (n and links and any(k[0] == least for k in kept))


def test_boundary_follows_the_cost():
    assert jaccard.boundary({}, 0.0) == 0
    assert jaccard.boundary({3: 10, 8: 10}, 0.0) < 8 <= jaccard.boundary({3: 10, 8: 10}, 100.0)


def test_least_overlap_is_three_quarters_rounded_up():
    assert all(4 * jaccard.needed(n) >= 3 * n > 4 * (jaccard.needed(n) - 1) for n in range(1, 200))


def test_a_large_group_whose_pairs_straddle_the_bound(spark, monkeypatch):
    """Few pairs link, so hubs settle little: the rest is compared in blocks, and few rows are written."""
    random.seed(8)
    base = [f"b{k}" for k in range(90)]
    texts = []
    for _ in range(700):
        text = list(base)
        for at in random.sample(range(90), 3):
            text[at] = f"x{random.randrange(10**9)}"
        texts.append(" ".join(text))
    rows = [(k, t) for k, t in enumerate(texts)]
    seen, across = [], jaccard._across
    blocks = jaccard._blocks

    def counted(lists, light):
        made = across(lists, light)
        seen.append(("pairs", made.count()))
        return made

    def cut(members, *told):
        made = blocks(members, *told)
        seen.append(("rows", made.count()))
        return made

    monkeypatch.setattr(jaccard, "_across", counted)
    monkeypatch.setattr(jaccard, "_blocks", cut)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 128)
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [frozenset(shingles_of(t)) for t in texts]
    part = list(range(len(rows)))

    def top(k):
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    linked = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                linked += 1
                x, y = top(a), top(b)
                part[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in found} == {k: top(k) for k in range(len(rows))}
    assert 0 < linked < 0.2 * 700 * 699 / 2
    assert all(n < 20_000 for kind, n in seen if kind == "pairs") and all(n < 700 * 40 for kind, n in seen if kind == "rows")

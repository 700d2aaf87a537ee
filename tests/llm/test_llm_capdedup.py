"""Near-duplicate vectors against comparing all pairs."""

import math

import numpy as np
import pytest

from plumeria.llm import capdedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def vectors(seed=1, dimension=64, bases=150, near=6):
    random = np.random.default_rng(seed)
    rows = []
    for base in random.standard_normal((bases, dimension)):
        for k in range(near):
            x = base + random.standard_normal(dimension) * 0.04 * k
            rows.append((len(rows), [float(np.float32(v)) for v in x], int(len(rows) % 3 == 0), "x"))
    return rows


def brute(rows):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    return link


@pytest.mark.parametrize("block", [512, 3])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(capdedup, "BLOCK_VECTORS", block)
    rows = vectors()
    link = brute(rows)
    found = {r.vec_id: r for r in capdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = np.array([found[k].n_links for k in range(len(rows))])
    assert (got <= link.sum(axis=1)).all()
    assert got.sum() >= 0.99 * link.sum() > 0
    for k in range(len(rows)):
        assert found[k].kept == (found[k].component_id == k)
        if got[k] == link[k].sum() == 0:
            assert found[k].component_id == k


def test_nulls_zeros_copies_and_scaled_vectors(spark):
    a, b = [1.0, 2.0, 3.0, 4.0] * 16, [-4.0, 1.0, 0.5, 2.0] * 16
    rows = [
        (9, a, 1), (4, a, 1), (7, [2 * x for x in a], 1), (2, a, 2), (1, a, None), (3, None, 1), (5, [0.0] * 64, 1), (6, [math.nan] * 64, 1),
        (8, [math.inf] + a[1:], 1), (10, [None] + a[1:], 1), (11, [], 1), (12, b, 1), (12, b, 1), (None, b, 1), (13, a[:32], 1), (14, [-0.0] + a[1:], 3), (15, [0.0] + a[1:], 3),
        (16, [1e30 * x for x in a], 1), (17, [1e-30 * x for x in a], 1),
    ]
    found = capdedup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None)
    alone = [1, 2, 3, 5, 6, 8, 10, 11, 13]
    expected = [(k, 0, k, True) for k in alone] + [(k, 4, 4, k == 4) for k in (4, 7, 9, 16, 17)]
    expected += [(12, 2, 12, True)] * 2 + [(14, 1, 14, True), (15, 1, 14, False)]
    assert got == sorted(expected)
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(2, 12, False)]


def test_empty_table(spark):
    assert capdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_decoding_lists_exactly_the_filters_above_the_threshold():
    code = capdedup.codewords(12, 125)
    x = np.random.default_rng(2).standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = [(i, *rest) for i in range(len(code[0])) for rest in ([(j,) for j in range(len(code[1]))] if len(code) == 2 else [(j, k) for j in range(len(code[1])) for k in range(len(code[2]))])]
    directions = np.array([np.concatenate([code[b][w] for b, w in enumerate(f)]) for f in whole])
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    rows, filters = capdedup.decode(x, code, 0.4)
    expected = np.argwhere(x @ directions.T >= 0.4)
    assert list(zip(rows.tolist(), filters.tolist())) == [tuple(p) for p in expected.tolist()]


def test_recall_of_three_blocks():
    """Above 2 ** 22 filters a code has three blocks; uneven vectors have no filter above some thresholds."""
    random = np.random.default_rng(5)
    one = random.standard_normal((300, 64)) * np.where(random.random((300, 64)) < 0.5, 0.2, 1.5)
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = random.standard_normal(one.shape)
    off -= (off * one).sum(axis=1, keepdims=True) * one
    two = 0.9801 * one + np.sqrt(1 - 0.9801**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    codes = capdedup._codes(64, 1 << 23)
    assert len(codes[0][1]) == 3
    sides = [capdedup.filters_of(v, codes) for v in (one, two)]
    sets = [[set(f[r == k].tolist()) for k in range(300)] for r, f in sides]
    assert all({f >> 48 for f in own} == set(range(len(codes))) for own in sets[0])
    assert np.mean([bool(a & b) for a, b in zip(*sets)]) >= 0.996

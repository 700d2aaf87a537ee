"""Top-k lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.operators import topk as tk
from plumeria.operators.blocks import block_norms, norm_blocks, norm_of

WEIGHTS = {1: {"a": 2, "b": -1}, 2: {"c": 1, "a": 1}, 3: {"a": 0}, 4: {"b": -3}}
VIDEOS = {10: "a", 11: "b", 12: "a", 13: "c", 14: "b", 15: "c", 16: "x"}
VOCABULARY = ["a", "b", "c", "d"]


def frames(spark):
    profile = [(u, c, w) for u, own in WEIGHTS.items() for c, w in own.items()]
    return (
        spark.createDataFrame(profile, "user_id bigint, category string, weight bigint"),
        spark.createDataFrame(list(VIDEOS.items()), "video_id bigint, category string"),
        spark.createDataFrame([(c,) for c in VOCABULARY], "category string"),
    )


def expected(measure, k, ascending):
    out = {}
    for user, own in WEIGHTS.items():
        vector = np.array([own.get(c, 0) for c in VOCABULARY], dtype=float)
        if not vector.any():
            continue
        scored = []
        for video, category in VIDEOS.items():
            if category not in VOCABULARY:
                continue
            one = np.array([float(c == category) for c in VOCABULARY])
            score = {
                "cosine": vector @ one / np.linalg.norm(vector),
                "dot": vector @ one,
                "euclid": 1 / (1 + np.linalg.norm(vector - one)),
            }[measure]
            scored.append((round(score, 12), video))
        scored.sort(key=lambda x: (x[0] if ascending else -x[0], x[1]))
        out[user] = [v for _, v in scored[:k]]
    return out


@pytest.mark.parametrize("measure", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("k,ascending", [(1, False), (3, False), (4, True), (20, False)])
def test_factored_equals_brute_force(spark, measure, k, ascending):
    rows = tk.factored_topk(*frames(spark), k, measure, ascending).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["rank"])):
        got.setdefault(r["user_id"], []).append(r["video_id"])
    assert got == expected(measure, k, ascending)
    assert all(r["list_size"] == len(got[r["user_id"]]) for r in rows)


def test_very_many_categories(spark):
    n = 10_001
    categories = spark.createDataFrame([(k, f"c{k:05d}") for k in range(n)], "video_id bigint, category string")
    profile = spark.createDataFrame([(1, "c10000", 2), (1, "c00000", -1), (2, "c00003", 1)], "user_id bigint, category string, weight bigint")
    rows = tk.factored_topk(profile, categories, categories.select("category"), 3).collect()
    got = {(r["user_id"], r["rank"]): r["video_id"] for r in rows}
    assert got == {(1, 1): 10_000, (1, 2): 1, (1, 3): 2, (2, 1): 3, (2, 2): 0, (2, 3): 1}


def test_text_ids_are_ranked(spark):
    users = spark.createDataFrame([("u1", [1.0, 0.0]), ("u2", [0.0, 1.0])], "user_id string, features array<double>")
    items = spark.createDataFrame([("a", [2.0, 1.0]), ("b", [1.0, 3.0])], "item_id string, features array<double>")
    seen = spark.createDataFrame([("u2", "b")], "user_id string, item_id string")
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in tk.blocked_topk(users, items, 2, seen).collect()}
    assert got == {("u1", 1): "a", ("u1", 2): "b", ("u2", 1): "a"}


def test_category_scores_equal_brute_force(spark):
    scores = [(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.5), (2, "c", 0.1)]
    df = spark.createDataFrame(scores, "user_id bigint, category string, score double")
    catalogue = frames(spark)[1]
    got = {(r["user_id"], r["rank"]): r["video_id"] for r in tk.topk_by_category_score(df, catalogue, 4).collect()}
    assert got == {(1, 1): 11, (1, 2): 14, (1, 3): 10, (1, 4): 12, (2, 1): 13, (2, 2): 15}


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    return {int(i): [float(x) for x in rng.integers(-3, 4, 4)] for i in rng.choice(1000, n, replace=False)}


@pytest.mark.parametrize("block", [4, 8192])
def test_blocked_equals_brute_force(spark, block):
    users, items = vectors(30, 1), vectors(25, 2)
    rng = np.random.default_rng(3)
    seen = {(u, i) for u in users for i in items if rng.random() < 0.2}
    one = next(iter(users))
    seen |= {(one, i) for i in items}
    schema = "{} bigint, features array<double>"
    got = tk.blocked_topk(
        spark.createDataFrame(list(users.items()), schema.format("user_id")),
        spark.createDataFrame(list(items.items()), schema.format("item_id")),
        5,
        spark.createDataFrame(list(seen), "user_id bigint, item_id bigint"),
        block,
    )
    want = set()
    for u, uf in users.items():
        scored = sorted((-np.dot(uf, vf), i) for i, vf in items.items() if (u, i) not in seen)
        want |= {(u, i, rank) for rank, (_, i) in enumerate(scored[:5], start=1)}
    assert {(r["user_id"], r["item_id"], r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("block", [4, 8192])
def test_blocked_histogram_counts_every_pair(spark, block):
    users, items = vectors(12, 4), vectors(9, 5)
    liked = {(u, i) for n, u in enumerate(users) for m, i in enumerate(items) if (n + m) % 4 == 0}
    schema = "{} bigint, features array<double>"
    got = tk.blocked_histogram(
        spark.createDataFrame(list(users.items()), schema.format("user_id")),
        spark.createDataFrame(list(items.items()), schema.format("item_id")),
        spark.createDataFrame(list(liked), "user_id bigint, item_id bigint"),
        6,
        block,
    )
    want = {}
    for u, uf in users.items():
        for i, vf in items.items():
            cell = want.setdefault(float(np.dot(uf, vf)), [0, 0])
            cell[0 if (u, i) in liked else 1] += 1
    assert {r["score"]: [r["pos"], r["neg"]] for r in got.collect()} == want


def test_blocks_beyond_reach_are_skipped(spark):
    """Norms fall fast, so most users stop after a few of the blocks, with the lists of comparing all."""
    rng = np.random.default_rng(9)
    items = {i: [float(x) for x in rng.normal(size=6) / (1 + i) ** 0.5] for i in range(400)}
    users = {u: [float(x) for x in rng.normal(size=6) * 10.0 ** rng.integers(-2, 3)] for u in range(150)} | {999: [0.0] * 6}
    schema = "{} bigint, features array<double>"
    left = spark.createDataFrame(list(users.items()), schema.format("user_id"))
    right = spark.createDataFrame(list(items.items()), schema.format("item_id"))
    got = {(r["user_id"], r["item_id"], r["rank"]) for r in tk.blocked_topk(left, right, 5, block=20).collect()}
    want = set()
    for u, uf in users.items():
        scored = sorted((-round(float(np.dot(uf, vf)), 12), i) for i, vf in items.items())
        want |= {(u, i, rank) for rank, (_, i) in enumerate(scored[:5], start=1)}
    assert got == want
    placed = norm_blocks(right.withColumn("norm", norm_of("features")), "item_id", 20, "ib")
    norms = block_norms(placed, "ib")
    assert norms == sorted(norms, reverse=True) and len(norms) > 15
    known = left.withColumn("norm", norm_of("features"))
    first = tk._block_best(known.withColumns({"ub": F.lit(0), "ib": F.lit(0)}), placed, None, 5)
    copies = tk.further_blocks(known, first, norms, 5, 3).where("user_id <> 999").count()
    assert copies < 0.4 * 150 * len(norms)

"""Nearest items against dense arithmetic, and what the bounds spare."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.operators import neighbours as nb
from plumeria.operators.blocks import norm_blocks
from plumeria.operators.products import unit_columns
from plumeria.plans import catalog


def entries(seed, n_users=40, n_items=30):
    """Some repeats, one user of all items, one item of all users, and items of one user only."""
    rng = np.random.default_rng(seed)
    pairs = [(u, i) for u in range(n_users) for i in range(n_items) if rng.random() < 0.15]
    pairs += [(0, i) for i in range(n_items + 8)] + [(u, 0) for u in range(n_users)] + pairs[:25]
    return pairs + [(u, i) for u in (1, 2) for i in range(0, n_items, 2)]


def brute(pairs, n):
    users, items = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    m = np.zeros((len(users), len(items)))
    for u, i in pairs:
        m[users.index(u), items.index(i)] += 1
    unit = m / np.linalg.norm(m, axis=0)
    cosine = unit.T @ unit
    out = {}
    for a, row in enumerate(items):
        ranked = sorted((-round(cosine[a, b], 12), col) for b, col in enumerate(items) if b != a and cosine[a, b] > 0)
        out[row] = [(col, pytest.approx(-value)) for value, col in ranked[:n]]
    return {row: found for row, found in out.items() if found}


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["row"], r["rank"])):
        out.setdefault(r["row"], []).append((r["col"], r["value"]))
    return out


@pytest.mark.parametrize("short,block", [(1000, 1000), (5, 1000), (5, 7), (1, 4), (12, 3)])
@pytest.mark.parametrize("n", [1, 4, 100])
def test_equals_all_pairs(spark, short, block, n):
    pairs = entries(3)
    frame = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    assert listed(nb.nearest(frame, "item_id", "user_id", n, short, block)) == brute(pairs, n)


def test_text_ids_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK_ITEMS", 3)
    monkeypatch.setattr(nb, "CHUNK_FEATURES", 2)
    pairs = [(f"u{u:02d}", f"i{i:02d}") for u, i in entries(8)]
    frame = spark.createDataFrame(pairs, "user_id string, item_id string")
    assert listed(nb.nearest(frame, "item_id", "user_id", 5, 4, 10)) == brute(pairs, 5)


def test_no_entries(spark):
    assert nb.nearest(spark.createDataFrame([], "user_id bigint, item_id bigint"), "item_id", "user_id", 3).count() == 0


def test_one_user_of_very_many_items(spark):
    """All of a user's 100,000 items but a few have no one else: ties, which only the first block settles."""
    n = 100_000
    likes = spark.range(n).select(F.lit(-1).cast("bigint").alias("user_id"), F.col("id").alias("item_id"))
    others = spark.createDataFrame([(u, i) for u in range(5) for i in (70_001, 80_002, 90_003)], "user_id bigint, item_id bigint")
    found = nb.nearest(likes.unionByName(others), "item_id", "user_id", 3)
    assert found.count() == 3 * n
    got = listed(found.where("row IN (0, 1, 99999, 80002)"))
    one = pytest.approx(1.0)
    assert got[0] == [(1, one), (2, one), (3, one)] and got[1] == [(0, one), (2, one), (3, one)]
    assert got[99999] == [(0, one), (1, one), (2, one)]
    assert got[80002] == [(70001, one), (90003, one), (0, pytest.approx(1 / np.sqrt(6)))]


def test_bounds_spare_most_blocks(spark):
    """Items whose long part is small meet the first block only."""
    rng = np.random.default_rng(4)
    pairs = {(0, i) for i in range(400)} | {(int(u), i) for i in range(400) for u in 1 + rng.choice(60, size=1 + i // 20, replace=False)}
    frame = spark.createDataFrame(sorted(pairs), "user_id bigint, item_id bigint")
    unit = unit_columns(frame, "item_id", "user_id").where("user_id = 0")
    norms = unit.select(F.col("item_id").alias("item"), F.col("weight").alias("norm"))
    placed = norm_blocks(norms, "item", 20, "block")
    blocks = placed.select("block").distinct().count()
    found = nb.nearest(frame, "item_id", "user_id", 5, 399, 20)
    needed = nb.needed_blocks(placed, found.drop("rank"), 5).count()
    assert blocks > 15 and needed < 0.4 * blocks * blocks
    assert listed(found) == brute(sorted(pairs), 5)


def test_item_item_cosine_has_every_pair(spark, tmp_path):
    rows = [(u * 30 + i, "2024-01-05 10:00:00", u, "click", 1.0, json.dumps({"k": i})) for u in range(2) for i in range(30)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.queries()["item_item_cosine"](spark, str(tmp_path)).collect()
    assert {(r["row"], r["col"]) for r in found} == {(i, j) for i in range(30) for j in range(i + 1, 30)}
    assert {r["value"] for r in found} == {1.0}

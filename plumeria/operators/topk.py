"""Top-k lists per user.

``factored_topk`` ranks one-hot items: a score depends on the item's category
only, so users are scored against categories and items are joined afterwards.
``blocked_topk`` ranks dense factor vectors against blocks of items in the order of their norms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.operators.blocks import block_norms, blocks_within, norm_blocks, norm_of
from plumeria.session import cut_lineage

ITEM_BLOCK = 8192
USER_BLOCK = 2048
USER_BLOCKS_PER_ITEM_BLOCK = 4
CHUNK_ROWS = 256
SCORE_DIGITS = 12


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key with their 1-based rank. Spark applies the limit before the shuffle too."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def shelf(categories: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k lowest video ids per category, as an array: all a top-k list can draw on."""
    keys = [*by, "category"]
    first = top_per_key(categories.distinct(), keys, [F.col("video_id")], k)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("video_id")).alias("videos"))


def pool(shelves: DataFrame, most: int, by: str | None = None) -> Column:
    """The ``most`` lowest videos of all shelves with their categories, in order, as one array value.

    With ``by``, a map from its values to such arrays.
    """
    keys = [by] if by else []
    rows = shelves.select(*keys, "category", F.explode("videos").alias("video_id"))
    order = [F.col("video_id"), F.col("category")]
    first = top_per_key(rows, keys, order, most) if by else rows.orderBy(*order).limit(most)
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("video_id", "category"))).alias("pool"))
    if by:
        return lists.agg(F.map_from_entries(F.collect_list(F.struct(by, "pool"))).alias("pools")).scalar()
    return lists.scalar()


def category_scores(measure: str) -> Column:
    """Score of a user against a one-hot category, from its weight and the user's squared norm."""
    weight, norm2 = F.col("weight"), F.col("norm2")
    if measure == "cosine":
        return weight / F.sqrt(norm2)
    if measure == "dot":
        return weight.cast("double")
    if measure == "euclid":
        return 1 / (1 + F.sqrt(norm2 - 2 * weight + 1))
    raise ValueError(f"unknown measure {measure!r}")


def factored_topk(
    profile: DataFrame,
    categories: DataFrame,
    vocabulary: DataFrame,
    k: int,
    measure: str = "cosine",
    ascending: bool = False,
) -> DataFrame:
    """(user_id, video_id, score, rank, list_size) of the best k videos per user.

    Videos whose category is outside the ``vocabulary`` have no vector and are not
    ranked; a category the user has no weight for scores as weight zero. Equal scores are ordered by video id. Users with a zero profile get no list.
    After the per-user aggregate every step runs in the same user partitioning.
    """
    shelves = shelf(categories.join(vocabulary, "category", "left_semi"), k)
    return rank_shelves(user_weights(profile, ["user_id"]), shelves, ["user_id"], k, measure, ascending)


def user_weights(profile: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its weights as a map and their squared norm; zero profiles are dropped."""
    return (
        profile.groupBy(*keys)
        .agg(
            F.sum(F.col("weight").cast("double") * F.col("weight")).alias("norm2"),
            F.map_from_entries(F.collect_list(F.struct("category", "weight"))).alias("weights"),
        )
        .where("norm2 > 0")
    )


def rank_shelves(
    users: DataFrame,
    shelves: DataFrame,
    keys: list[str],
    k: int,
    measure: str,
    ascending: bool = False,
    by: str | None = None,
) -> DataFrame:
    """(keys, video_id, score, rank, list_size) from users with weights and shelves of videos.

    Categories with a weight are joined to their shelves. All others score alike, as weight
    zero: of them only the lowest k videos matter, and they are among the first
    k * (weights + 1) videos of all shelves. So a user makes work for the weights it has,
    however many categories there are. With ``by``, one of the keys, shelves differ by it.
    A category is opened only while the better ones hold fewer than k videos.
    """
    users = cut_lineage(users)
    widest = users.agg(F.max(F.size("weights"))).first()[0] or 0
    first = pool(shelves, k * (widest + 1), by)
    first = F.element_at(first, F.col(by)) if by else first
    score = F.round(category_scores(measure), SCORE_DIGITS).alias("score")
    weighted = users.select(*keys, "norm2", F.explode("weights").alias("category", "weight"))
    weighted = weighted.join(shelves, [*([by] if by else []), "category"]).select(*keys, score, "videos")
    others = users.withColumn("first", F.slice(first, 1, F.lit(k) * (F.size("weights") + 1))).withColumn("weight", F.lit(0))
    others = others.withColumn("others", F.filter("first", lambda v: ~F.map_contains_key("weights", v["category"])))
    others = others.select(*keys, score, F.transform(F.slice("others", 1, k), lambda v: v["video_id"]).alias("videos"))
    order = F.col("score").asc() if ascending else F.col("score").desc()
    opened = _while_short(weighted.unionByName(others), keys, order, F.size("videos"), k)
    items = opened.select(*keys, "score", F.explode("videos").alias("video_id"))
    ranked = top_per_key(items, keys, [order, F.col("video_id")], k)
    return ranked.withColumn("list_size", F.count("*").over(Window.partitionBy(*keys)))


def _while_short(rows: DataFrame, keys: list[str], order: Column, size: Column, k: int) -> DataFrame:
    """Rows whose strictly better rows of the same key hold fewer than k items in all."""
    upto = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.sum(size).over(upto) - F.sum(size).over(Window.partitionBy(*keys, "score"))
    return rows.withColumn("ahead", ahead).where(F.col("ahead") < k).drop("ahead")


def user_lists(topk: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, videos): one row per key with the list in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "video_id")))
    return topk.groupBy(*keys).agg(ordered.alias("ranked")).select(*keys, F.col("ranked.video_id").alias("videos"))


def topk_by_category_score(scores: DataFrame, categories: DataFrame, k: int) -> DataFrame:
    """Top k videos per user from given (user_id, category, score) rows, highest first."""
    best = scores.join(shelf(categories, k), "category")
    opened = _while_short(best, ["user_id"], F.col("score").desc(), F.size("videos"), k)
    items = opened.select("user_id", "score", F.explode("videos").alias("video_id"))
    ranked = top_per_key(items, ["user_id"], [F.col("score").desc(), F.col("video_id")], k)
    return ranked.withColumn("list_size", F.count("*").over(Window.partitionBy("user_id")))


def _block_counts(users: DataFrame, items: DataFrame, block: int) -> tuple[int, int]:
    """How many user and item blocks to cut; small inputs still fill the cores with user blocks."""
    n_users, n_items = users.count(), items.count()
    cores = users.sparkSession.sparkContext.defaultParallelism
    wide = -(-n_users // (USER_BLOCKS_PER_ITEM_BLOCK * block))
    return max(1, wide, min(cores, -(-n_users // 256))), max(1, -(-n_items // block))


def _pair_blocks(users: DataFrame, items: DataFrame, user_blocks: int, item_blocks: int):
    """Give both sides (ub, ib) keys so that every user block meets every item block once."""
    left = users.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(user_blocks))).withColumn(
        "ib", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1)).cast("array<bigint>"))
    )
    right = items.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(item_blocks))).withColumn(
        "ub", F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1)).cast("array<bigint>"))
    )
    return left, right


def _chunks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(rows), CHUNK_ROWS):
        yield rows.iloc[start : start + CHUNK_ROWS]


def _with_marks(users: DataFrame, pairs: DataFrame | None, item_blocks: int, item_type: str) -> DataFrame:
    """Adds the user's ``marked`` items of the same item block; a list never exceeds its block."""
    if pairs is None:
        return users.withColumn("marked", F.lit(None).cast(f"array<{item_type}>"))
    marks = (
        pairs.select("user_id", "item_id")
        .distinct()
        .groupBy("user_id", F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).alias("ib"))
        .agg(F.collect_list("item_id").alias("marked"))
    )
    return users.join(marks, ["user_id", "ib"], "left")


def blocked_topk(
    users: DataFrame,
    items: DataFrame,
    k: int,
    seen: DataFrame | None = None,
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """Best k items per user by dot product, leaving out ``seen`` (user_id, item_id) pairs.

    ``users`` and ``items`` hold an id and a ``features`` array. Items are cut into blocks in
    falling order of their norms. All users meet the first block; after that a user goes on only
    to the blocks whose largest norm, times its own, reaches its k-th best score. Users with
    similar needs share a task, which multiplies them with one block, a few hundred at a time,
    and returns k rows per user: neither side is broadcast and no pair is written out. Equal
    scores, at ``SCORE_DIGITS`` places, are ordered by item id.
    """
    items = norm_blocks(items.select("item_id", "features", norm_of("features").alias("norm")), "item_id", block, "ib")
    users = cut_lineage(users.select("user_id", "features", norm_of("features").alias("norm")))
    norms = block_norms(items, "ib")
    if not norms:
        norms = [0.0]
    n = max(1, math.ceil(users.count() / USER_BLOCK))
    marks = None
    if seen is not None:
        pairs = seen.select("user_id", "item_id").distinct().join(items.select("item_id", "ib"), "item_id")
        marks = cut_lineage(pairs.groupBy("user_id", "ib").agg(F.collect_list("item_id").alias("marked")))
    first = users.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int")).withColumn("ib", F.lit(0))
    found = _block_best(first, items, marks, k)
    if len(norms) == 1:
        return top_per_key(found, ["user_id"], _by_score(), k)
    found = cut_lineage(top_per_key(found, ["user_id"], _by_score(), k).drop("rank"))
    left = further_blocks(users, found, norms, k, n)
    return top_per_key(found.unionByName(_block_best(left, items, marks, k)), ["user_id"], _by_score(), k)


def _by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("item_id")]


def further_blocks(users: DataFrame, found: DataFrame, norms: list[float], k: int, user_blocks: int) -> DataFrame:
    """Users with (ub, ib) for every item block after the first that may hold one of their k best."""
    kth = found.groupBy("user_id").agg(F.count("*").alias("_n"), F.min("score").alias("_beat"))
    beat = F.when(F.col("_n") >= k, F.col("_beat"))
    need = users.join(kth, "user_id", "left").withColumn("_need", blocks_within(F.col("norm"), beat, norms))
    open_ = need.where("_need > 1").drop("_n", "_beat")
    # Users that need equally many blocks are together, so that a block goes to few groups.
    ranged = cut_lineage(open_.repartitionByRange(user_blocks, "_need", "user_id").withColumn("ub", F.spark_partition_id()))
    return ranged.withColumn("ib", F.explode(F.sequence(F.lit(1), F.col("_need") - 1))).drop("_need")


def _block_best(users: DataFrame, items: DataFrame, marks: DataFrame | None, k: int) -> DataFrame:
    """(user_id, item_id, score): k at most for each row (user, ub, ib) of ``users``, of the items of its block."""
    user_type, item_type = dict(users.dtypes)["user_id"], dict(items.dtypes)["item_id"]
    if marks is None:
        left = users.withColumn("marked", F.lit(None).cast(f"array<{item_type}>"))
    else:
        left = users.join(marks, ["user_id", "ib"], "left")
    # Named anew, as the block pairs come from the other side.
    met = users.select(F.col("ub").alias("ub"), F.col("ib").alias("ib")).distinct()
    right = items.select("item_id", F.col("features").alias("features"), "ib").join(met, "ib")

    def best(user_rows: pd.DataFrame, item_rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"user_id": [], "item_id": [], "score": []})]
        if not item_rows.empty:
            item_rows = item_rows.sort_values("item_id")
            ids = item_rows["item_id"].to_numpy()
            vectors = np.stack(item_rows["features"].to_list()).T
            for rows in _chunks(user_rows):
                parts.append(best_of(rows, ids, vectors))
        return pd.concat(parts[1:] or parts)

    def best_of(rows: pd.DataFrame, ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        scores = np.round(np.stack(rows["features"].to_list()) @ vectors, SCORE_DIGITS)
        for row, gone in enumerate(rows["marked"]):
            if gone is not None and len(gone):
                scores[row, np.isin(ids, gone)] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame(
            {
                "user_id": np.repeat(rows["user_id"].to_numpy(), top.shape[1]),
                "item_id": ids[top].ravel(),
                "score": np.take_along_axis(scores, top, axis=1).ravel(),
            }
        )
        return out[np.isfinite(out["score"])]

    pairs = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib"))
    return pairs.applyInPandas(best, f"user_id {user_type}, item_id {item_type}, score double")


def blocked_histogram(
    users: DataFrame, items: DataFrame, liked: DataFrame, digits: int, block: int = ITEM_BLOCK
) -> DataFrame:
    """(score, pos, neg): liked and other pairs at each rounded dot product, over all user-item pairs.

    Pairs are counted inside the task that multiplies their blocks; only distinct
    rounded scores leave it.
    """
    user_blocks, item_blocks = _block_counts(users, items, block)
    left, right = _pair_blocks(users, items, user_blocks, item_blocks)
    left = _with_marks(left, liked, item_blocks, dict(items.dtypes)["item_id"])

    def count(user_rows: pd.DataFrame, item_rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"score": [], "pos": [], "neg": []})]
        if not item_rows.empty:
            ids = item_rows["item_id"].to_numpy()
            vectors = np.stack(item_rows["features"].to_list()).T
            for rows in _chunks(user_rows):
                parts.append(count_of(rows, ids, vectors))
        return pd.concat(parts[1:] or parts).groupby("score", as_index=False).sum()

    def count_of(rows: pd.DataFrame, ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        scores = np.round(np.stack(rows["features"].to_list()) @ vectors, digits)
        hit = np.zeros(scores.shape, dtype=bool)
        for row, own in enumerate(rows["marked"]):
            if own is not None and len(own):
                hit[row] = np.isin(ids, own)
        values, place = np.unique(scores, return_inverse=True)
        place = place.ravel()
        n = np.bincount(place, minlength=len(values))
        pos = np.bincount(place[hit.ravel()], minlength=len(values))
        return pd.DataFrame({"score": values, "pos": pos, "neg": n - pos})

    pairs = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib"))
    counts = pairs.applyInPandas(count, "score double, pos bigint, neg bigint")
    return counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

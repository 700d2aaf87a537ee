"""The nearest items of every item, by the cosine of who acts on them.

Features are told apart by the number of their items. Short ones, of at most ``SHORT`` items,
are joined with themselves, which gives rows in proportion to the entries; their sums are lower
bounds of the cosines, and an item's n-th best sum is what a neighbour has to beat. Long
features are never joined with themselves:

- a pair that shares short features is completed by its long ones only if its sum and the
  product of both items' norms over long features reach what has to be beaten;
- a pair that shares long features only is at most the product of these norms. Items are cut
  into blocks in falling order of them; a task multiplies two blocks and returns n rows for
  each item. All items meet the first block; the others only as far as their bound, of equal
  norms and ids, can still beat the n-th best.

Results are exact: nothing is skipped that could be among the n best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.operators.blocks import SLACK, norm_blocks
from plumeria.operators.products import unit_columns
from plumeria.operators.topk import top_per_key
from plumeria.session import cut_lineage

#: Items of a short feature.
SHORT = 256
BLOCK_ITEMS = 2048
#: Items and features of the dense pieces that a task multiplies.
CHUNK_ITEMS, CHUNK_FEATURES = 512, 1024
DIGITS = 12


def _best(pairs: DataFrame, n: int) -> DataFrame:
    """The n best columns of every row, equal values by id."""
    return top_per_key(pairs, ["row"], [F.round("value", DIGITS).desc(), F.col("col")], n)


def _to_beat(pairs: DataFrame, n: int) -> DataFrame:
    """row, beat, last: the n-th best value of rows that have n, and the largest id among those as good as it."""
    best = _best(pairs, n)
    per_row = best.groupBy("row").agg(F.count("*").alias("_n"), F.min("value").alias("beat"), F.max(F.struct("rank", "col")).alias("_last"))
    return per_row.where(F.col("_n") == n).select("row", "beat", F.col("_last.col").alias("last"))


def _short_pairs(short: DataFrame) -> DataFrame:
    """row, col, value in both directions: the products over short features."""
    a = short.select(F.col("item").alias("row"), "feature", F.col("weight").alias("_a"))
    b = short.select(F.col("item").alias("col"), "feature", F.col("weight").alias("_b"))
    half = a.join(b, "feature").where(F.col("row") < F.col("col")).groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
    half = cut_lineage(half)
    return half.unionByName(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def _completed(pairs: DataFrame, long: DataFrame, norms: DataFrame, n: int) -> DataFrame:
    """Pairs that may be among the n best of their row, with the products over long features added."""
    beat = cut_lineage(_to_beat(pairs, n).select("row", "beat"))
    own = norms.select(F.col("item").alias("row"), F.col("norm").alias("_own"))
    other = norms.select(F.col("item").alias("col"), F.col("norm").alias("_other"))
    bounded = pairs.join(beat, "row", "left").join(own, "row", "left").join(other, "col", "left")
    reach = F.col("value") + F.coalesce(F.col("_own") * F.col("_other"), F.lit(0.0)) + SLACK
    hopeful = cut_lineage(bounded.where(F.col("beat").isNull() | (reach >= F.col("beat"))).select("row", "col", "value"))
    a = long.select(F.col("item").alias("row"), "feature", F.col("weight").alias("_a"))
    b = long.select(F.col("item").alias("col"), "feature", F.col("weight").alias("_b"))
    more = hopeful.select("row", "col").join(a, "row").join(b, ["col", "feature"]).select("row", "col", (F.col("_a") * F.col("_b")).alias("value"))
    return hopeful.unionByName(more).groupBy("row", "col").agg(F.sum("value").alias("value"))


def _multiply(n: int):
    """The n best columns of each row of a block, by their products with the columns of another."""

    def run(rows: pd.DataFrame, cols: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"row": rows["item"][:0], "col": rows["item"][:0], "value": np.zeros(0)})
        shared = np.intersect1d(rows["feature"].unique(), cols["feature"].unique())
        rows, cols = rows[rows["feature"].isin(shared)], cols[cols["feature"].isin(shared)]
        if rows.empty:
            return none
        row_ids, row_at = np.unique(rows["item"].to_numpy(), return_inverse=True)
        col_ids, col_at = np.unique(cols["item"].to_numpy(), return_inverse=True)
        feature_of = pd.Index(shared)
        row_feature, col_feature = feature_of.get_indexer(rows["feature"]), feature_of.get_indexer(cols["feature"])
        out = [none]
        for start in range(0, len(row_ids), CHUNK_ITEMS):
            ids = row_ids[start : start + CHUNK_ITEMS]
            total = np.zeros((len(ids), len(col_ids)))
            for low in range(0, len(shared), CHUNK_FEATURES):
                high = min(low + CHUNK_FEATURES, len(shared))
                mine = (row_at >= start) & (row_at < start + len(ids)) & (row_feature >= low) & (row_feature < high)
                theirs = (col_feature >= low) & (col_feature < high)
                a, b = np.zeros((len(ids), high - low)), np.zeros((len(col_ids), high - low))
                a[row_at[mine] - start, row_feature[mine] - low] = rows["weight"].to_numpy()[mine]
                b[col_at[theirs], col_feature[theirs] - low] = cols["weight"].to_numpy()[theirs]
                total += a @ b.T
            total[ids[:, None] == col_ids[None, :]] = 0
            top = np.argsort(-np.round(total, DIGITS), axis=1, kind="stable")[:, :n]
            value = np.take_along_axis(total, top, axis=1)
            found = pd.DataFrame({"row": np.repeat(ids, top.shape[1]), "col": col_ids[top].ravel(), "value": value.ravel()})
            out.append(found[found["value"] > 0])
        return pd.concat(out)

    return run


def _products(needed: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """row, col, value of the block pairs (rb, cb): n columns at most for each row and block of columns."""
    left = rows.withColumnRenamed("block", "rb").join(needed, "rb")
    # Named anew, as both sides are the same table.
    again = rows.select(F.col("block").alias("cb"), *(F.col(c).alias(c) for c in ("item", "feature", "weight")))
    right = again.join(needed.select(F.col("rb").alias("rb"), F.col("cb").alias("cb")), "cb")
    id_type = dict(rows.dtypes)["item"]
    grouped = left.groupBy("rb", "cb").cogroup(right.groupBy("rb", "cb"))
    return grouped.applyInPandas(_multiply(n), f"row {id_type}, col {id_type}, value double")


def needed_blocks(placed: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(rb, cb) of the block pairs, without the first column block, that may hold one of the n best of a row.

    A block pair is out if its bound is below what each of its rows has to beat, or equal and all its ids come later.
    """
    beat = placed.select(F.col("item").alias("row"), F.col("block").alias("rb"), "norm").join(_to_beat(found, n), "row", "left")
    rows = beat.groupBy("rb").agg(
        F.max("norm").alias("_own"),
        F.when(F.count("beat") == F.count("*"), F.min("beat")).alias("beat"),
        F.max("last").alias("last"),
    )
    cols = placed.groupBy(F.col("block").alias("cb")).agg(F.max("norm").alias("_other"), F.min("item").alias("first"))
    # One row, with two numbers and an id for each block.
    table = cols.where("cb > 0").agg(F.collect_list(F.struct("cb", "_other", "first")).alias("cols"))
    bound = lambda c: F.col("_own") * c["_other"]
    may = lambda c: (
        F.col("beat").isNull()
        | (bound(c) > F.col("beat") + SLACK)
        | ((bound(c) >= F.col("beat") - SLACK) & (c["first"] < F.col("last")))
    )
    joined = rows.join(F.broadcast(table))
    return joined.select("rb", F.explode(F.filter("cols", may)).alias("c")).select("rb", "c.cb")


def nearest(entries: DataFrame, item: str, feature: str, n: int, short: int | None = None, block: int | None = None) -> DataFrame:
    """(row, col, value, rank): the ``n`` most similar other items of every item, by the cosine of their counts by feature.

    Values of 0 are left out; equal values, at 12 places, are ordered by id.
    """
    short, block = short or SHORT, block or BLOCK_ITEMS
    unit = unit_columns(entries, item, feature).select(F.col(item).alias("item"), F.col(feature).alias("feature"), "weight")
    unit = cut_lineage(unit)
    sizes = cut_lineage(unit.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > short).select("feature"))
    if sizes.isEmpty():
        return _best(_short_pairs(unit), n)
    long = cut_lineage(unit.join(sizes, "feature", "left_semi"))
    norms = cut_lineage(long.groupBy("item").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")))
    pairs = _short_pairs(unit.join(sizes, "feature", "left_anti"))
    found = cut_lineage(_best(_completed(pairs, long, norms, n), n).drop("rank"))
    placed = norm_blocks(norms, "item", block, "block")
    rows = cut_lineage(long.join(placed.select("item", "block"), "item"))
    first = placed.select(F.col("block").alias("rb")).distinct().withColumn("cb", F.lit(0))
    found = cut_lineage(_merged(found, _products(first, rows, n), n))
    more = cut_lineage(needed_blocks(placed, found, n))
    if not more.isEmpty():
        found = _merged(found, _products(more, rows, n), n)
    return _best(found, n)


def _merged(found: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """The n best of both; a pair that is in both counts with all its features in one of them, the larger."""
    whole = found.unionByName(more).groupBy("row", "col").agg(F.max("value").alias("value"))
    return _best(whole, n).drop("rank")

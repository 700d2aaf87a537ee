"""Ranking and classification metrics as closed forms over counts.

With N catalogue items, P relevant ones, T recommended ones and TP in both, all
0/1 metrics follow from the four counts, so no catalogue-length vector is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.functions.discount import discount, discount_prefix, discount_total
from plumeria.operators.prefix import running_total
from plumeria.operators.topk import user_lists

RANKING = ["roc_auc_score", "accuracy", "precision_score", "recall", "f1_score", "hit_ratio_k", "ndcg_k"]


def _or_zero(value: Column, defined: Column) -> Column:
    return F.when(defined, value).otherwise(F.lit(0.0))


def auc_binary() -> Column:
    """ROC AUC of a 0/1 prediction; null when one class is missing."""
    n, p, t, tp = (F.col(c) for c in ("n", "p", "t", "tp"))
    return F.when((p > 0) & (p < n), 0.5 * (tp / p + 1 - (t - tp) / (n - p)))


def accuracy() -> Column:
    return (F.col("n") - F.col("t") - F.col("p") + 2 * F.col("tp")) / F.col("n")


def precision() -> Column:
    return _or_zero(F.try_divide(F.col("tp"), F.col("t")), F.col("t") > 0)


def recall() -> Column:
    return _or_zero(F.try_divide(F.col("tp"), F.col("p")), F.col("p") > 0)


def f1() -> Column:
    both = F.col("t") + F.col("p")
    return _or_zero(F.try_divide(2 * F.col("tp"), both), both > 0)


def ndcg_tied(k: int) -> Column:
    """NDCG at k of a 0/1 prediction: all recommended items share one tied rank block."""
    n, p, t, tp = (F.col(c) for c in ("n", "p", "t", "tp"))
    head = F.try_divide(tp, t) * discount_prefix(k, "t")
    rest = F.try_divide(p - tp, n - t) * (discount_prefix(k, "n") - discount_prefix(k, "t"))
    gain = F.coalesce(head, F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
    return F.when(p > 0, gain / discount_prefix(k, "p"))


def list_counts(rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, p, t, tp, hit) from rows of a relevant ``video_id`` and the user's list ``videos``."""
    place = F.array_position("videos", F.col("video_id"))
    return (
        rows.select(*by, F.size("videos").alias("t"), place.alias("rank"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("p"),
            F.max("t").alias("t"),
            F.count(F.when(F.col("rank") > 0, 1)).alias("tp"),
            F.max(F.when(F.col("rank").between(1, k), 1).otherwise(0)).alias("hit"),
        )
    )


def daily_counts(truth: DataFrame, topk: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """(dt, user_id, n, p, t, tp, hit) from (dt, user_id, video_id) and top lists.

    Only users with a list and items of the catalogue count.
    """
    size = catalogue.agg(F.countDistinct("video_id").alias("n")).scalar()
    relevant = (
        truth.select("dt", "user_id", "video_id")
        .distinct()
        .join(catalogue.select("video_id").distinct(), "video_id", "left_semi")
        .join(user_lists(topk, ["user_id"]), "user_id")
    )
    return list_counts(relevant, ["dt", "user_id"], k).withColumn("n", size)


def user_metrics(counts: DataFrame, k: int) -> DataFrame:
    """The seven metrics per row of counts."""
    return counts.withColumns(
        {
            "roc_auc_score": auc_binary(),
            "accuracy": accuracy(),
            "precision_score": precision(),
            "recall": recall(),
            "f1_score": f1(),
            "hit_ratio_k": F.col("hit").cast("double"),
            "ndcg_k": ndcg_tied(k),
        }
    )


def macro_daily(per_user: DataFrame, model: str, by: Sequence[str] = ("dt",)) -> DataFrame:
    """Mean of the per-user metrics per day, with the number of users behind it."""
    means = [F.avg(m).alias(m) for m in RANKING]
    return per_user.groupBy(*by).agg(*means, F.count("*").alias("users")).withColumn("model", F.lit(model))


def metric_row(df: DataFrame, model: str) -> DataFrame:
    """Project to (dt, seven metrics, model); metrics that are not defined become 0."""
    present = [F.col(m) if m in df.columns else F.lit(0.0).alias(m) for m in RANKING]
    return df.select("dt", *present, F.lit(model).alias("model"))


def score_histogram(scored: DataFrame, digits: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg) at rounded scores, from (score, y) rows. Null scores are left out."""
    return (
        scored.where(F.col("score").isNotNull())
        .groupBy(*by, F.round("score", digits).alias("score"))
        .agg(
            F.sum(F.col("y").cast("bigint")).alias("pos"),
            F.sum(1 - F.col("y").cast("bigint")).cast("bigint").alias("neg"),
        )
    )


def positives_above(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``above``: positives at strictly higher scores, from running totals over ranges of scores."""
    return running_total(histogram, "score", "pos", "above", by, descending=True)


def rank_auc(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC of continuous scores by the rank sum; null when one class is missing."""
    ranked = positives_above(histogram, by)
    pairs = F.sum(F.col("neg") * (F.col("above") + F.col("pos") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return ranked.groupBy(*by).agg(
        F.when((p > 0) & (n > 0), pairs / (p.cast("double") * n)).alias("roc_auc_score")
    )


def threshold_metrics(histogram: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``score > threshold``."""
    chosen = F.col("score") > threshold
    counts = histogram.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("p"),
        F.sum(F.when(chosen, F.col("pos") + F.col("neg")).otherwise(0)).alias("t"),
        F.sum(F.when(chosen, F.col("pos")).otherwise(0)).alias("tp"),
    )
    return counts.select(
        *by,
        accuracy().alias("accuracy"),
        precision().alias("precision_score"),
        recall().alias("recall"),
        f1().alias("f1_score"),
    )


def confusion(df: DataFrame) -> DataFrame:
    """(dt, actual, predicted, count)."""
    return df.groupBy("dt", "actual", "predicted").agg(F.count("*").alias("count"))


def weighted_multiclass(cells: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 per day, from confusion counts."""
    right = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    actual = cells.groupBy("dt", F.col("actual").alias("label")).agg(
        F.sum("count").alias("support"), F.sum(right).alias("hit")
    )
    predicted = cells.groupBy("dt", F.col("predicted").alias("label")).agg(F.sum("count").alias("claimed"))
    classes = actual.join(predicted, ["dt", "label"], "left").na.fill(0, ["claimed"])
    per_class = classes.withColumns(
        {
            "pr": F.coalesce(F.try_divide("hit", "claimed"), F.lit(0.0)),
            "re": F.col("hit") / F.col("support"),
            "f": 2 * F.col("hit") / (F.col("support") + F.col("claimed")),
        }
    )
    total = F.sum("support")
    return per_class.groupBy("dt").agg(
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum(F.col("pr") * F.col("support")) / total).alias("precision_score"),
        (F.sum(F.col("re") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / total).alias("f1_score"),
    )


def row_hits(test: DataFrame, topk: DataFrame, known_users: DataFrame) -> DataFrame:
    """Per test row: rank of its item in the user's list, and whether the user is known."""
    known = known_users.select("user_id", F.lit(True).alias("known")).distinct()
    return test.join(known, "user_id", "left").join(
        topk.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left"
    )


def row_metrics(hits: DataFrame) -> DataFrame:
    """Metrics per day of rows that are all relevant.

    Hit ratio and NDCG average over known users; accuracy and recall count
    unknown users as a miss; precision is 1 once anything was hit.
    """
    pred = F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)
    known = F.col("known")
    share = F.avg(pred)
    gain = F.when(F.col("rank").isNotNull(), discount("rank")).otherwise(0.0)
    return hits.groupBy("dt").agg(
        F.lit(0.0).alias("roc_auc_score"),
        share.alias("accuracy"),
        F.max(pred).alias("precision_score"),
        share.alias("recall"),
        (2 * share / (1 + share)).alias("f1_score"),
        F.avg(F.when(known, pred)).alias("hit_ratio_k"),
        F.avg(F.when(known, gain)).alias("ndcg_k"),
    )


def user_list_metrics(truth: DataFrame, topk: DataFrame, k: int) -> DataFrame:
    """Mean user-level hit ratio and NDCG; the ideal list fills all k places."""
    found = truth.select("user_id", "item_id").distinct().join(
        topk.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left"
    )
    gain = F.when(F.col("rank").isNotNull(), discount("rank")).otherwise(0.0)
    users = found.groupBy("user_id").agg(
        F.max(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit"),
        (F.sum(gain) / discount_total(k)).alias("ndcg"),
    )
    return users.agg(F.avg("hit").alias("hit_ratio_k"), F.avg("ndcg").alias("ndcg_k"))

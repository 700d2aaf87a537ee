"""Closed-form metrics against explicit catalogue vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.operators import evaluation as ev


def tied_ndcg(true, pred, k):
    """NDCG where equal predictions share the mean gain of their ranks."""
    order = sorted(set(pred), reverse=True)
    gain, rank = 0.0, 1
    for value in order:
        group = [t for t, p in zip(true, pred) if p == value]
        mean = sum(group) / len(group)
        for _ in group:
            if rank <= k:
                gain += mean / math.log2(rank + 1)
            rank += 1
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(k, sum(true)) + 1))
    return gain / ideal


def pair_auc(true, score):
    pos = [s for t, s in zip(true, score) if t]
    neg = [s for t, s in zip(true, score) if not t]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def counts(true, pred, hit=0):
    tp = sum(t and p for t, p in zip(true, pred))
    return (len(true), sum(true), sum(pred), tp, hit)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_closed_forms_equal_vectors(spark, k):
    rng = random.Random(k)
    cases = []
    for _ in range(40):
        n = rng.randint(5, 30)
        t, p = rng.randint(1, n - 1), rng.randint(1, n - 1)
        true = [1] * p + [0] * (n - p)
        pred = [1] * t + [0] * (n - t)
        rng.shuffle(true)
        rng.shuffle(pred)
        cases.append((true, pred))
    rows = [(i, *counts(true, pred)) for i, (true, pred) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, n bigint, p bigint, t bigint, tp bigint, hit int")
    for row in ev.user_metrics(df, k).collect():
        true, pred = cases[row["i"]]
        tp = sum(a and b for a, b in zip(true, pred))
        assert row["roc_auc_score"] == pytest.approx(pair_auc(true, pred))
        assert row["accuracy"] == pytest.approx(np.mean([a == b for a, b in zip(true, pred)]))
        assert row["precision_score"] == pytest.approx(tp / sum(pred))
        assert row["recall"] == pytest.approx(tp / sum(true))
        assert row["f1_score"] == pytest.approx(2 * tp / (sum(pred) + sum(true)))
        assert row["ndcg_k"] == pytest.approx(tied_ndcg(true, pred, k))


def test_published_identity(spark):
    """Seventeen users, lists of 20, one positive each, and a single hit."""
    rows = [(i, 1000, 1, 20, int(i == 0), 0) for i in range(17)]
    df = spark.createDataFrame(rows, "user_id int, n bigint, p bigint, t bigint, tp bigint, hit int")
    day = df.withColumn("dt", F.lit("2023-08-19").cast("date"))
    row = ev.macro_daily(ev.user_metrics(day, 3), "knn").first()
    assert row["precision_score"] == pytest.approx(0.0029411765, abs=1e-9)
    assert row["recall"] == pytest.approx(0.0588235294, abs=1e-9)
    assert row["f1_score"] == pytest.approx(0.0056022409, abs=1e-9)
    assert row["ndcg_k"] == pytest.approx(0.0062674405, abs=1e-9)


def test_undefined_values(spark):
    df = spark.createDataFrame(
        [(10, 0, 0, 0, 0), (10, 10, 5, 5, 0)], "n bigint, p bigint, t bigint, tp bigint, hit int"
    )
    none, full = ev.user_metrics(df, 3).orderBy("p").collect()
    assert none["roc_auc_score"] is None and full["roc_auc_score"] is None
    assert none["precision_score"] == none["recall"] == none["f1_score"] == 0
    assert none["ndcg_k"] is None


def test_daily_counts_by_brute_force(spark):
    """P above K, a list shorter than 20, a video outside the catalogue and an unknown user."""
    catalogue = spark.createDataFrame([(v, "c") for v in range(1, 9)], "video_id bigint, category string")
    topk = spark.createDataFrame(
        [(1, v, float(-r), r) for r, v in enumerate([3, 5, 7], start=1)],
        "user_id bigint, video_id bigint, score double, rank int",
    )
    truth = spark.createDataFrame(
        [("2024-01-01", 1, 5), ("2024-01-01", 1, 5), ("2024-01-01", 1, 1), ("2024-01-01", 1, 99),
         ("2024-01-02", 1, 7), ("2024-01-01", 2, 3)],
        "dt string, user_id bigint, video_id bigint",
    )
    found = {r["dt"]: r for r in ev.daily_counts(truth, topk, catalogue, 2).collect()}
    first, second = found["2024-01-01"], found["2024-01-02"]
    assert (first["n"], first["p"], first["t"], first["tp"], first["hit"]) == (8, 2, 3, 1, 1)
    assert (second["p"], second["tp"], second["hit"]) == (1, 1, 0)


def test_rank_auc_with_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1)], "score double, y int")
    got = ev.rank_auc(ev.score_histogram(df)).first()[0]
    assert got == pytest.approx(pair_auc([y for _, y in rows], [s for s, _ in rows]))


def test_rank_auc_single_class(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, y int")
    assert ev.rank_auc(ev.score_histogram(df)).first()[0] is None


def test_rank_auc_equals_library(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(9)
    rows = [(rng.random() + 0.2 * y, y) for y in [int(rng.random() < 0.4) for _ in range(500)]]
    df = spark.createDataFrame(rows, "score double, y int")
    library = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y").evaluate(df)
    assert ev.rank_auc(ev.score_histogram(df, 12)).first()[0] == pytest.approx(library, abs=2e-3)


def test_multiclass_equals_library(spark):
    """A class never predicted and a class never actual."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 3), (0, 0)]
    df = spark.createDataFrame([("d", float(a), float(p)) for a, p in pairs], "dt string, actual double, predicted double")
    row = ev.weighted_multiclass(ev.confusion(df)).first()
    for column, name in [
        ("accuracy", "accuracy"),
        ("precision_score", "weightedPrecision"),
        ("recall", "weightedRecall"),
        ("f1_score", "f1"),
    ]:
        library = MulticlassClassificationEvaluator(labelCol="actual", predictionCol="predicted", metricName=name)
        assert row[column] == pytest.approx(library.evaluate(df))


def test_row_metrics_skip_unknown_users_only_where_due(spark):
    test = spark.createDataFrame([("d", 1, 10), ("d", 1, 11), ("d", 2, 10)], "dt string, user_id bigint, item_id bigint")
    topk = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "user_id bigint, item_id bigint, rank int")
    known = spark.createDataFrame([(1,)], "user_id bigint")
    row = ev.row_metrics(ev.row_hits(test, topk, known)).first()
    assert row["hit_ratio_k"] == pytest.approx(1 / 2)
    assert row["ndcg_k"] == pytest.approx(1 / 2)
    assert row["accuracy"] == row["recall"] == pytest.approx(1 / 3)
    assert row["precision_score"] == 1
    assert row["f1_score"] == pytest.approx(2 * (1 / 3) / (4 / 3))


def test_user_list_metrics_ideal_fills_all_places(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "user_id bigint, item_id bigint")
    topk = spark.createDataFrame([(1, 9, 1), (1, 10, 2)], "user_id bigint, item_id bigint, rank int")
    row = ev.user_list_metrics(truth, topk, 2).first()
    ideal = 1 + 1 / math.log2(3)
    assert row["hit_ratio_k"] == pytest.approx(0.5)
    assert row["ndcg_k"] == pytest.approx((1 / math.log2(3)) / ideal / 2)

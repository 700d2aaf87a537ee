"""Running totals, the AUC and the quartiles against sums over sorted lists."""

import random
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeria.operators import evaluation as ev
from plumeria.operators.explore import boxplot
from plumeria.operators.prefix import running_total


@pytest.mark.parametrize("descending", [False, True])
def test_running_total_by_group(spark, descending):
    rng = random.Random(4)
    rows = [(g, x, rng.randrange(9)) for g, size in (("a", 2000), ("b", 1), (None, 300)) for x in rng.sample(range(9999), size)]
    df = spark.createDataFrame(rows, "g string, x int, n bigint")
    got = {(r["g"], r["x"]): r["t"] for r in running_total(df, "x", "n", "t", ["g"], descending).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        own = sorted(((x, n) for h, x, n in rows if h == g), reverse=descending)
        for (x, _), before in zip(own, [0, *accumulate(n for _, n in own)]):
            assert got[(g, x)] == before


def test_running_total_of_values_that_shrink_towards_zero(spark):
    df = spark.range(20_000).select(F.pow(F.lit(0.99), "id").alias("x"), F.lit(1).cast("bigint").alias("n"))
    total = running_total(df, "x", "n", "t")
    assert total.agg(F.countDistinct("t")).first()[0] == 20_000


def test_auc_of_scores_inside_one_thousandth_of_the_range(spark):
    """All scores but one lie within 1e-9, where buckets of equal width would hold them all."""
    rng = random.Random(6)
    rows = [(0.5 + rng.randrange(400) * 1e-12, int(rng.random() < 0.3)) for _ in range(600)] + [(1.0, 0)]
    df = spark.createDataFrame(rows, "score double, y int")
    scores = np.round(np.array([s for s, _ in rows]), 12)
    y = np.array([v for _, v in rows])
    higher = (scores[y == 1][:, None] > scores[y == 0][None, :]).mean()
    equal = (scores[y == 1][:, None] == scores[y == 0][None, :]).mean()
    assert ev.rank_auc(ev.score_histogram(df)).first()[0] == pytest.approx(higher + equal / 2, abs=1e-12)


def test_auc_of_no_rows(spark):
    df = spark.createDataFrame([], "score double, y int")
    assert ev.rank_auc(ev.score_histogram(df)).first()[0] is None


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50) | st.sampled_from([7, 10**9]), min_size=1, max_size=60))
def test_boxplot_equals_dense_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
    box = boxplot(df, "v").first()
    q1, q2, q3 = np.quantile(np.array(values, dtype=float), [0.25, 0.5, 0.75])
    assert (box["q1"], box["median"], box["q3"]) == pytest.approx((q1, q2, q3))
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (box["low"], box["high"]) == (min(values), max(values))
    assert (box["whisker_low"], box["whisker_high"]) == (min(inside), max(inside))
    assert box["outliers"] == len(values) - len(inside)


def test_boxplot_of_nothing_and_its_plan(spark):
    box = boxplot(spark.createDataFrame([(None,)], "v bigint"), "v")
    assert box.first().asDict() == {
        "q1": None, "median": None, "q3": None, "low": None, "high": None,
        "whisker_low": None, "whisker_high": None, "outliers": 0,
    }
    assert "percentile" not in box._jdf.queryExecution().toString()

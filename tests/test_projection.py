"""Profile projections against the dense decomposition."""

import numpy as np
import pytest

from plumeria.operators.projection import right_vectors, svd_factors


def test_projection_equals_dense_svd(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 5, (30, 5)).astype(float)
    rows = [(u, f"c{j}", float(m[u, j])) for u in range(30) for j in range(5) if m[u, j]]
    profile = spark.createDataFrame(rows, "user_id bigint, category string, weight double")
    left, values, right = np.linalg.svd(m, full_matrices=False)
    _, got_values, _ = right_vectors(profile, 3)
    assert got_values == pytest.approx(values[:3])
    projected = np.zeros((30, 3))
    for r in svd_factors(profile, 3).collect():
        projected[r["user_id"], r["component"]] = r["value"]
    for i in range(3):
        want = left[:, i] * values[i]
        assert projected[:, i] == pytest.approx(want) or projected[:, i] == pytest.approx(-want)


def test_more_components_than_categories(spark):
    profile = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0)], "user_id bigint, category string, weight double")
    assert svd_factors(profile, 50).select("component").distinct().count() == 2

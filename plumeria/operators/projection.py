"""Rank-k projection of category profiles by singular value decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.operators.tagging import label_names


def profile_vectors(profile: DataFrame, names: list[str]) -> DataFrame:
    """(user_id, features): one dense vector per user over the named categories."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("category") == n, F.col("weight").cast("double"))), F.lit(0.0)) for n in names
    ]
    return profile.groupBy("user_id").agg(array_to_vector(F.array(*cells)).alias("features"))


def right_vectors(profile: DataFrame, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(categories, singular values, vectors as columns) of the user x category matrix.

    The users stay distributed; the width of the matrix is checked first. The sign
    of each vector makes its largest entry positive.
    """
    names = label_names(profile, "category")
    rows = MLUtils.convertVectorColumnsFromML(profile_vectors(profile, names).select("features"), "features")
    found = RowMatrix(rows).computeSVD(min(k, len(names)))
    vectors = found.V.toArray()
    largest = np.abs(vectors).argmax(axis=0)
    return names, found.s.toArray(), vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


def svd_factors(profile: DataFrame, k: int = 50) -> DataFrame:
    """(user_id, component, value): each user's profile projected on the leading k directions."""
    names, _, vectors = right_vectors(profile, k)
    rows = [(n, i, float(vectors[j, i])) for j, n in enumerate(names) for i in range(vectors.shape[1])]
    loadings = profile.sparkSession.createDataFrame(rows, "category string, component int, loading double")
    return profile.join(loadings, "category").groupBy("user_id", "component").agg(
        F.sum(F.col("weight") * F.col("loading")).alias("value")
    )

"""Operators on the daily metric and rate tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.dates import bin_end
from plumeria.functions.text import decimal_text, percent_text

METRICS = ["roc_auc_score", "accuracy", "precision_score", "recall", "f1_score", "hit_ratio_k", "ndcg_k"]

# Column titles shown by the dashboard.
DISPLAY_NAMES = {
    "roc_auc_score": "ROC AUC Score",
    "accuracy": "Accuracy",
    "precision_score": "Precision",
    "recall": "Recall",
    "f1_score": "F1 Score",
    "hit_ratio_k": "HitRatio@K",
    "ndcg_k": "NDCG@K",
}


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under ``order``. The rank filter limits before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def filter_models(df: DataFrame, models: Sequence[str]) -> DataFrame:
    return df.where(F.col("model").isin(list(models)))


def _by_date_desc(df: DataFrame, group: str, when: str) -> DataFrame:
    newest = Window.partitionBy(group).orderBy(F.col(when).desc())
    return df.withColumn("_age", F.row_number().over(newest))


def latest_vs_previous(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Latest value and change against the date before, per model and metric.

    A model with one date is compared with itself; a previous value of zero
    gives no change.
    """
    recent = _by_date_desc(df, "model", "dt").where("_age <= 2")
    long = recent.select("model", "_age", F.explode(_metric_structs(metrics)).alias("m")).select(
        "model", "_age", "m.metric", "m.value"
    )
    pairs = long.groupBy("model", "metric").agg(
        F.max(F.when(F.col("_age") == 1, F.col("value"))).alias("latest"),
        F.max_by("value", "_age").alias("previous"),
    )
    change = F.when(F.col("previous") != 0, (F.col("latest") - F.col("previous")) / F.col("previous"))
    return pairs.select(
        "model",
        "metric",
        F.round("latest", 2).alias("latest"),
        F.round(change * 100, 0).alias("pct_change"),
    )


def _metric_structs(metrics: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])


def comparison_dates(df: DataFrame) -> DataFrame:
    """Latest and second-latest date per model; equal when there is only one."""
    recent = _by_date_desc(df, "model", "dt").where("_age <= 2")
    return recent.groupBy("model").agg(F.max("dt").alias("latest_date"), F.min("dt").alias("previous_date"))


def trailing_averages(
    df: DataFrame, when: str, value: str, rows: Sequence[int] = (3, 7, 31), text: Callable[[str], Column] = percent_text
) -> DataFrame:
    """Mean of the newest 3, 7 and 31 rows of one series, with text: percent, or what ``text`` makes of counts."""
    newest = df.select(when, value).orderBy(F.col(when).desc()).limit(max(rows))
    ages = newest.withColumn("_age", F.row_number().over(Window.orderBy(F.col(when).desc())))
    means = [F.avg(F.when(F.col("_age") <= n, F.col(value))).alias(f"avg_{n}") for n in rows]
    texts = [text(f"avg_{n}").alias(f"avg_{n}_text") for n in rows]
    return ages.agg(*means).select("*", *texts)


def rolling_averages(df: DataFrame, group: str, when: str, value: str, rows: Sequence[int]) -> DataFrame:
    """Mean of the last n rows at each date of a series per group."""
    ordered = Window.partitionBy(group).orderBy(when)
    means = [F.avg(value).over(ordered.rowsBetween(1 - n, 0)).alias(f"avg_{n}") for n in rows]
    return df.select(group, when, *means)


def select_range(df: DataFrame, when: str, span: str) -> DataFrame:
    """Rows within a span back from the newest date: 3D, 1W, 1M, 6M, YTD, 1Y or all."""
    if span == "all":
        return df
    newest = df.agg(F.max(when).alias("newest"))
    if span == "YTD":
        return df.where(F.col(when) >= newest.select(F.trunc("newest", "year")).scalar())
    intervals = {"3D": "3 DAYS", "1W": "7 DAYS", "1M": "1 MONTH", "6M": "6 MONTHS", "1Y": "1 YEAR"}
    start = newest.select((F.col("newest") - F.expr(f"INTERVAL {intervals[span]}")).alias("start"))
    return df.where(F.col(when) > start.scalar())


def resample_mean(df: DataFrame, when: str, metrics: Sequence[str], freq: str) -> DataFrame:
    """Mean per calendar bin and model, with the model's empty bins kept as null."""
    means = df.groupBy("model", bin_end(when, freq).alias("bin")).agg(*[F.avg(m).alias(m) for m in metrics])
    bounds = means.groupBy("model").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    step = {"D": "1 DAY", "W": "7 DAYS", "M": "1 MONTH", "Y": "1 YEAR"}[freq]
    days = F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step}")))
    spine = bounds.select("model", days.alias("bin")).select("model", bin_end("bin", freq).alias("bin"))
    return spine.join(means, ["model", "bin"], "left")


def pivot_models(df: DataFrame, models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per date and one column per metric and model, named ``metric_model``."""
    cells = [
        F.first(F.when(F.col("model") == model, F.col(metric)), ignorenulls=True).alias(f"{metric}_{model}")
        for model in models
        for metric in metrics
    ]
    return df.groupBy("dt").agg(*cells)


def display_table(df: DataFrame) -> DataFrame:
    """The metric table under the dashboard's column titles."""
    return df.withColumnsRenamed(DISPLAY_NAMES)


def retraining_dates(df: DataFrame) -> DataFrame:
    return df.select("dt").distinct()


def date_bounds(df: DataFrame, when: str) -> DataFrame:
    return df.agg(F.min(when).alias("first_date"), F.max(when).alias("last_date"))


def model_ratings(feedback: DataFrame, item: str) -> DataFrame:
    """Average rating per model for one recommended item, as 2-decimal text."""
    return (
        feedback.where(F.col("recommended_item") == item)
        .groupBy("model")
        .agg(decimal_text(F.avg("rating"), 2).alias("rating"))
    )


def null_for_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def combine_metrics(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of per-model metric tables, projected by name onto the nine columns."""
    columns = ["dt", *METRICS, "model"]
    combined = tables[0]
    for table in tables[1:]:
        combined = combined.unionByName(table, allowMissingColumns=True)
    return combined.select(*columns)

"""Read queries behind the dashboard pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.operators.explore import attach_counts, boxplot, histogram, membership, share, value_counts
from plumeria.operators.keyed import latest_snapshot
from plumeria.operators.series import (
    comparison_dates,
    display_table,
    filter_models,
    latest_vs_previous,
    pivot_models,
    resample_mean,
    rolling_averages,
    select_range,
)
from plumeria.operators.splits import in_range

TILES = ["precision_score", "recall", "f1_score"]


def metric_table(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    return display_table(filter_models(metrics, models))


def summary_tiles(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """Latest precision, recall and F1 per model, their change, and the dates compared."""
    chosen = filter_models(metrics, models)
    return latest_vs_previous(chosen, TILES).join(comparison_dates(chosen), "model")


def rate_series(log: DataFrame, rate: str, low: Column, high: Column, rows: Sequence[int] = (3, 7, 31)) -> DataFrame:
    """Newest rate per date in a date range, with its trailing row averages."""
    latest = in_range(latest_snapshot(log, "recommendation_date", "dt"), "recommendation_date", low, high)
    keyed = latest.withColumn("series", F.lit(rate))
    averages = rolling_averages(keyed, "series", "recommendation_date", rate, rows)
    return latest.join(averages.drop("series"), "recommendation_date")


def history(metrics: DataFrame, models: Sequence[str], columns: Sequence[str], freq: str, span: str = "all"):
    """Metrics x models per calendar bin, over a span back from the newest date."""
    chosen = select_range(filter_models(metrics, models), "dt", span)
    binned = resample_mean(chosen, "dt", columns, freq).withColumnRenamed("bin", "dt")
    return pivot_models(binned, models, columns)


def registered_split(users: DataFrame, interest: DataFrame) -> DataFrame:
    flagged = membership(users, "id", interest, "user_id", "Registered", "Not Registered", "interest_registered")
    return value_counts(flagged, "interest_registered")


def voted_video_split(video: DataFrame, votes: DataFrame) -> DataFrame:
    return value_counts(membership(video, "id", votes, "video_id", "Voted", "Not Voted", "voted_on"), "voted_on")


def voted_user_split(users: DataFrame, votes: DataFrame) -> DataFrame:
    return value_counts(membership(users, "id", votes, "voter_id", "Voted", "Not Voted", "voted"), "voted")


def liked_user_split(users: DataFrame, likes: DataFrame) -> DataFrame:
    return value_counts(membership(users, "id", likes, "like_giver_id", "Liked", "Not Liked", "liked"), "liked")


def liked_conversation_split(conversation: DataFrame, likes: DataFrame) -> DataFrame:
    return value_counts(
        membership(conversation, "id", likes, "conversation_id", "Liked", "Not Liked", "liked"), "liked"
    )


def interest_share(interest: DataFrame) -> DataFrame:
    """Declared interests per category with their percentage."""
    return share(interest.groupBy("name").agg(F.count("*").alias("total")), "total")


def votes_per_video(video: DataFrame, votes: DataFrame) -> DataFrame:
    return attach_counts(video.select("id"), "id", votes, "video_id", "voter_id", "vote_count")


def likes_per_conversation(conversation: DataFrame, likes: DataFrame) -> DataFrame:
    return attach_counts(conversation.select("id"), "id", likes, "conversation_id", "activity_id", "like_count")


def vote_share(video: DataFrame, season: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes per category with their percentage."""
    seasons = season.select(F.col("id").alias("season_id"), "category")
    counted = votes_per_video(video, votes).join(video.select("id", "season_id"), "id").join(seasons, "season_id")
    return share(counted.groupBy("category").agg(F.sum("vote_count").alias("total")), "total")


def count_histogram(counts: DataFrame, value: str, below: int, bins: int) -> DataFrame:
    """Distribution of a count column, limited to values below a bound as the charts are."""
    return histogram(counts.where(F.col(value) < below), value, bins)


def count_boxplot(counts: DataFrame, value: str) -> DataFrame:
    return boxplot(counts, value)


def positive_histogram(users: DataFrame, value: str, bins: int) -> DataFrame:
    """Distribution of a positive follower or following count; missing counts as 0."""
    return histogram(users.na.fill(0, [value]).where(F.col(value) > 0), value, bins)

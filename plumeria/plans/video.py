"""Video recommenders that rank by category profile: cosine, dot product, closeness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.operators.evaluation import daily_counts, macro_daily, user_metrics
from plumeria.operators.profiles import (
    declared_interest,
    user_category_profile,
    video_categories,
    watch_weighted_profile,
)
from plumeria.operators.splits import test_after
from plumeria.operators.topk import factored_topk

LIST_SIZE = 20


@dataclass
class VideoTables:
    """The tables the video recommenders read."""

    user: DataFrame
    interest: DataFrame
    video: DataFrame
    season: DataFrame
    vote: DataFrame
    feed: DataFrame


@dataclass
class Features:
    """User profile, (video_id, category) catalogue and the declared categories."""

    profile: DataFrame
    catalogue: DataFrame
    vocabulary: DataFrame


def features(
    tables: VideoTables, split: Column, leak_votes: bool = False, only: DataFrame | None = None
) -> Features:
    """Features at the split date, of all users or of the given ones.

    ``leak_votes`` also counts votes cast after the split, as the first version
    of this recommender did.
    """
    catalogue = video_categories(tables.video, tables.season, split)
    until = None if leak_votes else split
    profile = user_category_profile(tables.interest, tables.vote, catalogue, split, until, only)
    return Features(profile, catalogue, declared_interest(tables.interest, split).select("category").distinct())


def watch_features(tables: VideoTables, split: Column, only: DataFrame | None = None) -> Features:
    """Features with the watch ratio blended into the profile."""
    base = features(tables, split, only=only)
    feed = tables.feed if only is None else tables.feed.join(only, "user_id", "left_semi")
    weighted = watch_weighted_profile(base.profile, feed, base.catalogue, base.vocabulary)
    return Features(weighted, base.catalogue, base.vocabulary)


def rank(found: Features, measure: str, k: int = LIST_SIZE, ascending: bool = False) -> DataFrame:
    return factored_topk(found.profile, found.catalogue, found.vocabulary, k, measure, ascending)


def content_topk(tables: VideoTables, split: Column, k: int = LIST_SIZE) -> DataFrame:
    """Nearest videos by cosine between profile and category."""
    return rank(features(tables, split), "cosine", k)


def weighted_topk(tables: VideoTables, split: Column, k: int = LIST_SIZE, ascending: bool = False) -> DataFrame:
    """Best videos by dot product of the watch-weighted profile."""
    return rank(watch_features(tables, split), "dot", k, ascending)


def closest_topk(tables: VideoTables, split: Column, k: int = LIST_SIZE) -> DataFrame:
    """Best videos by closeness of profile and category."""
    return rank(features(tables, split), "euclid", k)


def vote_truth(votes: DataFrame, split: Column, end: Column | None) -> DataFrame:
    """(dt, user_id, video_id) of the votes after the split."""
    return test_after(votes, "created_at", split, end).select(
        F.to_date("created_at").alias("dt"), F.col("voter_id").alias("user_id"), "video_id"
    )


def daily_metrics(
    topk: DataFrame, catalogue: DataFrame, votes: DataFrame, split: Column, end: Column | None, k: int, model: str
) -> DataFrame:
    """Macro-averaged metrics of every day after the split."""
    counts = daily_counts(vote_truth(votes, split, end), topk, catalogue, k)
    return macro_daily(user_metrics(counts, k), model)


def active_users(votes: DataFrame, split: Column, end: Column | None) -> DataFrame:
    """Users with a vote to evaluate; no others need a list."""
    return vote_truth(votes, split, end).select("user_id").distinct()


def content_metrics(tables: VideoTables, split: Column, end: Column, k: int = 3) -> DataFrame:
    found = features(tables, split, only=active_users(tables.vote, split, end))
    return daily_metrics(rank(found, "cosine"), found.catalogue, tables.vote, split, end, k, "knn")


def weighted_metrics(tables: VideoTables, split: Column, end: Column, k: int = 10) -> DataFrame:
    found = watch_features(tables, split, active_users(tables.vote, split, end))
    return daily_metrics(rank(found, "dot"), found.catalogue, tables.vote, split, end, k, "svd")

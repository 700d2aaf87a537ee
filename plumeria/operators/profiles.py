"""User and item category profiles in long form: one row per entity and category.

The long form carries the same numbers as a user x category matrix without a
data-dependent schema; a category that has no row has weight zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.similarity import ratio
from plumeria.operators.splits import trailing, train_before, train_until


def declared_interest(interest: DataFrame, split: Column) -> DataFrame:
    """(user_id, category) declared by the split date, once each."""
    return (
        train_until(interest, "updated_at", split)
        .where(F.col("name").isNotNull())
        .select("user_id", F.col("name").alias("category"))
        .distinct()
    )


def video_categories(video: DataFrame, season: DataFrame, split: Column | None = None) -> DataFrame:
    """(video_id, category) of the videos created by the split date: the one-hot matrix."""
    known = video if split is None else train_until(video, "created_at", split)
    seasons = season.select(F.col("id").alias("season_id"), "category")
    return known.select(F.col("id").alias("video_id"), "season_id").join(seasons, "season_id").select(
        "video_id", "category"
    )


def signed_votes(votes: DataFrame, categories: DataFrame) -> DataFrame:
    """(user_id, category, value): +1 per up-vote and -1 per other vote on a categorised video."""
    signed = F.when(F.col("status") == "UPVOTE", 1).otherwise(-1)
    return (
        votes.select("video_id", F.col("voter_id").alias("user_id"), signed.alias("value"))
        .join(categories, "video_id")
        .where(F.col("category").isNotNull())
        .select("user_id", "category", "value")
    )


def user_category_profile(
    interest: DataFrame,
    votes: DataFrame,
    categories: DataFrame,
    split: Column,
    votes_until: Column | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Declared interest plus vote balance, for users who voted.

    Categories are limited to those someone declared. ``votes_until`` keeps later
    votes out of the profile; ``None`` uses them all. Votes are read once: whether
    a user voted is settled on the aggregated rows. ``only`` (user_id) builds the
    profiles of some users, which are the same as among all.
    """
    declared = declared_interest(interest, split)
    vocabulary = declared.select("category").distinct()
    known = votes if votes_until is None else train_until(votes, "created_at", votes_until)
    if only is not None:
        declared = declared.join(only, "user_id", "left_semi")
        known = known.join(only.withColumnRenamed("user_id", "voter_id"), "voter_id", "left_semi")
    parts = (
        signed_votes(known, categories)
        .withColumn("voted", F.lit(True))
        .unionByName(declared.select("user_id", "category", F.lit(1).alias("value"), F.lit(False).alias("voted")))
    )
    sums = parts.groupBy("user_id", "category").agg(
        F.sum("value").cast("bigint").alias("weight"), F.max("voted").alias("voted")
    )
    voters = sums.withColumn("voted", F.max("voted").over(Window.partitionBy("user_id"))).where("voted")
    return voters.join(vocabulary, "category", "left_semi").select("user_id", "category", "weight")


def watch_ratio(feed: DataFrame, categories: DataFrame) -> DataFrame:
    """(user_id, category, ratio): mean over the user's videos of the mean watched share."""
    per_post = (
        feed.where("media_type = 'VIDEO'")
        .select("user_id", F.col("post_id").alias("video_id"), ratio("watch_time", "video_duration").alias("share"))
        .groupBy("user_id", "video_id")
        .agg(F.avg("share").alias("share"))
    )
    return per_post.join(categories, "video_id").groupBy("user_id", "category").agg(F.avg("share").alias("ratio"))


def watch_weighted_profile(
    profile: DataFrame,
    feed: DataFrame,
    categories: DataFrame,
    vocabulary: DataFrame,
    profile_weight: float = 0.7,
) -> DataFrame:
    """Profile and watch ratio blended 0.7 / 0.3 for the users of the profile."""
    watched = watch_ratio(feed, categories).join(vocabulary, "category", "left_semi")
    own, seen = profile_weight * F.col("weight"), (1 - profile_weight) * F.col("ratio")
    parts = profile.select("user_id", "category", own.alias("part"), F.lit(True).alias("known")).unionByName(
        watched.select("user_id", "category", seen.alias("part"), F.lit(False).alias("known"))
    )
    sums = parts.groupBy("user_id", "category").agg(F.sum("part").alias("weight"), F.max("known").alias("known"))
    kept = sums.withColumn("known", F.max("known").over(Window.partitionBy("user_id"))).where("known")
    return kept.select("user_id", "category", "weight")


def recent_upvotes(votes: DataFrame, split: Column, days: int = 28) -> DataFrame:
    """(user_id, video_id, upvotes): distinct votes in the window before the split."""
    return (
        trailing(votes, "created_at", split, days)
        .groupBy(F.col("voter_id").alias("user_id"), "video_id")
        .agg(F.countDistinct("id").alias("upvotes"))
    )


def recency_profile(
    users: DataFrame,
    interest: DataFrame,
    upvotes: DataFrame,
    categories: DataFrame,
    split: Column,
    interest_weight: float = 0.4,
) -> DataFrame:
    """0.4 x interest + 0.6 x recent up-votes per category, users with a positive total."""
    members = users.select(F.col("id").alias("user_id"))
    declared = declared_interest(interest, split).join(members, "user_id", "left_semi")
    voted = upvotes.join(categories, "video_id").where(F.col("category").isNotNull())
    parts = declared.select("user_id", "category", F.lit(1).cast("bigint").alias("own"), _none("n")).unionByName(
        voted.select("user_id", "category", _none("own"), F.col("upvotes").alias("n"))
    )
    sums = parts.groupBy("user_id", "category").agg(F.sum("own").alias("own"), F.sum("n").alias("n"))
    weighted = sums.withColumn("weight", interest_weight * F.col("own") + (1 - interest_weight) * F.col("n"))
    total = F.sum("weight").over(Window.partitionBy("user_id"))
    return weighted.withColumn("total", total).where("total > 0").select("user_id", "category", "weight")


def _none(name: str) -> Column:
    return F.lit(0).cast("bigint").alias(name)


def conversation_categories(conversation: DataFrame, split: Column) -> DataFrame:
    """(conversation_id, category) of the conversations created before the split."""
    return train_before(conversation, "created_at", split).select(
        F.col("id").alias("conversation_id"), F.col("categories").alias("category")
    )


def like_category_counts(likes: DataFrame, categories: DataFrame, split: Column) -> DataFrame:
    """(user_id, category, weight): likes per category before the split."""
    return (
        train_before(likes, "liked_at", split)
        .select("conversation_id", F.col("like_giver_id").alias("user_id"))
        .join(categories.where(F.col("category").isNotNull()), "conversation_id")
        .groupBy("user_id", "category")
        .agg(F.count("*").alias("weight"))
    )


def as_matrix(long: DataFrame, key: str, names: list[str], value: str = "weight", prefix: str = "") -> DataFrame:
    """One row per key and one column per named category, 0 where there is no row; repeats add up."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("category") == n, F.col(value))), F.lit(0)).alias(f"{prefix}{n}") for n in names
    ]
    return long.groupBy(key).agg(*cells)

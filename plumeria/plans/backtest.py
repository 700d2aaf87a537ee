"""Back-tests of the profile recommenders: many split dates in one plan.

Each row knows the first cycle it is training data for. Votes are summed once per
user, category and first cycle; the profile at a cycle is the sum up to it, and it
is formed only for users with a vote to evaluate in that cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.similarity import ratio
from plumeria.operators.evaluation import list_counts, macro_daily, user_metrics
from plumeria.operators.topk import rank_shelves, shelf, user_lists, user_weights
from plumeria.plans.video import LIST_SIZE, VideoTables

DAY_MICROS = 86_400_000_000


class Cycles:
    """Consecutive daily splits: cycle i trains up to ``start + i`` days and tests the day after."""

    def __init__(self, start: str, count: int):
        self.start = start
        self.count = count

    def _days_after_start(self, when: str) -> Column:
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{self.start}', CAST({when} AS TIMESTAMP_NTZ))")
        return F.ceil(micros / DAY_MICROS).cast("int")

    def first_trained(self, when: str) -> Column:
        return F.greatest(self._days_after_start(when), F.lit(0))

    def tested(self, when: str) -> Column:
        return self._days_after_start(when) - 1

    def trained(self, df: DataFrame, when: str) -> DataFrame:
        """Rows that are training data of some cycle, with ``first``."""
        return df.withColumn("first", self.first_trained(when)).where(F.col("first") < self.count)

    def from_first(self, df: DataFrame) -> DataFrame:
        """Each row repeated for every cycle from its first; for small tables only."""
        cycles = F.explode(F.sequence(F.col("first"), F.lit(self.count - 1)))
        return df.withColumn("cycle", cycles).drop("first")

    def split_date(self) -> Column:
        return F.date_add(F.lit(self.start).cast("date"), F.col("cycle"))


def _catalogue(tables: VideoTables, cycles: Cycles) -> DataFrame:
    """(video_id, category, first) of all categorised videos of any cycle."""
    seasons = tables.season.select(F.col("id").alias("season_id"), "category")
    videos = cycles.trained(tables.video, "created_at").select(F.col("id").alias("video_id"), "season_id", "first")
    return videos.join(seasons, "season_id").select("video_id", "category", "first")


def _truth(tables: VideoTables, cycles: Cycles, catalogue: DataFrame) -> DataFrame:
    """(cycle, dt, user_id, video_id) of the votes to evaluate, on videos known by then."""
    votes = tables.vote.select(
        cycles.tested("created_at").alias("cycle"),
        F.to_date("created_at").alias("dt"),
        F.col("voter_id").alias("user_id"),
        "video_id",
    ).where(F.col("cycle").between(0, cycles.count - 1))
    known = votes.distinct().join(catalogue.select("video_id", "first"), "video_id")
    return known.where(F.col("first") <= F.col("cycle")).drop("first")


def _parts(tables: VideoTables, cycles: Cycles, catalogue: DataFrame, declared: DataFrame, watch: bool) -> DataFrame:
    """(user_id, category, first, own, voted, shared, posts) of votes, interest and watch log."""
    videos = catalogue.withColumnRenamed("first", "known")
    signed = F.when(F.col("status") == "UPVOTE", 1).otherwise(-1)
    voted = cycles.trained(tables.vote, "created_at").join(videos, "video_id").select(
        F.col("voter_id").alias("user_id"),
        "category",
        F.greatest("first", "known").alias("first"),
        signed.alias("own"),
        F.lit(True).alias("voted"),
    )
    parts = voted.where(F.col("category").isNotNull()).unionByName(
        declared.select("user_id", "category", "first", F.lit(1).alias("own"), F.lit(False).alias("voted"))
    )
    if not watch:
        return parts
    per_post = (
        tables.feed.where("media_type = 'VIDEO'")
        .select("user_id", F.col("post_id").alias("video_id"), ratio("watch_time", "video_duration").alias("share"))
        .groupBy("user_id", "video_id")
        .agg(F.avg("share").alias("shared"))
    )
    watched = per_post.join(catalogue, "video_id").select(
        "user_id", "category", "first", "shared", F.when(F.col("shared").isNotNull(), 1).alias("posts")
    )
    return parts.unionByName(watched, allowMissingColumns=True)


def _profiles(
    parts: DataFrame, truth: DataFrame, vocabulary: DataFrame, watch: bool, own_weight: float = 0.7
) -> DataFrame:
    """(cycle, user_id, category, weight) for the users each cycle evaluates."""
    names = ["own", "shared", "posts"] if watch else ["own"]
    wanted = truth.select("cycle", "user_id").distinct()
    active = wanted.select("user_id").distinct()
    sums = parts.join(active, "user_id", "left_semi").groupBy("user_id", "category", "first").agg(
        *[F.sum(c).alias(c) for c in names], F.max("voted").alias("voted")
    )
    upto = wanted.join(sums, "user_id").where(F.col("first") <= F.col("cycle"))
    totals = upto.groupBy("cycle", "user_id", "category").agg(
        *[F.sum(c).alias(c) for c in names], F.max("voted").alias("voted")
    )
    voters = totals.withColumn("voted", F.max("voted").over(Window.partitionBy("cycle", "user_id"))).where("voted")
    own = F.coalesce(F.col("own"), F.lit(0))
    if watch:
        seen = F.coalesce(ratio("shared", "posts"), F.lit(0.0))
        weight = own_weight * own + (1 - own_weight) * seen
    else:
        weight = own.cast("bigint")
    known = voters.join(vocabulary, "category").where(F.col("first") <= F.col("cycle"))
    return known.select("cycle", "user_id", "category", weight.alias("weight"))


def profile_backtest(
    tables: VideoTables, start: str, count: int, k: int, measure: str, model: str, watch: bool = False
) -> DataFrame:
    """(split_date, dt, seven metrics, users, model) over ``count`` consecutive splits."""
    cycles = Cycles(start, count)
    catalogue = _catalogue(tables, cycles)
    declared = (
        cycles.trained(tables.interest.where(F.col("name").isNotNull()), "updated_at")
        .groupBy("user_id", F.col("name").alias("category"))
        .agg(F.min("first").alias("first"))
    )
    vocabulary = declared.groupBy("category").agg(F.min("first").alias("first"))
    truth = _truth(tables, cycles, catalogue)
    profiles = _profiles(_parts(tables, cycles, catalogue, declared, watch), truth, vocabulary, watch)

    fresh = shelf(catalogue, LIST_SIZE, ("first",)).select("first", "category", F.explode("videos").alias("video_id"))
    named = cycles.from_first(vocabulary)
    open_shelves = shelf(cycles.from_first(fresh), LIST_SIZE, ("cycle",)).join(named, ["cycle", "category"], "left_semi")
    sizes = cycles.from_first(catalogue.groupBy("first").agg(F.countDistinct("video_id").alias("n")))
    sizes = sizes.groupBy("cycle").agg(F.sum("n").alias("n"))

    keys = ["cycle", "user_id"]
    ranked = rank_shelves(user_weights(profiles, keys), open_shelves, keys, LIST_SIZE, measure, by="cycle")
    lists = user_lists(ranked, keys)
    counts = list_counts(truth.join(lists, keys), ["cycle", "dt", "user_id"], k).join(sizes, "cycle")
    daily = macro_daily(user_metrics(counts, k), model, ("cycle", "dt"))
    return daily.withColumn("split_date", cycles.split_date()).drop("cycle")


def content_backtest(tables: VideoTables, start: str, count: int, k: int = 3) -> DataFrame:
    return profile_backtest(tables, start, count, k, "cosine", "knn")


def weighted_backtest(tables: VideoTables, start: str, count: int, k: int = 10) -> DataFrame:
    return profile_backtest(tables, start, count, k, "dot", "svd", watch=True)

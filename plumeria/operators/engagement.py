"""How often recommendations are acted on within a few days.

Two forms give the same numbers. ``acted_flags`` joins recommendations to actions
row by row, for actions that are unique per item and user, and for streams.
``acted_counts`` counts the actions inside each interval from running totals, so a
pair of item and user with many rows on both sides never multiplies out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.dates import acted_within, plus_days
from plumeria.operators.splits import since


def first_action(actions: DataFrame, item: str, user: str, when: str) -> DataFrame:
    """One row per (item, user) with its earliest time."""
    return actions.groupBy(item, user).agg(F.min(when).alias(when))


def acted_flags(
    recs: DataFrame,
    actions: DataFrame,
    *,
    rec_item: str,
    rec_user: str,
    rec_time: str,
    item: str,
    user: str,
    when: str,
    days: int = 2,
) -> DataFrame:
    """Recommendations left-joined to actions, with a 0/1 ``is_acted`` flag."""
    left = recs.select(
        F.col(rec_item).alias("rec_item"), F.col(rec_user).alias("rec_user"), F.col(rec_time).alias("rec_time")
    )
    right = actions.select(
        F.col(item).alias("act_item"), F.col(user).alias("act_user"), F.col(when).alias("act_time")
    )
    match = (F.col("rec_item") == F.col("act_item")) & (F.col("rec_user") == F.col("act_user"))
    return left.join(right, match, "left").withColumn("is_acted", acted_within("rec_time", "act_time", days))


def acted_counts(
    recs: DataFrame,
    actions: DataFrame,
    *,
    rec_item: str,
    rec_user: str,
    rec_time: str,
    item: str,
    user: str,
    when: str,
    days: int = 2,
) -> DataFrame:
    """(rec_time, copies, matches, total): per item, user and time of recommendation, how
    often it was shown, how many actions fall into its interval, and how many exist for
    its item and user at all.

    Actions up to the end of the interval minus actions before its start. The
    running totals are cut by calendar day, so one busy pair spreads over tasks.
    """
    pair = ["item", "user"]
    # At equal times a start sorts before the actions and an end after them.
    edges = F.explode(
        F.array(
            F.struct(F.col(rec_time).alias("at"), F.lit(0).alias("kind")),
            F.struct(plus_days(rec_time, days).alias("at"), F.lit(2).alias("kind")),
        )
    )
    probes = recs.select(
        F.col(rec_item).alias("item"), F.col(rec_user).alias("user"), F.col(rec_time).alias("rec_time"), edges.alias("e")
    ).select(*pair, "rec_time", "e.at", "e.kind", F.lit(0).alias("weight"))
    acted = actions.where(F.col(item).isNotNull() & F.col(user).isNotNull() & F.col(when).isNotNull()).select(
        F.col(item).alias("item"), F.col(user).alias("user"), F.col(when).alias("at")
    )
    points = probes.unionByName(
        acted.withColumns({"kind": F.lit(1), "weight": F.lit(1)}), allowMissingColumns=True
    ).withColumn("day", F.to_date("at"))

    inside = (
        Window.partitionBy(*pair, "day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = points.withColumn("local", F.sum("weight").over(inside)).where("kind <> 1")
    earlier = Window.partitionBy(*pair).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        points.groupBy(*pair, "day")
        .agg(F.sum("weight").alias("n"))
        .select(
            *pair, "day", F.sum("n").over(earlier).alias("base"), F.sum("n").over(Window.partitionBy(*pair)).alias("total")
        )
    )
    upto = F.col("local") + F.coalesce("base", F.lit(0))
    hits = F.sum(F.when(F.col("kind") == 2, upto).otherwise(-upto))
    copies = F.count(F.when(F.col("kind") == 2, 1))
    return (
        running.join(before, [*pair, "day"], "left")
        .groupBy(*pair, "rec_time")
        .agg(copies.alias("copies"), hits.alias("hits"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
        .select("rec_time", "copies", F.expr("hits div copies").alias("matches"), "total")
    )


def counted_rate(counts: DataFrame, acted: str, rate: str, interval_in_join: bool, stamp: Column | None = None):
    """The same columns as ``daily_rate``, from counts.

    A recommendation counts once per action of its item and user, at least once;
    with ``interval_in_join`` only actions inside the interval count.
    """
    rows = F.greatest(F.col("matches") if interval_in_join else F.col("total"), F.lit(1))
    hits, shown = F.sum(F.col("copies") * F.col("matches")), F.sum(F.col("copies") * rows)
    out = counts.groupBy(F.to_date("rec_time").alias("recommendation_date")).agg(
        hits.alias(acted), shown.alias("number_recommended"), (hits / shown).alias(rate)
    )
    return out if stamp is None else out.withColumn("dt", stamp)


def daily_rate(flags: DataFrame, acted: str, rate: str, stamp: Column | None = None) -> DataFrame:
    """Sum, count and ratio of the flags per recommendation date."""
    hits = F.sum("is_acted").cast("bigint")
    out = flags.groupBy(F.to_date("rec_time").alias("recommendation_date")).agg(
        hits.alias(acted),
        F.count("is_acted").alias("number_recommended"),
        (hits / F.count("is_acted")).alias(rate),
    )
    return out if stamp is None else out.withColumn("dt", stamp)


def video_upvote_rate(
    recs: DataFrame,
    votes: DataFrame,
    as_of: Column,
    lookback_days: int = 2,
    status: str | None = None,
    stamp: Column | None = None,
) -> DataFrame:
    """Per-day share of video recommendations voted on within two days.

    Any vote counts unless ``status`` names one; repeated votes count once.
    """
    counted = votes if status is None else votes.where(F.col("status") == status)
    flags = acted_flags(
        since(recs, "created_at", as_of, lookback_days),
        first_action(counted, "video_id", "voter_id", "created_at"),
        rec_item="recommended_video_id",
        rec_user="user_id",
        rec_time="created_at",
        item="video_id",
        user="voter_id",
        when="created_at",
    )
    return daily_rate(flags, "upvoted_videos", "upvote_percentage", stamp)


def conversation_like_rate(
    recs: DataFrame,
    likes: DataFrame,
    as_of: Column | None = None,
    lookback_days: int = 2,
    interval_in_join: bool = False,
    stamp: Column | None = None,
) -> DataFrame:
    """Per-day share of conversation recommendations liked within two days.

    Likes are not deduplicated: each like of the pair adds to the count. With
    ``interval_in_join`` likes outside the interval add nothing, which is the form
    a stream can compute with bounded state.
    """
    counts = acted_counts(
        recs if as_of is None else since(recs, "created_at", as_of, lookback_days),
        likes,
        rec_item="recommended_conversation_id",
        rec_user="user_id",
        rec_time="created_at",
        item="conversation_id",
        user="like_giver_id",
        when="liked_at",
    )
    return counted_rate(counts, "liked_conversations", "like_percentage", interval_in_join, stamp)

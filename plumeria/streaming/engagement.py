"""The acted-upon rate as a stream: updated while the two-day window is open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumeria.functions.dates import acted_within, plus_days
from plumeria.session import cut_lineage
from plumeria.sources.tables import upsert_by_date


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _shown(recs: DataFrame, item: str, lateness: str) -> DataFrame:
    return recs.select(
        F.col("recommendation_id").alias("rec_id"),
        F.col(item).alias("rec_item"),
        F.col("user_id").alias("rec_user"),
        F.col("created_at").cast("timestamp").alias("rec_time"),
    ).withWatermark("rec_time", lateness)


def _acted(actions: DataFrame, item: str, user: str, when: str, lateness: str) -> DataFrame:
    return actions.select(
        F.col(item).alias("act_item"), F.col(user).alias("act_user"), F.col(when).cast("timestamp").alias("act_time")
    ).withWatermark("act_time", lateness)


def _flags(shown: DataFrame, acted: DataFrame, days: int) -> DataFrame:
    """Left outer join on item, user and interval: state is dropped once no later action can match."""
    within = F.col("act_time").between(F.col("rec_time"), plus_days("rec_time", days))
    match = (F.col("rec_item") == F.col("act_item")) & (F.col("rec_user") == F.col("act_user")) & within
    return shown.join(acted, match, "left_outer").withColumn("is_acted", acted_within("rec_time", "act_time", days))


def _daily(flags: DataFrame, acted: str, rate: str) -> DataFrame:
    """Per recommendation date, emitted once the date is final."""
    hits = F.sum("is_acted").cast("bigint")
    daily = flags.groupBy(F.window("rec_time", "1 day")).agg(
        hits.alias(acted),
        F.count("is_acted").alias("number_recommended"),
        (hits / F.count("is_acted")).alias(rate),
    )
    return daily.select(F.to_date("window.start").alias("recommendation_date"), acted, "number_recommended", rate)


def conversation_rate_stream(
    recs: DataFrame, likes: DataFrame, days: int = 2, lateness: str = "1 hour"
) -> DataFrame:
    """(recommendation_date, liked_conversations, number_recommended, like_percentage); every like counts."""
    flags = _flags(
        _shown(recs, "recommended_conversation_id", lateness),
        _acted(likes, "conversation_id", "like_giver_id", "liked_at", lateness),
        days,
    )
    return _daily(flags, "liked_conversations", "like_percentage")


def video_rate_stream(recs: DataFrame, votes: DataFrame, days: int = 2, lateness: str = "1 hour") -> DataFrame:
    """(recommendation_date, upvoted_videos, number_recommended, upvote_percentage).

    A recommendation counts once, however many votes fall into its interval. A vote
    from before the recommendation is not remembered, unlike in the batch form.
    """
    flags = _flags(
        _shown(recs, "recommended_video_id", lateness),
        _acted(votes, "video_id", "voter_id", "created_at", lateness),
        days,
    )
    key = ["rec_id", "rec_item", "rec_user", "rec_time"]
    once = flags.select(*key, "is_acted").dropDuplicates(key)
    return _daily(once, "upvoted_videos", "upvote_percentage")


def upsert_rates(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps one row per recommendation date in a Parquet table."""

    def write(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            upsert_by_date(spark, path, batch, ["recommendation_date"], "recommendation_date")

    return write


def landed(recs: DataFrame, actions: DataFrame, names: dict[str, str]) -> DataFrame:
    """Recommendations and actions as one stream of (kind, id, item, user, at).

    ``names`` says which columns they are: rec_id, rec_item, rec_user, rec_time, act_item, act_user, act_time.
    """

    def rows(df: DataFrame, kind: str, ident) -> DataFrame:
        columns = [F.col(names[f"{kind}_{c}"]).alias(c) for c in ("item", "user")]
        return df.select(F.lit(kind).alias("kind"), ident.alias("id"), *columns, F.col(names[f"{kind}_time"]).cast("timestamp").alias("at"))

    kind_of_id = dict(recs.dtypes)[names["rec_id"]]
    return rows(recs, "rec", F.col(names["rec_id"])).unionByName(rows(actions, "act", F.lit(None).cast(kind_of_id)))


def refresh_rates(
    spark: SparkSession, log: str, rates: str, rate: Callable[[DataFrame, DataFrame], DataFrame], days: int = 2
) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the rates of all dates up to date, also of those whose interval is open.

    Rows land in a log by batch; a batch that comes again replaces its part. The dates that its
    rows can change are rated again from the log and replace the stored ones. Late rows count.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        whole = spark.read.parquet(log)
        day = F.to_date("at")
        # An action changes recommendations of its own day and of the days before that reach it.
        back = F.when(F.col("kind") == "act", days).otherwise(0)
        new = whole.where(F.col("epoch") == epoch).select(F.explode(F.sequence(F.date_sub(day, back), day)).alias("day"))
        touched = sorted(r[0] for r in new.distinct().collect())
        if not touched:
            return
        recs = whole.where((F.col("kind") == "rec") & day.isin(touched))
        reach = F.date_add(F.lit(touched[-1]), days + 1)
        acts = whole.where((F.col("kind") == "act") & day.between(F.lit(touched[0]), reach))
        recs = recs.select(F.col("id").alias("rec_id"), F.col("item").alias("rec_item"), F.col("user").alias("rec_user"), F.col("at").alias("rec_time"))
        acts = acts.select(F.col("item").alias("act_item"), F.col("user").alias("act_user"), F.col("at").alias("act_time"))
        # One row per date: a year's rates are one small file.
        rated = rate(recs, acts).withColumn("year", F.year("recommendation_date"))
        upsert_by_date(spark, rates, cut_lineage(rated), ["recommendation_date"], "year")

    return write


def like_rate(recs: DataFrame, acts: DataFrame, days: int = 2) -> DataFrame:
    """Rates from (rec_id, rec_item, rec_user, rec_time) and (act_item, act_user, act_time); every like counts."""
    return _daily(_flags(recs, acts, days), "liked_conversations", "like_percentage")


def vote_rate(recs: DataFrame, acts: DataFrame, days: int = 2) -> DataFrame:
    """As ``like_rate``; a recommendation counts once, however many votes fall into its interval."""
    key = ["rec_id", "rec_item", "rec_user", "rec_time"]
    once = _flags(recs, acts, days).groupBy(*key).agg(F.max("is_acted").alias("is_acted"))
    return _daily(once, "upvoted_videos", "upvote_percentage")


def drain(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process everything that is available, then stop; the checkpoint carries on next time."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

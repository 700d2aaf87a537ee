"""Streaming plans drained over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumeria.plans.views import SocialTables
from plumeria.session import scratch_folder
from plumeria.streaming.engagement import drain, file_stream, landed, like_rate, refresh_rates, vote_rate
from plumeria.streaming.ingest import merge_into

LIKE_NAMES = {
    "rec_id": "recommendation_id",
    "rec_item": "recommended_conversation_id",
    "rec_user": "user_id",
    "rec_time": "created_at",
    "act_item": "conversation_id",
    "act_user": "like_giver_id",
    "act_time": "liked_at",
}
VOTE_NAMES = {
    "rec_id": "recommendation_id",
    "rec_item": "recommended_video_id",
    "rec_user": "user_id",
    "rec_time": "created_at",
    "act_item": "video_id",
    "act_user": "voter_id",
    "act_time": "created_at",
}


class StreamedTables(SocialTables):
    """The same views over file streams; a table is a file or a folder of part files."""

    def __init__(self, spark: SparkSession, folder: str, files_per_batch: int | None = None):
        super().__init__(spark, folder)
        self.files_per_batch = files_per_batch

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema
        # As a pattern, as a stream takes a plain path for a folder.
        return file_stream(self.spark, f"{self.folder}/{name}.parque[t]", schema, self.files_per_batch)


def _refreshed(spark: SparkSession, rows: DataFrame, rate) -> DataFrame:
    folder = scratch_folder(spark, "stream")
    write = refresh_rates(spark, f"{folder}/log", f"{folder}/rates", rate)
    drain(rows, write, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rates")


def like_rates(tables: SocialTables, files_per_batch: int | None = None) -> DataFrame:
    """Rates of all dates, open ones included, after everything available has been streamed."""
    streams = StreamedTables(tables.spark, tables.folder, files_per_batch)
    rows = landed(streams.rs_daily_conversation_for_user(), streams.conversation_like(), LIKE_NAMES)
    rates = _refreshed(tables.spark, rows, like_rate)
    return rates.select("recommendation_date", "liked_conversations", "number_recommended", "like_percentage")


def video_rates(tables: SocialTables, files_per_batch: int | None = None) -> DataFrame:
    """Rates of all dates from recommendations and votes landed as files."""
    folder = scratch_folder(tables.spark, "stream")
    recs, votes = tables.rs_daily_video_for_user(), tables.vote()
    recs.write.parquet(f"{folder}/recs")
    votes.write.parquet(f"{folder}/votes")
    rows = landed(
        file_stream(tables.spark, f"{folder}/recs", recs.schema, files_per_batch),
        file_stream(tables.spark, f"{folder}/votes", votes.schema, files_per_batch),
        VOTE_NAMES,
    )
    rates = _refreshed(tables.spark, rows, vote_rate)
    return rates.select("recommendation_date", "upvoted_videos", "number_recommended", "upvote_percentage")


def merged_likes(tables: SocialTables) -> DataFrame:
    """Likes as a snapshot kept up to date by a stream."""
    folder = scratch_folder(tables.spark, "stream")
    streams = StreamedTables(tables.spark, tables.folder)
    likes = streams.conversation_like()
    write = merge_into(tables.spark, f"{folder}/likes", ["activity_id"], "liked_at")
    drain(likes, write, f"{folder}/state").awaitTermination()
    return tables.spark.read.parquet(f"{folder}/likes").select(*likes.columns)

"""Social-app tables derived from the given Parquet tables.

Each view maps retail and event rows onto the columns the recommender operators
read: lineitems become votes and video recommendations, orders carry the acting
user, parts are videos, events are conversation views and likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _six(value: Column) -> Column:
    """Six decimals; halves, as seen at twelve decimals, go up."""
    return F.round(F.round(value, 12) + 1e-10, 6)


class SocialTables:
    """Lazily builds each view over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def season(self) -> DataFrame:
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("id"),
                F.col("r_name").alias("category"),
            )
        )

    def video(self) -> DataFrame:
        first_shipped = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("created_at"))
        return (
            self.table("part")
            .join(first_shipped, F.col("p_partkey") == F.col("l_partkey"))
            .select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("season_id"), "created_at")
        )

    def _order_lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def vote(self) -> DataFrame:
        return self._order_lines().select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_partkey").alias("video_id"),
            F.col("o_custkey").alias("voter_id"),
            F.when(F.col("l_returnflag") == "R", "DOWNVOTE").otherwise("UPVOTE").alias("status"),
            F.col("l_shipdate").alias("created_at"),
        )

    def app_user(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100).cast("bigint")).alias("follower_count"),
            (F.col("c_custkey") % 97).cast("bigint").alias("following_count"),
            F.col("c_mktsegment").alias("type"),
        )

    def user_interest(self) -> DataFrame:
        customer, region = self.table("customer"), self.table("region")
        home = (
            customer.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("name"))
        )
        second = customer.join(region, F.col("r_regionkey") == F.col("c_custkey") % 5).select(
            F.col("c_custkey").alias("user_id"), F.col("r_name").alias("name")
        )
        first_order = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("updated_at"))
        return (
            home.unionByName(second)
            .where(F.col("user_id") % 3 != 0)
            .distinct()
            .join(first_order, F.col("user_id") == F.col("o_custkey"))
            .select("user_id", "name", "updated_at")
        )

    def source(self, table: str) -> DataFrame:
        """A table with the id and the time column by which extracts find new rows."""
        opened = F.lit("1992-01-01").cast("date")
        if table == "user":
            first_order = self.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("updated_at"))
            return self.app_user().join(first_order, "id", "left").withColumn("updated_at", F.coalesce("updated_at", opened))
        if table == "user_interest":
            return self.user_interest().withColumn("id", F.xxhash64("user_id", "name"))
        if table == "season":
            return self.season().withColumn("created_at", opened)
        if table == "vote":
            return self.vote().withColumn("id", F.xxhash64("id", "video_id", "voter_id", "status", "created_at"))
        return {"video": self.video, "conversation_like": self.conversation_like}[table]()

    def post_feed(self) -> DataFrame:
        return self._order_lines().select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("post_id"),
            F.when(F.col("l_linestatus") == "O", "VIDEO").otherwise("IMAGE").alias("media_type"),
            F.col("l_quantity").alias("watch_time"),
            F.lit(50.0).alias("video_duration"),
        )

    def rs_daily_video_for_user(self) -> DataFrame:
        return self._order_lines().select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("recommendation_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("recommended_video_id"),
            F.col("o_orderdate").alias("created_at"),
        )

    @staticmethod
    def _conversation_key():
        return F.get_json_object("props", "$.k").cast("bigint")

    def rs_daily_conversation_for_user(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_type = 'view'")
            .select(
                F.col("event_id").alias("recommendation_id"),
                "user_id",
                self._conversation_key().alias("recommended_conversation_id"),
                F.col("ts").alias("created_at"),
            )
        )

    def conversation_like(self) -> DataFrame:
        return (
            self.table("events")
            .where(F.col("event_type").isin("click", "purchase"))
            .select(
                F.col("event_id").alias("activity_id"),
                F.col("user_id").alias("like_giver_id"),
                self._conversation_key().alias("conversation_id"),
                F.col("ts").alias("liked_at"),
            )
        )

    def conversation(self) -> DataFrame:
        first_seen = (
            self.table("events")
            .groupBy(self._conversation_key().alias("id"))
            .agg(F.min("ts").alias("created_at"))
        )
        return first_seen.join(self.table("region"), F.col("r_regionkey") == F.col("id") % 5).select(
            "id",
            "created_at",
            F.col("r_name").alias("categories"),
            F.concat(F.lit("topic "), F.col("r_name")).alias("title"),
            F.when(F.col("id") % 10 == 0, None)
            .otherwise(F.concat(F.lit("caption "), F.col("id").cast("string")))
            .alias("caption"),
        )

    def model_metrics(self) -> DataFrame:
        return (
            self.table("events")
            .groupBy(F.to_date("ts").alias("dt"), F.col("event_type").alias("model"))
            .agg(
                _six(F.avg("value") / 500).alias("roc_auc_score"),
                _six(F.avg("value") / 600).alias("accuracy"),
                _six(F.avg("value") / 700).alias("precision_score"),
                _six(F.avg("value") / 800).alias("recall"),
                _six(F.avg("value") / 900).alias("f1_score"),
                _six(F.min("value") / 500).alias("hit_ratio_k"),
                _six(F.max("value") / 500).alias("ndcg_k"),
            )
        )

    def rate_log(self) -> DataFrame:
        acted = F.col("event_id") % 7
        shown = F.lit(10).cast("bigint") + F.col("event_id") % 50
        return (
            self.table("events")
            .where("event_type = 'view'")
            .select(
                F.to_date("ts").alias("recommendation_date"),
                F.col("ts").alias("dt"),
                acted.alias("liked_conversations"),
                shown.alias("number_recommended"),
                (acted.cast("double") / shown).alias("like_percentage"),
            )
        )

    def model_feedback(self) -> DataFrame:
        return self.table("events").select(
            (F.lit(1).cast("bigint") + F.col("event_id") % 5).alias("rating"),
            F.col("props").alias("feedback"),
            F.col("event_type").alias("model"),
            F.when(F.col("event_id") % 2 == 0, "video").otherwise("convo").alias("recommended_item"),
            "user_id",
        )

    def account(self) -> DataFrame:
        key = F.col("c_custkey")
        name = F.concat(F.lit("user"), key.cast("string"))
        return self.table("customer").select(
            key.cast("string").alias("user_id"),
            name.alias("username"),
            F.concat(name, F.when(key % 7 == 0, "#bad").otherwise("@mail.com")).alias("email"),
            F.when(key % 3 == 0, "admin")
            .when(key % 3 == 1, "user_for_videos")
            .otherwise("user_for_conversation")
            .alias("role"),
        )

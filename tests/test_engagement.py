"""The acted-upon rate in batch and as a stream."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from plumeria.functions.dates import ts
from plumeria.operators.engagement import conversation_like_rate, video_upvote_rate
from plumeria.plans.views import SocialTables
from plumeria.streaming.engagement import conversation_rate_stream, drain, drain_to_parquet, file_stream, upsert_rates
from plumeria.streaming.ingest import merge_into

RECS = "recommendation_id bigint, user_id bigint, recommended_conversation_id bigint, created_at timestamp_ntz"
LIKES = "activity_id bigint, like_giver_id bigint, conversation_id bigint, liked_at timestamp_ntz"


def at(hours, minutes=0, seconds=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours, minutes=minutes, seconds=seconds)


def test_interval_edges(spark):
    """Likes at 0 h and 48 h count; one before, one after and one by another user do not."""
    cases = [(1, at(0)), (2, at(48)), (3, at(0) - dt.timedelta(seconds=1)), (4, at(48, 0, 1)), (6, at(1)), (6, at(2))]
    recs = spark.createDataFrame([(i, i, i, at(0)) for i in range(1, 7)], RECS)
    likes = spark.createDataFrame([(n, i, i, t) for n, (i, t) in enumerate(cases)] + [(99, 7, 5, at(1))], LIKES)
    row = conversation_like_rate(recs, likes).first()
    assert (row["liked_conversations"], row["number_recommended"]) == (4, 7)
    narrow = conversation_like_rate(recs, likes, interval_in_join=True).first()
    assert (narrow["liked_conversations"], narrow["number_recommended"]) == (4, 7)


def test_interval_in_join_drops_late_rows(spark):
    recs = spark.createDataFrame([(1, 1, 1, at(0))], RECS)
    likes = spark.createDataFrame([(1, 1, 1, at(1)), (2, 1, 1, at(90))], LIKES)
    assert conversation_like_rate(recs, likes).first()["number_recommended"] == 2
    assert conversation_like_rate(recs, likes, interval_in_join=True).first()["number_recommended"] == 1


def test_counts_equal_the_row_join(spark):
    """Repeated recommendations and likes of the same pairs, at equal and different times."""
    rng = random.Random(11)
    recs = [(n, rng.randint(1, 3), rng.randint(1, 2), at(rng.randint(0, 120))) for n in range(60)]
    acts = [(n, rng.randint(1, 3), rng.randint(1, 3), at(rng.randint(0, 160))) for n in range(80)]
    recs += [(97, None, 1, at(5)), (98, 1, None, at(5)), (99, None, None, at(5))]
    acts += [(97, None, 1, at(6)), (98, 1, None, at(6)), (99, None, None, at(6))]
    shown, liked = spark.createDataFrame(recs, RECS), spark.createDataFrame(acts, LIKES)
    for narrow in (False, True):
        want = {}
        for _, user, item, start in recs:
            end = start + dt.timedelta(days=2)
            times = [t for _, u, c, t in acts if None not in (user, item) and (u, c) == (user, item)]
            inside = [t for t in times if start <= t <= end]
            cell = want.setdefault(start.date(), [0, 0])
            cell[0] += len(inside)
            cell[1] += max(1, len(inside if narrow else times))
        rows = conversation_like_rate(shown, liked, interval_in_join=narrow).collect()
        got = {r["recommendation_date"]: [r["liked_conversations"], r["number_recommended"]] for r in rows}
        assert got == want


def test_a_busy_pair_does_not_multiply(spark):
    """20,000 recommendations and 30,000 likes of one pair: a row join would make 600 million rows."""
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seconds)")
    one = F.lit(1).cast("bigint")

    def moments(n, step):
        return spark.range(n).withColumn("seconds", (F.col("id") * step % 864_000).cast("int"))

    recs = moments(20_000, 911).select(
        F.col("id").alias("recommendation_id"), one.alias("user_id"), one.alias("recommended_conversation_id"),
        start.alias("created_at"),
    )
    likes = moments(30_000, 977).select(
        F.col("id").alias("activity_id"), one.alias("like_giver_id"), one.alias("conversation_id"), start.alias("liked_at")
    )
    rec_at = np.arange(20_000) * 911 % 864_000
    like_at = np.sort(np.arange(30_000) * 977 % 864_000)
    inside = np.searchsorted(like_at, rec_at + 172_800, "right") - np.searchsorted(like_at, rec_at, "left")
    rows = conversation_like_rate(recs, likes).collect()
    assert sum(r["liked_conversations"] for r in rows) == inside.sum()
    assert sum(r["number_recommended"] for r in rows) == 20_000 * 30_000


def test_first_vote_counts_once(spark):
    recs = spark.createDataFrame(
        [(1, 1, 5, at(0)), (2, 2, 5, at(0)), (3, 1, 5, at(-100))],
        "recommendation_id bigint, user_id bigint, recommended_video_id bigint, created_at timestamp_ntz",
    )
    votes = spark.createDataFrame(
        [(1, 5, 1, "DOWNVOTE", at(1)), (2, 5, 1, "UPVOTE", at(3)), (3, 5, 2, "UPVOTE", at(60))],
        "id bigint, video_id bigint, voter_id bigint, status string, created_at timestamp_ntz",
    )
    row = video_upvote_rate(recs, votes, ts("2024-01-02"), 2).first()
    assert (row["upvoted_videos"], row["number_recommended"]) == (1, 2)
    none = video_upvote_rate(recs, votes, ts("2024-01-02"), 2, status="MISSING").first()
    assert none["upvoted_videos"] == 0


def write_stream_inputs(spark, folder, root, sentinel):
    tables = SocialTables(spark, folder)
    recs, likes = tables.rs_daily_conversation_for_user(), tables.conversation_like()
    recs.coalesce(1).write.mode("append").parquet(f"{root}/recs")
    likes.coalesce(1).write.mode("append").parquet(f"{root}/likes")
    return recs, likes


def add_sentinel(spark, root, day):
    moment = dt.datetime.fromisoformat(day)
    spark.createDataFrame([(-1, -1, -1, moment)], RECS).coalesce(1).write.mode("append").parquet(f"{root}/recs")
    spark.createDataFrame([(-1, -2, -1, moment)], LIKES).coalesce(1).write.mode("append").parquet(f"{root}/likes")


def test_stream_equals_batch(spark, folder, tmp_path):
    root = str(tmp_path)
    recs, likes = write_stream_inputs(spark, folder, root, None)

    def rates():
        left = file_stream(spark, f"{root}/recs", recs.schema)
        return conversation_rate_stream(left, file_stream(spark, f"{root}/likes", likes.schema))

    sink, store = f"{root}/rates", f"{root}/store"
    for day in [None, "2024-03-01", "2024-03-10"]:
        if day:
            add_sentinel(spark, root, day)
        drain(rates(), upsert_rates(spark, sink), store).awaitTermination()
    columns = ["recommendation_date", "liked_conversations", "number_recommended"]
    got = spark.read.parquet(sink).where("recommendation_date < DATE '2024-02-15'").select(*columns)
    want = conversation_like_rate(recs, likes, interval_in_join=True).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_drops_likes_behind_the_watermark(spark, tmp_path):
    root = str(tmp_path)

    def put(recs, likes):
        if recs:
            spark.createDataFrame(recs, RECS).coalesce(1).write.mode("append").parquet(f"{root}/recs")
        if likes:
            spark.createDataFrame(likes, LIKES).coalesce(1).write.mode("append").parquet(f"{root}/likes")

    def run():
        recs = file_stream(spark, f"{root}/recs", RECS)
        likes = file_stream(spark, f"{root}/likes", LIKES)
        drain_to_parquet(conversation_rate_stream(recs, likes), f"{root}/out", f"{root}/store").awaitTermination()

    put([(1, 1, 1, at(0)), (2, 2, 2, at(0))], [(1, 9, 9, at(0))])
    run()
    put([(3, 3, 3, at(10))], [(2, 1, 1, at(5))])
    run()
    put([(4, 8, 8, at(24 * 9))], [(3, 8, 9, at(24 * 9))])
    run()
    put([(5, 8, 8, at(24 * 20))], [(4, 2, 2, at(3)), (5, 8, 9, at(24 * 20))])
    run()
    put([(6, 8, 8, at(24 * 30))], [(6, 8, 9, at(24 * 30))])
    run()
    rows = {
        r["recommendation_date"]: (r["liked_conversations"], r["number_recommended"])
        for r in spark.read.parquet(f"{root}/out").collect()
    }
    assert rows[dt.date(2024, 1, 1)] == (1, 3)


def test_refreshed_rates_replace_older_ones(spark, tmp_path):
    write = upsert_rates(spark, str(tmp_path / "rates"))
    columns = "recommendation_date date, liked_conversations bigint, number_recommended bigint, like_percentage double"
    day = dt.date(2024, 1, 1)
    for hits in (1, 1, 2):
        write(spark.createDataFrame([(day, hits, 4, hits / 4)], columns), 0)
    rows = spark.read.parquet(str(tmp_path / "rates")).collect()
    assert [(r["liked_conversations"], r["like_percentage"]) for r in rows] == [(2, 0.5)]


def test_streamed_merge_equals_the_source(spark, folder, tmp_path):
    root = str(tmp_path)
    likes = SocialTables(spark, folder).conversation_like()
    early, late = likes.where("liked_at < TIMESTAMP_NTZ '2024-01-15'"), likes.where("liked_at >= TIMESTAMP_NTZ '2024-01-10'")
    sink = merge_into(spark, f"{root}/snapshot", ["activity_id"], "liked_at")
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = file_stream(spark, f"{root}/in", likes.schema)
        drain(stream, sink, f"{root}/store").awaitTermination()
    got = spark.read.parquet(f"{root}/snapshot").select(*likes.columns)
    assert got.count() == likes.count()
    assert got.exceptAll(likes).count() == 0


def test_number_recommended_by_id(spark, folder):
    tables = SocialTables(spark, folder)
    recs = tables.rs_daily_conversation_for_user()
    total = conversation_like_rate(recs, tables.conversation_like()).agg(F.sum("number_recommended")).first()[0]
    assert total >= recs.count()


def test_streamed_rates_of_folder_tables_in_several_batches(spark, folder, tmp_path):
    """Open dates are published, late likes count, and a folder of part files is read whole."""
    from plumeria.plans import streams

    spark.read.parquet(f"{folder}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    tables = SocialTables(spark, str(tmp_path))
    streamed = streams.like_rates(tables, files_per_batch=1)
    batch = conversation_like_rate(tables.rs_daily_conversation_for_user(), tables.conversation_like(), interval_in_join=True)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    merged = streams.merged_likes(tables)
    assert merged.count() == tables.conversation_like().select("activity_id").distinct().count()

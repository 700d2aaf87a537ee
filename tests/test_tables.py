"""Sources, sinks and keyed writes."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.feather as pf
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumeria.operators import keyed, quality, series
from plumeria.schemas import conform, schema
from plumeria.sources import feather, tables
from plumeria.sources.jdbc import JdbcTables


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_feather_reads_every_batch(spark, tmp_path):
    table = pa.table(
        {
            "id": pa.array(range(25), pa.int64()),
            "name": pa.array([f"n{i % 3}" for i in range(25)]).dictionary_encode(),
            "ts": pa.array(pd.date_range("2024-01-01", periods=25, freq="h").as_unit("ns")),
        }
    )
    pf.write_feather(table, str(tmp_path / "t.feather"), chunksize=10)
    df = feather.read_feather(spark, str(tmp_path / "t.feather"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "ts": "timestamp_ntz"}
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 25
    assert df.agg(F.max("ts")).first()[0] == dt.datetime(2024, 1, 2, 0)


def test_feather_round_trip_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "new" / "folder")
    df = spark.range(100).withColumn("x", F.col("id") / 7)
    feather.write_feather(df.repartition(3), path)
    assert rows_of(feather.read_feather(spark, path)) == rows_of(df)
    feather.write_feather(df.limit(5), path)
    assert feather.read_feather(spark, path).count() == 5


def test_snapshot_and_conform(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "MUSIC", "x")], "id string, category string, extra string")
    with pytest.raises(ValueError, match="created_at"):
        conform(rows, "season")
    full = rows.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    tables.snapshot_tables(lambda name: full, ["season"], str(tmp_path))
    assert tables.read_snapshot(spark, str(tmp_path), "season").columns == ["id", "category", "created_at"]


def test_load_first_falls_back_to_an_empty_table(spark, tmp_path):
    missing = lambda: spark.read.parquet(str(tmp_path / "none"))
    empty = tables.load_first(spark, [missing], "account")
    assert empty.count() == 0 and empty.schema == schema("account")
    known = spark.createDataFrame([("1", "ann", "a@b.c", "x", "admin")], schema("account"))
    assert tables.load_first(spark, [missing, lambda: known], "account").count() == 1


DIRTY = """,dt,roc_auc_score,accuracy,precision,recall,f1_score,hit_ratio_k,ndcg_k,model
<<<<<<< HEAD,,,,,,,,,
0,2023-07-01,0.5,0.9,0.1,0.2,0.3,0.4,0.5,als
1,2023-7-2,0.5,0.9,,0.2,0.3,0.4,0.5,als
=======,,,,,,,,,
2,not a day,0.5,0.9,0.1,0.2,0.3,0.4,0.5,als
3,2023-13-01,0.5,0.9,0.1,0.2,0.3,0.4,0.5,als
>>>>>>> branch,,,,,,,,,
"""


def test_dirty_metric_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(DIRTY)
    df = tables.read_metrics_csv(spark, str(path), dirty=True)
    assert df.columns == ["dt", *series.METRICS, "model"]
    rows = df.orderBy("dt").collect()
    assert [r["dt"] for r in rows] == [dt.date(2023, 7, 1), dt.date(2023, 7, 2)]
    assert rows[0]["precision_score"] == 0.1 and rows[1]["precision_score"] is None
    tables.write_csv(df, str(tmp_path / "out"))
    assert tables.read_metrics_csv(spark, str(tmp_path / "out")).count() == 2


def metric_rows(spark, rows):
    full = [(dt.date.fromisoformat(d), *[v] * 7, m) for d, m, v in rows]
    return spark.createDataFrame(full, schema("model_metrics"))


def test_upsert_metrics_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    tables.upsert_metrics(spark, path, metric_rows(spark, [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 1.0)]))
    update = metric_rows(spark, [("2024-01-02", "a", 2.0), ("2024-01-02", "b", 2.0)])
    for _ in range(2):
        tables.upsert_metrics(spark, path, update)
    got = spark.read.parquet(path).select("dt", "model", "recall")
    day1, day2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert rows_of(got) == [(day1, "a", 1.0), (day2, "a", 2.0), (day2, "b", 2.0)]
    tables.upsert_metrics(spark, path, metric_rows(spark, [("2024-01-01", "a", 9.0)]), mode="insert_only")
    assert rows_of(spark.read.parquet(path).select("dt", "model", "recall"))[0] == (day1, "a", 1.0)


def test_a_wrong_batch_does_not_replace_the_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    tables.upsert_metrics(spark, path, metric_rows(spark, [("2024-01-01", "a", 1.0)]))
    wrong = metric_rows(spark, [("2024-01-01", "a", 2.0)]).withColumn("extra", F.lit(1))
    with pytest.raises(AnalysisException):
        tables.upsert_metrics(spark, path, wrong)
    assert spark.read.parquet(path).first()["recall"] == 1.0


def test_repeated_keys_in_a_batch_settle(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = metric_rows(spark, [("2024-01-01", "a", 1.0), ("2024-01-01", "a", 3.0), ("2024-01-01", "a", 2.0)])
    tables.upsert_metrics(spark, path, rows)
    assert rows_of(spark.read.parquet(path).select("model", "recall")) == [("a", 3.0)]


def test_partial_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([("1", "ann", "x"), ("2", "bob", None)], "user_id string, username string, email string")
    new = spark.createDataFrame([("9", "bob", "b"), ("3", "cy", "c")], old.schema)
    got = keyed.upsert(old, new, ["username"], ["email"])
    assert rows_of(got) == [("1", "ann", "x"), ("2", "bob", "b"), ("3", "cy", "c")]
    emptied = keyed.upsert(old, new.withColumn("email", F.lit(None).cast("string")), ["username"], ["email"])
    assert ("2", "bob", None) in {tuple(r) for r in emptied.collect()}


def test_accounts_on_disk(spark, tmp_path):
    path = str(tmp_path / "accounts")
    first = [("1", "ann", "a@b.c", "p", "admin"), ("2", "bob", "b@b.c", "p", "admin")]
    spark.createDataFrame(first, schema("account")).write.parquet(path)
    change = spark.createDataFrame([("7", "bob", "new@b.c", "q", "admin"), ("3", "cy", "c@b.c", "p", "admin")], schema("account"))
    tables.upsert_accounts(spark, path, change)
    assert rows_of(spark.read.parquet(path).select("user_id", "email")) == [
        ("1", "a@b.c"), ("2", "new@b.c"), ("3", "c@b.c")
    ]
    tables.delete_rows(spark, path, spark.createDataFrame([("ann",)], "username string"), ["username"])
    assert rows_of(spark.read.parquet(path).select("username")) == [("bob",), ("cy",)]


def test_ensure_table(spark, tmp_path):
    name = f"metrics_{tmp_path.name.replace('-', '_')}"
    assert tables.ensure_table(spark, name, "model_metrics", str(tmp_path / "t"))
    assert not tables.ensure_table(spark, name, "model_metrics")
    assert spark.table(name).schema == schema("model_metrics")
    spark.sql(f"DROP TABLE {name}")


def snapshot(spark, rows):
    return spark.createDataFrame(
        [(i, "u", n, dt.datetime.fromisoformat(t)) for i, n, t in rows],
        "id bigint, user_id string, name string, updated_at timestamp",
    )


def test_incremental_extract_merges_and_keeps_the_delta(spark, tmp_path):
    """A row on the high-water mark, an updated row, a late row and a new row."""
    root, delta_root = str(tmp_path / "root"), str(tmp_path / "delta")
    tables.write_snapshot(snapshot(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")]), root, "user_interest")
    source = snapshot(
        spark,
        [(2, "b", "2024-01-02"), (1, "changed", "2024-01-03"), (5, "late", "2024-01-01"), (3, "c", "2024-01-04"),
         (3, "older", "2024-01-03")],
    )
    delta = tables.extract_new(spark, lambda name: source, "user_interest", root, delta_root)
    assert rows_of(delta.select("id", "name")) == [(1, "changed"), (3, "c"), (3, "older"), (5, "late")]
    merged = spark.read.parquet(f"{root}/user_interest")
    assert rows_of(merged.select("id", "name")) == [(1, "changed"), (2, "b"), (3, "c"), (5, "late")]
    again = tables.extract_new(spark, lambda name: source, "user_interest", root, delta_root)
    assert again.count() == 0
    with pytest.raises(ValueError):
        tables.extract_new(spark, lambda name: source, "contest", root, delta_root)


def test_incremental_extract_appends_facts(spark, tmp_path):
    root, delta_root = str(tmp_path / "root"), str(tmp_path / "delta")
    columns = "activity_id bigint, liked_at timestamp"
    first = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], columns)
    tables.write_snapshot(first, root, "conversation_like")
    source = first.union(spark.createDataFrame([(2, dt.datetime(2024, 1, 2))], columns))
    tables.extract_new(spark, lambda name: source, "conversation_like", root, delta_root, "activity_id")
    assert rows_of(spark.read.parquet(f"{root}/conversation_like").select("activity_id")) == [(1,), (2,)]


def test_feedback_is_validated_and_appended(spark, tmp_path):
    path = str(tmp_path / "feedback")
    rows = spark.createDataFrame(
        [(5, "good", "knn", "video", "u", "admin"), (1, "x" * 501, "knn", "video", "u", "admin"),
         (None, "ok", "knn", "video", "u", "admin")],
        schema("model_feedback"),
    )
    for _ in range(2):
        rejected = tables.append_feedback(rows, path)
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["feedback too long", "missing value"]
    assert spark.read.parquet(path).count() == 2


def test_account_rules(spark):
    rows = [
        ("ann1", "ann@mail.com", "Abcdef1!"),
        ("b", "b@mail.com", "Abcdef1!"),
        ("cy d", "cy.d@mail.com", "Abcdef1!"),
        ("eve", "same@mail.com", "abcdefgh"),
        ("eve", "same@mail.com", "Ab1!"),
        ("kim", "kim@mail.info", "ABCDEFG1!"),
        ("nul", None, None),
    ]
    df = spark.createDataFrame(rows, "username string, email string, password string")
    got = [(r["username"], r["failed"]) for r in quality.failed_rules(df, "password").collect()]
    by_name = {}
    for name, failed in got:
        by_name.setdefault(name, []).append(failed)
    assert by_name["ann1"] == [[]]
    assert by_name["b"] == [["username length"]]
    assert by_name["cy d"] == [["email", "username"]]
    assert by_name["eve"] == [["email repeated", "username repeated", "password"]] * 2
    assert by_name["kim"] == [["email", "password"]]
    assert by_name["nul"] == [["email", "password"]]


def test_jdbc_options():
    db = JdbcTables("jdbc:some://host/db", {"user": "u"})
    options = db.scan_options("vote", "id", 1, 1000, 16)
    assert options["partitionColumn"] == "id" and options["upperBound"] == "1000" and options["numPartitions"] == "16"
    assert "partitionColumn" not in db.scan_options("vote")
    assert db.query_options("SELECT 1") == {
        "url": "jdbc:some://host/db", "query": "SELECT 1", "fetchsize": "10000", "user": "u"
    }
    assert db.append_options("rates")["dbtable"] == "rates"


def test_latest_snapshot_and_trailing_averages(spark):
    rows = [("2024-01-01", "2024-01-01 06:00", 0.1), ("2024-01-01", "2024-01-01 12:00", 0.3), ("2024-01-02", "2024-01-02 00:00", 0.5)]
    log = spark.createDataFrame(rows, "d string, t string, rate double").select(
        F.col("d").cast("date").alias("recommendation_date"), F.col("t").cast("timestamp").alias("dt"), "rate"
    )
    latest = keyed.latest_snapshot(log, "recommendation_date", "dt")
    assert rows_of(latest.select("rate")) == [(0.3,), (0.5,)]
    row = series.trailing_averages(latest, "recommendation_date", "rate", (1, 3)).first()
    assert row["avg_1"] == 0.5 and row["avg_3"] == pytest.approx(0.4)
    assert row["avg_1_text"] == "50.00%"


def test_metric_change_with_one_date_and_zero_before(spark):
    df = metric_rows(spark, [("2024-01-01", "one", 0.5), ("2024-01-01", "zero", 0.0), ("2024-01-02", "zero", 0.4),
                             ("2024-01-01", "up", 0.2), ("2024-01-03", "up", 0.3)])
    got = {r["model"]: r for r in series.latest_vs_previous(df, ["recall"]).collect()}
    assert got["one"]["pct_change"] == 0 and got["zero"]["pct_change"] is None and got["up"]["pct_change"] == 50
    dates = {r["model"]: (r["latest_date"], r["previous_date"]) for r in series.comparison_dates(df).collect()}
    assert dates["one"][0] == dates["one"][1]
    assert dates["up"] == (dt.date(2024, 1, 3), dt.date(2024, 1, 1))


@pytest.mark.parametrize("freq", ["D", "W", "M", "Y"])
def test_resample_keeps_empty_bins(spark, freq):
    days = ["2023-11-05", "2023-11-06", "2024-02-29", "2024-03-01"]
    df = metric_rows(spark, [(d, "m", float(i)) for i, d in enumerate(days)])
    got = {r["bin"]: r["recall"] for r in series.resample_mean(df, "dt", ["recall"], freq).collect()}
    labels = {
        "D": lambda d: d,
        "W": lambda d: d + dt.timedelta(days=6 - d.weekday()),
        "M": lambda d: (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1),
        "Y": lambda d: d.replace(month=12, day=31),
    }[freq]
    parsed = [dt.date.fromisoformat(d) for d in days]
    want, day = {}, parsed[0]
    while day <= parsed[-1]:
        want.setdefault(labels(day), [])
        day += dt.timedelta(days=1)
    for i, d in enumerate(parsed):
        want[labels(d)].append(float(i))
    assert got == {k: (sum(v) / len(v) if v else None) for k, v in want.items()}


def test_null_for_nan_and_range(spark):
    df = metric_rows(spark, [("2024-01-01", "m", float("nan")), ("2024-02-01", "m", 1.0), ("2023-12-31", "m", 2.0)])
    assert rows_of(series.null_for_nan(df, ["recall"]).where("recall IS NULL").select("dt")) == [(dt.date(2024, 1, 1),)]
    assert series.select_range(df, "dt", "YTD").count() == 2
    assert series.select_range(df, "dt", "1W").count() == 1
    assert series.select_range(df, "dt", "all").count() == 3

"""SQL that states each registered query on the given tables, for a second engine."""

from __future__ import annotations

from datetime import date, timedelta

from plumeria.plans.catalog import (
    LIKE_DAY,
    NEURAL_END,
    NEURAL_SPLIT,
    ORDER_AS_OF,
    VIDEO_END,
    VIDEO_SPLIT,
    WIDE_LOOKBACK,
)

VIEWS = """
season AS (
  SELECT 'Brand#' || CAST(n_nationkey + 1 AS VARCHAR) AS id, r_name AS category
  FROM nation JOIN region ON n_regionkey = r_regionkey),
video AS (
  SELECT p_partkey AS id, p_brand AS season_id, min(l_shipdate) AS created_at
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_brand),
vote AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS video_id, o_custkey AS voter_id,
    CASE WHEN l_returnflag = 'R' THEN 'DOWNVOTE' ELSE 'UPVOTE' END AS status, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
app_user AS (
  SELECT c_custkey AS id,
    CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS follower_count,
    CAST(c_custkey % 97 AS BIGINT) AS following_count, c_mktsegment AS type
  FROM customer),
user_interest AS (
  SELECT DISTINCT z.user_id, z.name, f.updated_at FROM (
    SELECT c_custkey AS user_id, r_name AS name FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT c_custkey AS user_id, r_name AS name FROM customer JOIN region ON r_regionkey = c_custkey % 5) z
  JOIN (SELECT o_custkey, min(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey) f
    ON f.o_custkey = z.user_id
  WHERE z.user_id % 3 <> 0),
post_feed AS (
  SELECT o_custkey AS user_id, l_partkey AS post_id,
    CASE WHEN l_linestatus = 'O' THEN 'VIDEO' ELSE 'IMAGE' END AS media_type,
    l_quantity AS watch_time, CAST(50 AS DOUBLE) AS video_duration
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rs_daily_video_for_user AS (
  SELECT l_orderkey * 10 + l_linenumber AS recommendation_id, o_custkey AS user_id,
    l_partkey AS recommended_video_id, o_orderdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rs_daily_conversation_for_user AS (
  SELECT event_id AS recommendation_id, user_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS recommended_conversation_id, ts AS created_at
  FROM events WHERE event_type = 'view'),
conversation_like AS (
  SELECT event_id AS activity_id, user_id AS like_giver_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS conversation_id, ts AS liked_at
  FROM events WHERE event_type IN ('click', 'purchase')),
conversation AS (
  SELECT e.id, e.created_at, r_name AS categories, 'topic ' || r_name AS title,
    CASE WHEN e.id % 10 = 0 THEN NULL ELSE 'caption ' || CAST(e.id AS VARCHAR) END AS caption
  FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, min(ts) AS created_at
        FROM events GROUP BY 1) e
  JOIN region ON r_regionkey = e.id % 5),
model_metrics AS (
  SELECT CAST(ts AS DATE) AS dt, event_type AS model, round(round(avg(value) / 500, 12) + 1e-10, 6) AS roc_auc_score,
    round(round(avg(value) / 600, 12) + 1e-10, 6) AS accuracy, round(round(avg(value) / 700, 12) + 1e-10, 6) AS precision_score,
    round(round(avg(value) / 800, 12) + 1e-10, 6) AS recall, round(round(avg(value) / 900, 12) + 1e-10, 6) AS f1_score,
    round(round(min(value) / 500, 12) + 1e-10, 6) AS hit_ratio_k, round(round(max(value) / 500, 12) + 1e-10, 6) AS ndcg_k
  FROM events GROUP BY CAST(ts AS DATE), event_type),
rate_log AS (
  SELECT CAST(ts AS DATE) AS recommendation_date, ts AS dt, event_id % 7 AS liked_conversations,
    10 + event_id % 50 AS number_recommended,
    CAST(event_id % 7 AS DOUBLE) / (10 + event_id % 50) AS like_percentage
  FROM events WHERE event_type = 'view'),
model_feedback AS (
  SELECT 1 + event_id % 5 AS rating, props AS feedback, event_type AS model,
    CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'convo' END AS recommended_item, user_id FROM events),
account AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'user' || CAST(c_custkey AS VARCHAR) AS username,
    'user' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 7 = 0 THEN '#bad' ELSE '@mail.com' END AS email,
    CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'user_for_videos' ELSE 'user_for_conversation' END AS role
  FROM customer)"""

METRIC_COLUMNS = ["roc_auc_score", "accuracy", "precision_score", "recall", "f1_score", "hit_ratio_k", "ndcg_k"]


def r(expression: str) -> str:
    """The rounding every floating-point result goes through."""
    return f"round(round({expression}, 12) + 1e-10, 6) + 0.0"


def rounded(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + c)} AS {c}" for c in columns)


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([VIEWS, *ctes]) + "\n" + select


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


ORACLES: dict[str, str] = {}


# Acted-upon rates


def _video_rate(status: str, stamped: bool) -> str:
    dt = f", '{ORDER_AS_OF} 00:00:00' AS dt" if stamped else ""
    return sql(
        f"""SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS recommendation_date,
          CAST(sum(f) AS BIGINT) AS upvoted_videos, count(f) AS number_recommended,
          {r("sum(f) / count(f)")} AS upvote_percentage{dt}
        FROM flagged GROUP BY CAST(created_at AS DATE)""",
        f"""first_vote AS (SELECT video_id, voter_id, min(created_at) AS voted_at FROM vote
          WHERE {status} GROUP BY video_id, voter_id)""",
        f"""flagged AS (SELECT c.created_at,
          CASE WHEN voted_at BETWEEN c.created_at AND c.created_at + INTERVAL 2 DAY THEN 1 ELSE 0 END AS f
          FROM rs_daily_video_for_user c LEFT JOIN first_vote
            ON recommended_video_id = video_id AND user_id = voter_id
          WHERE c.created_at >= TIMESTAMP '{ORDER_AS_OF}' - INTERVAL {WIDE_LOOKBACK} DAY)""",
    )


ORACLES["video_upvote_rate"] = _video_rate("true", True)
ORACLES["video_upvote_rate_upvotes_only"] = _video_rate("status = 'UPVOTE'", False)


def _conversation_rate(where: str = "true", on: str = "true") -> str:
    return sql(
        f"""SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS recommendation_date,
          CAST(sum(f) AS BIGINT) AS liked_conversations, count(f) AS number_recommended,
          {r("sum(f) / count(f)")} AS like_percentage
        FROM flagged GROUP BY CAST(created_at AS DATE)""",
        f"""flagged AS (SELECT c.created_at,
          CASE WHEN liked_at BETWEEN c.created_at AND c.created_at + INTERVAL 2 DAY THEN 1 ELSE 0 END AS f
          FROM rs_daily_conversation_for_user c LEFT JOIN conversation_like
            ON recommended_conversation_id = conversation_id AND user_id = like_giver_id AND {on}
          WHERE {where})""",
    )


ORACLES["conversation_like_rate"] = _conversation_rate()
ORACLES["conversation_like_rate_lookback"] = _conversation_rate(
    "c.created_at >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY"
)
ORACLES["conversation_like_rate_interval_join"] = _conversation_rate(
    on="liked_at BETWEEN c.created_at AND c.created_at + INTERVAL 2 DAY"
)

ORACLES["stream_like_rate"] = sql(
    f"""SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS recommendation_date,
      CAST(sum(f) AS BIGINT) AS liked_conversations, count(f) AS number_recommended,
      {r("sum(f) / count(f)")} AS like_percentage
    FROM flagged
    GROUP BY CAST(created_at AS DATE)""",
    """flagged AS (SELECT c.created_at, CASE WHEN liked_at IS NOT NULL THEN 1 ELSE 0 END AS f
      FROM rs_daily_conversation_for_user c LEFT JOIN conversation_like
        ON recommended_conversation_id = conversation_id AND user_id = like_giver_id
        AND liked_at BETWEEN c.created_at AND c.created_at + INTERVAL 2 DAY)""",
)
ORACLES["stream_video_rate"] = sql(
    f"""SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS recommendation_date,
      CAST(sum(f) AS BIGINT) AS upvoted_videos, count(f) AS number_recommended, {r("sum(f) / count(f)")} AS upvote_percentage
    FROM flagged
    GROUP BY CAST(created_at AS DATE)""",
    """flagged AS (SELECT recommendation_id, user_id, recommended_video_id, c.created_at,
        max(CASE WHEN v.created_at IS NOT NULL THEN 1 ELSE 0 END) AS f
      FROM rs_daily_video_for_user c LEFT JOIN vote v ON recommended_video_id = video_id AND user_id = voter_id
        AND v.created_at BETWEEN c.created_at AND c.created_at + INTERVAL 2 DAY
      GROUP BY ALL)""",
)
ORACLES["stream_snapshot_merge"] = sql(
    f"""SELECT activity_id, like_giver_id, conversation_id, {stamp("liked_at")} AS liked_at FROM conversation_like
    QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY liked_at DESC) = 1"""
)

LATEST_RATE = """latest AS (SELECT * FROM rate_log
  QUALIFY row_number() OVER (PARTITION BY recommendation_date
    ORDER BY dt DESC, liked_conversations DESC, number_recommended DESC, like_percentage DESC) = 1)"""

ORACLES["latest_rate_per_date"] = sql(
    f"""SELECT CAST(recommendation_date AS VARCHAR) AS recommendation_date, {stamp("dt")} AS dt, liked_conversations,
      number_recommended, {r("like_percentage")} AS like_percentage FROM latest""",
    LATEST_RATE,
)
ORACLES["rate_trailing_averages"] = sql(
    """SELECT round(round(a3, 12) + 1e-10, 6) AS avg_3, round(round(a7, 12) + 1e-10, 6) AS avg_7, round(round(a31, 12) + 1e-10, 6) AS avg_31,
      printf('%.2f%%', 100 * a3) AS avg_3_text, printf('%.2f%%', 100 * a7) AS avg_7_text,
      printf('%.2f%%', 100 * a31) AS avg_31_text
    FROM (SELECT avg(like_percentage) FILTER (age <= 3) AS a3, avg(like_percentage) FILTER (age <= 7) AS a7,
            avg(like_percentage) FILTER (age <= 31) AS a31 FROM aged)""",
    LATEST_RATE,
    "aged AS (SELECT *, row_number() OVER (ORDER BY recommendation_date DESC) AS age FROM latest)",
)
ORACLES["count_trailing_averages"] = sql(
    """SELECT round(round(a3, 12) + 1e-10, 6) AS avg_3, round(round(a7, 12) + 1e-10, 6) AS avg_7, round(round(a31, 12) + 1e-10, 6) AS avg_31,
      format('{:,.2f}', a3) AS avg_3_text, format('{:,.2f}', a7) AS avg_7_text, format('{:,.2f}', a31) AS avg_31_text
    FROM (SELECT avg(number_recommended) FILTER (age <= 3) AS a3, avg(number_recommended) FILTER (age <= 7) AS a7,
            avg(number_recommended) FILTER (age <= 31) AS a31 FROM aged)""",
    LATEST_RATE,
    "aged AS (SELECT *, row_number() OVER (ORDER BY recommendation_date DESC) AS age FROM latest)",
)
_ROLLING = ", ".join(
    f"{r(f'avg(like_percentage) OVER (ORDER BY recommendation_date ROWS {n - 1} PRECEDING)')} AS avg_{n}"
    for n in (3, 7, 31)
)
ORACLES["rate_series"] = sql(
    f"""SELECT CAST(recommendation_date AS VARCHAR) AS recommendation_date, {stamp("dt")} AS dt, liked_conversations,
      number_recommended, {r("like_percentage")} AS like_percentage, {_ROLLING}
    FROM latest WHERE recommendation_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
    LATEST_RATE,
)
ORACLES["rate_date_bounds"] = sql(
    """SELECT CAST(min(recommendation_date) AS VARCHAR) AS first_date,
      CAST(max(recommendation_date) AS VARCHAR) AS last_date FROM rate_log"""
)


# Metric tables

_TILE_ROWS = """tile AS (
  UNPIVOT (SELECT model, dt, precision_score, recall, f1_score FROM model_metrics)
  ON precision_score, recall, f1_score INTO NAME metric VALUE value)"""
_AGED = """aged AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY dt DESC) AS age FROM tile),
pairs AS (SELECT model, metric, max(value) FILTER (age = 1) AS latest, arg_max(value, age) AS previous,
    max(dt) AS latest_date, min(dt) AS previous_date
  FROM aged WHERE age <= 2 GROUP BY model, metric)"""
_CHANGE = """round(latest, 2) + 0.0 AS latest,
  CASE WHEN previous <> 0 THEN round((latest - previous) / previous * 100, 0) + 0.0 END AS pct_change"""

ORACLES["metric_latest_vs_previous"] = sql(f"SELECT model, metric, {_CHANGE} FROM pairs", _TILE_ROWS, _AGED)
ORACLES["metric_comparison_dates"] = sql(
    """SELECT DISTINCT model, CAST(latest_date AS VARCHAR) AS latest_date,
      CAST(previous_date AS VARCHAR) AS previous_date FROM pairs""",
    _TILE_ROWS,
    _AGED,
)
ORACLES["metric_summary_tiles"] = sql(
    f"""SELECT model, metric, {_CHANGE}, CAST(latest_date AS VARCHAR) AS latest_date,
      CAST(previous_date AS VARCHAR) AS previous_date
    FROM pairs""",
    _TILE_ROWS,
    _AGED,
)
ORACLES["metric_filter_models"] = sql(
    """SELECT CAST(dt AS VARCHAR) AS dt, model, roc_auc_score AS "ROC AUC Score", accuracy AS "Accuracy",
      precision_score AS "Precision", recall AS "Recall", f1_score AS "F1 Score", hit_ratio_k AS "HitRatio@K",
      ndcg_k AS "NDCG@K"
    FROM model_metrics WHERE model IN ('click', 'view')"""
)

_BINS = {
    "day": ("dt", "INTERVAL 1 DAY", "x"),
    "week": ("CAST(dt + CAST(7 - isodow(dt) AS INTEGER) AS DATE)", "INTERVAL 7 DAY", "x"),
    "month": ("last_day(dt)", "INTERVAL 1 MONTH", "last_day(x)"),
    "year": ("make_date(year(dt), 12, 31)", "INTERVAL 1 YEAR", "x"),
}


def _resample(name: str, columns: list[str], where: str) -> tuple[str, str]:
    label, step, tidy = _BINS[name]
    means = ", ".join(f"avg({c}) AS {c}" for c in columns)
    start = "date_trunc('month', min(bin))" if name == "month" else "min(bin)"
    return (
        f"means AS (SELECT model, {label} AS bin, {means} FROM model_metrics WHERE {where} GROUP BY ALL)",
        f"""spine AS (SELECT DISTINCT model, CAST({tidy} AS DATE) AS bin FROM (
          SELECT model, CAST(unnest(generate_series(CAST({start} AS TIMESTAMP), CAST(max(bin) AS TIMESTAMP), {step}))
            AS DATE) AS x FROM means GROUP BY model))""",
    )


for _name in _BINS:
    ORACLES[f"metric_resample_{_name}"] = sql(
        f"""SELECT model, CAST(spine.bin AS VARCHAR) AS bin, {rounded(["accuracy", "recall"])}
        FROM spine LEFT JOIN means USING (model, bin)""",
        *_resample(_name, ["accuracy", "recall"], "true"),
    )

ORACLES["metric_pivot_by_model"] = sql(
    "SELECT CAST(dt AS VARCHAR) AS dt, "
    + ", ".join(
        f"max({c}) FILTER (model = '{m}') AS {c}_{m}"
        for m in ("click", "view", "purchase", "signup", "error")
        for c in ("accuracy", "ndcg_k")
    )
    + " FROM model_metrics GROUP BY dt"
)
ORACLES["metric_history_chart"] = sql(
    "SELECT CAST(bin AS VARCHAR) AS dt, "
    + ", ".join(
        f"{r(f'''max(roc_auc_score) FILTER (model = '{m}')''')} AS roc_auc_score_{m}"
        for m in ("click", "view", "purchase", "signup", "error")
    )
    + " FROM spine LEFT JOIN means USING (model, bin) GROUP BY bin",
    *_resample(
        "week",
        ["roc_auc_score"],
        "dt > (SELECT max(dt) - INTERVAL 1 MONTH FROM model_metrics)",
    ),
)
ORACLES["metric_range_selector"] = sql(
    """SELECT CAST(dt AS VARCHAR) AS dt, model, accuracy FROM model_metrics
    WHERE dt > (SELECT max(dt) - INTERVAL 7 DAY FROM model_metrics)"""
)
ORACLES["metric_range_year_to_date"] = sql(
    """SELECT CAST(dt AS VARCHAR) AS dt, model, accuracy FROM model_metrics
    WHERE dt >= (SELECT date_trunc('year', max(dt)) FROM model_metrics)"""
)
ORACLES["metric_retraining_dates"] = sql("SELECT DISTINCT CAST(dt AS VARCHAR) AS dt FROM model_metrics")
ORACLES["metric_union_clean"] = sql(
    f"""SELECT CAST(dt AS VARCHAR) AS dt, {", ".join(METRIC_COLUMNS)}, model FROM model_metrics
    WHERE day(dt) % 10 <> 3"""
)
ORACLES["metric_csv_clean"] = ORACLES["metric_union_clean"]
ORACLES["metric_null_for_nan"] = sql(
    """SELECT CAST(dt AS VARCHAR) AS dt, model, CASE WHEN day(dt) % 5 <> 0 THEN recall END AS recall
    FROM model_metrics"""
)


def _upsert(first: str, second: str) -> str:
    columns = ", ".join(METRIC_COLUMNS)
    return sql(
        f"""SELECT CAST(dt AS VARCHAR) AS dt, model, {rounded(METRIC_COLUMNS)} FROM (
          SELECT dt, model, {columns} FROM {first} UNION ALL
          SELECT dt, model, {columns} FROM {second} s
          WHERE NOT EXISTS (SELECT 1 FROM {first} f WHERE f.dt = s.dt AND f.model = s.model))""",
        "stored AS (SELECT * FROM model_metrics WHERE dt <= DATE '2024-01-20')",
        """batch AS (SELECT * REPLACE (round(recall + 1, 6) AS recall) FROM model_metrics
          WHERE dt >= DATE '2024-01-15')""",
    )


ORACLES["metric_upsert"] = _upsert("batch", "stored")
ORACLES["metric_table_upsert"] = ORACLES["metric_upsert"]
ORACLES["metric_insert_only"] = _upsert("stored", "batch")
ORACLES["model_ratings"] = sql(
    """SELECT model, printf('%.2f', avg(rating)) AS rating FROM model_feedback
    WHERE recommended_item = 'video' GROUP BY model"""
)
ORACLES["feedback_validated"] = sql(
    """SELECT model, CASE WHEN feedback IS NULL OR rating IS NULL THEN 'missing value'
        WHEN length(feedback) > 500 THEN 'feedback too long' END AS reject_reason, count(*) AS rows
    FROM model_feedback GROUP BY ALL"""
)


# Exploration


def _split(entity: str, rows: str, key: str, yes: str, no: str, flag: str) -> str:
    return sql(
        f"""SELECT CASE WHEN id IN (SELECT {key} FROM {rows}) THEN '{yes}' ELSE '{no}' END AS {flag},
          count(*) AS count FROM {entity} GROUP BY 1"""
    )


ORACLES["interest_registered_split"] = _split(
    "app_user", "user_interest", "user_id", "Registered", "Not Registered", "interest_registered"
)
ORACLES["video_voted_split"] = _split("video", "vote", "video_id", "Voted", "Not Voted", "voted_on")
ORACLES["user_voted_split"] = _split("app_user", "vote", "voter_id", "Voted", "Not Voted", "voted")
ORACLES["user_liked_split"] = _split("app_user", "conversation_like", "like_giver_id", "Liked", "Not Liked", "liked")
ORACLES["conversation_liked_split"] = _split(
    "conversation", "conversation_like", "conversation_id", "Liked", "Not Liked", "liked"
)
ORACLES["interest_share"] = sql(
    f"""SELECT name, count(*) AS total, {r("100.0 * count(*) / (SELECT count(*) FROM user_interest)")} AS percentage
    FROM user_interest GROUP BY name"""
)
VOTE_COUNTS = """counts AS (SELECT v.id, v.season_id, count(o.voter_id) AS vote_count
  FROM video v LEFT JOIN vote o ON o.video_id = v.id GROUP BY v.id, v.season_id)"""
LIKE_COUNTS = """counts AS (SELECT c.id, count(l.activity_id) AS like_count
  FROM conversation c LEFT JOIN conversation_like l ON l.conversation_id = c.id GROUP BY c.id)"""
ORACLES["votes_per_video"] = sql("SELECT id, vote_count FROM counts", VOTE_COUNTS)
ORACLES["likes_per_conversation"] = sql("SELECT id, like_count FROM counts", LIKE_COUNTS)
ORACLES["vote_share_by_category"] = sql(
    f"""SELECT category, CAST(sum(vote_count) AS BIGINT) AS total,
      {r("100.0 * sum(vote_count) / (SELECT sum(vote_count) FROM counts JOIN season s ON s.id = season_id)")}
        AS percentage
    FROM counts JOIN season s ON s.id = season_id GROUP BY category""",
    VOTE_COUNTS,
)


def _histogram(counts: str, value: str, where: str, bins: int, fixed: str | None = None) -> str:
    return sql(
        f"""SELECT CAST(CASE WHEN w > 0 THEN least(floor(({value} - lo) / w), {bins - 1}) ELSE 0 END AS INTEGER) AS bin,
          {r("any_value(lo) + bin * any_value(w)")} AS low, {r("any_value(lo) + (bin + 1) * any_value(w)")} AS high,
          count(*) AS count
        FROM kept, edges GROUP BY bin""",
        *([counts] if counts else []),
        f"kept AS (SELECT {value} FROM {fixed or 'counts'} WHERE {where})",
        f"""edges AS (SELECT CAST(min({value}) AS DOUBLE) AS lo,
          CAST(max({value}) - min({value}) AS DOUBLE) / {bins} AS w FROM kept)""",
    )


ORACLES["vote_count_histogram"] = _histogram(VOTE_COUNTS, "vote_count", "vote_count < 200", 10)
ORACLES["like_count_histogram"] = _histogram(LIKE_COUNTS, "like_count", "like_count < 85", 10)
ORACLES["follower_count_histogram"] = _histogram("", "follower_count", "follower_count > 0", 100, "app_user")
ORACLES["following_count_histogram"] = _histogram("", "following_count", "following_count > 0", 100, "app_user")


def _boxplot(counts: str, value: str) -> str:
    return sql(
        f"""SELECT {r("any_value(q1)")} AS q1, {r("any_value(q2)")} AS median, {r("any_value(q3)")} AS q3,
          min(x) AS low, max(x) AS high, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
          count(*) FILTER (NOT inside) AS outliers
        FROM (SELECT {value} AS x, q1, q2, q3, {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
              FROM counts, box)""",
        counts,
        f"""box AS (SELECT quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
          quantile_cont({value}, 0.75) AS q3 FROM counts)""",
    )


ORACLES["vote_count_boxplot"] = _boxplot(VOTE_COUNTS, "vote_count")
ORACLES["like_count_boxplot"] = _boxplot(LIKE_COUNTS, "like_count")


# Splits

ORACLES["temporal_split_counts"] = sql(
    f"""SELECT count(*) AS n, 'train' AS part FROM vote WHERE created_at <= TIMESTAMP '{VIDEO_SPLIT}'
    UNION ALL SELECT count(*), 'test' FROM vote
    WHERE created_at > TIMESTAMP '{VIDEO_SPLIT}' AND created_at <= TIMESTAMP '2001-10-01'"""
)
ORACLES["strict_split_counts"] = sql(
    f"""SELECT count(*) AS n, 'train' AS part FROM conversation_like WHERE liked_at < TIMESTAMP '{LIKE_DAY}'
    UNION ALL SELECT count(*), 'test' FROM conversation_like WHERE liked_at >= TIMESTAMP '{LIKE_DAY}'"""
)
ORACLES["day_split_counts"] = sql(
    f"""SELECT count(*) AS n, 'train' AS part FROM conversation_like WHERE CAST(liked_at AS DATE) < DATE '{LIKE_DAY}'
    UNION ALL SELECT count(*), 'test' FROM conversation_like WHERE CAST(liked_at AS DATE) = DATE '{LIKE_DAY}'"""
)
ORACLES["backtest_split_grid"] = sql(
    """SELECT CAST(split_date AS VARCHAR) AS split_date,
      (SELECT count(*) FROM conversation_like WHERE CAST(liked_at AS DATE) < split_date) AS train,
      (SELECT count(*) FROM conversation_like WHERE CAST(liked_at AS DATE) = split_date) AS test
    FROM (SELECT DATE '2024-01-20' + CAST(i AS INTEGER) AS split_date FROM range(10) t(i))"""
)
ORACLES["evaluation_windows"] = sql(
    f"""SELECT {stamp("m")} AS as_of, CAST(date_diff('day', DATE '{VIDEO_SPLIT}', CAST(m AS DATE)) AS INTEGER) AS cycles,
      {stamp("m - INTERVAL 7 DAY")} AS one_week_back, {stamp("m - INTERVAL 14 DAY")} AS two_weeks_back,
      CAST(CAST(m AS DATE) - 89 AS VARCHAR) AS first_start
    FROM (SELECT max(created_at) AS m FROM vote)"""
)


# Profiles


def _profile(split: str = VIDEO_SPLIT, until: bool = True) -> list[str]:
    votes = f"WHERE vote.created_at <= TIMESTAMP '{split}'" if until else ""
    return [
        f"""declared AS (SELECT DISTINCT user_id, name AS category FROM user_interest
          WHERE updated_at <= TIMESTAMP '{split}')""",
        f"""cat AS (SELECT v.id AS video_id, s.category FROM video v JOIN season s ON v.season_id = s.id
          WHERE v.created_at <= TIMESTAMP '{split}')""",
        f"""balance AS (SELECT voter_id AS user_id, category, sum(CASE WHEN status = 'UPVOTE' THEN 1 ELSE -1 END) AS w
          FROM vote JOIN cat USING (video_id) {votes} GROUP BY ALL)""",
        """profile AS (SELECT user_id, category, CAST(sum(w) AS BIGINT) AS weight FROM (
            SELECT user_id, category, 1 AS w FROM declared WHERE user_id IN (SELECT user_id FROM balance)
            UNION ALL SELECT user_id, category, w FROM balance WHERE category IN (SELECT category FROM declared))
          GROUP BY ALL)""",
    ]


_WATCH = """watched AS (SELECT user_id, category, avg(share) AS ratio FROM (
    SELECT user_id, post_id AS video_id, avg(watch_time / video_duration) AS share FROM post_feed
    WHERE media_type = 'VIDEO' GROUP BY ALL) JOIN cat USING (video_id) GROUP BY ALL)"""
_BLENDED = """blended AS (SELECT user_id, category, sum(w) AS weight FROM (
    SELECT user_id, category, 0.7::DOUBLE * weight AS w FROM profile
    UNION ALL SELECT user_id, category, 0.3::DOUBLE * ratio FROM watched
      WHERE user_id IN (SELECT user_id FROM profile) AND category IN (SELECT category FROM declared)) GROUP BY ALL)"""

ORACLES["trailing_window_upvotes"] = sql(
    f"""SELECT voter_id AS user_id, video_id, count(DISTINCT id) AS upvotes FROM vote
    WHERE created_at > TIMESTAMP '{VIDEO_SPLIT}' - INTERVAL 28 DAY AND created_at <= TIMESTAMP '{VIDEO_SPLIT}'
    GROUP BY ALL"""
)
ORACLES["user_category_profile"] = sql("SELECT * FROM profile", *_profile())
ORACLES["user_category_profile_all_votes"] = sql("SELECT * FROM profile", *_profile(until=False))
ORACLES["video_category_onehot"] = sql("SELECT * FROM cat", *_profile())
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _matrix(key: str, value: str, source: str) -> str:
    return f"SELECT {key}, " + ", ".join(
        f"""CAST(coalesce(sum({value}) FILTER (category = '{n}'), 0) AS BIGINT) AS "{n}" """ for n in _REGIONS
    ) + f" FROM {source} GROUP BY {key}"


ORACLES["user_category_matrix"] = sql(_matrix("user_id", "weight", "profile"), *_profile())
ORACLES["video_category_matrix"] = sql(_matrix("video_id", "1", "cat"), *_profile())
ORACLES["watch_ratio_by_category"] = sql(
    f"SELECT user_id, category, {r('ratio')} AS ratio FROM watched", *_profile(), _WATCH
)
ORACLES["watch_weighted_profile"] = sql(
    f"SELECT user_id, category, {r('weight')} AS weight FROM blended", *_profile(), _WATCH, _BLENDED
)
RECENCY_PARTS = f"""parts AS (SELECT user_id, category, sum(w) AS weight FROM (
    SELECT DISTINCT user_id, name AS category, 0.4::DOUBLE AS w FROM user_interest
    WHERE updated_at <= TIMESTAMP '{VIDEO_SPLIT}'
    UNION ALL SELECT voter_id, category, 0.6::DOUBLE * count(DISTINCT vote.id)
    FROM vote JOIN video ON video.id = video_id JOIN season ON season.id = season_id
    WHERE vote.created_at > TIMESTAMP '{VIDEO_SPLIT}' - INTERVAL 28 DAY
      AND vote.created_at <= TIMESTAMP '{VIDEO_SPLIT}'
    GROUP BY voter_id, category) GROUP BY ALL)"""
ORACLES["rf_user_profile"] = sql(
    f"""SELECT user_id, category, {r("weight")} AS weight FROM parts
    WHERE user_id IN (SELECT user_id FROM parts GROUP BY user_id HAVING sum(weight) > 0)""",
    RECENCY_PARTS,
)
ORACLES["user_like_category_matrix"] = sql(
    f"""SELECT like_giver_id AS user_id, categories AS category, count(*) AS weight
    FROM conversation_like JOIN conversation c ON c.id = conversation_id
    WHERE liked_at < TIMESTAMP '{LIKE_DAY}' AND c.created_at < TIMESTAMP '{LIKE_DAY}' GROUP BY ALL"""
)
ORACLES["interest_user_vote_season_join"] = sql(
    """SELECT name, category, status, count(*) AS rows, count(DISTINCT i.user_id) AS users
    FROM user_interest i JOIN app_user u ON u.id = i.user_id JOIN vote o ON o.voter_id = i.user_id
      JOIN video v ON v.id = o.video_id JOIN season s ON s.id = v.season_id GROUP BY ALL"""
)


# Video recommenders

_MEASURES = {
    "cosine": "coalesce(p.weight, 0) / sqrt(norm2)",
    "dot": "coalesce(p.weight, 0)",
    "euclid": "1 / (1 + sqrt(norm2 - 2 * coalesce(p.weight, 0) + 1))",
}


def _ranked(profile: str, measure: str, direction: str = "DESC") -> list[str]:
    return [
        f"""norms AS (SELECT user_id, CAST(sum(weight * weight) AS DOUBLE) AS norm2 FROM {profile}
          GROUP BY user_id HAVING sum(weight * weight) > 0)""",
        f"""scored AS (SELECT n.user_id, c.video_id, round({_MEASURES[measure]}, 12) AS score
          FROM norms n CROSS JOIN (SELECT * FROM cat WHERE category IN (SELECT category FROM declared)) c
          LEFT JOIN {profile} p ON p.user_id = n.user_id AND p.category = c.category)""",
        f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score {direction}, video_id) AS rank
          FROM scored)""",
        "top AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS list_size FROM ranked WHERE rank <= 20)",
    ]


_TOP = f"SELECT user_id, video_id, {r('score')} AS score, CAST(rank AS INTEGER) AS rank, list_size FROM top"
ORACLES["knn_topk"] = sql(_TOP, *_profile(), *_ranked("profile", "cosine"))
ORACLES["dot_topk"] = sql(_TOP, *_profile(), _WATCH, _BLENDED, *_ranked("blended", "dot"))
ORACLES["dot_topk_smallest"] = sql(_TOP, *_profile(), _WATCH, _BLENDED, *_ranked("blended", "dot", "ASC"))
ORACLES["euclid_topk"] = sql(_TOP, *_profile(), *_ranked("profile", "euclid"))


def _daily(split: str, end: str, k: int, model: str, extra: str = "") -> tuple[str, list[str]]:
    ctes = [
        f"gains AS (SELECT i, sum(1 / log2(i + 1)) OVER (ORDER BY i) AS d FROM range(1, {k + 1}) t(i))",
        f"""truth AS (SELECT DISTINCT CAST(created_at AS DATE) AS dt, voter_id AS user_id, video_id FROM vote
          WHERE created_at > TIMESTAMP '{split}' AND created_at <= TIMESTAMP '{end}'
            AND video_id IN (SELECT video_id FROM cat) AND voter_id IN (SELECT user_id FROM top))""",
        f"""counts AS (SELECT dt, user_id, CAST(count(*) AS DOUBLE) AS p, CAST(count(rank) AS DOUBLE) AS tp,
            max(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END) AS hit,
            any_value((SELECT count(*) FROM cat)) AS n,
            any_value(sizes.t) AS t
          FROM truth JOIN (SELECT user_id, CAST(count(*) AS DOUBLE) AS t FROM top GROUP BY user_id) sizes USING (user_id)
          LEFT JOIN top USING (user_id, video_id) GROUP BY dt, user_id)""",
        f"""per_user AS (SELECT dt,
            CASE WHEN p < n THEN (tp / p + (n - t - p + tp) / (n - p)) / 2 END AS roc_auc_score,
            (n - t - p + 2 * tp) / n AS accuracy, tp / t AS precision_score, tp / p AS recall,
            2 * tp / (t + p) AS f1_score, hit AS hit_ratio_k,
            (tp / t) * (SELECT max(d) FROM gains) / (SELECT max(d) FROM gains WHERE i <= least({k}, p)) AS ndcg_k
          FROM counts)""",
    ]
    means = ", ".join(f"{r(f'avg({c})')} AS {c}" for c in METRIC_COLUMNS)
    return (
        f"SELECT CAST(dt AS VARCHAR) AS dt, {means}, count(*) AS users, '{model}' AS model{extra} FROM per_user GROUP BY dt",
        ctes,
    )


def _daily_sql(k: int, model: str, *ctes: str) -> str:
    select, more = _daily(VIDEO_SPLIT, VIDEO_END, k, model)
    return sql(select, *ctes, *more)


ORACLES["knn_daily_metrics"] = _daily_sql(3, "knn", *_profile(), *_ranked("profile", "cosine"))
ORACLES["dot_daily_metrics"] = _daily_sql(10, "svd", *_profile(), _WATCH, _BLENDED, *_ranked("blended", "dot"))


def _cycle(day: str, k: int, model: str, *ranked: str) -> str:
    end = (date.fromisoformat(day) + timedelta(days=1)).isoformat()
    select, more = _daily(day, end, k, model, f", '{day}' AS split_date")
    return "SELECT * FROM (WITH " + ",\n".join([*_profile(day), *ranked, *more]) + select + ")"


ORACLES["video_backtest"] = sql(
    "\nUNION ALL\n".join(_cycle(f"2001-10-{20 + i}", 3, "knn", *_ranked("profile", "cosine")) for i in range(4))
)
ORACLES["dot_backtest"] = sql(
    "\nUNION ALL\n".join(
        _cycle(f"2001-10-{24 + i}", 10, "svd", _WATCH, _BLENDED, *_ranked("blended", "dot")) for i in range(3)
    )
)


# Conversation recommenders


def _item_parts(day: str) -> list[str]:
    return [
        f"""train AS (SELECT DISTINCT like_giver_id AS u, conversation_id AS c FROM conversation_like
          WHERE liked_at < TIMESTAMP '{day}')""",
        f"""test AS (SELECT DISTINCT like_giver_id AS u, conversation_id AS c FROM conversation_like
          WHERE CAST(liked_at AS DATE) = DATE '{day}')""",
        "sizes AS (SELECT c, count(*) AS n FROM train GROUP BY c)",
        """near AS (SELECT a.c AS c, b.c AS j, count(*) / sqrt(any_value(x.n) * any_value(y.n)) AS s
          FROM train a JOIN train b ON a.u = b.u JOIN sizes x ON x.c = a.c JOIN sizes y ON y.c = b.c
          WHERE a.c IN (SELECT c FROM test) GROUP BY a.c, b.c)""",
        """score AS (SELECT t.u, near.c, least(sum(s) / any_value(m.n), 1.0) AS s
          FROM train t JOIN near ON near.j = t.c JOIN (SELECT u, count(*) AS n FROM train GROUP BY u) m ON m.u = t.u
          WHERE t.u IN (SELECT u FROM test) GROUP BY t.u, near.c)""",
    ]


def _item_metrics(day: str) -> tuple[str, list[str]]:
    ctes = [
        *_item_parts(day),
        """pairs AS (SELECT round(coalesce(s, 0), 12) AS s, CASE WHEN t.u IS NULL THEN 0 ELSE 1 END AS y
          FROM (SELECT DISTINCT u FROM test WHERE u IN (SELECT u FROM train)) uu
          CROSS JOIN (SELECT DISTINCT c FROM test WHERE c IN (SELECT c FROM train)) cc
          LEFT JOIN score ON score.u = uu.u AND score.c = cc.c LEFT JOIN test t ON t.u = uu.u AND t.c = cc.c)""",
        """hist AS (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM pairs GROUP BY s)""",
        """above AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS above FROM hist)""",
        """cells AS (SELECT sum(pos + neg) AS n, sum(pos) AS p, coalesce(sum(pos + neg) FILTER (s > 0.1), 0) AS t,
          coalesce(sum(pos) FILTER (s > 0.1), 0) AS tp, sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) AS auc
          FROM above)""",
    ]
    select = f"""SELECT '{day}' AS dt, {r("auc")} AS roc_auc_score, {r("(n - t - p + 2 * tp) / n")} AS accuracy,
      {r("CASE WHEN t > 0 THEN tp / t ELSE 0 END")} AS precision_score, {r("tp / p")} AS recall,
      {r("2 * tp / (t + p)")} AS f1_score, CAST(0 AS DOUBLE) AS hit_ratio_k, CAST(0 AS DOUBLE) AS ndcg_k, 'knn' AS model
    FROM cells"""
    return select, ctes


ORACLES["item_item_cosine"] = sql(
    f"""SELECT a.c AS "row", b.c AS "col", {r("count(*) / sqrt(any_value(x.n) * any_value(y.n))")} AS value
    FROM likes a JOIN likes b ON a.u = b.u AND a.c < b.c JOIN sizes x ON x.c = a.c JOIN sizes y ON y.c = b.c
    GROUP BY a.c, b.c""",
    "likes AS (SELECT DISTINCT like_giver_id AS u, conversation_id AS c FROM conversation_like)",
    "sizes AS (SELECT c, count(*) AS n FROM likes GROUP BY c)",
)
ORACLES["item_neighbours"] = sql(
    f"""SELECT "row", col, {r("v")} AS value, CAST(row_number() OVER best AS INTEGER) AS rank FROM cosines
    WINDOW best AS (PARTITION BY "row" ORDER BY round(v, 12) DESC, col) QUALIFY row_number() OVER best <= 20""",
    "likes AS (SELECT DISTINCT like_giver_id AS u, conversation_id AS c FROM conversation_like)",
    "sizes AS (SELECT c, count(*) AS n FROM likes GROUP BY c)",
    """cosines AS (
      SELECT a.c AS "row", b.c AS col, count(*) / sqrt(any_value(x.n) * any_value(y.n)) AS v
      FROM likes a JOIN likes b ON a.u = b.u AND a.c <> b.c JOIN sizes x ON x.c = a.c JOIN sizes y ON y.c = b.c
      GROUP BY a.c, b.c)""",
)
ORACLES["itemcf_scores"] = sql(
    f"SELECT u AS user_id, c AS item_id, {r('s')} AS score FROM score", *_item_parts(LIKE_DAY)
)
_select, _ctes = _item_metrics(LIKE_DAY)
ORACLES["itemcf_daily_metrics"] = sql(_select, *_ctes)


def _item_cycle(day: str) -> str:
    select, ctes = _item_metrics(day)
    return "SELECT * FROM (WITH " + ",\n".join(ctes) + "\n" + select + ")"


ORACLES["itemcf_backtest"] = sql("\nUNION ALL\n".join(_item_cycle(f"2024-01-{27 + i}") for i in range(3)))


# What must hold of fitted models whatever the fit

ORACLES["svd_profile_norms"] = sql(
    f"SELECT user_id, {r('sum(weight * weight)')} AS norm2 FROM profile GROUP BY user_id", *_profile()
)
ORACLES["als_list_sizes"] = sql(
    """SELECT user_id, items, CAST(items AS INTEGER) AS last_rank FROM (
      SELECT u AS user_id, least(10, (SELECT count(DISTINCT c) FROM train) - count(*)) AS items
      FROM train WHERE u IN (SELECT u FROM test) GROUP BY u) WHERE items > 0""",
    *_item_parts(LIKE_DAY),
)
ORACLES["hybrid_list_sizes"] = sql(
    f"""SELECT DISTINCT u AS user_id, items, CAST(items AS INTEGER) AS last_rank
    FROM train, (SELECT least(10, count(DISTINCT c)) AS items FROM train)
    WHERE u IN (SELECT like_giver_id FROM conversation_like WHERE liked_at >= TIMESTAMP '{LIKE_DAY}')""",
    *_item_parts(LIKE_DAY),
)
ORACLES["rf_list_sizes"] = sql(
    """SELECT user_id, items, CAST(items AS INTEGER) AS last_rank
    FROM (SELECT DISTINCT user_id FROM parts),
      (SELECT least(20, count(*)) AS items FROM video JOIN season ON season.id = season_id)""",
    RECENCY_PARTS,
)
ORACLES["ncf_support"] = sql(
    f"""SELECT CAST(CAST(updated_at AS DATE) AS VARCHAR) AS dt, category AS actual, count(*) AS rows,
      count(DISTINCT i.user_id) AS users
    FROM user_interest i JOIN app_user u ON u.id = i.user_id JOIN vote o ON o.voter_id = i.user_id
      JOIN video v ON v.id = o.video_id JOIN season s ON s.id = v.season_id
    WHERE updated_at > TIMESTAMP '{NEURAL_SPLIT}' AND updated_at <= TIMESTAMP '{NEURAL_END}' GROUP BY 1, 2"""
)


# Metrics on given scores

_SCORED = [
    "scored AS (SELECT round(value / 500, 12) AS s, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y FROM events)",
    "hist AS (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY s)",
]
ORACLES["auc_rank_sum"] = sql(
    f"""SELECT {r("sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg))")} AS roc_auc_score FROM (
      SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
      FROM hist)""",
    *_SCORED,
)
ORACLES["score_threshold_metrics"] = sql(
    f"""SELECT {r("avg(CASE WHEN (s > 0.1) = (y = 1) THEN 1 ELSE 0 END)")} AS accuracy,
      {r("sum(CASE WHEN s > 0.1 THEN y END) / count(CASE WHEN s > 0.1 THEN 1 END)")} AS precision_score,
      {r("sum(CASE WHEN s > 0.1 THEN y END) / sum(y)")} AS recall,
      {r("2 * sum(CASE WHEN s > 0.1 THEN y END) / (sum(y) + count(CASE WHEN s > 0.1 THEN 1 END))")} AS f1_score
    FROM scored""",
    *_SCORED,
)

_TAGGED = [
    """cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
      FROM embeddings)""",
    """protos AS (SELECT label, list(m ORDER BY pos) AS proto FROM (
      SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY label, pos) GROUP BY label)""",
    """tagged AS (SELECT e.vec_id, e.label AS actual, p.label AS predicted,
        list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), p.proto) AS score
      FROM embeddings e CROSS JOIN protos p
      QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(score, 12) DESC, p.label) = 1)""",
]
ORACLES["category_tagging"] = sql(
    f"SELECT vec_id, predicted AS label, {r('score')} AS score FROM tagged", *_TAGGED
)
ORACLES["confusion_counts"] = sql(
    "SELECT vec_id % 10 AS dt, actual, predicted, count(*) AS count FROM tagged GROUP BY ALL", *_TAGGED
)
ORACLES["weighted_multiclass_metrics"] = sql(
    f"""SELECT dt, {r("sum(hit) / sum(support)")} AS accuracy,
      {r("sum(CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END * support) / sum(support)")} AS precision_score,
      {r("sum(hit / support * support) / sum(support)")} AS recall,
      {r("sum(2 * hit / (support + claimed) * support) / sum(support)")} AS f1_score
    FROM classes GROUP BY dt""",
    *_TAGGED,
    """classes AS (SELECT a.dt, a.label, a.support, a.hit, coalesce(p.claimed, 0) AS claimed FROM
        (SELECT vec_id % 10 AS dt, actual AS label, count(*) AS support,
           count(*) FILTER (actual = predicted) AS hit FROM tagged GROUP BY ALL) a
        LEFT JOIN (SELECT vec_id % 10 AS dt, predicted AS label, count(*) AS claimed FROM tagged GROUP BY ALL) p
          ON p.dt = a.dt AND p.label = a.label)""",
)
ORACLES["vector_similarities"] = sql(
    f"""SELECT vec_id, {r("list_inner_product(v, proto)")} AS dot, {r("list_cosine_similarity(v, proto)")} AS cosine,
      {r("1 / (1 + list_distance(v, proto))")} AS closeness
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, proto FROM embeddings JOIN protos USING (label))""",
    *_TAGGED,
)
ORACLES["conversation_text_tagging"] = sql(
    f"""SELECT id, CASE WHEN share > 0 THEN name END AS label, {r("coalesce(share, 0)")} AS score FROM (
      SELECT c.id, name, len(list_intersect(string_split(lower(name), ' '),
          string_split(lower(title || ' ' || caption), ' '))) / len(string_split(lower(name), ' ')) AS share
      FROM conversation c CROSS JOIN (SELECT DISTINCT name FROM user_interest)
      QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY share DESC NULLS LAST, name) = 1)"""
)


# Codes

ORACLES["id_index"] = sql(
    """SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) - 1 AS code
    FROM (SELECT DISTINCT conversation_id FROM conversation_like WHERE conversation_id IS NOT NULL)"""
)
ORACLES["label_encode"] = sql(
    """SELECT status, CAST(s AS BIGINT) AS status_code, count(*) AS rows, CAST(sum(v) AS BIGINT) AS code_sum FROM (
      SELECT status, dense_rank() OVER (ORDER BY status) - 1 AS s, dense_rank() OVER (ORDER BY video_id) - 1 AS v
      FROM vote) GROUP BY ALL"""
)
ORACLES["label_decode"] = sql(
    """SELECT user_id, dense_rank() OVER (ORDER BY role) - 1 AS role_code, role FROM account"""
)
ORACLES["interaction_matrix"] = sql(
    "SELECT like_giver_id, conversation_id, count(*) AS value FROM conversation_like GROUP BY ALL"
)


# Snapshots and accounts

ORACLES["incremental_merge"] = sql(
    f"""SELECT status, count(*) AS rows, count(DISTINCT id) AS ids, {stamp("max(created_at)")} AS newest FROM (
      SELECT * FROM vote WHERE created_at <= TIMESTAMP '2001-06-30' AND id NOT IN (SELECT id FROM delta)
      UNION ALL SELECT * FROM delta) GROUP BY status""",
    """delta AS (SELECT * FROM vote
      WHERE created_at > (SELECT max(created_at) FROM vote WHERE created_at <= TIMESTAMP '2001-06-30')
      QUALIFY row_number() OVER (PARTITION BY id
        ORDER BY created_at DESC, video_id DESC, voter_id DESC, status DESC) = 1)""",
)
ORACLES["incremental_extract"] = sql(
    f"""SELECT activity_id, like_giver_id, conversation_id, {stamp("liked_at")} AS liked_at FROM conversation_like"""
)
ORACLES["feather_snapshot"] = sql(
    f"SELECT id, video_id, voter_id, status, {stamp('created_at')} AS created_at FROM vote"
)
ORACLES["user_upsert"] = sql(
    """SELECT user_id, username, email, CASE WHEN role = 'admin' THEN 'user_for_videos' ELSE role END AS role FROM account
    UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'seller' || CAST(s_suppkey AS VARCHAR),
      'seller' || CAST(s_suppkey AS VARCHAR) || '@mail.com', 'user_for_conversation' FROM supplier"""
)
ORACLES["user_delete"] = sql("SELECT * FROM account WHERE role <> 'admin'")
ORACLES["account_quality_rules"] = sql(
    """SELECT username, concat_ws(',',
        CASE WHEN NOT regexp_matches(email, '^[a-zA-Z0-9-_]+@[a-zA-Z0-9]+\\.[a-z]{1,3}$') THEN 'email' END,
        CASE WHEN count(*) OVER (PARTITION BY email) > 1 THEN 'email repeated' END,
        CASE WHEN NOT regexp_matches(username, '^[a-zA-Z0-9]*$') THEN 'username' END,
        CASE WHEN count(*) OVER (PARTITION BY username) > 1 THEN 'username repeated' END,
        CASE WHEN length(username) < 2 THEN 'username length' END) AS failed
    FROM account"""
)
ORACLES["account_search"] = sql("SELECT username, role FROM account WHERE contains(username, '10')")
ORACLES["role_lookup"] = sql(
    """SELECT k.username, coalesce(a.role, '') AS role
    FROM (SELECT 'user' || CAST(o_custkey AS VARCHAR) AS username FROM orders
      UNION SELECT 'seller' || CAST(s_suppkey AS VARCHAR) FROM supplier) k
    LEFT JOIN account a USING (username)"""
)
ORACLES["hash_column"] = sql("SELECT username, sha256(email) AS digest FROM account")
ORACLES["full_text"] = sql("SELECT id, title || ' ' || caption AS text FROM conversation")
ORACLES["account_fresh_ids"] = sql("SELECT count(*) AS ids, count(*) AS distinct_ids, count(*) AS formed FROM account")


# Metrics and lists from given scores

_GIVEN = [
    *_item_parts(LIKE_DAY),
    f"""lists AS (SELECT u, c, row_number() OVER (PARTITION BY u ORDER BY {r("s")} DESC, c) AS rank FROM score
      QUALIFY rank <= 10)""",
    f"""shown AS (SELECT DISTINCT like_giver_id AS u, conversation_id AS c, liked_at FROM conversation_like
      WHERE CAST(liked_at AS DATE) = DATE '{LIKE_DAY}')""",
]
ORACLES["list_row_metrics"] = sql(
    f"""SELECT '{LIKE_DAY}' AS dt, CAST(0 AS DOUBLE) AS roc_auc_score, {r("avg(p)")} AS accuracy, max(p) AS precision_score,
      {r("avg(p)")} AS recall, {r("2 * avg(p) / (1 + avg(p))")} AS f1_score, {r("avg(p) FILTER (known)")} AS hit_ratio_k,
      {r("avg(g) FILTER (known)")} AS ndcg_k FROM (
        SELECT CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p, s.u IN (SELECT u FROM train) AS known,
          CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 / log2(rank + 1) END AS g
        FROM shown s LEFT JOIN lists l ON l.u = s.u AND l.c = s.c)""",
    *_GIVEN,
)
ORACLES["list_user_metrics"] = sql(
    f"""SELECT {r("avg(hit)")} AS hit_ratio_k, {r("avg(gain / total)")} AS ndcg_k FROM (
      SELECT t.u, max(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS hit,
        sum(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 / log2(rank + 1) END) AS gain,
        (SELECT sum(1 / log2(x + 1)) FROM range(1, 11) places(x)) AS total
      FROM test t LEFT JOIN lists l ON l.u = t.u AND l.c = t.c GROUP BY t.u)""",
    *_GIVEN,
)
ORACLES["given_category_topk"] = sql(
    """SELECT user_id, video_id, score, CAST(row_number() OVER best AS INTEGER) AS rank,
      least(20, count(*) OVER (PARTITION BY user_id)) AS list_size
    FROM (SELECT voter_id AS user_id, category, CAST(count(*) AS DOUBLE) AS score FROM vote JOIN videos USING (video_id) GROUP BY ALL)
    JOIN videos USING (category)
    WINDOW best AS (PARTITION BY user_id ORDER BY score DESC, video_id) QUALIFY row_number() OVER best <= 20""",
    "videos AS (SELECT v.id AS video_id, category FROM video v JOIN season s ON s.id = season_id)",
)
ORACLES["given_vectors_topk"] = sql(
    f"""SELECT x.vec_id AS user_id, CAST(y.vec_id AS VARCHAR) AS item_id, {r("list_dot_product(x.f, y.f)")} AS score,
      CAST(row_number() OVER best AS INTEGER) AS rank
    FROM vectors x JOIN vectors y ON x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id
    WINDOW best AS (PARTITION BY x.vec_id ORDER BY round(list_dot_product(x.f, y.f), 12) DESC, CAST(y.vec_id AS VARCHAR))
    QUALIFY row_number() OVER best <= 10""",
    "vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)",
)

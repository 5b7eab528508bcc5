"""Streams over the events, run until everything is read; windows that the watermark hasn't closed stay in the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import query, table
from quillon.streaming import run as R
from quillon.streaming import state as V


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.files(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, arg_min(event_id, ts) AS leading, arg_max(event_id, ts) AS trailing FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.settled(V.throttled(_events(spark, sf_dir), "user_id", "ts", "event_id", "6 hours", "1 hour"))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g), d AS (SELECT user_id, min(ts) AS start, arg_max(event_id, ts) AS event_id, count(*) AS n, max(ts) AS last FROM s GROUP BY user_id, b)
SELECT user_id, start, event_id, n FROM d WHERE last + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.settled(V.debounced(_events(spark, sf_dir), "user_id", "ts", "event_id", "1 hour", "10 minutes"))


@query("SELECT user_id AS client, CAST(count(DISTINCT event_id % 20) AS BIGINT) AS score FROM events WHERE event_type = 'view' GROUP BY user_id")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's answer to a question counts once, however often it comes."""
    answers = _events(spark, sf_dir).select((F.col("event_id") % 20).alias("question"), F.col("user_id").alias("client"), "ts", (F.col("event_type") == "view").alias("correct"))
    return R.settled(V.scores(answers, "ts", "60 days"), "complete")


@query("SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage log in which nothing stands twice in a row."""
    return R.settled(V.once_in_a_row(_events(spark, sf_dir), "user_id", "ts", "event_type", idle_ms=None))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
f AS (SELECT user_id, t, ts, k, true AS fetched, t AS last FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.t, e.ts, e.k, e.t - f.last >= 172800000000, CASE WHEN e.t - f.last >= 172800000000 THEN e.t ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, ts, fetched FROM f""")
def stream_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.settled(V.fetched(_events(spark, sf_dir).select("user_id", "ts"), "user_id", "ts", 172_800))


@query("WITH o AS (SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id) SELECT e.event_id, e.user_id AS question FROM events e JOIN o USING (user_id) WHERE e.ts < o.opened + INTERVAL 5 DAY")
def stream_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("question")).agg(F.min(F.col("ts").cast("timestamp")).alias("opened"))
    answers = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("question"), "ts")
    return R.settled(V.closing(answers, opened, "ts", 5 * 86_400, "1 hour")).select("event_id", "question")


@query("SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'start_timer' WHEN 'view' THEN 'show_slide' ELSE 'start_show' END AS action FROM events WHERE event_type IN ('click', 'view', 'signup') UNION ALL SELECT event_id, event_type, 'clear' FROM events WHERE event_type = 'view'")
def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by activation id; an id may start several."""
    actions = spark.createDataFrame([("click", "start_timer"), ("view", "show_slide"), ("view", "clear"), ("signup", "start_show"), ("never", "x")], "event_type string, action string")
    return R.settled(V.triggered(_events(spark, sf_dir).select("event_id", "event_type"), actions, "event_type")).select("event_id", "event_type", "action")

"""Calendar, timeline and log queries over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import times as M
from quillon.operators import timelines as L
from quillon.plans.registry import query, table


def _events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    found = table(spark, sf_dir, "events")
    return found.where(F.col("event_type").isin(*kinds)) if kinds else found


ASOF = """WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'view')
SELECT a.event_id, b.event_id AS found FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts {} b.ts"""


@query(ASOF.format(">="))
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _events(spark, sf_dir, "view").select("user_id", "ts", F.col("event_id").alias("found"))
    return L.asof(_events(spark, sf_dir, "click").select("user_id", "ts", "event_id"), right, ["user_id"], "ts", ["found"]).select("event_id", "found")


@query(ASOF.format("<"))
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _events(spark, sf_dir, "view").select("user_id", "ts", F.col("event_id").alias("found"))
    return L.asof(_events(spark, sf_dir, "click").select("user_id", "ts", "event_id"), right, ["user_id"], "ts", ["found"], forward=True).select("event_id", "found")


@query("WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'view') SELECT a.event_id, b.event_id AS found FROM a ASOF LEFT JOIN b ON a.ts >= b.ts")
def asof_one_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline of all events, split by day so that no task sees it whole."""
    side = lambda kind, name: _events(spark, sf_dir, kind).select(F.lit(1).alias("k"), "ts", F.col("event_id").alias(name))
    return L.asof(side("click", "event_id"), side("view", "found"), ["k"], "ts", ["found"], bucket="1 day").select("event_id", "found")


@query("""WITH i AS (SELECT event_id AS action, user_id, epoch_ms(ts) AS s, epoch_ms(ts) + value * 100000 AS e FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, user_id, epoch_ms(ts) AS t FROM events WHERE event_type = 'purchase') SELECT event_id, action FROM p JOIN i ON p.user_id = i.user_id AND s <= t AND t < e""")
def interval_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    intervals = _events(spark, sf_dir, "view").select("user_id", F.col("event_id").alias("action"), ms.alias("s"), (ms + F.col("value") * 100000).alias("e"))
    points = _events(spark, sf_dir, "purchase").select("user_id", "event_id", ms.alias("t"))
    return L.active_at(points, intervals, ["user_id"], "t", "s", "e", 600_000.0).select("event_id", "action")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-10 06:00:00'")
def tick_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    return _events(spark, sf_dir).where((at >= F.lit("2024-01-10").cast("timestamp")) & (at < F.lit("2024-01-10 06:00:00").cast("timestamp"))).select("event_id")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS b FROM orders)
SELECT o_orderkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM d""")
def day_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("until", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")).cast("timestamp"))
    return L.day_overlap(orders, "o_orderdate", "until").select("o_orderkey", "day")


@query("""WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['day', 'week', 'month', 'year'][o_orderkey % 4 + 1] AS u, CAST(o_orderkey % 3 + 1 AS INT) AS s FROM orders),
k AS (SELECT *, unnest(range(0, 6)) AS n FROM e)
SELECT o_orderkey, CAST(n AS INT) AS occurrence, CAST(CASE u WHEN 'day' THEN d + CAST(n * s AS INT) WHEN 'week' THEN d + CAST(7 * n * s AS INT) WHEN 'month' THEN d + to_months(CAST(n * s AS INT)) ELSE d + to_months(CAST(12 * n * s AS INT)) END AS DATE) AS date FROM k""")
def recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, ("day", "week", "month", "year"))), (F.col("o_orderkey") % 4).cast("int"))
    orders = table(spark, sf_dir, "orders").withColumns({"unit": unit, "every": F.col("o_orderkey") % 3 + 1, "times": F.lit(6)})
    return L.recurrences(orders, "o_orderdate", "unit", "every", times="times").select("o_orderkey", "occurrence", "date")


@query("""WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT *, unnest(range(0, 40)) AS n FROM e),
x AS (SELECT o_orderkey, CAST(d + CAST(91 * n AS INT) AS DATE) AS date FROM k) SELECT o_orderkey, date FROM x WHERE date <= DATE '2000-01-01' AND day(date) <> 13""")
def recurrence_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.lit("week").alias("unit"), F.lit(13).alias("every"), F.lit("2000-01-01").cast("date").alias("until"))
    dates = L.recurrences(orders, "o_orderdate", "unit", "every", until="until").select("o_orderkey", "date")
    return L.without_exceptions(dates, dates.where(F.dayofmonth("date") == 13), ["o_orderkey"])


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 25")
def upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.upcoming(_events(spark, sf_dir).select("event_id", "ts"), "ts", F.lit("2024-01-15").cast("timestamp"), most=25)


@query("SELECT user_id, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY user_id")
def closest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.closest_upcoming(_events(spark, sf_dir), ["user_id"], "ts", F.lit("2024-01-20").cast("timestamp"), "event_id")


@query("""SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS INT) AS week, CAST(ceil(day(o_orderdate) / 7.0) AS INT) AS nth, strftime(o_orderdate, '%d.%m.%y') AS shown, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.weekofyear(d).alias("week"), M.nth_weekday(d).alias("nth"), F.date_format("o_orderdate", "dd.MM.yy").alias("shown"), F.last_day(d).alias("month_end"))


@query("""WITH d AS (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
SELECT o_orderkey, CAST(m + CAST((8 - isodow(m)) % 7 + 14 AS INT) AS DATE) AS third_monday,
  CASE WHEN month(m + CAST((12 - isodow(m)) % 7 + 28 AS INT)) = month(m) THEN CAST(m + CAST((12 - isodow(m)) % 7 + 28 AS INT) AS DATE) END AS fifth_friday,
  CAST(last_day(m) - CAST(isodow(last_day(m)) % 7 AS INT) AS DATE) AS last_sunday FROM d""")
def nth_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.weekday_of_month(d, "Mon", 3).alias("third_monday"), M.weekday_of_month(d, "Fri", 5).alias("fifth_friday"), M.weekday_of_month(d, "Sun", -1).alias("last_sunday"))


@query("SELECT user_id, CAST(max(event_id * 1000 + event_id % 7 * 1000) AS BIGINT) AS duration_ms FROM events GROUP BY user_id")
def timeline_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", (F.col("event_id") * 1000).alias("t"), (F.col("event_id") % 7).alias("s"))
    return L.duration(rows, ["user_id"], "t", "s")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rolling_mean(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("mean", 6).alias("mean"))


@query("""WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: 0.15 * x + 0.85 * a), 6) AS smoothed FROM v""")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.smoothed(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH k AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'view'), p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
a AS (SELECT p.*, k.t AS ta, k.value AS va FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.t >= k.t), b AS (SELECT a.*, k.t AS tb, k.value AS vb FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t < k.t)
SELECT user_id, t, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * ((t - ta) / (tb - ta)) END, 6) AS value FROM b""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    keys = _events(spark, sf_dir, "view").select("user_id", ms, "value")
    return L.interpolated(_events(spark, sf_dir, "click").select("user_id", ms), keys, ["user_id"], "t", "value").withColumn("value", F.round("value", 6))


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.once_in_a_row(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g) SELECT user_id, min(ts) AS start, arg_max(event_id, ts) AS event_id, count(*) AS n FROM s GROUP BY user_id, b""")
def debounce_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.debounced(_events(spark, sf_dir), ["user_id"], "ts", "event_id", "1 hour")


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, arg_min(event_id, ts) AS leading, arg_max(event_id, ts) AS trailing FROM events GROUP BY 1, 2")
def throttle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.throttled(_events(spark, sf_dir), ["user_id"], "ts", "event_id", "6 hours")


@query("""SELECT user_id, round(20 * log10(greatest(sqrt(avg(pow((value - 128) / 128, 2))), 0.0001)), 6) AS db, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS weighted FROM events GROUP BY user_id""")
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rms = F.sqrt(F.avg(F.pow((F.col("value") - 128) / 128, F.lit(2))))
    weight = F.col("event_id") % 5 + 1
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(N.decibels(rms), 6).alias("db"), F.round(F.sum(F.col("value") * weight) / F.sum(weight), 6).alias("weighted"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 360, 6) AS angle FROM lineitem""")
def pie_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    before = F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1))
    angle = F.coalesce(before, F.lit(0.0)) / F.sum("l_quantity").over(w) * 360
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(angle, 6).alias("angle"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown,
CASE WHEN s < 1 THEN 'now' WHEN s < 60 THEN s || CASE WHEN s = 1 THEN ' second' ELSE ' seconds' END WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute' ELSE ' minutes' END ELSE (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour' ELSE ' hours' END END AS ago
FROM (SELECT event_id, event_id * 37 % 80000 AS s FROM events)""")
def time_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id") * 37 % 80000
    return _events(spark, sf_dir).select("event_id", M.join_time(s).alias("shown"), M.time_ago(s).alias("ago"))

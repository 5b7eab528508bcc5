"""Queries of shows, timers, outputs and their small functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.functions import times as M
from quillon.operators import conditions as K
from quillon.operators import documents as D
from quillon.operators import shows as H
from quillon.operators import variables as W
from quillon.plans.registry import query, table

NOW = "2024-01-15 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '{NOW}' - INTERVAL 1 SECOND")
def upcoming_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.upcoming_actions(table(spark, sf_dir, "events"), _now(), "ts", "event_type", "click").select("event_id", "ts")


@query("""WITH a AS (SELECT user_id, arg_min(value, event_id) AS current_time_, arg_min(event_id % 2 = 0, event_id) AS paused FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT c_custkey AS id, c_name AS name, a.user_id IS NOT NULL AS is_active, current_time_ AS current_time, paused FROM customer LEFT JOIN a ON c_custkey = user_id""")
def timers_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    timers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    active = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("id"), F.col("event_id").alias("place"), F.col("value").alias("current_time"), (F.col("event_id") % 2 == 0).alias("paused"))
    return H.timers_detailed(timers, active)


@query("""WITH s AS (SELECT l_partkey, sum(l_quantity) - 750 AS score FROM lineitem GROUP BY l_partkey), j AS (SELECT p_partkey AS id, score FROM part JOIN s ON p_partkey = l_partkey WHERE score > 0 AND p_type <> 'SMALL')
SELECT id, score AS original_match, round(score / max(score) OVER () * 100, 6) AS match FROM j""")
def scored_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.sum("l_quantity") - 750).alias("score"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"))
    archived = spark.createDataFrame([("SMALL",), ("ECONOMY",)], "category string")
    return H.scored(parts, scores, archived, "ECONOMY").select("id", "original_match", F.round("match", 6).alias("match"))


@query("""WITH d AS (SELECT unnest([DATE '2024-01-03', DATE '2024-01-10', DATE '2024-01-17']) AS day)
SELECT day, event_id, CAST(row_number() OVER (PARTITION BY day ORDER BY ts, ts + to_hours(event_id % 30)) AS INT) AS place, CAST(ts + to_hours(event_id % 30) AS DATE) = day AS same_day FROM events JOIN d ON CAST(ts AS DATE) = day WHERE event_type = 'view'""")
def events_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([("2024-01-03",), ("2024-01-10",), ("2024-01-17",)], "day string").select(F.to_date("day").alias("day"))
    until = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 30 * 3_600_000_000)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), until.alias("until"))
    return H.events_of_days(days, events, "ts", "until", F.col("event_type") == "view").select("day", "event_id", "place", "same_day")


INDEX = """f AS (SELECT c_name AS name, c_custkey AS id FROM customer), k AS (SELECT name, max(id) AS id FROM (SELECT c_name AS name, c_custkey * 10 AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_name, c_custkey FROM customer WHERE c_acctbal > 5000) WHERE name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY name)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf_dir, "customer")
    files = customer.select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".show").otherwise(".SHOW")).alias("name")).unionByName(customer.select(F.concat("c_name", F.lit(".txt")).alias("name")))
    cached = customer.where("c_acctbal > 0").select(F.col("c_name").alias("name"), (F.col("c_custkey") * 10).alias("id")).unionByName(customer.where("c_acctbal > 5000").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))
    return H.reindexed(files, cached, customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name")))


@query(f"WITH {INDEX} SELECT f.name, k.id FROM f JOIN k USING (name)")
def index_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].select("name", "id")


@query(f"WITH {INDEX} SELECT f.name FROM f WHERE name NOT IN (SELECT name FROM k)")
def index_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1].select("name")


@query("""WITH o AS (SELECT s_suppkey AS output, ['A', 'N', 'R'][s_suppkey % 3 + 1] AS type, s_suppkey AS key FROM supplier)
SELECT output, l_orderkey, l_linenumber FROM lineitem JOIN o ON l_returnflag = type AND CASE type WHEN 'A' THEN l_partkey WHEN 'N' THEN l_suppkey END = key""")
def output_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("output"), F.get(F.array(*map(F.lit, "ANR")), (F.col("s_suppkey") % 3).cast("int")).alias("type"), F.col("s_suppkey").alias("key"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("type"), "l_partkey", "l_suppkey")
    return H.output_matches(outputs, items, {"A": "l_partkey", "N": "l_suppkey"}).select("output", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, sum(l_quantity) AS seconds FROM lineitem GROUP BY l_orderkey")
def playlist_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.total_seconds(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


@query("SELECT user_id, greatest(coalesce(max(CASE WHEN event_type <> 'error' THEN value - 150 END), -80), -80) AS peak FROM events GROUP BY user_id")
def peak_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") != "error", F.col("value") - 150)
    return H.peak_level(table(spark, sf_dir, "events").withColumn("db", level), ["user_id"], "db")


@query("SELECT o_custkey, greatest(coalesce(max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - 5000 END), 0), 0) AS latest FROM orders GROUP BY o_custkey")
def latest_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return H.latest_modification(table(spark, sf_dir, "orders").withColumn("modified", F.when(key % 3 != 0, key - 5000)), ["o_custkey"], "modified")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 25 THEN 'plain ' || lower(p_type) ELSE p_name END, p_partkey) AS rank FROM part")
def locale_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("plain "), F.lower("p_type")).alias("translated"), (F.col("p_size") > 25).alias("is_default"))
    return H.locale_sorted(parts, "p_name", "translated", "is_default", "p_partkey").select("p_partkey", "rank")


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || p_partkey), p_partkey) AS rank FROM part")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shuffled(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7).select("p_partkey", "rank")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS number FROM part), v AS (SELECT *, CASE WHEN number = '' THEN 0 ELSE TRY_CAST(number AS DOUBLE) END AS x FROM n)
SELECT p_partkey, row_number() OVER (ORDER BY x IS NULL DESC, coalesce(x, 0) DESC, CASE WHEN x IS NULL THEN lower(number) ELSE '' END DESC, p_partkey) AS rank FROM v""")
def tablet_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.catalogue import ranked

    size = F.col("p_size")
    number = F.when(size % 5 == 0, "").when(size % 5 == 1, F.col("p_brand")).otherwise(size.cast("string"))
    return ranked(table(spark, sf_dir, "part").select("p_partkey", number.alias("number")), *H.tablet_order("number", True), F.col("p_partkey")).select("p_partkey", "rank")


@query("SELECT DISTINCT conv_id, turn, coalesce(nullif(role, 'user'), 'Verse') || ' ' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS section FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "user", F.col("role")).alias("role")).distinct()
    return H.numbered_sections(slides, ["conv_id"], ["turn"], "role").select("conv_id", "turn", "section")


@query("SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R'), -1) AS end_index FROM lineitem GROUP BY l_orderkey")
def end_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.end_index(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R")


@query("""WITH s AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['underline'] WHEN 1 THEN ['underline', 'overline'] ELSE [] END AS t, CASE p_size % 2 WHEN 0 THEN ['line-through'] ELSE ['underline', 'line-through'] END AS o FROM part),
m AS (SELECT p_partkey, list_concat(list_filter(t, lambda x: x <> 'underline' OR list_contains(o, 'underline')), CASE WHEN list_contains(o, 'underline') AND NOT list_contains(t, 'underline') THEN ['underline'] ELSE [] END) AS u FROM s)
SELECT p_partkey, CASE WHEN len(u) = 0 THEN 'none' ELSE array_to_string(u, ' ') END AS decorations FROM m""")
def text_decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    template = F.when(size % 3 == 0, "underline").when(size % 3 == 1, "Underline  overline").otherwise("")
    own = F.when(size % 2 == 0, "line-through").otherwise("underline line-through")
    return table(spark, sf_dir, "part").select("p_partkey", T.decorations(template, own, underline=True).alias("decorations"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '' ELSE event_type END AS v FROM events)
SELECT event_id, CASE WHEN v = 'true' THEN 'boolean' WHEN v <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS kind, CASE WHEN v = 'true' THEN true END AS flag, TRY_CAST(nullif(v, '') AS DOUBLE) AS number FROM v""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    value = F.when(k == 0, "true").when(k == 1, F.col("event_id").cast("string")).when(k == 2, "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.typed(value).alias("v")).select("event_id", "v.*")


@query("SELECT conv_id, string_agg(role || ': ' || turn, ' | ' ORDER BY turn, role) AS feed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS nth FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) WHERE nth <= 5 GROUP BY conv_id")
def feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("turn", F.col("role").alias("title"), F.col("turn").cast("string").alias("description"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("conv_id", T.feed_text(F.col("items")).alias("feed"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y') AS short, dayname(o_orderdate) || ' ' || day(o_orderdate) || '. ' || monthname(o_orderdate) || ', ' || year(o_orderdate) AS long, dayname(o_orderdate) AS weekday,
date_trunc('day', o_orderdate) + INTERVAL 465 MINUTE AS at, CASE o_orderkey % 3 WHEN 0 THEN 86400000 WHEN 1 THEN 604800000 ELSE 0 END AS span,
'Service ' || strftime(o_orderdate, '%d.%m.%Y') || '/' || strftime(CAST(o_orderdate AS DATE) + CAST((7 - isodow(o_orderdate)) % 7 AS INT), '%d') AS project FROM orders""")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    kind = F.get(F.array(*map(F.lit, ("daily", "weekly", "never"))), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.date_text(day).alias("short"), M.date_text(day, True).alias("long"), M.weekday_name(day).alias("weekday"), M.combined(day, F.lit("07:45")).alias("at"), M.interval_ms(kind).alias("span"), M.dated_name(F.lit("Service {DD}.{MM}.{YYYY}/{D7}"), F.to_date(day)).alias("project"))


@query("SELECT event_id, 66600 - (hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT)) AS until, printf('%02d:%02d:%02d.%03d', event_id * 1234 // 3600000, event_id * 1234 // 60000 % 60, event_id * 1234 // 1000 % 60, event_id * 1234 % 1000) AS shown FROM events")
def clock_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", M.until_clock(F.lit("18:30"), F.col("ts")).cast("long").alias("until"), M.subtitle_time(F.col("event_id") * 1234).alias("shown"))


@query("SELECT event_id, unnest([date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 4 HOUR, date_trunc('hour', ts) + INTERVAL 7 HOUR, date_trunc('hour', ts) + INTERVAL 12 HOUR]) AS at FROM events UNION ALL SELECT event_id, unnest([date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts) + INTERVAL 36 HOUR, date_trunc('day', ts) + INTERVAL 60 HOUR, date_trunc('day', ts) + INTERVAL 84 HOUR]) FROM events")
def forecast_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    part = lambda far: events.select("event_id", F.explode(M.forecast_times(F.col("ts"), far)).alias("at"))
    return part(False).unionByName(part(True))


@query("""WITH f AS (SELECT p_partkey, p_size, pow(10, log10(20) + p_partkey % 100 / 100.0 * (log10(20000) - log10(20))) AS f FROM part),
g AS (SELECT p_partkey, p_size, f, (p_size - 25.0) / (1 + pow(2 * log2(f / 1000) * (1 + p_size % 3), 2)) + 20 * pow(f / 5000, 4) / (1 + pow(f / 5000, 4)) + 15 / (1 + pow(f / 80, 2)) AS r FROM f)
SELECT p_partkey, round(f, 4) AS frequency, round(greatest(-30, least(30, r)), 6) AS response, round(1 / sqrt(p_size), 9) AS scale FROM g""")
def equaliser_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = N.log_frequency(F.col("p_partkey") % 100 / 100)
    band = lambda kind, centre, gain, q: F.struct(F.lit(kind).alias("type"), F.lit(float(centre)).alias("frequency"), gain.cast("double").alias("gain"), q.cast("double").alias("q"))
    bands = F.array(band("peaking", 1000, F.col("p_size") - 25, 1 + F.col("p_size") % 3), band("highpass", 5000, F.lit(20), F.lit(2)), band("lowpass", 80, F.lit(15), F.lit(0.5)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(f, 4).alias("frequency"), F.round(N.equaliser(bands, f), 6).alias("response"), F.round(N.loudness_scale(F.col("p_size")), 9).alias("scale"))


@query("SELECT p_partkey, floor(p_partkey * 1000 / 914400.0 * 96 * 100 + 0.5) / 100 AS pixels, regexp_replace(printf('%.1f', floor((p_size * 9 / 5 + 32) * 10 + 0.5) / 10), '\\.0$', '') AS fahrenheit FROM part")
def converted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.emu_pixels((F.col("p_partkey") * 1000).cast("string")).alias("pixels"), N.fahrenheit(F.col("p_size")).alias("fahrenheit"))


@query("SELECT p_brand AS id, CAST(sum(p_partkey % 10 + 1) AS BIGINT) AS numbers FROM part GROUP BY p_brand")
def range_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.total_size(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_size").cast("long").alias("low"), (F.col("p_size") + F.col("p_partkey") % 10).alias("high")))


@query("SELECT min(p_partkey) AS p_partkey, p_name, p_type FROM part GROUP BY p_name, p_type")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first id of each value."""
    return table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to a map for each nation and back."""
    maps = D.rows_map(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_acctbal"), ["c_nationkey"])
    rows = maps.select("c_nationkey", F.transform_values("map", lambda _, v: F.struct(v.alias("c_acctbal"))).alias("map"))
    return D.map_rows(rows, "map", "c_custkey")


@query("""SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'economy' WHEN 'small' THEN 'g2' WHEN 'large' THEN 'word' ELSE '' END AS group_id FROM part""")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("economy", "Any"), ("g1", "small"), ("g2", "Small"), ("g3", "ECONOMY")], "id string, name string")
    dictionary = spark.createDataFrame([("word", "Large"), ("other", "Small")], "id string, name string")
    return H.group_ids(table(spark, sf_dir, "part").withColumn("label", F.concat(F.lit(" "), "p_type", F.lit(" "))), "label", groups, dictionary).select("p_partkey", "group_id")


LINES = "t AS (SELECT DISTINCT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.split("text", "\n").alias("ls")).distinct()


@query(f"WITH {LINES} SELECT conv_id, CAST(turn // 3 AS INT) AS slide, array_to_string(flatten(list(ls ORDER BY turn)), '/') AS text FROM t GROUP BY conv_id, turn // 3")
def merged_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = H.merged_slides(_lines(spark, sf_dir).withColumn("slide", F.floor(F.col("turn") / 3).cast("int")), ["conv_id", "slide"], "turn", "ls")
    return merged.select("conv_id", "slide", F.array_join("ls", "/").alias("text"))


@query(f"WITH {LINES}, s AS (SELECT conv_id, turn, 0 AS part, ls[1:2] AS own FROM t UNION ALL SELECT conv_id, turn, 1, ls[3:] FROM t) SELECT conv_id, turn, part, array_to_string(own, '/') AS text FROM s WHERE len(own) > 0")
def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.split_items(_lines(spark, sf_dir), "ls", F.lit(2)).select("conv_id", "turn", "part", F.array_join("ls", "/").alias("text"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber - 1) // 3 DESC, l_linenumber) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is a parent; the parents in reverse order."""
    parent = F.floor((F.col("l_linenumber") - 1) / 3)
    slides = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("parent", parent)
    return H.regrouped(slides, ["l_orderkey"], [F.col("parent").desc()], "parent", "l_linenumber").select("l_orderkey", "l_linenumber", "ordinal")


@query("SELECT p_partkey, p_name || ' (' || p_brand || ' ' || p_size || ')' AS text FROM part")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"scripture_text": F.col("p_name"), "scripture_reference": F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))}
    return table(spark, sf_dir, "part").select("p_partkey", T.filled(F.lit("{scripture_number} {scripture_text} ({scripture_reference}){scripture1_number}"), values, ("scripture_number", "scripture1_number")).alias("text"))


@query("""WITH a AS (SELECT conv_id, turn, text AS c, length(text) AS n, length(text) // 2 AS m, length(text) // 2 // 2 AS g FROM (SELECT DISTINCT conv_id, turn, text FROM conversations)),
b AS (SELECT *, length(regexp_extract(substr(c, m - g + 1, 2 * g + 1), '(?s)^.*[.,!?]')) AS marked, length(regexp_extract(substr(c, 1, m + 1), '(?s)^.* ')) AS head, strpos(substr(c, m + 1), ' ') AS tail FROM a),
d AS (SELECT *, CASE WHEN head > 0 THEN head - 1 END AS l, CASE WHEN tail > 0 THEN m + tail - 1 END AS r FROM b),
e AS (SELECT *, CASE WHEN marked > 0 THEN m - g + marked WHEN l IS NOT NULL AND (r IS NULL OR m - l <= r - m) THEN l ELSE r END AS cut FROM d)
SELECT conv_id, turn, trim(substr(c, 1, coalesce(cut, n)), ' ') AS "first", CASE WHEN cut IS NOT NULL THEN trim(substr(c, cut + 1), ' ') END AS "second" FROM e""")
def text_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct().withColumn("h", T.halves(F.col("text")))
    return rows.select("conv_id", "turn", F.trim(F.get("h", F.lit(0))).alias("first"), F.get("h", F.lit(1)).alias("second"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
r AS (SELECT conv_id, turn, '' AS path, w FROM t UNION ALL SELECT conv_id, turn, path || side, CASE side WHEN '0' THEN w[1:len(w) // 2] ELSE w[len(w) // 2 + 1:] END FROM r, (VALUES ('0'), ('1')) s(side) WHERE len(w) > 8)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY path) - 1 AS INT) AS ordinal, array_to_string(w, ' ') AS line FROM r WHERE len(w) <= 8""")
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct()
    return rows.select("conv_id", "turn", F.posexplode(T.broken_lines(F.col("text"), 8)).alias("ordinal", "line"))


@query(f"""WITH l AS (SELECT event_id, epoch_ms(ts) - epoch_ms(TIMESTAMP '{NOW}') AS ms FROM events)
SELECT event_id, CASE WHEN ms <= 0 AND ms > -600000 THEN 'start' WHEN ms <= 600000 AND ms > 0 THEN 'ten_seconds' WHEN ms <= 1800000 AND ms > 1200000 THEN 'half_minute' WHEN ms <= 3600000 AND ms > 3000000 THEN 'minute' END AS "trigger" FROM l""")
def scheduled_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick of ten minutes with an hour for the minute, so that rows fall under every notice."""
    left = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(_now())
    return table(spark, sf_dir, "events").select("event_id", M.trigger_of(left, 600_000, 3_600_000).alias("trigger"))


@query("""WITH o AS (SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id) SELECT e.event_id, e.user_id AS question FROM events e JOIN o USING (user_id) WHERE e.ts < o.opened + INTERVAL 5 DAY""")
def poll_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("question"), F.col("ts").alias("time"))
    opened = answers.groupBy("question").agg(F.min("time").alias("opened"))
    return H.poll_answers_in_time(answers, opened, 5 * 86_400).select("event_id", "question")


@query("SELECT event_id, epoch_us(ts) // 1000 % 5400000 AS position, epoch_us(ts) // 1000 // 5400000 AS loop FROM events")
def timeline_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.looped(table(spark, sf_dir, "events"), F.unix_millis(F.col("ts").cast("timestamp")), 5_400_000).select("event_id", "position", "loop")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'upload' WHEN o_orderkey % 4 = 2 THEN 'read_only' WHEN o_orderkey % 4 = 3 THEN 'replace' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'per_item' ELSE 'newest_file' END AS strategy FROM orders")
def store_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.get(F.array(*map(F.lit, ("merge", "upload", "read_only", "replace"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.store_strategy(F.col("o_orderpriority"), method, ["1-URGENT", "2-HIGH"]).alias("strategy"))


@query("SELECT p_partkey, 'color: white;' || CASE WHEN regexp_matches(p_name, 'red') THEN 'color: red;' ELSE '' END || CASE WHEN regexp_matches(p_name, '^b') THEN 'font-weight: bold;' ELSE '' END AS style FROM part")
def style_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", H.styled(F.col("p_name"), F.lit("color: white;"), [("red", "color: red;"), ("^b", "font-weight: bold;")]).alias("style"))


@query("""SELECT event_id, strftime(ts, '%H:%M:%S') || ' ' || dayname(ts) || ' ' || event_type || ' ' || (event_id % 7 + 1) || '/' || 7 || ' ' || (7 - event_id % 7 - 1) || ' ' || upper(event_type) || ' ' || weekofyear(ts) AS text FROM events""")
def dynamic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = {"name": F.col("event_type"), "text": F.col("event_type"), "number": F.col("event_id") % 7 + 1, "total": F.lit(7)}
    values = H.dynamic_values(show, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", T.filled(F.lit("{time_hms} {date_weekday} {show_name} {slide_number}/{slides} {slides_left} {slide_text_upper} {date_week}"), values).alias("text"))


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type")
def read_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    shows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return H.read("get_categories", {"shows": shows})


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')")
def narrowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second search within the result of the first, as its words only add to it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    first = docs.where(F.contains("text", F.lit("the")))
    return H.narrowed(first, docs, "the of", "the").where(F.contains("text", F.lit("the")) & F.contains("text", F.lit("of"))).select("id")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 AS shown FROM customer")
def bound_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items bound to no output, or to this one."""
    bindings = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("OTHER"), F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", K.bound(bindings, "BUILDING").alias("shown"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'unknown' END AS media, upper(substr(split_part(url, '//', 2), 1, 3)) AS short, lpad(CAST(page_id % 10 AS VARCHAR), 2, '0') AS padded,
'c' || page_id AS id FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.get(F.split("url", "//"), F.lit(1))
    path = F.concat(F.lit("a.b/c"), F.col("page_id").cast("string"), F.get(F.array(*map(F.lit, (".MP3", ".png?x=1", ".mov", ".txt"))), (F.col("page_id") % 4).cast("int")))
    stem = F.regexp_extract(T.base_name(path), r"^([^.]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.media_type(path).alias("media"), T.acronym(rest).alias("short"), M.last_two(F.col("page_id") % 10).alias("padded"), stem.alias("id"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations), l AS (SELECT conv_id, turn * 10 AS n, '[' || role || ']' AS line FROM t
UNION ALL SELECT conv_id, turn * 10 + 1, '[C]some [Am/E]words by ' || role || ' ' || turn FROM t WHERE turn % 3 <> 2 UNION ALL SELECT conv_id, turn * 10 + 1, 'C    Am/E' FROM t WHERE turn % 3 = 2)
SELECT conv_id, CAST(n AS INT) AS n, line FROM l""")
def chord_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, chords and lyrics for each turn; some with an empty line between, some with no lyrics."""
    from quillon.operators import charts as C

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    words = F.concat(F.lit("some words by "), "role", F.lit(" "), F.col("turn").cast("string"))
    line = lambda k, text: F.struct((F.col("turn") * 10 + k).cast("int").alias("n"), text.alias("line"))
    head, chords = line(0, F.concat(F.lit("["), "role", F.lit("]"))), line(1, F.lit("C    Am/E"))
    plain, spaced, bare = F.array(head, chords, line(2, words)), F.array(head, chords, line(2, F.lit(" ")), line(3, words)), F.array(head, chords)
    each = F.when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, spaced).otherwise(bare)
    lines = turns.select("conv_id", F.explode(each).alias("x")).select("conv_id", "x.n", "x.line")
    return C.merged_chords(lines, ["conv_id"], "n", "line")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), o AS (SELECT l_orderkey, bool_or(n = 2) AS a, bool_or(n = 4) AS z FROM d GROUP BY l_orderkey),
r AS (SELECT l_orderkey, n, CASE WHEN a AND z AND n BETWEEN 2 AND 4 THEN 3 WHEN a AND NOT z AND n >= 2 THEN 2 ELSE 1 END AS times FROM d JOIN o USING (l_orderkey)),
c AS (SELECT l_orderkey, n, unnest(range(0, times)) AS k, times FROM r)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN times = 1 AND n < 3 THEN 0 WHEN times > 1 THEN 1 ELSE 2 END, k, n) - 1 AS INT) AS ordinal, 'line ' || n AS line FROM c""")
def repeat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block from the second line, twice, that the fourth ends, three times."""
    from quillon.operators import charts as C

    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumns({"line": F.concat(F.lit("line "), n.cast("string")), "start": F.when(n == 2, 2), "end": F.when(n == 4, 3)})
    return C.repeated_blocks(lines, ["l_orderkey"], "l_linenumber", "line", "start", "end")


@query(f"""WITH d AS (SELECT event_id, ts, floor((epoch_us(TIMESTAMP '{NOW}') // 1000 - epoch_us(ts) // 1000) / 86400000.0) AS days FROM events)
SELECT event_id, CASE WHEN days < 1 THEN 'Today' WHEN days < 2 THEN 'Yesterday' WHEN days < 7 THEN CAST(days AS INT) || ' days ago' ELSE strftime(ts, '%d.%m.%Y') END AS shown FROM d""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", M.relative_date(F.col("ts").cast("timestamp"), _now()).alias("shown"))


@query("""WITH t AS (SELECT event_id, event_id % 3 AS k, event_id % 50 AS a, event_id % 31 AS b, event_id % 40 AS e, event_id % 2 = 0 AS o FROM events), v AS (SELECT *, CASE WHEN a <= b THEN a + e ELSE a - e END AS n FROM t)
SELECT event_id, CASE WHEN k = 0 THEN CASE WHEN o THEN n WHEN a <= b THEN least(n, b) ELSE greatest(n, b) END WHEN o THEN n ELSE greatest(n, 0) END AS value FROM v""")
def timer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import timelines as L

    k = F.col("event_id")
    value = L.timer_value(F.when(k % 3 == 0, "counter").otherwise("clock"), k % 50, k % 31, k % 40, k % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


@query("SELECT p_partkey, p_type AS color, p_size || 'px' AS top, 2 AS n FROM part")
def style_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.concat(F.lit("color: red; top : "), F.col("p_size").cast("string"), F.lit("px;; none; color:"), "p_type")
    parts = table(spark, sf_dir, "part").select("p_partkey", T.style_map(style).alias("m"))
    return parts.select("p_partkey", F.element_at("m", "color").alias("color"), F.element_at("m", "top").alias("top"), F.size("m").alias("n"))


@query("""SELECT page_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS INT) AS hash FROM pages""")
def path_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.string_hash32(F.col("url")).alias("hash"))


@query("SELECT p_partkey, p_size % 7 <> 0 AS equal FROM part")
def equal_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.catalogue import object_equal

    size = F.col("p_size").cast("string")
    one = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), size)
    two = F.create_map(F.lit("size"), F.when(F.col("p_size") % 7 == 0, F.concat(size, F.lit("x"))).otherwise(size), F.lit("name"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", object_equal(one, two).alias("equal"))


@query("SELECT p_partkey, p_size % 3 = 0 AS chords, CASE p_size % 3 WHEN 0 THEN '0:C,3:G/B,8:Am7' ELSE '' END AS places FROM part")
def chord_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import charts as C
    from quillon.operators import texts as X

    kind = F.col("p_size") % 3
    line = F.when(kind == 0, "C  G/B  Am7").when(kind == 1, F.concat("p_name", F.lit(" "), "p_type")).otherwise("")
    chords = X.is_chord_line(line)
    places = F.array_join(F.transform(C.chord_places(line), lambda p: F.concat_ws(":", p["at"].cast("string"), p["chord"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", chords.alias("chords"), F.when(chords, places).otherwise("").alias("places"))


@query("SELECT n_name AS book, c_custkey AS verse FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) AND contains(lower(c_name), '7') ORDER BY c_custkey LIMIT 50")
def verse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that begins with a book's name, then words to look for in it."""
    from quillon.operators import scripture as R

    names = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]  # the books
    book, rest = R.split_query(f"{names[0].lower()} 7", names)
    verses = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("book"), F.lit(1).alias("chapter"), F.col("c_custkey").alias("verse"), F.col("c_name").alias("text"))
    return R.contains(verses, rest, book).select("book", "verse")


@query("""WITH t AS (SELECT p_partkey, '<b>' || p_name || '</b> ' || p_type || ' <i>and <u>' || p_brand || '</u></i>' AS x FROM part),
v AS (SELECT p_partkey, x, length(p_name) AS a, length(p_type) AS b, length(p_brand) AS c, p_name, p_type, p_brand FROM t JOIN part USING (p_partkey))
SELECT p_partkey, '<b>' || p_name || '</b> ' || p_type || ' <i>and</i>' AS first, '<i><u>' || p_brand || '</u></i>' AS second FROM v""".replace("AS first", 'AS "first"').replace("AS second", 'AS "second"'))
def markup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag that is open at the cut is closed there and opened again."""
    text = F.concat(F.lit("<b>"), "p_name", F.lit("</b> "), "p_type", F.lit(" <i>and <u>"), "p_brand", F.lit("</u></i>"))
    most = F.length("p_name") + F.length("p_type") + 5
    parts = table(spark, sf_dir, "part").withColumn("p", D.split_markup(text, most))
    return parts.select("p_partkey", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, t, k, true AS fetched, t AS last FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.k, e.t - f.last >= 172800000000, CASE WHEN e.t - f.last >= 172800000000 THEN e.t ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, fetched FROM f""")
def cache_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import timelines as L

    return L.fetches(table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), ["user_id"], "t", "event_id", 172_800_000_000).select("event_id", "fetched")


@query(f"SELECT event_id FROM events WHERE epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}') < 0 AND epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}') >= -3600000000")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers that passed zero within the last tick (of an hour here)."""
    from quillon.operators import timelines as L

    return L.crossed_zero(table(spark, sf_dir, "events"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(_now())) / 1e6, 3600).select("event_id")


@query("SELECT conv_id, turn, string_agg(line, '/' ORDER BY k) AS lines FROM (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT DISTINCT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)) GROUP BY conv_id, turn")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line gets a dynamic token, which goes."""
    token = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("{time_h}"), x, F.lit("{show_name|none}")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct()
    return rows.select("conv_id", "turn", F.array_join(T.without_tokens(token), "/").alias("lines"))

"""Poll queries over events: the type is the option, the user the client, the day the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import polls as P
from quillon.plans.registry import query, table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.dayofmonth("ts").alias("question"), F.col("user_id").alias("client"), F.array("event_type").alias("value"), F.unix_micros(ts).alias("time"))


A = "a AS (SELECT CAST(day(ts) AS INT) AS question, user_id AS client, event_type AS value, epoch_us(ts) AS time FROM events)"
FIRST = f"{A}, f AS (SELECT question, client, min(time) AS time FROM a WHERE value = 'view' GROUP BY ALL)"


@query(f"""WITH {A}, o AS (SELECT DISTINCT question, unnest(['view', 'click', 'purchase', 'other']) AS option FROM a), n AS (SELECT question, count(*) AS n FROM a GROUP BY 1),
k AS (SELECT question, value, count(*) AS k FROM a GROUP BY ALL) SELECT o.question, option, CAST(coalesce(floor(k / n * 100 + 0.5), 0) AS BIGINT) AS percent FROM o JOIN n USING (question) LEFT JOIN k ON k.question = o.question AND k.value = o.option""")
def option_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    options = answers.select("question").distinct().withColumn("option", F.explode(F.array(*map(F.lit, ("view", "click", "purchase", "other")))))
    return P.percentages(answers, options)


@query(f"WITH {FIRST} SELECT question, client, greatest(1, 10 - (row_number() OVER (PARTITION BY question ORDER BY time, client) - 1)) AS points FROM f")
def falloff_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.points(_answers(spark, sf_dir), F.array_contains("value", "view"), "falloff")


@query(f"""WITH {FIRST}, s AS (SELECT question, min(time) AS s FROM a GROUP BY 1)
SELECT question, client, CAST(floor(100 * (1 - least((time - s) / 1000 / 86400000.0, 1.0)) + 0.5) AS BIGINT) AS points FROM f JOIN s USING (question)""")
def speed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.points(_answers(spark, sf_dir), F.array_contains("value", "view"), "speed", limit_s=86_400_000.0)


@query(f"""WITH {FIRST}, p AS (SELECT client, CAST(count(*) AS BIGINT) AS points FROM f GROUP BY 1), s AS (SELECT c_custkey, 'Client ' || c_custkey AS name, coalesce(points, 0) + c_custkey % 3 AS score FROM customer LEFT JOIN p ON client = c_custkey)
SELECT c_custkey AS client, name, score, row_number() OVER (ORDER BY score DESC, c_custkey) AS rank FROM s""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.catalogue import ranked

    key = F.col("c_custkey")
    clients = table(spark, sf_dir, "customer").select(key.alias("client"), F.concat(F.lit("Client "), key.cast("string")).alias("name"), (key % 3).alias("score"))
    return ranked(P.leaderboard(clients, P.points(_answers(spark, sf_dir), F.array_contains("value", "view"))), F.desc("score"), F.col("client"))


@query(f"WITH {A} SELECT question, arg_max(value, time) AS latest FROM a GROUP BY question")
def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(_answers(spark, sf_dir))


@query("""SELECT c_custkey AS client, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'User #' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) END AS name FROM customer""")
def client_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    clients = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("poll"), F.col("c_custkey").alias("client"), name.alias("name"), F.col("c_acctbal").alias("time"))
    return P.client_names(clients).select("client", "name")


@query(f"WITH {A} SELECT count(DISTINCT client) AS clients, min(time) AS first FROM a")
def client_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).agg(F.countDistinct("client").alias("clients"), F.min("time").alias("first"))

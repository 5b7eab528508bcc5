"""Merge queries: customers stand for two copies of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import merging as G
from quillon.plans.registry import query, table



def _key() -> Column:
    return F.col("c_custkey")


SIDES = """c AS (SELECT c_custkey AS k, c_name || ' cloud' AS value, c_custkey * 17 % 100 AS modified FROM customer WHERE c_custkey % 5 <> 0),
l AS (SELECT c_custkey AS k, c_name || ' local' AS value, c_custkey * 29 % 100 AS modified FROM customer WHERE c_custkey % 7 <> 0)"""


def _side(spark: SparkSession, sf_dir: str, cloud: bool) -> DataFrame:
    kept = _key() % 5 != 0 if cloud else _key() % 7 != 0
    name = F.concat("c_name", F.lit(" cloud" if cloud else " local"))
    return table(spark, sf_dir, "customer").where(kept).select(F.lit("shows").alias("store"), _key().alias("key"), name.alias("value"), (_key() * (17 if cloud else 29) % 100).alias("modified"))


def _decisions(spark: SparkSession, sf_dir: str, new_device: bool = False) -> DataFrame:
    marks = table(spark, sf_dir, "customer").where(_key() % 3 == 0)
    own = F.when(_key() % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("B")))
    none = F.expr(G.NONE)
    ledger = marks.select(F.lit("shows").alias("store"), _key().alias("key"), F.when(_key() % 4 < 2, own).otherwise(none).alias("created"), F.when(_key() % 4 >= 2, own).otherwise(none).alias("deleted"))
    return G.decide(_side(spark, sf_dir, True), _side(spark, sf_dir, False), ledger, G.Run("A", ("A", "B", "C"), new_device))


DECIDED = f"""{SIDES}, j AS (SELECT coalesce(c.k, l.k) AS k, c.k IS NOT NULL AS cl, l.k IS NOT NULL AS lo, c.value AS cv, l.value AS lv, coalesce(c.modified, 0) AS cm, coalesce(l.modified, 0) AS lm FROM c FULL JOIN l ON c.k = l.k),
m AS (SELECT *, k % 3 = 0 AND k % 4 < 2 AS cr, k % 3 = 0 AND k % 4 >= 2 AS de, k % 2 = 0 AS mine FROM j),
d AS (SELECT *, CASE WHEN NOT lo THEN CASE WHEN cr AND NOT mine THEN 'create' ELSE 'skip' END WHEN NOT cl THEN CASE WHEN de AND NOT mine THEN 'delete' ELSE 'upload' END
  WHEN de THEN 'delete' WHEN cm > lm THEN 'download' ELSE 'upload' END AS action,
  CASE WHEN NOT lo THEN CASE WHEN cr AND NOT mine THEN 'created' ELSE 'deleted' END WHEN NOT cl THEN CASE WHEN de AND NOT mine THEN 'deleted' ELSE 'created' END WHEN de THEN 'deleted' WHEN cr THEN 'created' ELSE 'none' END AS mark FROM m)"""


@query(f"""WITH {DECIDED} SELECT k AS key, action, CASE WHEN action IN ('create', 'download') THEN cv WHEN action = 'upload' THEN lv END AS value FROM d""")
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("key", "action", "value")


@query(f"""WITH {DECIDED} SELECT k AS key, CASE WHEN NOT lo THEN 'create' WHEN NOT cl OR cm <= lm THEN 'upload' ELSE 'download' END AS action FROM d""")
def new_device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device that joins takes everything, whatever was deleted."""
    return _decisions(spark, sf_dir, True).select("key", "action")


@query(f"""WITH {DECIDED}, e AS (SELECT k, CASE WHEN mine THEN ['A'] ELSE ['A', 'B'] END AS pair, CASE WHEN mine THEN ['A'] ELSE ['B'] END AS own, * FROM d),
s AS (SELECT k AS key, CASE mark WHEN 'created' THEN CASE WHEN cr THEN pair ELSE ['A'] END WHEN 'deleted' THEN [] ELSE CASE WHEN cr THEN own ELSE [] END END AS c, CASE mark WHEN 'deleted' THEN CASE WHEN de THEN pair ELSE ['A'] END WHEN 'created' THEN [] ELSE CASE WHEN de THEN own ELSE [] END END AS d FROM e)
SELECT key, array_to_string(list_sort(c), ',') AS created, array_to_string(list_sort(d), ',') AS deleted FROM s WHERE len(c) > 0 OR len(d) > 0""")
def ledger_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return G.ledger_after(_decisions(spark, sf_dir)).select("key", shown("created"), shown("deleted"))


@query(f"WITH {SIDES} SELECT coalesce(c.k, l.k) AS key, CASE WHEN l.k IS NULL OR c.modified > l.modified + 10 THEN coalesce(c.value, l.value) ELSE l.value END AS value FROM c FULL JOIN l ON c.k = l.k")
def newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.newest_wins(_side(spark, sf_dir, False), _side(spark, sf_dir, True), "key", "modified", tolerance=10).select("key", "value")


@query(f"WITH {SIDES} SELECT k AS key FROM l WHERE k NOT IN (SELECT k FROM c)")
def local_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.local_only(_side(spark, sf_dir, False), _side(spark, sf_dir, True), "store", "key").select("key")


@query(f"WITH {SIDES} SELECT DISTINCT k AS key FROM (SELECT k FROM c UNION SELECT k FROM l)")
def union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(spark, sf_dir, False).select("key").union(_side(spark, sf_dir, True).select("key")).distinct()


@query(f"WITH {SIDES} SELECT coalesce(c.k, l.k) AS key, CASE WHEN l.k IS NULL THEN 'insert' WHEN c.k IS NULL THEN 'delete' ELSE 'update' END AS kind FROM c FULL JOIN l ON c.k = l.k")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.changes(_side(spark, sf_dir, False).drop("store"), _side(spark, sf_dir, True).drop("store"), "key").select("key", "kind")


@query(f"WITH {SIDES} SELECT k AS key, value FROM l")
def undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _side(spark, sf_dir, False).drop("store"), _side(spark, sf_dir, True).drop("store")
    return G.undo(after, G.changes(before, after, "key"), "key").select("key", "value")


@query("""WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k, epoch(TIMESTAMP '2024-01-30' - ts) AS age FROM events WHERE ts < TIMESTAMP '2024-01-30')
SELECT user_id, event_id FROM s WHERE k <= 2 OR age >= 3600 AND age <= 14 * 86400""")
def kept_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp")
    events = table(spark, sf_dir, "events").where(F.col("ts") < now)
    return G.kept_snapshots(events, "user_id", "ts", now).select("user_id", "event_id")


@query("SELECT o_orderkey, epoch((SELECT max(o_orderdate) FROM orders)) - epoch(o_orderdate) >= 2592000 AS read_only FROM orders")
def read_only_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("last"))
    latest = orders.agg(F.max("last").alias("latest"))
    return orders.join(F.broadcast(latest)).select("o_orderkey", G.read_only(F.col("last"), F.col("latest")).alias("read_only"))

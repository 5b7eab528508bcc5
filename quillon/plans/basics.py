"""Plain aggregates, sorts and joins of the inventory that need no operator of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import catalogue as C
from quillon.plans.registry import query, table


@query("SELECT l_orderkey, coalesce(nullif(l_returnflag, 'R'), 'text') AS type, count(*) AS n FROM lineitem GROUP BY ALL")
def items_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("R")), F.lit("text"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", kind.alias("type")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linestatus, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS lines FROM lineitem GROUP BY ALL")
def actions_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(lines.alias("lines"))


@query("SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS backgrounds, round(avg(l_discount), 6) AS level FROM lineitem GROUP BY l_orderkey")
def slide_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(on, F.col("l_quantity"))), F.lit(0.0)).alias("total"), F.count_if(F.col("l_returnflag") == "A").alias("backgrounds"), F.round(F.avg("l_discount"), 6).alias("level"))


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS characters, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("characters"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3 <> 0, c_custkey % 5 = 0, c_name, c_custkey) AS rank FROM customer")
def project_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders first, archived last, then by name."""
    k = F.col("c_custkey")
    order = [k % 3 != 0, k % 5 == 0, *C.name_order("c_name"), k]
    return C.ranked(table(spark, sf_dir, "customer"), *order, within=["c_nationkey"]).select("c_custkey", "rank")


@query("SELECT page_id, row_number() OVER (ORDER BY strlen(html) DESC, page_id) AS rank FROM pages")
def media_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("size")), F.desc("size"), F.col("page_id")).select("page_id", "rank")


@query("SELECT p_partkey, p_name FROM part WHERE contains(replace(p_name, ' ', ''), 'dwid') AND p_type <> 'ECONOMY'")
def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type filter and substring on the cleaned name."""
    hit = F.contains(T.closest_form(F.col("p_name")), T.closest_form(F.lit("D Wid")))
    return table(spark, sf_dir, "part").where(hit & (F.col("p_type") != "ECONOMY")).select("p_partkey", "p_name")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events JOIN (SELECT DISTINCT CAST(o_orderdate + INTERVAL 9496 DAY AS DATE) AS day FROM orders) o ON CAST(ts AS DATE) = o.day")
def exact_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at exactly the wanted times."""
    wanted = table(spark, sf_dir, "orders").select(F.date_add(F.to_date("o_orderdate"), 9496).alias("day")).distinct()
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day")).join(wanted, "day").select("event_id", "day")


@query("SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def union_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a.union(table(spark, sf_dir, "customer").where("c_acctbal > 9900").select("c_nationkey")).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-08' AND o_totalprice > 0")
def next_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((d >= F.lit("1998-01-01").cast("timestamp")) & (d < F.lit("1998-01-08").cast("timestamp")) & (F.col("o_totalprice") > 0)).select("o_orderkey")

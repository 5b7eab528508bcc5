"""Catalogue queries: facets, counts, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import catalogue as C
from quillon.plans.registry import query, table


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_nationkey = n_nationkey GROUP BY ALL")
def facet_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_nationkey", "n_nationkey")
    return C.count_by(chosen, nation, "n_nationkey").join(nation, "n_nationkey")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') OR source IS NULL")
def facet_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    return C.facet(table(spark, sf_dir, "documents").select("doc_id", "source"), "unlabeled", known, "source")


@query("SELECT p_partkey, p_name FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'ring'])")
def tag_all_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("tags"))
    return C.with_all_tags(df, ["red", "ring"]).drop("tags")


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0 AND NOT coalesce(d.n_chars > 5000, false)")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return C.live(docs.withColumns({"deleted": F.col("toxic") == 1, "private": F.col("n_chars") > 5000}), "deleted", "private").select("doc_id", "source")


@query("SELECT s.s_suppkey, s.s_name FROM supplier s WHERE s.s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    access = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_regionkey") == 1, "none").otherwise("write").alias("access"))
    return C.allowed(table(spark, sf_dir, "supplier"), access, "s_nationkey").select("s_suppkey", "s_name")


@query("""WITH k AS (SELECT n_name, CAST(regexp_extract(n_name, '[0-9]+') AS INT) AS k FROM nation) SELECT n_name, row_number() OVER (ORDER BY k) AS rank FROM k""")
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(table(spark, sf_dir, "nation").select("n_name"), *C.name_order("n_name"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'MP' END,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey * 7919 % 1000 END, p_name, p_partkey) AS rank FROM part""")
def song_number_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("mp"), (F.col("p_partkey") * 7919 % 1000).cast("string")))
    return C.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_name", number.alias("number")), *C.number_order("number", "p_name"), F.col("p_partkey")).select("p_partkey", "rank")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 7, s_suppkey, s_suppkey) AS rank FROM supplier""")
def file_name_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("take-"), F.chr(97 + F.col("s_suppkey") % 7), F.col("s_suppkey").cast("string"), F.lit(".mp3"))
    return C.ranked(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")), *C.file_order("name")).select("s_suppkey", "rank")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey * 31 % 997 END AS modified, o_orderkey % 101 AS created FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(nullif(modified, 0), created) DESC, o_orderkey) AS rank FROM c""")
def catalogue_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 == 0, 0).otherwise(key * 31 % 997).alias("modified"), (key % 101).alias("created"), key.cast("string").alias("name"))
    return C.ranked(df, *C.catalogue_order("modified")).select("o_orderkey", "rank")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY list_position(['1-URGENT', '5-LOW', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], o_orderpriority), o_orderkey IN (1, 2, 3) DESC, o_orderkey) AS rank FROM orders""")
def type_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [C.type_rank("o_orderpriority", ["1-URGENT", "5-LOW", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]), ~F.col("o_orderkey").isin(1, 2, 3), F.col("o_orderkey")]
    return C.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), *order).select("o_orderkey", "rank")


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return C.top_k(docs, 5, ["source"], F.desc("n_chars"), F.col("doc_id"))


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_k(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), 10, ["user_id"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def adaptive_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.search import result_limit

    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(result_limit("a query of twenty letters")).select("doc_id")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("known").isNull()).alias("unlabelled"))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def archived_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 5 DAY")
def recently_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recently_used(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.lit("1998-01-01").cast("timestamp"), used="o_orderdate")


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'c_acctbal' END, CASE WHEN c_custkey % 4 = 0 THEN 'c_name' END], lambda x: x IS NOT NULL), ',') AS changed
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0""")
def column_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer")
    new = old.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_name": F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))})
    return C.changed_columns(old, new, "c_custkey", ["c_acctbal", "c_name"]).select("c_custkey", F.array_join("changed", ",").alias("changed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change suppression: only rows whose hash over the chosen columns moved."""
    old = table(spark, sf_dir, "customer")
    new = old.withColumns({"c_mktsegment": F.lit("OTHER"), "c_acctbal": F.when(F.col("c_custkey") % 10 == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))})
    h = F.xxhash64("c_name", "c_acctbal").alias("h")
    return new.select("c_custkey", h).join(old.select("c_custkey", h), ["c_custkey", "h"], "left_anti").select("c_custkey")


@query("""WITH n AS (SELECT n_nationkey, n_nationkey AS p FROM nation WHERE n_nationkey % 4 <> 0), o AS (SELECT n_nationkey, 100 - n_nationkey AS p FROM nation WHERE n_nationkey % 3 <> 0)
SELECT n_nationkey, row_number() OVER (ORDER BY o.p IS NULL, coalesce(o.p, n.p), n_nationkey) AS position FROM n LEFT JOIN o USING (n_nationkey)""")
def keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = nation.where("n_nationkey % 4 <> 0").select("n_nationkey", F.col("n_nationkey").alias("p"))
    old = nation.where("n_nationkey % 3 <> 0").select("n_nationkey", (100 - F.col("n_nationkey")).alias("p"))
    return C.keep_order(new, old, "n_nationkey", "p")


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN url LIKE '%.html' THEN 'html' ELSE regexp_extract(url, '\\.([^./?#]+)([?#].*)?$', 1) END AS extension FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(F.col("url")).alias("name"), T.extension(F.col("url")).alias("extension"))


@query("SELECT p_partkey, (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS first_nation, p_size, greatest(p_size, 10) AS size FROM part WHERE p_size >= 5 AND p_type <> 'ECONOMY'")
def projection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(1).select(F.col("n_name").alias("first_nation"))
    part = table(spark, sf_dir, "part").where("p_size >= 5 AND p_type <> 'ECONOMY'")
    return part.join(F.broadcast(first)).select("p_partkey", "first_nation", "p_size", F.greatest("p_size", F.lit(10)).alias("size"))

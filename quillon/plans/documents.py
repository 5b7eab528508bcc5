"""Document queries: playlists, texts, neighbours, ordinals, ranges and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import documents as D
from quillon.plans.registry import query, table


@query("""WITH l AS (SELECT o_orderkey AS doc, o_custkey AS slide FROM orders), p AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey AS id, l_suppkey FROM lineitem WHERE l_partkey % 5 <> 0),
e AS (SELECT doc, pos, id AS parent, unnest(CASE WHEN id % 3 = 0 THEN [-1, 0, 1] ELSE [-1] END) AS k FROM p)
SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY pos, CAST(parent AS VARCHAR), k) - 1 AS layout_index, CASE WHEN k < 0 THEN CAST(parent AS VARCHAR) ELSE parent || '-' || k END AS id,
  CASE WHEN k < 0 THEN 'parent' ELSE 'child' END AS type FROM (SELECT DISTINCT * FROM e)""")
def layout_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    layout = items.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("id")).distinct()
    child = F.when(F.col("l_partkey") % 3 == 0, F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.concat_ws("-", F.col("l_partkey").cast("string"), k.cast("string"))))
    slides = items.where("l_partkey % 5 <> 0").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").cast("string").alias("id"), F.lit("Verse").alias("group"), child.alias("children")).dropDuplicates(["doc", "id"])
    return D.layout_ref(layout, slides).select("doc", "pos", "layout_index", "id", "type")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand || '/' || p_type AS meta FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 WHERE l_quantity > 40")
def project_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.concat_ws("/", "p_brand", "p_type").alias("meta"))
    return table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey", "left")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.text_of(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@query("SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN role || ' ' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE role END AS group_name FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def group_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    return D.group_names(rows, ["conv_id"], "role", "turn").select("conv_id", "turn", "group_name")


@query("SELECT event_id, lag(event_type) OVER w AS event_type_previous, lead(event_type) OVER w AS event_type_next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "event_type_previous", "event_type_next")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current,
first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS upcoming FROM events""")
def next_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.upcoming(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", F.col("event_type") == "purchase").select("event_id", "current", "upcoming")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey % 60 AS v FROM lineitem), r AS (SELECT *, v - row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS g FROM d),
s AS (SELECT l_suppkey, min(v) AS a, max(v) AS b FROM r GROUP BY l_suppkey, g) SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, '+' ORDER BY a) AS ranges FROM s GROUP BY l_suppkey""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.islands(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 60).alias("v")), ["l_suppkey"], "v")


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS INT) AS chunk FROM events")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 4).select("event_id", "chunk")


@query("SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS first, max(l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS last FROM lineitem GROUP BY l_orderkey")
def first_last_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bounds(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "R")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type AS mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def frequent_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mode_of(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS joined FROM customer GROUP BY c_nationkey")
def joined_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.joined_distinct(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


TREE = """nodes AS (SELECT 'root' AS id, CAST(NULL AS VARCHAR) AS parent, 'root' AS label UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
t(id, depth, path) AS (SELECT id, 0, label FROM nodes WHERE id = 'root' UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.label FROM nodes n JOIN t ON n.parent = t.id)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    root = spark.createDataFrame([("root", None, "root")], "id string, parent string, label string")
    region = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.col("r_name").alias("label"))
    nation = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    customer = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent"), F.col("c_name").alias("label"))
    return root.unionByName(region).unionByName(nation).unionByName(customer)


@query(f"WITH RECURSIVE {TREE} SELECT id, depth FROM t")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tree_closure(_tree(spark, sf_dir), "root").select("id", "depth")


@query(f"WITH RECURSIVE {TREE} SELECT id, path, row_number() OVER (ORDER BY path, id) AS rank FROM t")
def tree_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.catalogue import ranked

    return ranked(D.tree_closure(_tree(spark, sf_dir), "root").select("id", "path"), F.col("path"), F.col("id"))


@query("SELECT p_partkey, [p_brand, p_type, p_name][1] AS was_first, array_to_string([p_type, p_name, p_brand], '|') AS moved, array_to_string([1, 2, 3, 4, 7], ',') AS selected FROM part")
def move_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array("p_brand", "p_type", "p_name")
    chosen = D.range_selected(F.array(F.lit(7), F.lit(2)), F.lit(4), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(a, F.lit(0)).alias("was_first"), F.array_join(D.moved(a, F.lit(0), F.lit(2)), "|").alias("moved"), F.array_join(chosen.cast("array<string>"), ",").alias("selected"))


@query("""WITH s AS (SELECT l_orderkey AS slide, l_linenumber AS pos, l_returnflag AS type, l_linestatus AS style, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem)
SELECT slide, pos, type, CASE WHEN type = 'A' AND nth = 1 THEN 'big' WHEN type = 'A' AND nth = 2 THEN 'small' WHEN type = 'N' AND nth = 1 THEN 'note' ELSE style END AS style FROM s""")
def template_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    slides = items.select(F.col("l_orderkey").alias("slide"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("style"))
    template = spark.createDataFrame([(0, "A", "big"), (1, "N", "note"), (2, "A", "small")], "pos int, type string, style string")
    return D.template_overlay(slides, template).select("slide", F.col("pos.l_linenumber").alias("pos"), "type", "style")

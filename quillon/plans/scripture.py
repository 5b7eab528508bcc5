"""Verse queries: orders stand for books, suppliers for chapters and verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import scripture as R
from quillon.operators import variables as W
from quillon.plans.registry import query, table


def _verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_orderkey") % 5).alias("book"), (F.col("l_suppkey") % 8 + 1).alias("chapter"), (F.col("l_partkey") % 30 + 1).alias("verse"), F.concat_ws(" ", F.lit("Verse"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_returnflag").alias("translation"))


V = "v AS (SELECT l_orderkey % 5 AS book, l_suppkey % 8 + 1 AS chapter, l_partkey % 30 + 1 AS verse, 'Verse ' || l_partkey AS text, l_returnflag AS translation FROM lineitem)"


@query(f"WITH {V} SELECT DISTINCT book, chapter, verse FROM v WHERE book = 2 AND ((chapter = 1 AND verse BETWEEN 3 AND 12) OR (chapter = 2 AND verse >= 20) OR chapter = 3 OR (chapter = 4 AND verse <= 5) OR (chapter = 6 AND verse IN (1, 4)) OR chapter = 8)")
def verse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select(_verses(spark, sf_dir), 2, "1:3-12; 2:20-4:5; 6:1,4; 8").select("book", "chapter", "verse").distinct()


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS book, l_linenumber AS chapter, l_partkey % 176 + 1 AS verse FROM lineitem), r AS (SELECT *, verse - row_number() OVER (PARTITION BY book, chapter ORDER BY verse) AS g FROM d),
s AS (SELECT book, chapter, min(verse) AS a, max(verse) AS b FROM r GROUP BY book, chapter, g), t AS (SELECT book, chapter, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, '+' ORDER BY a) AS x FROM s GROUP BY book, chapter)
SELECT book, string_agg(chapter || ':' || x, '; ' ORDER BY chapter) AS reference FROM t GROUP BY book""")
def reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return R.reference_text(items.select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("chapter"), (F.col("l_partkey") % 176 + 1).alias("verse")))


@query(f"""WITH {V} SELECT book, chapter, verse, max(text) FILTER (WHERE translation = 'A') AS A, max(text) FILTER (WHERE translation = 'N') AS N FROM v WHERE translation IN ('A', 'N') GROUP BY ALL""")
def parallel_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parallel(_verses(spark, sf_dir), ["A", "N"])


@query(f"""WITH {V} SELECT book, chapter, verse FROM (SELECT DISTINCT * EXCLUDE (translation) FROM v) WHERE book = 3 AND contains(lower(text), 'verse 77') ORDER BY book, chapter, verse, text LIMIT 50""")
def verse_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contains(_verses(spark, sf_dir).drop("translation").distinct(), "VERSE 77", book=3).select("book", "chapter", "verse")


@query("""WITH l AS (SELECT event_id, CAST(event_id % 9 AS INT) AS line, CAST(event_id % 9 + event_id % 5 AS INT) AS lines FROM events),
s AS (SELECT *, CASE WHEN line + 4 >= lines AND lines % 4 > 0 THEN lines - lines % 4 ELSE line // 4 * 4 END AS start FROM l) SELECT event_id, CAST(start AS INT) AS start, CAST(start + 4 AS INT) AS "end",
CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 THEN true WHEN event_id % 4 = 2 THEN line = 0 ELSE line IN (0, 8) END AS metadata FROM s""")
def visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    line, lines = (k % 9).cast("int"), (k % 9 + k % 5).cast("int")
    rule = F.get(F.array(*map(F.lit, ("never", "always", "first", "first_last"))), (k % 4).cast("int"))
    x = R.visible_lines(line, lines, 4)
    return table(spark, sf_dir, "events").select("event_id", x["start"].alias("start"), x["end"].alias("end"), R.shows_metadata(rule, line, F.lit(0), F.lit(8)).alias("metadata"))


@query("""WITH m AS (SELECT url AS missing, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS a FROM pages WHERE page_id % 50 = 0), f AS (SELECT DISTINCT url AS path, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS b FROM pages WHERE url NOT IN (SELECT missing FROM m)),
s AS (SELECT missing, path, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END AS s FROM m, f), r AS (SELECT *, row_number() OVER (PARTITION BY missing ORDER BY s DESC, path) AS rank FROM s WHERE s >= 0.5)
SELECT missing, path, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def similar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    """The missing files are the pages whose id is divisible by 50, asked of all others."""
    found = R.similar_paths(pages.where("page_id % 50 = 0").select("path"), pages.select("path"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT p_partkey AS id, CAST(least(greatest(p_size + 7, 10), 40) AS VARCHAR) AS value FROM part")
def variable_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("id"), F.lit("number").alias("type"), F.col("p_size").cast("string").alias("value"), F.lit(7).alias("step"), F.lit(10).alias("low"), F.lit(40).alias("high"), F.array().cast("array<string>").alias("sets"))
    return W.changed(part, "x", "increment").select(F.col("p_partkey").alias("id"), "value")


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS book, l_linenumber AS chapter, l_partkey % 50 AS verse FROM lineitem)
SELECT book, chapter, verse, lead(book) OVER w AS next_book, lead(chapter) OVER w AS next_chapter, lead(verse) OVER w AS next_verse FROM v WINDOW w AS (ORDER BY book, chapter, verse)""")
def following_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    found = R.following(items.select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("chapter"), (F.col("l_partkey") % 50).alias("verse")))
    return found.select("book", "chapter", "verse", F.col("next.book").alias("next_book"), F.col("next.chapter").alias("next_chapter"), F.col("next.verse").alias("next_verse"))

"""Search queries over the documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import search as S
from quillon.plans.registry import query, table

#: The search form in SQL, for a column or literal.
FORM = "strip_accents(regexp_replace(lower({}), '[.,/#!?$%^&*;:{{}}=\\-_''\"´`~()]', '', 'g'))"
#: Edit distance there counts bytes, so the one letter without a decomposition is put as a byte of its own.
SIM = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein(replace({0}, 'ß', '~'), replace({1}, 'ß', '~')) / greatest(length({0}), length({1})) END"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a catalogue: the first six words are the name, the source is the category."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("name"), F.col("text").alias("content"), F.col("source").alias("category"), "lang")


BASE = "c AS (SELECT doc_id AS id, array_to_string(string_split(text, ' ')[1:6], ' ') AS name, text AS content, source AS category, lang FROM documents)"


def _form(x: str, spaces: bool = True) -> str:
    out = FORM.format(x)
    return out if spaces else f"regexp_replace({out}, '\\s+', '', 'g')"


def rank_sql(text: str, words: list[str]) -> str:
    long_words = [w for w in words if len(w) >= 3] or words
    flat, typed = "".join(words), "".join(w for w in words if len(w) > 2)
    cover = lambda c, ws: "(" + " + ".join(f"CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END" for w in ws) + f") / {len(ws)}.0"
    return f"""
WITH {BASE},
f AS (SELECT id, {_form("name", False)} AS flat, {_form("' ' || name")} AS title, {_form("content")} AS body FROM c WHERE category <> 'src3'),
p AS (SELECT *, {cover("title", words)} * 65 AS t, {cover("body", long_words)} * 35 AS b,
  least(3 * ((length(regexp_replace(body, '\\s+', '', 'g')) - length(replace(regexp_replace(body, '\\s+', '', 'g'), '{flat}', ''))) // {len(flat)}), 10) AS d,
  {SIM.format("flat", f"'{typed}'")} AS s FROM f),
r AS (SELECT id, CASE WHEN flat = '{flat}' OR starts_with(flat, '{flat}') THEN 100.0 WHEN t = 0 AND b = 0 AND d = 0 AND s < 0.7 THEN 0.0 ELSE t + b + s * 20 + d END AS raw FROM p),
q AS (SELECT id, CASE WHEN raw >= 100 AND raw <> 100 THEN 99.0 ELSE raw END AS m FROM r WHERE raw > 0)
SELECT id, round(m, 6) AS original_match, round(m / max(m) OVER () * 100, 6) AS match FROM q
"""


@query(rank_sql("onand the ered", ["onand", "the", "ered"]))
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = spark.createDataFrame([("src3",)], "category string")
    found = S.search(catalogue(spark, sf_dir), "Onand, the ered!", archived, keep=["id"])
    return found.select("id", F.round("original_match", 6).alias("original_match"), F.round("match", 6).alias("match"))


@query(f"""WITH {BASE}, f AS (SELECT id, {_form("' ' || name")} AS title, {_form("content")} AS body FROM c)
SELECT id, CASE WHEN contains(title, 'of the') THEN CAST(100 AS DOUBLE) ELSE 60 END AS score FROM f WHERE contains(title, 'of the') OR contains(body, 'of the')""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalogue(spark, sf_dir)
    return df.withColumn("score", S.score(df, '"Of the"')).where("score > 0").select("id", "score")


@query("""WITH f AS (SELECT p_partkey AS id, p_name, replace(p_name, ' ', '') AS flat FROM part),
s AS (SELECT *, ((CASE WHEN contains(p_name, 'blue') THEN 1 ELSE 0 END) + (CASE WHEN contains(p_name, 'r') THEN 1 ELSE 0 END)) / 2.0 * 65 AS cover, 1 - levenshtein(flat, 'blue') / greatest(length(flat), 4) AS sim FROM f)
SELECT id, round(CASE WHEN starts_with(flat, 'bluer') THEN 100 WHEN cover = 0 AND sim < 0.7 THEN 0 ELSE least(99, cover + 20 * sim) END, 6) AS score FROM s""")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return df.select("id", F.round(S.score(df, "BLUE r"), 6).alias("score"))


@query("""SELECT p_partkey AS id, round(1 - levenshtein(replace(p_name, ' ', ''), 'ring') / length(replace(p_name, ' ', '')), 6) AS similarity
FROM part WHERE contains(p_name, 'ring')""")
def closest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return S.closest(df, "Ring").select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {BASE},
w AS (SELECT id, 'name' AS field, list_filter(regexp_split_to_array({_form("name")}, '\\s+'), lambda x: x <> '') AS ws FROM c
  UNION ALL SELECT id, 'content', list_filter(regexp_split_to_array({_form("content")}, '\\s+'), lambda x: x <> '') FROM c),
g AS (SELECT id, field, 1 AS size, unnest(ws) AS term FROM w
  UNION ALL SELECT id, field, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT id, field, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
n AS (SELECT id, field, size, term, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT * FROM (VALUES ('that and the', 3, 1.0), ('that and', 2, 0.6 + 0.4 / 3), ('and the', 2, 0.6 + 0.4 / 3), ('that', 1, 0.5), ('and', 1, 0.5), ('the', 1, 0.5)) v(term, size, weight))
SELECT id, round(sum(CASE WHEN t.size > 1 THEN 20 * weight WHEN n.term = t.term THEN weight * CASE field WHEN 'name' THEN 3.0 ELSE 1.0 END + 0.5 * least(n, 5)
  ELSE 0.3 * weight * CASE field WHEN 'name' THEN 2.0 ELSE 0.5 END END), 6) AS score
FROM n JOIN t ON n.size = t.size AND (n.term = t.term OR t.size = 1 AND starts_with(n.term, t.term)) GROUP BY id""")
def phrase_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.index_search(S.postings(catalogue(spark, sf_dir), longest=3, query="that and the"), "that and the")
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {BASE}, w AS (SELECT id, unnest(list_filter(regexp_split_to_array({_form("name")}, '\\s+'), lambda x: x <> '')) AS term FROM c)
SELECT id, term, count(*) AS n FROM w GROUP BY id, term""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(catalogue(spark, sf_dir), longest=1).where("field = 'name'").select("id", "term", "n")


VERSES = "v AS (SELECT conv_id AS book, turn AS chapter, 1 AS verse, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM conversations)"


@query(f"""WITH {VERSES}, h AS (SELECT *, CASE WHEN list_contains(ws, 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(ws, 'of') THEN 1 ELSE 0 END AS hits FROM v)
SELECT book, chapter, hits, hits + CASE WHEN contains(lower(text), 'of the') THEN CAST(20 AS DOUBLE) ELSE 0 END AS score FROM h WHERE hits >= 2 ORDER BY score DESC, book, chapter LIMIT 50""")
def verse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    verses = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), F.lit(1).alias("verse"), "text")
    return S.verse_search(verses, "of the").select("book", "chapter", "hits", "score")


@query("""SELECT p_partkey AS id, CASE WHEN NOT contains(p_name, 'red') OR NOT contains(p_name, 'ring') THEN 0 ELSE 50 END AS score FROM part""")
def remote_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.remote_score(F.col("p_name"), "Red ring").alias("score"))


@query("""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'the') AS pos FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN pos = 0 THEN '' ELSE (CASE WHEN pos > 31 THEN '...' ELSE '' END) || substr(text, greatest(pos - 30, 1), least(pos + 52, length(text)) - greatest(pos - 30, 1) + 1) || (CASE WHEN pos + 52 < length(text) THEN '...' ELSE '' END) END AS snippet FROM p""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select("doc_id", T.snippet(F.col("text"), F.lit("The")).alias("snippet"))


@query("""SELECT p_partkey AS id, regexp_replace(p_name, '(ring|red)', '<mark>\\1</mark>', 'g') AS name FROM part""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.highlight(F.col("p_name"), "ring red").alias("name"))


@query("""WITH s AS (SELECT 'part' AS type, CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, p_name AS name, replace(lower(p_name), ' ', '') AS f FROM part
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_suppkey, s_name, replace(lower(s_name), ' ', '') FROM supplier
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_nationkey, n_name, replace(lower(n_name), ' ', '') FROM nation),
r AS (SELECT *, 1 - levenshtein(f, 'on') / greatest(length(f), 2) AS sim FROM s WHERE contains(f, 'on'))
SELECT type, id, name, round(sim, 6) AS similarity FROM r QUALIFY row_number() OVER (PARTITION BY type ORDER BY sim DESC, k) <= 5""")
def quick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t, i, n: table(spark, sf_dir, t).select(F.col(i).alias("id"), F.col(n).alias("name"))
    return S.federated({"part": of("part", "p_partkey", "p_name"), "supplier": of("supplier", "s_suppkey", "s_name"), "nation": of("nation", "n_nationkey", "n_name")}, "ON")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#0000001') OR contains(lower(c_mktsegment), '#0000001')")
def panel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.panel_filter(table(spark, sf_dir, "customer"), " #0000001", "c_name", "c_mktsegment").select("c_custkey", "c_name")


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS n, [string_split(p_name, ' ')[1]] AS o FROM part)
SELECT p_partkey, list_has_all(n, o) AS own, list_has_all(n, ['red']) AS red FROM t""")
def query_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.is_refinement(words, F.slice(words, 1, 1)).alias("own"), S.is_refinement(words, F.array(F.lit("red"))).alias("red"))

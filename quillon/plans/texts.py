"""Text, JSON, condition and template queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.operators import conditions as K
from quillon.operators import texts as X
from quillon.plans.registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))


L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)"


@query("""WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM t)
SELECT conv_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS ordinal, unnest(s) AS section FROM s""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.documents import text_of

    whole = text_of(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", "\n\n")
    return X.sections(whole, "conv_id", "text")


@query(f"WITH {L} SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(min(ordinal) OVER (PARTITION BY doc_id, line) AS INT) AS first FROM l")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deduped(_lines(spark, sf_dir), "doc_id", "ordinal", "line").select("doc_id", "ordinal", "first")


#: Parts as sections, forty to a document: labelled, short, repetitive, unlike any other, and alike.
SECTIONS = """t AS (SELECT p_partkey, p_partkey // 40 AS doc, CASE p_size % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '[Verse]' ELSE '[Chorus]' END || chr(10) || p_name WHEN 1 THEN p_name
  WHEN 2 THEN repeat(p_name || ' and all of it once more' || chr(10), 3) WHEN 3 THEN sha256(CAST(p_partkey AS VARCHAR)) ELSE p_name || ' ' || p_type || ' for everyone who sings along' END AS x, p_size % 5 AS kind FROM part),
u AS (SELECT doc, lower(x) AS l, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT a.doc, a.l, sum(CASE WHEN a.l = b.l THEN b.n - 1 ELSE b.n END) AS n_similar FROM u a JOIN u b ON a.doc = b.doc WHERE 1 - levenshtein(a.l, b.l) / greatest(length(a.l), length(b.l)) >= 0.7 GROUP BY ALL)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind, key = F.col("p_name"), F.col("p_size") % 5, F.col("p_partkey")
    label = F.concat(F.when(key % 2 == 0, "[Verse]").otherwise("[Chorus]"), F.lit("\n"), name)
    again = F.repeat(F.concat(name, F.lit(" and all of it once more\n")), F.lit(3))
    alike = F.concat_ws(" ", name, "p_type", F.lit("for everyone who sings along"))
    text = F.when(kind == 0, label).when(kind == 1, name).when(kind == 2, again).when(kind == 3, F.sha2(key.cast("string"), 256)).otherwise(alike)
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(key / 40).alias("doc"), text.alias("text"))


@query(f"WITH {SECTIONS} SELECT p_partkey, CAST(n_similar AS BIGINT) AS n_similar FROM t JOIN m ON t.doc = m.doc AND lower(x) = l")
def near_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.near_sections(_sections(spark, sf_dir), "doc", "text").select("p_partkey", "n_similar")


@query(f"""WITH {SECTIONS} SELECT p_partkey, CASE WHEN kind = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'verse' ELSE 'chorus' END WHEN kind IN (1, 2) THEN 'tag' WHEN n_similar > 0 THEN 'chorus' ELSE 'verse' END AS "group"
FROM t JOIN m ON t.doc = m.doc AND lower(x) = l""")
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.classified(_sections(spark, sf_dir), "doc", "text").select("p_partkey", "group")


@query(f"""WITH {L}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, ordinal) AS k FROM l), n AS (SELECT doc_id, ordinal, line, unnest(range(0, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END)) AS copy FROM r)
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(copy AS INT) AS copy, trim(line, ' ') AS line FROM n""")
def repeat_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("line", F.lit(" x3"))).otherwise(F.col("line"))
    return X.expanded_repeats(_lines(spark, sf_dir).withColumn("line", marked), "doc_id", "ordinal", "line")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations), e AS (SELECT conv_id, turn, len(ws) AS n FROM w)
SELECT conv_id, turn, CAST(n AS INT) AS words FROM e""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapping to one character a line gives a line a character; to a very long one, one line: both bounds are checked in tests."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))


#: Greedy wrapping to 40 characters as a fold over the words.
WRAPPED = """w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations),
f AS (SELECT conv_id, turn, list_reduce(list_prepend({'lines': 0, 'at': 0}, list_transform(ws, lambda x: {'lines': 0, 'at': CAST(length(x) AS INT)})),
  lambda s, x: CASE WHEN s['at'] > 0 AND s['at'] + 1 + x['at'] <= 40 THEN {'lines': s['lines'], 'at': CAST(s['at'] + 1 + x['at'] AS INT)}
    ELSE {'lines': CAST(s['lines'] + ceil(x['at'] / 40.0) AS INT), 'at': CAST(x['at'] - (ceil(x['at'] / 40.0) - 1) * 40 AS INT)} END)['lines'] AS lines FROM w)"""


@query(f"WITH {WRAPPED} SELECT conv_id, turn, lines FROM f")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.wrapped_lines(F.col("text"), 40).alias("lines"))


@query(f"""WITH {WRAPPED}, v AS (SELECT conv_id, list({{'turn': turn, 'lines': lines, 'used': 0, 'slide': -1, 'out': CAST([] AS INT[])}} ORDER BY turn, lines) AS v FROM f GROUP BY conv_id),
r AS (SELECT conv_id, v, list_reduce(list_prepend({{'turn': CAST(-1 AS INT), 'lines': 0, 'used': 0, 'slide': -1, 'out': CAST([] AS INT[])}}, v), lambda s, x: CASE WHEN s['slide'] >= 0 AND s['used'] + x['lines'] <= 12
  THEN {{'turn': x['turn'], 'lines': x['lines'], 'used': s['used'] + x['lines'], 'slide': s['slide'], 'out': list_append(s['out'], s['slide'])}}
  ELSE {{'turn': x['turn'], 'lines': x['lines'], 'used': x['lines'], 'slide': s['slide'] + 1, 'out': list_append(s['out'], s['slide'] + 1)}} END)['out'] AS slides FROM v),
u AS (SELECT conv_id, unnest(v) AS x, unnest(slides) AS slide FROM r) SELECT conv_id, x['turn'] AS turn, slide FROM u""")
def fitted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fitted_groups(wrapped_lines(spark, sf_dir), "conv_id", "turn", "lines", 12)


@query()
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = X.splitter(120)(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(pieces).alias("piece", "text"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_valid(props) AS valid FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), v.isNotNull().alias("valid"))


@query("""SELECT user_id, sum(value) AS total, greatest(max(value), 1) AS most, bool_and(value = 0) AS empty FROM (SELECT user_id, CAST(floor(value) AS DOUBLE) AS value FROM events) GROUP BY user_id""")
def chart_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(": ", "event_type", F.concat(F.floor("value").cast("string"), F.lit("%")))
    charts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("data"))
    each = charts.select("user_id", F.explode(X.chart_data(F.col("data"))).alias("r"))
    return each.groupBy("user_id").agg(F.sum("r.value").alias("total"), F.greatest(F.max("r.value"), F.lit(1.0)).alias("most"), F.bool_and(F.col("r.value") == 0).alias("empty"))


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) OR (contains(c_name, '77') AND c_mktsegment <> 'MACHINERY' AND c_acctbal < 1000)")
def condition_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = [
        [[[{"element": "segment", "value": "BUILDING"}, {"element": "balance", "operator": "isAbove", "value": "5000"}]]],
        [[[{"element": "text", "operator": "has", "value": "77"}]], [[{"element": "segment", "operator": "isNot", "value": "MACHINERY"}, {"element": "balance", "operator": "isBelow", "value": "1000"}]]],
    ]
    values = {"segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal"), "text": F.col("c_name")}
    return table(spark, sf_dir, "customer").where(K.condition(tree, values)).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice * (1 - l_discount) + 2.5) / l_quantity % 7, 6) AS result FROM lineitem")
def expression_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {n: F.col(f"l_{n}") for n in ("extendedprice", "discount", "quantity")}
    result = N.arithmetic("(extendedprice * (1 - discount) + 2.5) / quantity % 7", c)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(result, 6).alias("result"))


@query("SELECT p_partkey, p_name || ' by ' || CASE WHEN p_size > 25 THEN p_brand ELSE 'nobody' END || ' {other} ' || p_type || ' none' AS text FROM part")
def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") > 25, F.col("p_brand"))
    values = {"name": F.col("p_name"), "brand": brand, "list": [F.lit("x"), F.col("p_type")]}
    return table(spark, sf_dir, "part").select("p_partkey", K.fill(F.lit("{name} by {brand|nobody} {other} {list#1} {list#7|none}"), values).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice >= 1024 THEN CAST(round(p_retailprice / 1024, 2) AS VARCHAR) || ' KB' ELSE CAST(floor(p_retailprice) AS INT) || ' B' END AS bytes, CAST(floor(p_size / 2.0 + 0.5) AS BIGINT) AS half,
lower(replace(p_type, ' ', '_')) AS id, chr(CAST(97 + p_size % 26 AS INT)) AS letter FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.format_bytes(F.when(F.col("p_retailprice") >= 1024, F.col("p_retailprice")).otherwise(F.floor("p_retailprice"))).alias("bytes"), N.half_up(size / 2).alias("half"), T.variable_id(F.col("p_type")).alias("id"), T.part_letter(size % 26 + 1).alias("letter"))


@query("""SELECT p_partkey, '[' || ['A', 'A#', 'B', 'C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#'][p_partkey % 12 + 1] || 'm7/E] ' || p_name || ' [D]' AS text FROM part""")
def transpose_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = F.array(*map(F.lit, ("G", "Ab", "A", "Bb", "B", "C", "Db", "D", "Eb", "E", "F", "Gb")))
    line = F.concat(F.lit("["), F.get(roots, (F.col("p_partkey") % 12).cast("int")), F.lit("m7/D] "), F.col("p_name"), F.lit(" [C]"))
    return table(spark, sf_dir, "part").select("p_partkey", X.transpose(line, 2).alias("text"))


@query("SELECT s_suppkey, CAST(s_suppkey * 7 % 256 AS INT) AS red, CASE WHEN s_suppkey * 7 % 256 >= 128 THEN '#000000' ELSE '#FFFFFF' END AS contrast FROM supplier")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.lpad(F.lower(F.hex(F.col("s_suppkey") * 7 % 256)), 2, "0")
    colour = F.concat(F.lit("#"), grey, grey, grey)
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.hex_channel(colour, 0).alias("red"), N.contrast(colour).alias("contrast"))

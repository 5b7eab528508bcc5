"""Scores, order and normal forms, by the expected values of the fixtures."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import search as S

NAMES = [("amazing", "Amazing Grace", None), ("gracealone", "Grace Alone", None), ("great", "How Great Thou Art", None), ("mp", "Blessed Be", "MP133")]


def scores(spark, query, contents=None):
    rows = [(i, n, k, (contents or {}).get(i)) for i, n, k in NAMES]
    df = spark.createDataFrame(rows, "id string, name string, number string, content string")
    return {r.id: r.s for r in df.select("id", S.score(df, query).alias("s")).collect()}


@pytest.mark.parametrize(
    ("query", "row", "contents", "want"),
    [
        ("Amazing Grace", "amazing", {}, 100),
        ("amaz", "amazing", {}, 100),
        ("mp133", "mp", {}, 100),
        ("amazing", "great", {"great": "amazing love how can it be"}, 39.333333),
        ("xylophone", "amazing", {}, 0),
        ("", "amazing", {}, 0),
        ("!!!", "amazing", {}, 0),
        ("amazing grace", "gracealone", {}, 35.833333),
        ("grace", "amazing", {}, 73.333333),
        ("grace", "gracealone", {}, 100),
        ("everlasting portion", "great", {"great": "thou my everlasting portion more than friend or life to me"}, 42.444444),
        ("amzinggrace", "amazing", {}, 18.333333),
        ('"amazing grace"', "amazing", {}, 100),
        ('"amazing grace"', "gracealone", {}, 0),
        ('"amzing grace"', "amazing", {}, 0),
        ('"everlasting portion"', "great", {"great": "thou my everlasting portion more than friend"}, 60),
    ],
)
def test_scores(spark, query, row, contents, want):
    assert scores(spark, query, contents)[row] == pytest.approx(want, abs=1e-5)


def test_order_and_share_of_the_best(spark):
    df = spark.createDataFrame([(i, n, k, c) for (i, n, k), c in zip(NAMES, ["x", "y", "x", None], strict=True)], "id string, name string, number string, category string").withColumn("content", F.lit(""))
    got = {r.id: r for r in S.search(df, "grace").collect()}
    assert got["gracealone"].match == 100 and got["amazing"].match == pytest.approx(73.333333, abs=1e-5)
    hidden = spark.createDataFrame([("x",)], "category string")
    assert {r.id for r in S.search(df, "grace", hidden).collect()} == {"gracealone"}
    assert {r.id for r in S.search(df, "grace", hidden, "x").collect()} == {"amazing", "gracealone"}
    assert S.search(df, "kitchen").collect() == []
    assert [S.result_limit(x) for x in ("a", "a" * 16, "a" * 31)] == [None, 50, 30]


def test_normal_forms(spark):
    df = spark.createDataFrame([("Café, Réal!", "Amazing Grace", None, "well-known Ñandú ß")], "a string, b string, c string, d string")
    r = df.select(T.format_search(F.col("a")), T.format_search(F.col("b"), spaces=False), T.format_search(F.col("c")), T.format_search(F.col("d"))).first()
    assert tuple(r) == ("cafe real", "amazinggrace", "", "wellknown nandu ß")


def test_text_functions(spark):
    c = F.lit
    row = spark.range(1).select(
        T.similarity(c(""), c("")).alias("none"),
        T.similarity(c("kitten"), c("sitting")).alias("some"),
        T.occurrences(c("aaaa"), c("aa")).alias("twice"),
        T.label_id(c("[Verse 1] x3:")).alias("label"),
        T.file_name(c('a:b/c*"d"')).alias("file"),
        T.extension(c("http://x/y/Song.MP3?x=1")).alias("ext"),
        T.media_type(c("/a/b.webm")).alias("media"),
        T.format_bytes(c(1536)).alias("kb"),
        T.format_bytes(c(0)).alias("zero"),
        T.string_hash32(c("hello world")).alias("hash"),
        T.acronym(c("King James Version")).alias("kjv"),
        T.sanitize_verse(c("<q>Peace</q>&nbsp;be<br/>still  <i>now</i>")).alias("verse"),
        T.style_map(c("color: red; top:1px;color: blue")).alias("style"),
        T.highlight(c("Grace and grace"), "GRACE").alias("mark"),
        T.natural_key(c("Á10b")).alias("key"),
    ).first()
    assert row.none == 1 and row.some == pytest.approx(4 / 7) and row.twice == 2
    assert (row.label, row.file, row.ext, row.media) == ("verse", "a,bcd", "mp3", "video")
    assert (row.kb, row.zero, row.hash, row.kjv) == ("1.5 KB", "0 B", 1794106052, "KJV")
    assert row.verse == '"Peace" be still now' and row.style == {"top": "1px", "color": "blue"}
    assert row.mark == "<mark>Grace</mark> and <mark>grace</mark>" and row.key == "a00000000000000000010b"


def test_closest_with_aliases(spark):
    df = spark.createDataFrame([(1, "Genesis", ["Gen", "Gn"]), (2, "Exodus", None), (3, None, ["gene"])], "id int, name string, aliases array<string>")
    got = {r.id: (round(r.similarity, 4), r.alias_match) for r in S.closest(df, "gen", aliases="aliases").collect()}
    assert got == {1: (1.0, "Gen"), 3: (0.75, "gene")}

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import times as M
from quillon.operators import catalogue as C
from quillon.operators import conditions as K
from quillon.operators import documents as D
from quillon.operators import polls as P
from quillon.operators import texts as X
from quillon.operators import timelines as L


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rounding_and_times(spark):
    assert one(spark, N.half_up(F.lit(-2.5)), N.half_up(F.lit(2.5)), N.fahrenheit(F.lit(20.0)), N.fahrenheit(F.lit(21.3))) == (-2, 3, "68", "70.3")
    assert one(spark, M.join_time(F.lit(65)), M.join_time(F.lit(3661)), M.join_time(F.lit(90061)), M.last_two(F.lit(7)), M.last_two(F.lit(123))) == ("01:05", "01:01:01", "1, 01:01:01", "07", "23")
    assert one(spark, M.subtitle_time(F.lit(3723004)), M.until_clock(F.lit("18:30"), F.lit("2024-01-01 18:00:30").cast("timestamp"))) == ("01:02:03.004", 1770)
    assert one(spark, N.decibels(F.lit(0.0)), N.decibels(F.lit(1.0))) == (pytest.approx(-80), pytest.approx(0))


@pytest.mark.parametrize(("text", "want"), [("1 + 2 * 3", 7), ("-(4 - 6) / 4", 0.5), ("x % 4 + y", 5), ("2 * (x + 1)", 16), ("1 / 0", None)])
def test_arithmetic(spark, text, want):
    assert one(spark, N.arithmetic(text, {"x": F.lit(7.0), "y": F.lit(2.0)}))[0] == want


@pytest.mark.parametrize("text", ["1 +", "(1", "import os", "x.y", "1 2", "z", "__class__", "2 ** 3", ")", "a()"])
def test_arithmetic_refuses(spark, text):
    with pytest.raises(ValueError):
        N.arithmetic(text, {"x": F.lit(1)})


def test_conditions(spark):
    values = {"text": F.lit("Hello"), "n": F.lit("7"), "empty": F.lit(None), "clock": F.lit("3"), "clock.running": F.lit(True)}
    leaf = lambda **k: [[[[k]]]]
    cases = [
        (None, True), ([], False), ([[]], True), ({"values": []}, False), ({"values": [{"value": "Hello"}]}, True),
        (leaf(value="Hello"), True), (leaf(operator="isNot", value="Hello"), False), (leaf(operator="has", value="ell"), True),
        (leaf(operator="hasNot", value="ell"), False), (leaf(element="n", operator="isAbove", value="6.5"), True),
        (leaf(element="empty", operator="isBelow", value="1"), True), (leaf(operator="isAbove", value="1"), False),
        (leaf(element="timer", elementId="clock"), True), (leaf(operator="other"), True),
        ([[[[{"value": "no"}]], [[{"value": "Hello"}]]], [[[{"value": "Hello"}]]]], True),
    ]
    got = spark.range(1).select(*(K.condition(t, values).alias(f"c{k}") for k, (t, _) in enumerate(cases))).first()
    assert list(got) == [w for _, w in cases]


def test_tokens(spark):
    values = {"a.b": F.lit("$1 {x}"), "e": F.lit(""), "m": [F.lit("zero"), F.lit("one")], "n": F.lit(None).cast("string")}
    cases = {"{a.b}-{a.b}": "$1 {x}-$1 {x}", "{e}|{e|none}": "|none", "{m} {m#1} {m#2|two} {m#2}": "zero one two {m#2}", "{n|gone} {n} {q}": "gone {n} {q}", "": "", "aXb": "aXb"}
    for text, want in cases.items():
        assert one(spark, K.fill(F.lit(text), values)) == (want,)


def test_layouts_and_cache(spark):
    from quillon.operators.documents import SHOW

    item = lambda *lines: [("text", list(lines))]
    show = [("s1", "Name", "c", {}, [("a", "Verse", None, ["b"], item("One", "two")), ("b", "", None, None, item("Three"))], [("a", False), ("b", None), ("zz", None), ("a", True)])]
    df = spark.createDataFrame(show, SHOW)
    assert D.text_cache(df).first().content == "one two three"
    assert D.export_text(df).first().text == "[Verse]\nOne\ntwo\n\nThree"


def test_recurrences(spark):
    rows = [(1, dt.date(2024, 1, 31), "month", 1, 4, None), (2, dt.date(2024, 1, 1), "week", 2, None, dt.date(2024, 1, 29)), (3, dt.date(2024, 2, 29), "year", 1, 2, None), (4, dt.date(2024, 1, 5), "day", 3, None, dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id int, start date, unit string, every int, times int, until date")
    got = {}
    for r in L.recurrences(df, "start", "unit", "every", "times", "until").orderBy("id", "occurrence").collect():
        got.setdefault(r.id, []).append(str(r.date)[5:])
    assert got == {1: ["01-31", "02-29", "03-31", "04-30"], 2: ["01-01", "01-15", "01-29"], 3: ["02-29", "02-28"]}
    rule = one(spark, L.rrule(F.lit("RRULE:FREQ=WEEKLY;INTERVAL=2;UNTIL=20240301T000000Z;BYDAY=1MO")), L.rrule(F.lit("FREQ=DAILY")))
    assert tuple(rule[0]) == ("week", 2, None, dt.date(2024, 3, 1), "1MO") and tuple(rule[1]) == ("day", 1, 10, None, None)


def test_asof_ties_and_buckets(spark):
    t = lambda h, m=0, d=1: dt.datetime(2024, 1, d, h, m)
    left = spark.createDataFrame([(1, t(1), "a"), (1, t(5), "b"), (1, t(3, d=4), "c"), (2, t(1), "d")], "k int, ts timestamp, name string")
    right = spark.createDataFrame([(1, t(1), 10), (1, t(4), 11), (1, t(4), 12), (1, t(1, d=5), 13)], "k int, ts timestamp, v int")
    for bucket in (None, "1 day"):
        back = {r.name: r.v for r in L.asof(left, right, ["k"], "ts", ["v"], bucket=bucket).collect()}
        ahead = {r.name: r.v for r in L.asof(left, right, ["k"], "ts", ["v"], forward=True, bucket=bucket).collect()}
        assert back == {"a": 10, "b": 12, "c": 12, "d": None}
        assert ahead == {"a": 11, "b": 13, "c": 13, "d": None}


def test_polls(spark):
    answers = spark.createDataFrame([(1, "x", ["a"], 1000), (1, "y", ["a", "b"], 4000), (1, "y", ["a"], 9000), (1, "z", ["b"], 2000), (2, "x", ["b"], 0)], "question int, client string, value array<string>, time long")
    right = F.array_contains("value", "a")
    of = lambda df: {(r.question, r.client): r.points for r in df.collect()}
    assert of(P.points(answers, right)) == {(1, "x"): 1, (1, "y"): 1}
    assert of(P.points(answers, right, "falloff", 2)) == {(1, "x"): 2, (1, "y"): 1}
    assert of(P.points(answers, right, "speed")) == {(1, "x"): 100, (1, "y"): 90}
    options = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (3, "a")], "question int, option string")
    assert {(r.question, r.option): r.percent for r in P.percentages(answers, options).collect()} == {(1, "a"): 75, (1, "b"): 50, (1, "c"): 0, (3, "a"): 0}


def test_sections(spark):
    text = "[Verse]\nA first line of the song here\nsecond line\n\nSing along with all of us now\nevery day we live\n\nSing along with all of us now\nevery day we lived\n\nShort one\n\nChorus 2:\nx y z"
    rows = X.sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    got = [r.group for r in X.classified(rows, "id", "section").orderBy("ordinal").collect()]
    assert got == ["verse", "chorus", "chorus", "tag", "chorus"]
    lines = spark.createDataFrame([(1, 0, "hey x3"), (1, 1, ":/: twice :/:"), (1, 2, "once")], "id int, n int, line string")
    assert [r.line for r in X.expanded_repeats(lines, "id", "n", "line").orderBy("n", "copy").collect()] == ["hey"] * 3 + ["twice"] * 2 + ["once"]


def test_chords(spark):
    assert one(spark, X.transpose(F.lit("[C]a [F#m7/C#] [Bb] [Chorus] [E]"), 1))[0] == "[C#]a [Gm7/D] [B] [Chorus] [F]"
    assert one(spark, X.transpose(F.lit("[C] [F#] [Bbmaj7]"), -1))[0] == "[B] [F] [Amaj7]"
    assert one(spark, X.is_chord_line(F.lit("C  G/B   Am7 F#dim")), X.is_chord_line(F.lit("Come and go")), X.is_chord_line(F.lit(""))) == (True, False, False)


def test_wrapping(spark):
    assert one(spark, X.wrapped_lines(F.lit("aa bb cc"), 5), X.wrapped_lines(F.lit("abcdefghij k"), 4), X.wrapped_lines(F.lit(""), 4)) == (2, 3, 0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab []., \n", max_size=80), st.integers(5, 30))
def test_split_text_keeps_all_words(text, most):
    parts = X.split_text(text, most)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(len(p) <= most or not any(c.isspace() for c in p) for p in parts)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=12))
def test_islands_whatever_the_order(spark, numbers):
    df = spark.createDataFrame([(1, n) for n in numbers], "k int, n int").coalesce(1)
    text = D.islands(df, ["k"], "n").first().ranges
    back = {x for part in text.split("+") for a, _, b in [part.partition("-")] for x in range(int(a), int(b or a) + 1)}
    assert back == set(numbers)


def test_ranked_keeps_every_row_of_a_wide_table(spark):
    """Sorted partitions of uneven width are coalesced; places still run from 1 without a gap."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wide = spark.range(120_000).select((F.col("id") * 7919 % 120_011).alias("k"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), F.lit(900))).otherwise("y").alias("pad"))
        got = C.ranked(wide, F.col("k")).select("k", "rank", F.length("pad").alias("n")).orderBy("k").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 120_000
    assert (got["rank"].to_numpy() == range(1, 120_001)).all()

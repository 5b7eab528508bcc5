import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import storage
from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.operators import charts as C
from quillon.operators import shows as H
from quillon.operators import texts as X
from quillon.operators import timelines as L


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, _, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        storage.scratch(Session())


def test_stored_tables_are_dropped(spark):
    df = storage.store(spark.range(5))
    assert df.count() == 5
    storage.drop(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        storage.store(df)


def test_halves(spark):
    texts = ["One two, three four five", "no marks in here at all", "word", "", "a b", "Ends. middle half none here only words"]
    got = [one(spark, T.halves(F.lit(x)))[0] for x in texts]
    assert got[0] == ["One two,", "three four five"]
    assert got[1] == ["no marks in", "here at all"]
    assert got[2] == ["word"] and got[3] == [""] and got[4] == ["a", "b"]
    assert " ".join(got[5]) == texts[5]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9))
def test_broken_lines_keep_all_words(spark, words, most):
    line = " ".join(f"w{k}" for k in range(words))
    got = one(spark, T.broken_lines(F.lit(line), most))[0]
    assert " ".join(got) == line and all(len(x.split()) <= most for x in got)


def test_decorations(spark):
    cases = [("underline", "", True, "none"), ("overline", "underline", True, "overline underline"), ("underline", "", False, "underline"), (None, None, True, "none")]
    for template, own, keep, want in cases:
        assert one(spark, T.decorations(F.lit(template), F.lit(own), underline=keep))[0] == want


def test_equaliser_is_bounded(spark):
    band = lambda gain: F.struct(F.lit("peaking").alias("type"), F.lit(1000.0).alias("frequency"), F.lit(gain).alias("gain"), F.lit(1.0).alias("q"))
    assert one(spark, N.equaliser(F.array(band(25.0), band(25.0)), F.lit(1000.0)), N.equaliser(F.array(band(-25.0), band(-25.0)), F.lit(1000.0)), N.loudness_scale(F.lit(0))) == (30.0, -30.0, None)


def test_chords_over_lyrics(spark):
    lines = ["[Verse 1]", "C   G", "sing a song", "Am", "", "D", "  ", "more words here", "G", "[Chorus]", "plain line"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "d int, n int, line string")
    got = [r.line for r in C.merged_chords(df, ["d"], "n", "line").orderBy("n").collect()]
    assert got == ["[Verse 1]", "[C]sing[G] a song", "Am", "", "[D]more words here", "G", "[Chorus]", "plain line"]
    assert one(spark, X.is_chord_line(F.lit("")))[0] is False


def test_repeated_blocks(spark):
    rows = [(1, 0, "a", None, None), (1, 1, "b", 2, None), (1, 2, "c", None, 3), (1, 3, "d", None, 2), (1, 4, "e", 2, None), (2, 0, "x", 2, 2), (2, 1, "y", None, None)]
    df = spark.createDataFrame(rows, "s int, n int, line string, start int, end int")
    got = {}
    for r in C.repeated_blocks(df, ["s"], "n", "line", "start", "end").orderBy("s", "ordinal").collect():
        got[r.s] = got.get(r.s, "") + r.line
    assert got == {1: "abcbcbcdee", 2: "xxy"}


def test_read_actions(spark):
    shows = spark.createDataFrame([(1, "A", "x"), (2, "b", "y")], "id int, name string, category string")
    assert [r.id for r in H.read("get_show_by_name", {"shows": shows}, name="B").collect()] == [2]
    with pytest.raises(ValueError, match="unknown action"):
        H.read("drop_everything", {})


def test_narrowed(spark):
    before, every = spark.range(1), spark.range(2)
    assert H.narrowed(before, every, "the song", "the") is before
    assert H.narrowed(before, every, "song", "the") is every
    assert H.narrowed(before, every, "song", "") is every


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 400)), min_size=1, max_size=8), st.lists(st.integers(-5, 450), min_size=1, max_size=8))
def test_active_intervals_of_any_length(spark, spans, points):
    intervals = spark.createDataFrame([(1, k, float(a), float(a + n)) for k, (a, n) in enumerate(spans)], "u int, i int, a double, z double")
    at = spark.createDataFrame([(1, k, float(p)) for k, p in enumerate(points)], "u int, p int, at double")
    got = sorted((r.p, r.i) for r in L.active_at(at, intervals, ["u"], "at", "a", "z", 7.0).collect())
    assert got == sorted((k, i) for k, p in enumerate(points) for i, (a, n) in enumerate(spans) if a <= p < a + n)

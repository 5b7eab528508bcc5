import datetime as dt
import io
import sqlite3
import zipfile

from pyspark.sql import functions as F

from quillon.operators import documents as D
from quillon.sources import files as R
from quillon.sources import formats as A


def put(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def shown(df):
    return [(r.name, [(s.group, s["items"][0].lines) for s in r.slides]) for r in df.collect()]


def test_plain_text_and_chordpro(spark, tmp_path):
    path = put(tmp_path, song__txt="[Verse]\r\nOne\r\ntwo\r\n\r\n[Chorus]\r\nThree\r\n\r\nplain\r\n")
    df = A.plain_text(A.read_texts(spark, path))
    assert shown(df) == [("song", [("verse", ["One", "two"]), ("chorus", ["Three"]), ("verse", ["plain"])])]
    assert D.export_text(df).first().text == "[verse]\nOne\ntwo\n\n[chorus]\nThree\n\n[verse]\nplain"
    other = tmp_path / "b"
    other.mkdir()
    path = put(other, a__pro="{title: Song}\n{artist: X}\n# note\n[C]One [G]two\n\n{soc}\nSing\n{eoc}\nlast\n")
    df = A.chordpro(A.read_texts(spark, path))
    assert shown(df) == [("Song", [("verse", ["[C]One [G]two"]), ("chorus", ["Sing"]), ("verse", ["last"])])]
    assert df.first().meta["artist"] == "X"


def test_csv_keeps_empty_fields_and_quotes(spark, tmp_path):
    df = A.csv_show(A.read_texts(spark, put(tmp_path, a__csv='a,,c\n"x, ""y""",z\n"two\nlines",q')))
    assert [s[1] for s in shown(df)[0][1]] == [["a", "", "c"], ['x, "y"', "z"], ["two\nlines", "q"]]


def test_xml_songs(spark, tmp_path):
    xml = '<song xmlns="http://openlyrics.info/namespace/2009/song"><properties><titles><title>T</title></titles><authors><author>A</author><author>B</author></authors></properties><lyrics><verse name="v1"><lines>One<br/>two</lines></verse><verse name="c1"><lines>Sing</lines></verse></lyrics></song>'
    xml = xml.replace("name=", "name=")
    df = A.openlp_xml(A.read_texts(spark, put(tmp_path, a__xml=xml)))
    assert shown(df) == [("T", [("verse", ["One", "two"]), ("chorus", ["Sing"])])]
    assert df.first().meta == {"author": "A, B"}
    other = tmp_path / "o"
    other.mkdir()
    song = "<song><title>S</title><author>A</author><ccli>1</ccli><lyrics>[V1]\n.C  G\n One\n two\n[C]\n Sing\n</lyrics></song>"
    df = A.opensong_xml(A.read_texts(spark, put(other, a__xml=song)))
    assert shown(df) == [("S", [("verse", ["One", "two"]), ("chorus", ["Sing"])])]


def test_bibles(spark, tmp_path):
    texts = {
        "zefania": '<XMLBIBLE><BIBLEBOOK bnumber="1" bname="Genesis"><CHAPTER cnumber="1"><VERS vnumber="1">In the  beginning</VERS><VERS vnumber="2">And</VERS></CHAPTER></BIBLEBOOK></XMLBIBLE>',
        "beblia": '<bible><testament name="Old"><book number="1"><chapter number="1"><verse number="1">In the beginning</verse><verse number="2">And</verse></chapter></book></testament></bible>',
        "opensong_bible": '<bible><b n="Genesis"><c n="1"><v n="1">In the beginning</v><v n="2">And</v></c></b></bible>',
        "osis": '<osis><osisText><div type="book" osisID="Gen"><chapter osisID="Gen.1"><verse osisID="Gen.1.1">In the beginning</verse><verse osisID="Gen.1.2">And</verse></chapter></div></osisText></osis>',
        "json_bible": '{"name": "B", "books": [{"number": 1, "name": "Genesis", "chapters": [{"number": 1, "verses": [{"number": 1, "text": "In the beginning"}, {"number": 2, "text": "And"}]}]}]}',
    }
    for kind, text in texts.items():
        folder = tmp_path / kind
        folder.mkdir()
        files = A.read_texts(spark, put(folder, a__x=text))
        assert files.select(A.sniffed(F.col("content"))).first()[0] == kind
        got = [(r.book, r.chapter, r.verse, r.text) for r in A.ADAPTERS[kind](files).orderBy("verse").collect()]
        assert got == [(1, 1, 1, "In the beginning"), (1, 1, 2, "And")], kind


def test_json_documents_with_repair(spark, tmp_path):
    good = '["id1", {"name": "N", "category": null, "slides": {"a": {"group": "verse", "items": [{"type": "text", "lines": [{"text": [{"value": "One "}, {"value": "two"}]}]}]}}, "settings": {"activeLayout": "L"}, "layouts": {"L": {"name": "", "slides": [{"id": "a"}]}}}]'
    path = put(tmp_path, a__show=good, b__show=good.replace("id1", "id2") + 'junk}}]"', c__show="not json")
    shows, bad = A.shows_json(A.read_texts(spark, path))
    assert sorted(r.id for r in shows.collect()) == ["id1", "id2"]
    assert [r.content for r in bad.collect()] == ["not json"]
    assert {r.text for r in D.export_text(shows).collect()} == {"[verse]\nOne two"}


def test_calendar(spark, tmp_path):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:A long\r\n  name\r\nDTSTART;TZID=Europe/Oslo:20240101T120000\r\nDTEND:20240101T130000Z\r\nRRULE:FREQ=DAILY;COUNT=3\r\nEXDATE:20240102T000000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nSUMMARY:B\r\nDTSTART;VALUE=DATE:20240105\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    a, b = A.icalendar(A.read_texts(spark, put(tmp_path, a__ics=ics))).orderBy("uid").collect()
    assert (a.name, a.start, a.until, a.rule, a.exdates) == ("A long name", dt.datetime(2024, 1, 1, 11), dt.datetime(2024, 1, 1, 13), "FREQ=DAILY;COUNT=3", [dt.date(2024, 1, 2)])
    assert (b.name, b.start, b.until) == ("B", dt.datetime(2024, 1, 5), None)


def test_containers(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/b.txt", "text")
    base = sqlite3.connect(tmp_path / "songs.db")
    base.executescript("CREATE TABLE songs(id INT, title TEXT, lyrics TEXT); CREATE TABLE authors(id INT, display_name TEXT); CREATE TABLE authors_songs(author_id INT, song_id INT); INSERT INTO songs VALUES (1, 'T', 'L'), (2, 'U', NULL); INSERT INTO authors VALUES (1, 'A'), (2, 'B'); INSERT INTO authors_songs VALUES (2, 1), (1, 1);")
    base.commit()
    base.close()
    put(tmp_path, x__zip=held.getvalue(), y__zip=b"broken")
    files = R.binary(spark, str(tmp_path))
    zips = R.zip_entries(files.where("path like '%.zip'")).collect()
    assert [(r.entry, r.size, bytes(r.content)) for r in zips] == [("a/b.txt", 4, b"text")]
    rows = R.sqlite_rows(files.where("path like '%.db'"))
    assert {(r.title, tuple(r.authors)) for r in R.songs_with_authors(rows).collect()} == {("T", ("A", "B")), ("U", ())}
    assert {(r.files, r.size > 0) for r in A.backups(A.listing(spark, str(tmp_path))).collect()} == {(3, True)}


def test_decoding(spark):
    row = spark.range(1).select(R.decoded(F.lit(bytearray("Größe".encode("latin-1"))), "ISO-8859-1").alias("a"), R.rtf_text(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Gr\'f6\'dfe\par next\b  bold\b0}")).alias("b")).first()
    assert row.a == "Größe" and row.b == "Größe\nnext bold"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    R.write_texts(df, str(tmp_path / "t"))
    assert {(r.id, r.value) for r in spark.read.text(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "b")}
    R.write_documents(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    path = str(tmp_path / "v")
    assert [R.write_changed(x, path, "id") for x in (df, df, df.withColumn("text", F.when(F.col("id") == 1, "c").otherwise(F.col("text"))))] == [2, 0, 1]
    assert {(r.id, r.text) for r in R.latest_rows(spark.read.parquet(path), "id").collect()} == {(1, "c"), (2, "b")}
    archives = R.zipped(df.withColumn("archive", F.lit("z")), "archive", "text", "text").first()
    assert zipfile.ZipFile(io.BytesIO(archives.data)).namelist() == ["a", "b"]


def test_located(spark):
    missing = spark.createDataFrame([("/old/Song.MP3",), ("/old/x.png",)], "path string")
    files = spark.createDataFrame([("/a/b/song.mp3",), ("/a/song.mp3",)], "path string")
    assert {r.path: r.found for r in A.located(missing, files).collect()} == {"/old/Song.MP3": "/a/song.mp3", "/old/x.png": None}


def test_more_song_formats(spark, tmp_path):
    texts = {
        "quelea": ('<song><title>Q</title><author>A</author><lyrics><section title="Verse 1"><lyrics>One\ntwo</lyrics></section><section title="Chorus"><lyrics>Sing</lyrics></section></lyrics></song>', [("Q", [("verse", ["One", "two"]), ("chorus", ["Sing"])])]),
        "easyslides": ("<EasiSlides><Item><Title1>E</Title1><SongNumber>7</SongNumber><Contents>[1]\nOne\n[chorus]\nSing</Contents></Item><Item><Title1>F</Title1><SongNumber>0</SongNumber><Contents>Only</Contents></Item></EasiSlides>", [("E", [("verse", ["One"]), ("chorus", ["Sing"])]), ("F", [("verse", ["Only"])])]),
        "verseview": ("<songDB><song><name>V</name><author>A</author><slide><![CDATA[One<BR>two<slide>Three]]></slide><slide2></slide2></song></songDB>", [("V", [("", ["One", "two"]), ("", ["Three"])])]),
        "songbeamer": ("#LangCount=1\r\n#Title=S\r\n#Author=A=B\r\n---\r\nVerse 1\r\nOne\r\n--A\r\nplain\r\n", [("S", [("verse", ["One"]), ("verse", ["plain"])])]),
        "videopsalm": ('{Songs:[{Text:"P",Author:"A",Verses:[{Tag:1,Text:"Sing"},{Text:"One\\ntwo"}]}]}', [("P", [("chorus", ["Sing"]), ("verse", ["One", "two"])])]),
    }
    for kind, (text, want) in texts.items():
        folder = tmp_path / kind
        folder.mkdir()
        df = A.ADAPTERS[kind](A.read_texts(spark, put(folder, a__x=text)))
        assert sorted(shown(df)) == want, kind
        assert df.select("id").distinct().count() == len(want)

"""Format adapters over file contents made of the conversations (songs) and line items (Bibles), one file each.

A song's sections are the turns, two lines each; all adapters have to give back the same sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import query, table
from quillon.sources import formats as S

GROUPED = "CASE role WHEN 'user' THEN 'verse' ELSE 'chorus' END"
#: What every song adapter gives: name, slide, group, ordinal, line.
SONGS = """WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS slide FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)),
l AS (SELECT *, unnest(['line one of turn ' || turn || ' by ' || role, 'and another line of it']) AS line, unnest([0, 1]) AS ordinal FROM s)
SELECT 'Song ' || conv_id AS name, CAST(slide AS INT) AS slide, {} AS "group", CAST(ordinal AS INT) AS ordinal, line FROM l"""


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, title, path and parts: an ordered array of turn, role, first and second line."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    first = F.concat(F.lit("line one of turn "), F.col("turn").cast("string"), F.lit(" by "), F.col("role"))
    each = rows.select("conv_id", F.struct("turn", "role", first.alias("first"), F.lit("and another line of it").alias("second")).alias("p"))
    songs = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    title = F.concat(F.lit("Song "), F.col("conv_id").cast("string"))
    return songs.select("conv_id", title.alias("title"), F.concat(F.lit("songs/"), title, F.lit(".song")).alias("path"), "parts")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _joined(section: Callable[[Column], Column], between: str = "") -> Column:
    return F.array_join(F.transform("parts", section), between)


def _label(p: Column, user: str, other: str) -> Column:
    return F.when(p["role"] == "user", user).otherwise(other)


def _flat(shows: DataFrame) -> DataFrame:
    slides = shows.select("name", F.posexplode("slides").alias("slide", "s")).select("name", "slide", "s.group", F.posexplode(F.get("s.items", F.lit(0))["lines"]).alias("ordinal", "line"))
    return slides


def _read(spark: SparkSession, sf_dir: str, adapter: Callable[[DataFrame], DataFrame], content: Column) -> DataFrame:
    return _flat(adapter(_songs(spark, sf_dir).select("path", content.alias("content"))))


@query(SONGS.format(GROUPED))
def source_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text(_label(p, "[Verse]", "[Chorus]"), "\n", p["first"], "\n", p["second"]), "\n\n")
    return _read(spark, sf_dir, S.plain_text, body)


@query(SONGS.format(GROUPED))
def source_chordpro(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text(_label(p, "{start_of_verse}", "{start_of_chorus}"), "\n", p["first"], "\n", p["second"], "\n", _label(p, "{end_of_verse}", "{end_of_chorus}"), "\n"))
    return _read(spark, sf_dir, S.chordpro, _text("{title: ", F.col("title"), "}\n", body))


@query(SONGS.format("'verse'"))
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, S.csv_show, _joined(lambda p: _text('"', p["first"], '",', p["second"]), "\n"))


@query(SONGS.format(GROUPED))
def source_openlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text('<verse name="', _label(p, "v1", "c1"), '"><lines>', p["first"], "<br/>", p["second"], "</lines></verse>"))
    return _read(spark, sf_dir, S.openlp_xml, _text("<song><properties><titles><title>", F.col("title"), "</title></titles></properties><lyrics>", body, "</lyrics></song>"))


@query(SONGS.format(GROUPED))
def source_opensong(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text(_label(p, "[V1]", "[C]"), "\n.A  D\n ", p["first"], "\n ", p["second"], "\n"))
    return _read(spark, sf_dir, S.opensong_xml, _text("<song><title>", F.col("title"), "</title><lyrics>", body, "</lyrics></song>"))


@query(SONGS.format(GROUPED))
def source_quelea(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text('<section title="', _label(p, "Verse 1", "Chorus"), '"><lyrics>', p["first"], "\n", p["second"], "</lyrics></section>"))
    return _read(spark, sf_dir, S.quelea_xml, _text("<song><title>", F.col("title"), "</title><lyrics>", body, "</lyrics></song>"))


@query(SONGS.format(GROUPED))
def source_easyslides(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text(_label(p, "[1]", "[chorus]"), "\n", p["first"], "\n", p["second"], "\n"))
    return _read(spark, sf_dir, S.easyslides_xml, _text("<EasiSlides><Item><Title1>", F.col("title"), "</Title1><SongNumber>0</SongNumber><Contents>", body, "</Contents></Item></EasiSlides>"))


@query(SONGS.format("''"))
def source_verseview(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text(p["first"], "<BR>", p["second"]), "<slide>")
    return _read(spark, sf_dir, S.verseview_xml, _text("<songDB><song><name>", F.col("title"), "</name><slide><![CDATA[", body, "]]></slide></song></songDB>"))


@query(SONGS.format(GROUPED))
def source_songbeamer(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text("---\n", _label(p, "Verse 1", "Chorus"), "\n", p["first"], "\n", p["second"], "\n"))
    return _read(spark, sf_dir, S.songbeamer, _text("#LangCount=1\n#Title=", F.col("title"), "\n", body))


@query(SONGS.format(GROUPED))
def source_videopsalm(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(lambda p: _text('{Tag:"', _label(p, "0", "1"), '",Text:"', p["first"], "\\n", p["second"], '"}'), ",")
    return _read(spark, sf_dir, S.videopsalm, _text('{Songs:[{Text:"', F.col("title"), '",Verses:[', body, "]}]}"))


def _native(p: Column) -> Column:
    line = lambda c: F.struct(F.array(F.struct(c.alias("value"))).alias("text"))
    item = F.struct(F.lit("text").alias("type"), F.array(line(p["first"]), line(p["second"])).alias("lines"))
    return F.struct(_label(p, "verse", "chorus").alias("group"), F.lit("").alias("notes"), F.array(item).alias("items"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[id, document]`` JSON of each song."""
    songs = _songs(spark, sf_dir)
    ids = F.transform("parts", lambda p, k: F.format_string("s%04d", k))
    layout = F.create_map(F.lit("main"), F.struct(F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(False).alias("disabled"))).alias("slides")))
    doc = F.struct(F.col("title").alias("name"), F.map_from_arrays(ids, F.transform("parts", _native)).alias("slides"), layout.alias("layouts"), F.struct(F.lit("main").alias("activeLayout")).alias("settings"))
    return songs.select("path", _text('["', F.col("conv_id").cast("string"), '",', F.to_json(doc), "]").alias("content"))


@query(SONGS.format(GROUPED))
def source_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file ends in the rest of an older write and is repaired."""
    broken = F.when(F.crc32(F.col("path").cast("binary")) % 3 == 0, F.concat("content", F.lit('"main"}}]'))).otherwise(F.col("content"))
    good, _ = S.shows_json(_documents(spark, sf_dir).withColumn("content", broken))
    slides = good.select("name", F.array_sort("slides", lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1)).alias("slides"))
    return _flat(slides)


@query("SELECT DISTINCT 'songs/Song ' || conv_id || '.song' AS path, CASE WHEN conv_id % 3 = 0 THEN 'chordpro' WHEN conv_id % 3 = 1 THEN 'opensong' ELSE 'unknown' END AS kind FROM conversations")
def source_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 3
    content = F.when(kind == 0, _text("{title: ", F.col("title"), "}\nx")).when(kind == 1, _text("<song><title>", F.col("title"), "</title><lyrics> x</lyrics></song>")).otherwise("plain words")
    return _songs(spark, sf_dir).select("path", S.sniffed(content).alias("kind"))


@query("""SELECT 'event' || event_id AS uid, event_type AS name, date_trunc('second', ts) AS start, date_trunc('second', ts) + INTERVAL 1 HOUR AS until, 'FREQ=WEEKLY;COUNT=' || CAST(event_id % 5 + 1 AS VARCHAR) AS rule FROM events""")
def source_icalendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar for each user, with a folded line in every event."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    ts = F.date_trunc("second", "ts")
    event = _text("BEGIN:VEVENT\r\nUID:ev\r\n ent", F.col("event_id").cast("string"), "\r\nSUMMARY:", F.col("event_type"), "\r\nDTSTART:", stamp(ts), "\r\nDTEND:", stamp(ts + F.expr("interval 1 hour")), "\r\nRRULE:FREQ=WEEKLY;COUNT=", (F.col("event_id") % 5 + 1).cast("string"), "\r\nEND:VEVENT\r\n")
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(event), "").alias("events"))
    calendars = files.select(F.col("user_id").cast("string").alias("path"), _text("BEGIN:VCALENDAR\r\n", F.col("events"), "END:VCALENDAR\r\n").alias("content"))
    return S.icalendar(calendars).select("uid", "name", "start", "until", "rule")


#: What every Bible adapter gives.
VERSES = "SELECT DISTINCT 'bibles/' || l_suppkey || '.xml' AS path, l_linenumber AS chapter, CAST(l_partkey % 50 + 1 AS INT) AS verse, 'Verse ' || l_linenumber || ':' || (l_partkey % 50 + 1) AS text FROM lineitem"


def _bibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and chapters: an ordered array of number and an ordered array of verse number and text."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("c"), (F.col("l_partkey") % 50 + 1).alias("v")).distinct()
    text = F.concat(F.lit("Verse "), F.col("c").cast("string"), F.lit(":"), F.col("v").cast("string"))
    chapters = items.groupBy("b", "c").agg(F.array_sort(F.collect_list(F.struct(F.col("v").alias("n"), text.alias("text")))).alias("verses"))
    books = chapters.groupBy("b").agg(F.array_sort(F.collect_list(F.struct(F.col("c").alias("n"), "verses"))).alias("chapters"))
    return books.select("b", F.concat(F.lit("bibles/"), F.col("b").cast("string"), F.lit(".xml")).alias("path"), "chapters")


def _bible(spark: SparkSession, sf_dir: str, adapter: Callable[[DataFrame], DataFrame], chapter: tuple[str, str, str], verse: tuple[str, str, str], around: tuple[str, str], between: str = "", numbered: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``chapter`` and ``verse``: what stands before the number, before the content and behind it."""
    number = numbered or (lambda c, v: v["n"].cast("string"))
    verses = lambda c: F.array_join(F.transform(c["verses"], lambda v: _text(verse[0], number(c, v), verse[1], v["text"], verse[2])), between)
    chapters = F.array_join(F.transform("chapters", lambda c: _text(chapter[0], c["n"].cast("string"), chapter[1], verses(c), chapter[2])), between)
    files = _bibles(spark, sf_dir).select("path", _text(around[0], chapters, around[1]).alias("content"))
    return adapter(files).select("path", "chapter", "verse", "text")


@query(VERSES)
def source_zefania(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bible(spark, sf_dir, S.zefania_xml, ('<CHAPTER cnumber="', '">', "</CHAPTER>"), ('<VERS vnumber="', '">', "</VERS>"), ('<XMLBIBLE><BIBLEBOOK bnumber="1" bname="Genesis">', "</BIBLEBOOK></XMLBIBLE>"))


@query(VERSES)
def source_opensong_bible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bible(spark, sf_dir, S.opensong_bible, ('<c n="', '">', "</c>"), ('<v n="', '">', "</v>"), ('<bible><b n="Genesis">', "</b></bible>"))


@query(VERSES)
def source_beblia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bible(spark, sf_dir, S.beblia_xml, ('<chapter number="', '">', "</chapter>"), ('<verse number="', '">', "</verse>"), ('<bible><testament name="Old"><book number="1">', "</book></testament></bible>"))


@query(VERSES)
def source_osis(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c, v: _text("Gen.", c["n"].cast("string"), ".", v["n"].cast("string"))
    return _bible(spark, sf_dir, S.osis_xml, ('<chapter osisID="Gen.', '">', "</chapter>"), ('<verse osisID="', '">', "</verse>"), ('<osis><osisText><div type="book" osisID="Gen">', "</div></osisText></osis>"), numbered=place)


@query(VERSES)
def source_json_bible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bible(spark, sf_dir, S.json_bible, ('{"number":', ',"verses":[', "]}"), ('{"number":', ',"text":"', '"}'), ('{"name":"x","books":[{"number":1,"name":"Genesis","chapters":[', "]}]}"), between=",")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS path, c_name AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer")
def source_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("c_name", "c_custkey")))
    stores = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.to_json(entries).alias("content"))
    return S.key_values(stores)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def source_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("store/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), "c_custkey", "c_name")
    return S.point(files, "77.json").select("c_custkey", "c_name")


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INT) AS place, role || ' ' || turn AS title, 'said in turn ' || turn AS description, 'http://x/' || conv_id || '/' || turn AS link FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def source_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda p: p["turn"].cast("string")
    items = _joined(lambda p: _text("<item><title>", p["role"], " ", turn(p), "</title><description><![CDATA[<p>said in <b>turn</b> ", turn(p), "</p>]]></description><link>http://x/", F.col("conv_id").cast("string"), "/", turn(p), "</link></item>"))
    feeds = _songs(spark, sf_dir).select(F.col("conv_id").cast("string").alias("path"), _text('<rss version="2.0"><channel><title>t</title>', items, "</channel></rss>").alias("content"))
    return S.rss_items(feeds)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS project, 'Order ' || l_orderkey AS name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS place, CAST(l_partkey AS VARCHAR) AS id,
CASE WHEN l_returnflag = 'R' THEN 'section' ELSE 'show' END AS type, l_returnflag AS item_name FROM lineitem""")
def source_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").cast("string").alias("id"), F.when(F.col("l_returnflag") == "R", "section").alias("type"), F.col("l_returnflag").alias("name"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    key = F.col("l_orderkey").cast("string")
    project = F.struct(F.struct(_text("Order ", key).alias("name"), F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["type"].alias("type"), i["name"].alias("name"))).alias("shows")).alias("project"))
    return S.projects_json(rows.select(_text("projects/", key, ".project").alias("path"), F.to_json(project).alias("content")))


@query("""WITH f AS (SELECT '/media/' || p_size || '/' || replace(p_name, ' ', '_') || '.MP3' AS path, replace(p_name, ' ', '_') || '.mp3' AS n FROM part),
b AS (SELECT n, arg_min(path, (length(path), path)) AS found FROM f GROUP BY n)
SELECT '/old/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.mp3' AS path, found FROM part LEFT JOIN b ON n = replace(p_name, ' ', '_') || '.mp3'""")
def source_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files that were moved, by name whatever its case: the shortest path."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    part = table(spark, sf_dir, "part")
    missing = part.select(_text("/old/", F.col("p_partkey").cast("string"), "/", name, ".mp3").alias("path"))
    return S.located(missing, part.select(_text("/media/", F.col("p_size").cast("string"), "/", name, ".MP3").alias("path")))


@query("SELECT event_type AS folder, CAST(sum(event_id) AS BIGINT) AS size, count(*) AS files FROM events GROUP BY event_type")
def source_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select(_text("/backups/", F.col("event_type"), "/", F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("length"))
    return S.backups(files)


def _shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shows_json(_documents(spark, sf_dir))[0]


@query(f"WITH f AS ({SONGS.format(GROUPED)}), s AS (SELECT name, slide, any_value(\"group\") AS g, string_agg(line, chr(10) ORDER BY ordinal) AS t FROM f GROUP BY name, slide) SELECT name, string_agg('[' || g || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY slide) AS text FROM s GROUP BY name")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import documents as D

    shows = _shows(spark, sf_dir)
    return D.export_text(shows).join(shows.select("id", "name"), "id").select("name", "text")


@query(f"WITH f AS ({SONGS.format(GROUPED)}) SELECT substr(name, 6) AS id, lower(string_agg(line, ' ' ORDER BY slide, ordinal)) AS content FROM f GROUP BY name")
def text_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import documents as D

    ordered = F.array_sort("slides", lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1))
    return D.text_cache(_shows(spark, sf_dir).withColumn("slides", ordered))


def _rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of a database file as its reader gives them."""
    return df.select(F.lit("songs.sqlite").alias("path"), F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))


@query("""WITH a AS (SELECT l_partkey, string_agg(s_name, ',' ORDER BY l_suppkey, s_name) AS authors FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey)
SELECT CAST(p_partkey AS INT) AS id, p_name AS title, coalesce(authors, '') AS authors FROM part LEFT JOIN a ON l_partkey = p_partkey""")
def source_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources import files as R

    songs = _rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("lyrics")), "songs")
    links = _rows(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author_id"), F.col("l_partkey").alias("song_id")), "authors_songs")
    authors = _rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("display_name")), "authors")
    found = R.songs_with_authors(songs.unionByName(links).unionByName(authors))
    return found.select("id", "title", F.array_join("authors", ",").alias("authors"))


@query("SELECT o_orderkey AS song_id, o_orderpriority AS words, c_name AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0 WHERE true")
def source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words keep their row where the song is missing."""
    from quillon.sources import files as R

    songs = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("rowid"), F.col("c_name").alias("title"))
    words = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("song_id"), "o_orderkey", F.col("o_orderpriority").alias("words"))
    return R.songs_with_words(songs, words).select(F.col("o_orderkey").alias("song_id"), "words", "title")


@query("""SELECT o_orderkey, (SELECT string_agg('v' || n, ',' ORDER BY n) FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem WHERE l_orderkey = o_orderkey)) AS verses FROM orders""")
def source_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources import files as R

    verses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("Record"), F.col("l_linenumber").alias("Number")).distinct().withColumn("Text", F.concat(F.lit("v"), F.col("Number").cast("string")))
    songs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Record"))
    return R.verses_in_order(songs, verses).select(F.col("Record").alias("o_orderkey"), F.array_join("verses", ",").alias("verses"))


@query(f"WITH f AS ({SONGS.format(GROUPED)}) SELECT substr(name, 6) AS id, 's' || lpad(CAST(slide AS VARCHAR), 4, '0') AS slide, \"group\", line AS text FROM f WHERE slide IN (1, 3) AND ordinal = 1")
def slide_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second line of the first item of two slides."""
    from quillon.operators import documents as D

    slides = D.slides_of(_shows(spark, sf_dir), ["s0001", "s0003"])
    return D.item_lines(slides, [0], [1]).join(slides.select("id", "slide", "group"), ["id", "slide"]).select("id", "slide", "group", "text")


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, 'Song ' || conv_id AS name, CAST(conv_id % 90 AS VARCHAR) AS number, 1 AS kept FROM conversations")
def catalogue_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import documents as D

    meta = F.create_map(F.lit("number"), (F.col("id").cast("long") % 90).cast("string"), F.lit("author"), F.lit("someone"))
    shows = _shows(spark, sf_dir).withColumn("meta", meta)
    return D.trimmed(shows.withColumn("name", D.at_path("name"))).select("id", "name", D.at_path("quick.number").alias("number"), F.size("quick").alias("kept"))

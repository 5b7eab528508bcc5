"""Format adapters: files of many kinds to the nested document schema, or to verse rows.

Whole-file formats are read with ``wholetext`` or ``binaryFile`` (one row a file, split over tasks by Spark); XML is
parsed by Spark's own ``from_xml``, JSON by ``from_json`` in permissive mode. Adapters take and give DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import sanitize_verse
from quillon.operators.texts import explicit_label


def read_texts(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """path, content of each file, in UTF-8 or another character set."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", charset or "UTF-8").alias("content"))


def listing(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """path, name, length, modificationTime of the files below a folder, without reading them; ``depth`` 0 is the folder itself."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if depth is None:
        return found
    base = path.rstrip("/").split("://")[-1].removeprefix("file:")
    return found.where(F.size(F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/")) - len([p for p in base.split("/") if p]) - 2 <= depth)


def backups(files: DataFrame) -> DataFrame:
    """folder, size, files of each folder."""
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.sum("length").alias("size"), F.count("*").alias("files"))


def repaired_json(text: Column) -> Column:
    """JSON cut behind the first ``}}]`` if more follows (what a broken write leaves behind)."""
    return F.when(F.instr(text, "}}]") > 0, F.concat(F.substring_index(text, "}}]", 1), F.lit("}}]"))).otherwise(text)


def shows_json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents from ``[id, document]`` files and the files that can't be parsed even after repair."""
    body = "struct<name:string,category:string,meta:map<string,string>,slides:map<string,struct<group:string,notes:string,children:array<string>,items:array<struct<type:string,lines:array<struct<text:array<struct<value:string>>>>>>>>,settings:struct<activeLayout:string>,layouts:map<string,struct<name:string,slides:array<struct<id:string,disabled:boolean>>>>>"
    text = F.when(F.try_parse_json("content").isNotNull(), F.col("content")).otherwise(repaired_json(F.col("content")))
    v = F.try_parse_json(text)
    parsed = files.withColumns({"id": F.try_variant_get(v, "$[0]", "string"), "doc": F.from_json(F.get_json_object(text, "$[1]"), body)})
    bad = parsed.where("id is null or doc is null").select("path", "content")
    line = lambda x: F.array_join(F.transform(x["text"], lambda t: F.coalesce(t["value"], F.lit(""))), "")
    item = lambda i: F.struct(i["type"].alias("type"), F.transform(i["lines"], line).alias("lines"))
    slide = lambda e: F.struct(e["key"].alias("id"), e["value"]["group"].alias("group"), e["value"]["notes"].alias("notes"), e["value"]["children"].alias("children"), F.transform(F.filter(e["value"]["items"], lambda i: i.isNotNull()), item).alias("items"))
    layout = F.element_at("doc.layouts", F.coalesce("doc.settings.activeLayout", F.element_at(F.map_keys("doc.layouts"), 1)))["slides"]
    good = parsed.where("id is not null and doc is not null").select("id", F.coalesce("doc.name", F.lit("")).alias("name"), "doc.category", F.coalesce("doc.meta", F.expr("cast(map() as map<string,string>)")).alias("meta"), F.transform(F.map_entries("doc.slides"), slide).alias("slides"), layout.alias("layout"))
    return good, bad


def _show(df: DataFrame, sections: Column, name: Column, meta: Column, category: str | None = None) -> DataFrame:
    """One document from an ordered array of struct(group, lines)."""
    def slide(s: Column, k: Column) -> Column:
        item = F.struct(F.lit("text").alias("type"), s["lines"].alias("lines"))
        return F.struct(k.cast("string").alias("id"), s["group"].alias("group"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("array<string>").alias("children"), F.array(item).alias("items"))

    slides = F.transform(sections, slide)
    layout = F.transform(slides, lambda s: F.struct(s["id"].alias("id"), F.lit(False).alias("disabled")))
    return df.select(F.md5("path").alias("id"), name.alias("name"), F.lit(category).cast("string").alias("category"), meta.alias("meta"), slides.alias("slides"), layout.alias("layout"))


def _stem() -> Column:
    return F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)


def _no_meta() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def plain_text(files: DataFrame) -> DataFrame:
    """Sections between blank lines; a first line that is a label names the group and goes."""
    bare = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.regexp_replace("content", r"\r\n?", "\n"), r"\n\s*\n"), bare), lambda s: s != "")

    def section(s: Column) -> Column:
        label = explicit_label(s)
        lines = F.split(s, "\n")
        return F.struct(F.coalesce(label, F.lit("verse")).alias("group"), F.when(label.isNotNull(), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines).alias("lines"))

    return _show(files, F.transform(parts, section), _stem(), _no_meta())


def chordpro(files: DataFrame) -> DataFrame:
    """ChordPro: ``{title: ..}`` and other directives to metadata, ``{soc}`` and the like to groups; chords stay in brackets."""
    lines = F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x))
    directive = r"^\{\s*([A-Za-z_]+)\s*:?\s*(.*?)\s*\}$"
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(directive) & F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.regexp_extract(x, directive, 1)), F.regexp_extract(x, directive, 2)))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["col1"]))
    meta = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(pairs, lambda p: p["col1"] == k), F.lit(0))["col2"]))
    group = lambda x: F.when(x.rlike(r"^\{(soc|start_of_chorus)"), "chorus").when(x.rlike(r"^\{(sob|start_of_bridge)"), "bridge").when(x.rlike(r"^\{(sov|start_of_verse)"), "verse")
    start = F.expr("cast(named_struct('group', 'verse', 'lines', array(), 'done', array()) as struct<group:string,lines:array<string>,done:array<struct<group:string,lines:array<string>>>>)")

    def step(s: Column, x: Column) -> Column:
        ends = (x == "") | group(x).isNotNull() | x.rlike(r"^\{(eoc|end_of_|eob|eov)")
        held = F.struct(s["group"].alias("group"), s["lines"].alias("lines"))
        done = F.when(ends & (F.size(s["lines"]) > 0), F.concat(s["done"], F.array(held))).otherwise(s["done"])
        kept = F.when(ends, F.array().cast("array<string>")).when(x.rlike(directive) | x.startswith("#"), s["lines"]).otherwise(F.concat(s["lines"], F.array(x)))
        return F.struct(F.coalesce(group(x), F.when(x.rlike(r"^\{(eoc|end_of_|eob|eov)"), "verse"), s["group"]).alias("group"), kept.alias("lines"), done.alias("done"))

    parts = F.aggregate(F.concat(lines, F.array(F.lit(""))), start, step)["done"]
    title = F.coalesce(F.element_at(meta, "title"), F.element_at(meta, "t"), _stem())
    return _show(files, parts, title, meta)


def csv_show(files: DataFrame) -> DataFrame:
    """A slide for each row, a line for each field; quoted fields may hold commas, quotes and line ends. Empty fields stay."""
    rows = F.regexp_extract_all(F.concat("content", F.lit("\n")), F.lit(r'((?:[^"\n]|"(?:[^"]|"")*")*)\r?\n'), F.lit(1))
    field = lambda f: F.when(f.startswith('"'), F.replace(F.regexp_extract(f, r'(?s)^"(.*)"\s*$', 1), F.lit('""'), F.lit('"'))).otherwise(f)
    cells = lambda r: F.transform(F.regexp_extract_all(F.concat(r, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^,"])*),'), F.lit(1)), field)
    parts = F.transform(F.filter(rows, lambda r: F.trim(r) != ""), lambda r: F.struct(F.lit("verse").alias("group"), cells(r).alias("lines")))
    return _show(files, parts, _stem(), _no_meta())


def openlp_xml(files: DataFrame) -> DataFrame:
    """OpenLyrics songs: titles, authors, verses with names such as v1 and c1; line breaks within lines."""
    schema = "properties struct<titles:struct<title:array<string>>,authors:struct<author:array<string>>>, lyrics struct<verse:array<struct<_name:string,lines:array<string>>>>"
    flat = F.regexp_replace(F.regexp_replace("content", r"<br\s*/>", "\n"), r"</?(?:tag|chord|comment)\b[^>]*>", "")
    doc = files.withColumn("x", F.from_xml(flat, schema))
    kind = lambda n: F.element_at(F.create_map(*map(F.lit, ("v", "verse", "c", "chorus", "b", "bridge", "p", "pre_chorus", "e", "ending", "i", "intro", "o", "outro"))), F.lower(F.substring(n, 1, 1)))
    parts = F.transform("x.lyrics.verse", lambda v: F.struct(F.coalesce(kind(v["_name"]), F.lit("verse")).alias("group"), F.flatten(F.transform(v["lines"], lambda t: F.split(F.trim(t), "\n"))).alias("lines")))
    meta = F.map_from_arrays(F.array(F.lit("author")), F.array(F.array_join(F.coalesce("x.properties.authors.author", F.array().cast("array<string>")), ", ")))
    return _show(doc, parts, F.coalesce(F.get("x.properties.titles.title", F.lit(0)), _stem()), meta)


def opensong_xml(files: DataFrame) -> DataFrame:
    """OpenSong songs: ``[V1]`` headers in one lyrics text; lines start with a space, chord lines with a dot."""
    doc = files.withColumn("x", F.from_xml("content", "title string, author string, ccli string, lyrics string", {"ignoreSurroundingSpaces": "false"}))
    blocks = F.filter(F.split("x.lyrics", r"(?m)^(?=\[)"), lambda b: F.trim(b) != "")
    code = lambda b: F.lower(F.regexp_extract(b, r"^\[([A-Za-z])", 1))
    kind = lambda b: F.coalesce(F.element_at(F.create_map(*map(F.lit, ("v", "verse", "c", "chorus", "b", "bridge", "p", "pre_chorus", "t", "tag"))), code(b)), F.lit("verse"))
    body = lambda b: F.transform(F.filter(F.split(b, r"\r?\n"), lambda x: ~x.rlike(r"^\s*(\[|\.|;|$)")), lambda x: F.trim(x))
    parts = F.filter(F.transform(blocks, lambda b: F.struct(kind(b).alias("group"), body(b).alias("lines"))), lambda s: F.size(s["lines"]) > 0)
    meta = F.map_from_arrays(F.array(F.lit("author"), F.lit("ccli")), F.array(F.coalesce("x.author", F.lit("")), F.coalesce("x.ccli", F.lit(""))))
    return _show(doc, parts, F.coalesce("x.title", _stem()), meta)


def _verses(rows: DataFrame, book: Column, name: Column, chapter: Column, verse: Column, text: Column) -> DataFrame:
    return rows.select("path", book.cast("int").alias("book"), name.alias("book_name"), chapter.cast("int").alias("chapter"), verse.cast("int").alias("verse"), sanitize_verse(text).alias("text"))


def _nested_verses(files: DataFrame, schema: str, books: str, name: str, chapters: str, number: str, verses: str, text: str, book_number: str | None) -> DataFrame:
    x = files.withColumn("x", F.from_xml("content", schema))
    b = x.select("path", F.posexplode(books).alias("bi", "b"))
    c = b.select("path", "bi", "b", F.explode(f"b.{chapters}").alias("c"))
    v = c.select("path", "bi", "b", "c", F.explode(f"c.{verses}").alias("v"))
    book = F.col(f"b.{book_number}") if book_number else F.col("bi") + 1
    label = F.col(f"b.{name}") if name else F.lit(None).cast("string")
    return _verses(v, book, label, F.col(f"c.{number}"), F.col(f"v.{number}"), F.col(f"v.{text}"))


def zefania_xml(files: DataFrame) -> DataFrame:
    schema = "BIBLEBOOK array<struct<_bnumber:int,_bname:string,CHAPTER:array<struct<_cnumber:int,VERS:array<struct<_vnumber:int,_VALUE:string>>>>>>"
    x = files.withColumn("x", F.from_xml("content", schema))
    v = x.select("path", F.explode("x.BIBLEBOOK").alias("b")).select("path", "b", F.explode("b.CHAPTER").alias("c")).select("path", "b", "c", F.explode("c.VERS").alias("v"))
    return _verses(v, F.col("b._bnumber"), F.col("b._bname"), F.col("c._cnumber"), F.col("v._vnumber"), F.col("v._VALUE"))


def opensong_bible(files: DataFrame) -> DataFrame:
    schema = "b array<struct<_n:string,c:array<struct<_n:int,v:array<struct<_n:int,_VALUE:string>>>>>>"
    return _nested_verses(files, schema, "x.b", "_n", "c", "_n", "v", "_VALUE", None)


def beblia_xml(files: DataFrame) -> DataFrame:
    schema = "testament array<struct<book:array<struct<_number:int,chapter:array<struct<_number:int,verse:array<struct<_number:int,_VALUE:string>>>>>>>>"
    x = files.withColumn("x", F.from_xml("content", schema)).select("path", F.explode("x.testament").alias("t"))
    v = x.select("path", F.explode("t.book").alias("b")).select("path", "b", F.explode("b.chapter").alias("c")).select("path", "b", "c", F.explode("c.verse").alias("v"))
    return _verses(v, F.col("b._number"), F.lit(None).cast("string"), F.col("c._number"), F.col("v._number"), F.col("v._VALUE"))


def osis_xml(files: DataFrame) -> DataFrame:
    """Verses with text of their own (not milestones); places come from osisIDs such as Gen.1.2."""
    schema = "osisText struct<div:array<struct<_osisID:string,chapter:array<struct<_osisID:string,verse:array<struct<_osisID:string,_VALUE:string>>>>>>>"
    x = files.withColumn("x", F.from_xml("content", schema))
    b = x.select("path", F.posexplode("x.osisText.div").alias("bi", "b"))
    v = b.select("path", "bi", "b", F.explode("b.chapter").alias("c")).select("path", "bi", "b", F.explode("c.verse").alias("v"))
    part = lambda k: F.get(F.split("v._osisID", r"\."), F.lit(k))
    return _verses(v, F.col("bi") + 1, F.col("b._osisID"), part(1), part(2), F.col("v._VALUE"))


def json_bible(files: DataFrame) -> DataFrame:
    schema = "name string, books array<struct<number:int,name:string,chapters:array<struct<number:int,verses:array<struct<number:int,text:string>>>>>>"
    x = files.withColumn("x", F.from_json("content", schema))
    v = x.select("path", F.explode("x.books").alias("b")).select("path", "b", F.explode("b.chapters").alias("c")).select("path", "b", "c", F.explode("c.verses").alias("v"))
    return _verses(v, F.col("b.number"), F.col("b.name"), F.col("c.number"), F.col("v.number"), F.col("v.text"))


def sniffed(content: Column) -> Column:
    """Kind of a Bible or song file by what it holds, the first that fits."""
    found = F.lit("unknown")
    marks = (("osis", "<osis"), ("zefania", "<XMLBIBLE"), ("beblia", "<testament"), ("opensong_bible", "<bible>"), ("openlyrics", "<song xmlns"), ("opensong", "<lyrics>"), ("icalendar", "BEGIN:VCALENDAR"), ("chordpro", "{title:"), ("sqlite", "SQLite format 3"))
    for name, mark in reversed(marks):
        found = F.when(F.contains(content, F.lit(mark)), name).otherwise(found)
    return F.when(content.rlike(r'^\s*\{[\s\S]*"books"\s*:'), "json_bible").otherwise(found)


#: Adapters by the kind that :func:`sniffed` gives.
ADAPTERS = {"openlyrics": openlp_xml, "opensong": opensong_xml, "chordpro": chordpro, "osis": osis_xml, "zefania": zefania_xml, "beblia": beblia_xml, "opensong_bible": opensong_bible, "json_bible": json_bible}


def icalendar(files: DataFrame) -> DataFrame:
    """path, uid, name, start, until, rule, exdates of each VEVENT. Folded lines are joined; times with a zone are
    turned to the session's, times in UTC too."""
    lines = F.filter(F.split(F.regexp_replace(F.regexp_replace("content", r"\r\n", "\n"), r"\n[ \t]", ""), "\n"), lambda x: x != "")
    blocks = F.slice(F.split(F.array_join(lines, "\n"), "BEGIN:VEVENT\n"), F.lit(2), F.lit(1 << 30))
    each = files.select("path", F.explode(blocks).alias("b")).withColumn("b", F.substring_index("b", "END:VEVENT", 1))
    get = lambda k: F.nullif(F.regexp_extract("b", rf"(?m)^{k}(?:;[^:\n]*)?:(.*)$", 1), F.lit(""))
    zone = lambda k: F.nullif(F.regexp_extract("b", rf"(?m)^{k};[^:\n]*TZID=([^;:\n]+)", 1), F.lit(""))

    def moment(k: str) -> Column:
        raw = get(k)
        local = F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
        return F.when(raw.endswith("Z"), F.to_utc_timestamp(local, F.lit("UTC"))).when(zone(k).isNotNull(), F.to_utc_timestamp(local, zone(k))).otherwise(local)

    exdates = F.transform(F.regexp_extract_all("b", F.lit(r"(?m)^EXDATE[^:\n]*:(\d{8})"), F.lit(1)), lambda d: F.to_date(d, "yyyyMMdd"))
    return each.select("path", get("UID").alias("uid"), get("SUMMARY").alias("name"), moment("DTSTART").alias("start"), moment("DTEND").alias("until"), get("RRULE").alias("rule"), exdates.alias("exdates"))


def located(missing: DataFrame, files: DataFrame) -> DataFrame:
    """Moved files by name: missing path with the shortest candidate of the same name, whatever its case."""
    name = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1))
    best = files.groupBy(name("path").alias("n")).agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("found"))
    return missing.withColumn("n", name("path")).join(best, "n", "left").drop("n")


def _titled(songs: DataFrame, title: Column, sections: Column, meta: Column, category: str) -> DataFrame:
    """Documents of files that hold many songs: ids come from the path and the song's place."""
    return _show(songs.withColumn("path", F.concat_ws("#", "path", F.col("place").cast("string"))), sections, title, meta, category)


def quelea_xml(files: DataFrame) -> DataFrame:
    """Quelea songs: sections with a title attribute, lines in one text."""
    schema = "title string, author string, ccli string, copyright string, year string, lyrics struct<section:array<struct<_title:string,lyrics:string>>>"
    doc = files.withColumn("x", F.from_xml("content", schema))
    lines = lambda s: F.filter(F.transform(F.split(s["lyrics"], "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform("x.lyrics.section", lambda s: F.struct(F.coalesce(explicit_label(s["_title"]), F.lit("verse")).alias("group"), lines(s).alias("lines")))
    keys = ("author", "ccli", "copyright", "year")
    meta = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.coalesce(f"x.{k}", F.lit("")) for k in keys)))
    return _show(doc, F.filter(parts, lambda p: F.size(p["lines"]) > 0), F.coalesce("x.title", _stem()), meta)


def easyslides_xml(files: DataFrame) -> DataFrame:
    """EasySlides: many items a file, sections in the contents under bracketed numbers or names."""
    schema = "Item array<struct<Title1:string,SongNumber:string,Contents:string>>"
    each = files.withColumn("x", F.from_xml("content", schema)).select("path", F.posexplode("x.Item").alias("place", "s"))
    blocks = F.filter(F.split("s.Contents", r"(?m)^\s*(?=\[)"), lambda b: F.trim(b) != "")
    name = lambda b: F.regexp_extract(b, r"^\[([^\]]*)\]", 1)
    body = lambda b: F.filter(F.transform(F.split(F.regexp_replace(b, r"^\[[^\]]*\]", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.filter(F.transform(blocks, lambda b: F.struct(F.coalesce(explicit_label(name(b)), F.lit("verse")).alias("group"), body(b).alias("lines"))), lambda p: F.size(p["lines"]) > 0)
    meta = F.when(F.coalesce(F.col("s.SongNumber").try_cast("int"), F.lit(0)) > 0, F.map_from_arrays(F.array(F.lit("number")), F.array("s.SongNumber"))).otherwise(_no_meta())
    return _titled(each, F.coalesce("s.Title1", F.lit("")), parts, meta, "Easyslides")


def verseview_xml(files: DataFrame) -> DataFrame:
    """VerseVIEW: many songs a file, slides divided by ``<slide>`` and lines by ``<BR>`` in two texts."""
    schema = "song array<struct<name:string,category:string,author:string,copyright:string,slide:string,slide2:string>>"
    each = files.withColumn("x", F.from_xml("content", schema)).select("path", F.posexplode("x.song").alias("place", "s"))
    cut = lambda c: F.split(F.coalesce(c, F.lit("")), "<slide>")
    lines = lambda t: F.filter(F.transform(F.split(t, r"(?i)<br\s*/?>"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.filter(F.transform(F.concat(cut(F.col("s.slide")), cut(F.col("s.slide2"))), lambda t: F.struct(F.lit("").alias("group"), lines(t).alias("lines"))), lambda p: F.size(p["lines"]) > 0)
    meta = F.map_from_arrays(F.array(F.lit("author"), F.lit("copyright")), F.array(F.coalesce("s.author", F.lit("")), F.coalesce("s.copyright", F.lit(""))))
    return _titled(each, F.coalesce("s.name", F.lit("")), parts, meta, "VerseVIEW")


def songbeamer(files: DataFrame) -> DataFrame:
    """SongBeamer: ``#Key=value`` lines, then sections divided by lines of three dashes or two with a letter."""
    text = F.regexp_replace("content", r"\r\n?", "\n")
    pairs = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#\w+=")), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^#(\w+)=", 1)), F.trim(F.regexp_extract(x, r"^#\w+=(.*)$", 1))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["col1"]))
    meta = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(pairs, lambda p: p["col1"] == k), F.lit(0))["col2"]))
    blocks = F.slice(F.split(text, r"(?m)^--[-A-Za-z]\s*$"), F.lit(2), F.lit(1 << 30))

    def section(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        label = explicit_label(F.get(lines, F.lit(0)))
        return F.struct(F.coalesce(label, F.lit("verse")).alias("group"), F.when(label.isNotNull(), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines).alias("lines"))

    parts = F.filter(F.transform(blocks, section), lambda p: F.size(p["lines"]) > 0)
    return _show(files, parts, F.coalesce(F.nullif(F.element_at(meta, "title"), F.lit("")), _stem()), meta)


def videopsalm(files: DataFrame) -> DataFrame:
    """VideoPsalm agendas: JSON whose keys have no quotes is put right, then songs and their verses are read."""
    quoted = F.regexp_replace(F.regexp_replace("content", "﻿", ""), r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    schema = "Songs array<struct<Text:string,Author:string,CCLI:string,Verses:array<struct<Tag:string,Text:string>>>>"
    each = files.withColumn("x", F.from_json(quoted, schema)).select("path", F.posexplode("x.Songs").alias("place", "s"))
    kind = lambda t: F.coalesce(F.element_at(F.create_map(*map(F.lit, ("1", "chorus", "2", "bridge"))), t), F.lit("verse"))
    parts = F.transform("s.Verses", lambda v: F.struct(kind(F.coalesce(v["Tag"], F.lit(""))).alias("group"), F.split(v["Text"], "\n").alias("lines")))
    meta = F.map_from_arrays(F.array(F.lit("author"), F.lit("ccli")), F.array(F.coalesce("s.Author", F.lit("")), F.coalesce("s.CCLI", F.lit(""))))
    return _titled(each, F.coalesce("s.Text", F.lit("")), parts, meta, "VideoPsalm")


ADAPTERS |= {"quelea": quelea_xml, "easyslides": easyslides_xml, "verseview": verseview_xml, "songbeamer": songbeamer, "videopsalm": videopsalm}


def key_values(files: DataFrame) -> DataFrame:
    """path, key, value (JSON or plain text) of store files that hold one JSON object; a file that can't be read has none."""
    return files.select("path", F.explode(F.from_json("content", "map<string,string>")).alias("key", "value"))


def point(files: DataFrame, name: str) -> DataFrame:
    """The file of a name alone; the filter reaches the listing, so no other content is read."""
    return files.where(F.col("path").endswith(f"/{name}"))


def rss_items(files: DataFrame) -> DataFrame:
    """path, place, title, description, link of a feed's items, in order; tags in descriptions go."""
    x = files.withColumn("x", F.from_xml("content", "channel struct<item:array<struct<title:string,description:string,link:string>>>"))
    items = x.select("path", F.posexplode("x.channel.item").alias("place", "i"))
    bare = F.trim(F.regexp_replace(F.coalesce("i.description", F.lit("")), "<[^>]*>", ""))
    return items.select("path", "place", F.coalesce("i.title", F.lit("")).alias("title"), bare.alias("description"), "i.link")


def projects_json(files: DataFrame) -> DataFrame:
    """project, name, place, id, type, item_name of the items of native projects: ``{project: {name, shows}}``."""
    schema = "project struct<name:string,shows:array<struct<id:string,type:string,name:string>>>"
    x = files.withColumn("x", F.from_json("content", schema))
    items = x.select("path", F.col("x.project.name").alias("name"), F.posexplode("x.project.shows").alias("place", "i"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return items.select(stem.alias("project"), "name", "place", "i.id", F.coalesce("i.type", F.lit("show")).alias("type"), F.col("i.name").alias("item_name"))

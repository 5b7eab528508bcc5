"""Readers and writers for containers: SQLite tables, zip archives, documents as files.

Containers come as rows of ``binaryFile``, so that any store Spark reads will do; a task holds one file at a time.
"""

from __future__ import annotations

import io
import json
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def zip_entries(files: DataFrame, contents: bool = True) -> DataFrame:
    """path, entry, size, modified, content (or null) of each file in zip archives; broken archives give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if not info.is_dir():
                        yield pd.DataFrame({"path": [path], "entry": [info.filename], "size": [info.file_size], "modified": [pd.Timestamp(*info.date_time)], "content": [archive.read(info) if contents else None]})

    return files.select("path", "content").mapInPandas(run, "path string, entry string, size long, modified timestamp_ntz, content binary")


def sqlite_rows(files: DataFrame) -> DataFrame:
    """path, table, row (JSON object) of every table of SQLite files. Bytes become hexadecimal text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                with tempfile.NamedTemporaryFile(suffix=".db") as held:
                    held.write(data)
                    held.flush()
                    base = sqlite3.connect(held.name)
                    base.row_factory = sqlite3.Row
                    for (name,) in base.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                        cursor = base.execute(f'SELECT * FROM "{name.replace(chr(34), chr(34) * 2)}"')
                        while rows := cursor.fetchmany(5000):
                            yield pd.DataFrame({"path": path, "table": name, "row": [json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in dict(r).items()}) for r in rows]})
                    base.close()

    return files.select("path", "content").mapInPandas(run, "path string, table string, row string")


def sqlite_table(rows: DataFrame, table: str, schema: str) -> DataFrame:
    return rows.where(F.col("table") == table).select("path", F.from_json("row", schema).alias("r")).select("path", "r.*")


def songs_with_authors(rows: DataFrame) -> DataFrame:
    """OpenLP databases: songs with their authors, in order of the author's number, or none."""
    songs = sqlite_table(rows, "songs", "id int, title string, lyrics string")
    links = sqlite_table(rows, "authors_songs", "author_id int, song_id int")
    authors = sqlite_table(rows, "authors", "id int, display_name string").withColumnRenamed("id", "author_id")
    named = links.join(authors, ["path", "author_id"]).groupBy("path", F.col("song_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("author_id", "display_name"))), lambda x: x["display_name"]).alias("authors"))
    return songs.join(named, ["path", "id"], "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def songs_with_words(songs: DataFrame, words: DataFrame) -> DataFrame:
    """EasyWorship: words by song, at most one a song (the first by its own order), songs without words kept out."""
    one = songs.groupBy("rowid").agg(F.min_by(F.struct(*[c for c in songs.columns if c != "rowid"]), F.lit(0)).alias("s"))
    return words.join(one, words["song_id"] == one["rowid"], "left").select(words["*"], "s.*")


def verses_in_order(songs: DataFrame, verses: DataFrame) -> DataFrame:
    """MediaShout: verses of a song joined in the order of their numbers."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("Number", "Text"))), lambda x: x["Text"])
    return songs.join(verses.groupBy("Record").agg(lines.alias("verses")), "Record", "left")


def decoded(content: Column, charset: str = "UTF-8") -> Column:
    return F.decode(content, charset)


def rtf_text(c: Column) -> Column:
    """Plain text of simple RTF: hex escapes are Latin-1, paragraphs are line ends, groups that only format go."""
    x = F.regexp_replace(c, r"\{\\\*?\\?(fonttbl|colortbl|stylesheet|info)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "")
    x = F.regexp_replace(x, r"\\par[d]?\b ?|\\line\b ?", "\n")
    pieces = F.split(F.regexp_replace(x, r"\\'([0-9a-fA-F]{2})", "\u0001$1"), "\u0001")
    hexed = F.transform(F.slice(pieces, F.lit(2), F.lit(1 << 30)), lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.substring(p, 3, 1 << 30)))
    x = F.concat(F.get(pieces, F.lit(0)), F.array_join(hexed, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\\[a-z]+-?\d* ?", ""), r"[{}]", ""))


# Sinks


def write_documents(df: DataFrame, path: str, key: str = "id") -> None:
    """A file of JSON for each document, in 256 folders by a hash of the key, so that the commit handles as many folders
    however many documents there are."""
    bucket = F.pmod(F.xxhash64(key), F.lit(256)).cast("int")
    df.withColumn("__k", bucket).write.partitionBy("__k").option("maxRecordsPerFile", 1).mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str) -> None:
    """One text for each row of (id, text), in folders by id."""
    df.select("id", F.col("text").alias("value")).write.partitionBy("id").mode("overwrite").text(path)


def write_changed(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose content differs from the latest version at ``path``; gives the number of rows written.

    Rows carry ``__hash`` and ``__version``; readers take the latest version of a key with :func:`latest_rows`."""
    spark = df.sparkSession
    hashed = df.withColumn("__hash", F.xxhash64(*[c for c in df.columns if c != key]))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    version = 0
    if there:
        old = spark.read.parquet(path)
        version = (old.agg(F.max("__version")).first()[0] or 0) + 1
        hashed = hashed.join(latest_rows(old, key, keep=True).select(key, "__hash"), [key, "__hash"], "left_anti")
    fresh = hashed.withColumn("__version", F.lit(version)).select(*df.columns, "__hash", "__version")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("__version") == version).count()


def latest_rows(df: DataFrame, key: str, keep: bool = False) -> DataFrame:
    columns = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*columns), "__version").alias("x")).select(key, "x.*")
    return out if keep else out.drop("__hash", "__version")


def zipped(df: DataFrame, archive: str, entry: str, content: str) -> DataFrame:
    """archive, data: a zip file for each value of ``archive`` from rows of (archive, entry, content as text)."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(frame[entry], frame[content], strict=True)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
        return pd.DataFrame({"archive": [str(frame[archive].iloc[0])], "data": [held.getvalue()]})

    return df.groupBy(archive).applyInPandas(pack, "archive string, data binary")

"""Line deduplication by content-defined chunks of lines.

Each line is hashed; a rolling hash over ``WINDOW`` line hashes ends a chunk where it is divisible by ``spread``.
Boundaries hang on the lines around them alone, so a passage is cut alike wherever it stands, whatever was put in
before it. Chunks of two lines or more that occur anywhere again are found by digest, compared byte by byte with
the first occurrence (smallest doc_id, then place), and removed, the first excepted.

All of it is column expressions. Digests are counted with partial sums, and only digests travel for that; the text
of chunks that do repeat is written once and met by joins whose large side adaptive execution may split, so a chunk
that a third of all documents share is no single task's. What is joined to the texts grows with the corpus, so those
joins are sort-merge joins at every size and never broadcast.

Defined results: a null text stays null and has no lines. Lines end at ``\\n`` only. Chunks of nothing but white
space stay. Single lines stay however often they occur. Rows that repeat a doc_id and text are one document and are
treated alike; a null doc_id sorts first. A document may end up empty; its row stays. Extra columns of any name pass
through, but those named as the columns that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop, store, unused

WINDOW = 2
ROOT = 31


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def wide_hash(line: Column) -> Column:
    """56 bits of the line's MD5; a rolling hash over ``WINDOW`` of them fits a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 14), 16, 10).cast("long")


def chunks_of(text: Column, spread: int) -> Column:
    """array<struct<k:int,n:int,chunk:string>> in order; ``n`` is the number of lines. Joined by line ends they are the text."""
    lines = F.split(text, "\n")

    def cut(lines_: Column, hashes: Column) -> Column:
        last = F.size(lines_)
        ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | ((i >= WINDOW) & ((F.get(hashes, i - 2) * ROOT + F.get(hashes, i - 1)) % spread == 0)))

        def chunk(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1) + 1)
            return F.struct(k.alias("k"), (end - start + 1).alias("n"), F.array_join(F.slice(lines_, start, end - start + 1), "\n").alias("chunk"))

        return F.transform(ends, chunk)

    both = F.struct(lines.alias("lines"), F.transform(lines, line_hash).alias("hashes"))
    return F.transform(F.array(both), lambda x: cut(x["lines"], x["hashes"]))[0]


def row_key() -> Column:
    """128 bits of what makes a row a document of its own: its id, whether it has one, and its text."""
    known = F.when(F.col("doc_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("doc_id").cast("string")))
    return F.unhex(F.md5(F.concat(known, F.lit("\n"), F.col("text")).cast("binary")))


def between(items: Column, ends: Column) -> Column:
    """``items`` but those at the places ``ends`` (sorted, from 1)."""
    edges = F.concat(ends, F.array(F.size(items) + 1))
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(edges, i - 1))
    return F.flatten(F.transform(edges, lambda end, i: F.slice(items, after(i) + 1, end - after(i) - 1)))


def dedupe(docs: DataFrame, spread: int = 3) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and three columns more: __lines, __removed_lines,
    __removed_chunks."""
    key, dk, lost = row_key(), unused(docs, "__key"), unused(docs, "__gone")
    rows = docs.where("text is not null").select("doc_id", key.alias("dk"), F.explode(chunks_of(F.col("text"), spread)).alias("c"))
    rows = rows.select("doc_id", "dk", "c.k", "c.n", "c.chunk").where((F.col("n") > 1) & F.col("chunk").rlike(r"\S"))
    rows = rows.withColumn("digest", F.md5(F.col("chunk").cast("binary")))
    place = F.struct("doc_id", "dk", "k")
    again = store(rows.groupBy("digest").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1"))
    found = store(rows.join(again.hint("merge"), "digest").select("digest", "doc_id", "dk", "k", "chunk", place.eqNullSafe(F.col("first")).alias("is_first")))
    first = store(found.where("is_first").groupBy("digest").agg(F.min("chunk").alias("first_chunk")))
    same = found.where("not is_first").join(first, "digest").where(F.col("chunk") == F.col("first_chunk"))
    gone = store(same.groupBy("dk").agg(F.array_sort(F.collect_set(F.col("k") + 1)).alias(lost)))
    out = docs.withColumn(dk, key).join(gone.withColumnRenamed("dk", dk).hint("merge"), dk, "left").drop(dk)
    kept = F.transform(F.array(chunks_of(F.col("text"), spread)), lambda x: between(x, F.col(lost)))[0]
    some = F.col(lost).isNotNull()
    left = unused(out, "__left")
    out = out.withColumn(left, F.when(some, F.transform(F.array(kept), lambda x: F.struct(F.array_join(F.transform(x, lambda c: c["chunk"]), "\n").alias("text"), F.aggregate(x, F.lit(0), lambda n, c: n + c["n"]).alias("n")))[0]))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.withColumns(
        {
            "__lines": lines.cast("long"),
            "__removed_lines": F.when(some, lines - F.col(f"{left}.n")).otherwise(0).cast("long"),
            "__removed_chunks": F.coalesce(F.size(lost), F.lit(0)).cast("long"),
            "text": F.when(some, F.col(f"{left}.text")).otherwise(F.col("text")),
        }
    ).drop(left, lost)


def rolled(hashes: Column, i: Column) -> Column:
    """The rolling hash over the ``WINDOW`` hashes that end at place ``i`` (from 1)."""
    return F.get(hashes, i - 2) * ROOT + F.get(hashes, i - 1)


def with_text(text: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use`` of the text's lines, the places of those with text (from 1) and the wide hash of each of these."""

    def places(lines: Column) -> Column:
        full = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike(r"\S"))
        both = F.transform(F.array(full), lambda x: F.struct(x.alias("full"), F.transform(x, lambda i: wide_hash(F.get(lines, i - 1))).alias("hashes")))
        return F.transform(both, lambda x: use(lines, x["full"], x["hashes"]))[0]

    return F.transform(F.array(F.split(text, "\n")), places)[0]


def passage_chunks(text: Column, spread: int) -> Column:
    """array<struct<k:int,upto:int,n:int,chunk:string>>: content-defined chunks of the lines with text, from place ``k`` to ``upto``
    (from 1), blank lines between included. A chunk begins with the line that ends the one before, so that each of the ``n``
    windows of two lines lies in one chunk."""

    def cut(lines: Column, full: Column, hashes: Column) -> Column:
        last = F.size(full)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i == last) | ((i >= WINDOW) & (rolled(hashes, i) % spread == 0)))

        def chunk(begin: Column, end: Column) -> Column:
            k, upto = F.get(full, begin - 1), F.get(full, end - 1)
            return F.struct(k.alias("k"), upto.alias("upto"), (end - begin).alias("n"), F.array_join(F.slice(lines, k, upto - k + 1), "\n").alias("chunk"))

        chunks = F.transform(F.array(ends), lambda x: F.transform(x, lambda end, c: chunk(F.when(c == 0, F.lit(1)).otherwise(F.get(x, c - 1)), end)))[0]
        return F.filter(chunks, lambda c: c["n"] > 0)

    return with_text(text, cut)


def windows(text: Column) -> Column:
    """array<struct<k:int,upto:int,roll:long,pair:string>>: each line with text, from ``k`` to the next such line ``upto`` (from 1),
    blank lines between included, with the rolling hash over both."""

    def each(lines: Column, full: Column, hashes: Column) -> Column:
        def window(j: Column, n: Column) -> Column:
            k = F.get(full, n)
            return F.struct(k.alias("k"), j.alias("upto"), rolled(hashes, n + 2).alias("roll"), F.array_join(F.slice(lines, k, j - k + 1), "\n").alias("pair"))

        return F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), window)

    return with_text(text, each)


def chunk_digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def without_passages(docs: DataFrame, spread: int = 3) -> DataFrame:
    """``docs`` with every passage of two lines or more with text that stood before (smaller doc_id, then place) taken
    out of ``text``, and a column more: __removed_lines.

    The texts are cut into chunks by the rolling hash over line hashes; chunks that occur again are found by digest, compared byte
    by byte with the first occurrence, and go as a whole. That alone misses passages within which no two boundaries fall. So the
    chunks that stay are opened: their windows of two lines are found by the same rolling hash, without the condition of being
    divisible, and those of equal hash are compared byte by byte. A chunk that goes need not be opened, as each of its windows
    stands in the first occurrence too. So a passage goes in full length wherever the boundaries fall.

    A line's first occurrence in the corpus always stays; of a line repeated in a row, two stay. Defined results are those of
    :func:`dedupe`, but that blank lines neither make nor break a passage.
    """
    key, dk, lost = row_key(), unused(docs, "__key"), unused(docs, "__gone")
    place = F.struct("doc_id", "dk", "k")
    is_first = place.eqNullSafe(F.col("first"))
    rows = docs.where("text is not null").select("doc_id", key.alias("dk"), F.explode(passage_chunks(F.col("text"), spread)).alias("c"))
    rows = store(rows.select("doc_id", "dk", "c.*").withColumn("digest", chunk_digest(F.col("chunk"))))
    again = store(rows.groupBy("digest").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times"))
    met = store(rows.join(again.hint("merge"), "digest", "left"))
    drop(rows, again)
    first = store(met.where(is_first).groupBy("digest").agg(F.min("chunk").alias("first_chunk")))
    told = met.where(F.col("first").isNotNull() & ~is_first).join(first.hint("merge"), "digest").withColumn("same", F.col("chunk") == F.col("first_chunk"))
    told = store(told.select("doc_id", "dk", "k", "upto", "n", "first", "same", F.when(~F.col("same"), F.col("chunk")).alias("chunk")))
    opened = met.where(F.col("first").isNull() | is_first).select("doc_id", "dk", "k", "chunk").unionByName(told.where("not same").select("doc_id", "dk", "k", "chunk"))
    pairs = opened.select("doc_id", "dk", F.col("k").alias("at"), F.explode(windows(F.col("chunk"))).alias("w"))
    pairs = store(pairs.select("doc_id", "dk", (F.col("at") + F.col("w.k") - 1).alias("k"), (F.col("at") + F.col("w.upto") - 1).alias("upto"), "w.roll", "w.pair"))
    drop(met, first)
    twice = store(pairs.groupBy("roll").agg(F.count("*").alias("times")).where("times > 1").drop("times"))
    found = store(pairs.join(twice.hint("merge"), "roll", "left_semi"))
    drop(pairs, twice)
    firsts = store(found.groupBy("roll", "pair").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times"))
    again = found.join(firsts.hint("merge"), ["roll", "pair"]).where(~is_first).select("doc_id", "dk", "k", "upto", F.lit(1).alias("n"), "first")
    # A window that overlaps its own first occurrence (a line repeated in a row) leaves that one whole. Of a chunk of more windows
    # no window does, whatever chunk it follows.
    first_upto = F.col("first.k") + F.col("upto") - F.col("k")
    own = (F.col("n") == 1) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.dk") == F.col("dk")) & (first_upto >= F.col("k"))
    lines = F.sequence(F.when(own, first_upto + 1).otherwise(F.col("k")), F.col("upto"))
    repeated = told.where("same").select(again.columns).unionByName(again)
    gone = store(repeated.groupBy("dk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lines)))).alias(lost)))
    drop(told, found, firsts)
    out = docs.withColumn(dk, key).join(gone.withColumnRenamed("dk", dk).hint("merge"), dk, "left").drop(dk)
    kept = F.array_join(F.transform(F.array(F.split("text", "\n")), lambda x: between(x, F.col(lost)))[0], "\n")
    some = F.col(lost).isNotNull()
    return out.withColumns({"__removed_lines": F.coalesce(F.size(lost), F.lit(0)).cast("long"), "text": F.when(some, kept).otherwise(F.col("text"))}).drop(lost)


def digest(docs: DataFrame, spread: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks (removed), kept_sha256 (of the text that stays; null: empty)."""
    out = dedupe(docs.select("doc_id", "text"), spread)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed_lines").alias("n_removed"), F.col("__removed_chunks").alias("n_chunks"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same by window functions: a line ends a chunk if the hash says so or it is the last.
ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
b AS (SELECT *, CASE WHEN i >= 2 AND (lag(h) OVER w * 31 + h) % 3 = 0 OR i = n_lines THEN 1 ELSE 0 END AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM g GROUP BY doc_id, k),
r AS (SELECT *, n > 1 AND regexp_matches(chunk, '\\S') AS multi, row_number() OVER (PARTITION BY chunk, n > 1 AND regexp_matches(chunk, '\\S') ORDER BY doc_id, k) AS nth FROM c),
f AS (SELECT *, multi AND nth > 1 AS gone FROM r)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
       count(*) FILTER (WHERE gone) AS n_chunks, sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

"""Verses: references, spans, search, parallel translations, splitting queries into book and text.

``verses``: book, chapter, verse, text (and translation). References are parsed on the driver, as a user types them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.documents import islands


@dataclass(frozen=True)
class Span:
    """Verses from (chapter, verse) to (chapter, verse), both included; None is the chapter's first or last verse."""

    chapter: int
    verse: int | None
    last_chapter: int
    last_verse: int | None


_PART = re.compile(r"^(?:(\d+)\s*[:.]\s*)?(\d+)(?:\s*-\s*(?:(\d+)\s*[:.]\s*)?(\d+))?$")


def parse_reference(text: str) -> list[Span]:
    """``1:1-12;2:1-10``, ``1:5-2:3``, ``3:1,4,6-8`` and whole chapters such as ``4`` or ``4-5``."""
    spans, chapter = [], None
    for group in re.split(r";", text):
        for part in group.split(","):
            m = _PART.match(part.strip())
            if not m:
                raise ValueError(f"not a reference: {part!r}")
            a, b, c, d = (int(x) if x else None for x in m.groups())
            if a is None and (chapter is None or part is group.split(",")[0]):
                spans.append(Span(b, None, d or b, None))
                chapter = None if d else b
                continue
            chapter = a or chapter
            spans.append(Span(chapter, b, c or chapter, d if d is not None else b))
            chapter = c or chapter
    return spans


def within(spans: Sequence[Span], chapter: Column, verse: Column) -> Column:
    """True for the verses of the spans: comparisons on (chapter, verse), which reach the scan as filters."""

    def one(s: Span) -> Column:
        after = chapter > s.chapter if s.verse is None else (chapter > s.chapter) | ((chapter == s.chapter) & (verse >= s.verse))
        before = chapter < s.last_chapter if s.last_verse is None else (chapter < s.last_chapter) | ((chapter == s.last_chapter) & (verse <= s.last_verse))
        return (after | (chapter == s.chapter) if s.verse is None else after) & (before | (chapter == s.last_chapter) if s.last_verse is None else before)

    return reduce(lambda a, b: a | b, (one(s) for s in spans), F.lit(False))


def select(verses: DataFrame, book: int, reference: str) -> DataFrame:
    return verses.where((F.col("book") == book) & within(parse_reference(reference), F.col("chapter"), F.col("verse")))


def reference_text(verses: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    """by, reference: ``1:1-3+7; 2:4`` for the verses of each group."""
    ranges = islands(verses, [*by, "chapter"], "verse")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "ranges"))), lambda x: F.concat_ws(":", x["chapter"].cast("string"), x["ranges"]))
    return ranges.groupBy(*by).agg(F.array_join(parts, "; ").alias("reference"))


def parallel(verses: DataFrame, translations: Sequence[str]) -> DataFrame:
    """book, chapter, verse and a column of text for each translation; one pass, no join."""
    chosen = verses.where(F.col("translation").isin(*translations))
    return chosen.groupBy("book", "chapter", "verse").agg(*(F.max(F.when(F.col("translation") == t, F.col("text"))).alias(t) for t in translations))


def contains(verses: DataFrame, query: str, book: int | None = None, most: int = 50) -> DataFrame:
    """Verses with the text, in canonical order."""
    found = verses.where(F.contains(F.lower("text"), F.lit(query.lower())))
    return (found if book is None else found.where(F.col("book") == book)).orderBy("book", "chapter", "verse").limit(most)


def split_query(query: str, books: Sequence[str]) -> tuple[str | None, str]:
    """Book that the first one to three words name (whole name before beginning before part, more words first), and the rest."""
    words = query.lower().split()
    low = {b.lower(): b for b in books}
    for n in (3, 2, 1):
        head, rest = " ".join(words[:n]), " ".join(words[n:])
        if len(words) < n:
            continue
        if head in low:
            return low[head], rest
        for fits in (str.startswith, str.__contains__):
            for name, book in low.items():
                if len(head) > 1 and fits(name, head):
                    return book, rest
    return None, " ".join(words)


def visible_lines(line: Column, lines: Column, shown: int) -> Column:
    """struct(start, end) of the lines an output of ``shown`` lines has at a place; the last ones are aligned to the end."""
    start = F.floor(line / shown) * shown
    rest = lines % shown
    ending = (line + shown >= lines) & (rest > 0)
    first = F.when(ending, lines - rest).otherwise(start).cast("int")
    return F.struct(first.alias("start"), (first + shown).cast("int").alias("end"))


def shows_metadata(rule: Column, index: Column, first: Column, last: Column) -> Column:
    """never, always, first, last or first_last."""
    return F.coalesce((rule == "always") | (F.contains(rule, F.lit("first")) & (index == first)) | (F.contains(rule, F.lit("last")) & (index == last)), F.lit(False))


def similar_paths(missing: DataFrame, files: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    """For each missing path the files of most similar names, ties by path. The missing ones are the query set.

    Only distinct names are compared, each with the first ``most`` paths that bear it, as no more of them can be among
    the best. Names must be close in length for the level, so the join is on steps of length, and a name meets only its
    neighbours."""
    from pyspark.sql import Window

    from quillon.functions.text import similarity

    stem = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    step = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / -F.log(F.lit(least))).cast("int")
    first = F.row_number().over(Window.partitionBy("b").orderBy("path"))
    others = files.select("path").distinct().join(missing.select("path"), "path", "left_anti").select("path", stem.alias("b")).withColumn("nth", first).where(F.col("nth") <= most).drop("nth")
    names = others.select("b", step(F.col("b")).alias("k")).distinct()
    wanted = missing.select(F.col("path").alias("missing"), stem.alias("a"))
    asked = wanted.select("a", F.explode(F.array(step(F.col("a")) - 1, step(F.col("a")), step(F.col("a")) + 1)).alias("k")).distinct()
    pairs = asked.join(names, "k").withColumn("similarity", similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)
    near = pairs.withColumn("nth", F.rank().over(Window.partitionBy("a").orderBy(F.desc("similarity")))).where(F.col("nth") <= most)
    rank = F.row_number().over(Window.partitionBy("missing").orderBy(F.desc("similarity"), "path"))
    found = wanted.join(near.select("a", "b", "similarity"), "a").join(others, "b")
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("missing", "path", "similarity", "rank")


def following(verses: DataFrame) -> DataFrame:
    """``verses`` (book, chapter, verse) with the next verse as struct ``next``: in the chapter, else the first one of the next
    chapter, else of the next book; null at the end. Only books are put in one order as a whole."""
    from pyspark.sql import Window

    own = verses.select("book", "chapter", "verse").distinct()
    first = own.groupBy("book", "chapter").agg(F.min("verse").alias("first"))
    place = F.struct(F.col("book"), F.col("chapter"), F.col("first").alias("verse"))
    chapters = first.withColumn("__c", F.lead(place).over(Window.partitionBy("book").orderBy("chapter")))
    books = first.groupBy("book").agg(F.min(place).alias("p"))
    books = books.select("book", F.lead("p").over(Window.orderBy("book")).alias("__b"))  # a row a book
    ends = chapters.join(books, "book").select("book", "chapter", F.coalesce("__c", "__b").alias("__end"))
    here = F.lead(F.struct("book", "chapter", "verse")).over(Window.partitionBy("book", "chapter").orderBy("verse"))
    return own.withColumn("__n", here).join(ends, ["book", "chapter"]).select("book", "chapter", "verse", F.coalesce("__n", "__end").alias("next"))

"""Search over a catalogue: relevance ranking, phrase index, closest match, verse and remote search.

A catalogue has ``id``, ``name``, ``content`` and optionally ``number``, ``ccli`` and ``category``. Scores are
column expressions over one scan; only the normalisation to the best score needs the partial maximum of all rows,
and it is joined back as one row, not as a window over a single partition.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.storage import store

#: Weights of the parts of a score.
TITLE, CONTENT, FUZZY, REPEAT, MOST_REPEATS, FUZZY_ALONE = 65, 35, 20, 3, 10, 0.7


def _known(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def score(df: DataFrame, query: str) -> Column:
    """Relevance of each row for a query, 0 to 100. A quoted query wants its phrase in the title (100) or content (60).

    The content is folded once a row, and only for rows whose names don't decide; the query is folded on the driver's
    side by the optimizer, as it is constant."""
    name, number, ccli, content = _known(df, "name"), _known(df, "number"), _known(df, "ccli"), _known(df, "content")
    title = T.format_search(F.concat_ws(" ", number, name))
    trimmed = query.strip()
    if len(trimmed) > 2 and trimmed[0] == trimmed[-1] == '"':
        needle = T.format_search(F.lit(trimmed[1:-1]))
        found = F.when(needle == "", 0.0).when(F.contains(title, needle), 100.0).when(F.contains(T.format_search(content), needle), 60.0).otherwise(0.0)
        return F.when(name == "", 0.0).otherwise(found)
    wanted, spaced = T.format_search(F.lit(query), spaces=False), T.format_search(F.lit(query))
    words = T.tokens(spaced)
    long_words = F.filter(words, lambda w: F.length(w) >= 3)
    content_words = F.when(F.size(long_words) > 0, long_words).otherwise(words)
    typed = T.format_search(F.array_join(F.filter(F.split(spaced, " "), lambda w: F.length(w) > 2), " "), spaces=False)

    def of_content(body: Column) -> Column:
        again = F.when(F.length(wanted) >= 2, F.least(REPEAT * T.occurrences(F.regexp_replace(body, r"\s+", ""), wanted), F.lit(MOST_REPEATS))).otherwise(0)
        return F.struct((T.coverage(body, content_words) * CONTENT).alias("found"), again.alias("again"))

    def total(x: Column) -> Column:
        in_content, again, in_title, alike = x["c"]["found"], x["c"]["again"], x["t"], x["s"]
        sum_ = in_title + in_content + alike * FUZZY + again
        fine = (in_title > 0) | (in_content > 0) | (again > 0) | (alike >= FUZZY_ALONE)
        return F.when(~fine, 0.0).when(sum_ >= 100, 99.0).otherwise(sum_)

    def of_names(x: Column) -> Column:
        whole = F.concat(x["number"], x["name"])
        alike = F.when(typed != "", T.similarity(whole, typed)).otherwise(0.0)
        parts = F.struct(_let(T.format_search(content), of_content).alias("c"), (T.coverage(title, words) * TITLE).alias("t"), alike.alias("s"))
        return (
            F.when(name == "", 0.0)
            .when((number != "") & (x["number"] == wanted), 100.0)
            .when((ccli != "") & (ccli == trimmed), 100.0)
            .when((wanted == x["name"]) | (wanted == whole), 100.0)
            .when((wanted != "") & x["name"].startswith(wanted), 100.0)
            .when(F.size(words) == 0, 0.0)
            .otherwise(_let(parts, total))
        )

    return _let(F.struct(T.format_search(number, spaces=False).alias("number"), T.format_search(name, spaces=False).alias("name")), of_names)


def relative(scored: DataFrame, column: str = "match") -> DataFrame:
    """Scores as a percentage of the best; the plain score is kept as ``original_match``."""
    best = scored.agg(F.max(column).alias("__best"))
    share = F.when(F.col("__best") > 0, F.try_divide("original_match", "__best") * 100).otherwise(0.0)
    return scored.withColumnRenamed(column, "original_match").join(F.broadcast(best)).withColumn(column, share).drop("__best")


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def search(df: DataFrame, query: str, archived: DataFrame | None = None, active: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows that match, with ``match`` and ``original_match``. ``archived``: category names that are hidden unless active.

    Scores are written once, as both the best and each share of it are taken from them; ``keep`` names the columns that
    are wanted beside them (all of them by default)."""
    if archived is not None:
        hidden = archived.select(F.col("category")).where(~F.col("category").eqNullSafe(F.lit(active)))
        df = df.join(small(hidden), "category", "left_anti")
    # The filter would repeat the score below the projection, if it were merged with it.
    scored = df.withColumn("match", F.explode(F.array(score(df, query)))).where("match > 0")
    return relative(store(scored.select(*(keep or df.columns), "match")))


def result_limit(query: str) -> int | None:
    """Rows shown at most: long queries show fewer."""
    return 30 if len(query) > 30 else 50 if len(query) > 15 else None


def is_refinement(new: Column, old: Column) -> Column:
    """All old tokens are among the new ones, and there are some."""
    return (F.size(old) > 0) & (F.size(F.array_except(old, new)) == 0)


def closest(df: DataFrame, value: str, key: str = "name", aliases: str | None = None) -> DataFrame:
    """Rows whose key or alias contains the value, with ``similarity`` of the best source and the alias it came from."""
    wanted = T.closest_form(F.lit(value))
    sources = F.array(F.struct(F.col(key).alias("text"), F.lit(False).alias("alias")))
    if aliases:
        sources = F.concat(sources, F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.struct(a.alias("text"), F.lit(True).alias("alias"))))
    forms = F.filter(sources, lambda s: s["text"].isNotNull())
    hit = F.exists(forms, lambda s: F.contains(T.closest_form(s["text"]), wanted))
    rated = F.transform(forms, lambda s: F.struct(T.similarity(T.closest_form(s["text"]), wanted).alias("s"), (~s["alias"]).alias("own"), s["text"].alias("text")))
    best = F.array_max(rated)
    return df.where(hit).withColumns({"similarity": best["s"], "alias_match": F.when(~best["own"], best["text"])})


def remote_score(name: Column, query: str) -> Column:
    """The remote's own score: each term 100 if equal to the name, 25 if part of it; a term without either gives 0."""
    low = F.lower(name)
    terms = [t for t in query.lower().split() if t]
    if not terms:
        return F.lit(0)
    each = [F.when(low == t, 100).when(F.contains(low, F.lit(t)), 25).otherwise(0) for t in terms]
    none = each[0] == 0
    total = each[0]
    for x in each[1:]:
        none, total = none | (x == 0), total + x
    return F.when(none, 0).otherwise(F.least(total, F.lit(100)))


def postings(df: DataFrame, longest: int = 5, query: str | None = None) -> DataFrame:
    """Inverted index: (id, field, term, n) of words and of phrases of two to ``longest`` words, from name and content.

    With a query only the terms that it asks for are taken out of a text, before any row is made of them."""
    asked = search_terms(re.sub(r"[^\w\s]", "", query.lower())) if query else []
    fields = F.array(*(F.struct(F.lit(f).alias("field"), T.tokens(T.format_search(F.col(f))).alias("words")) for f in ("name", "content")))
    words = df.select("id", F.explode(fields).alias("x")).select("id", "x.field", "x.words")

    def phrases(k: int) -> Column:
        n = F.size("words")
        found = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, F.lit(k)), " "))
        if query:
            own = [t for t, size, _ in asked if size == k]
            found = F.filter(found, lambda t: reduce(lambda a, b: a | b, [t.startswith(o) if k == 1 else t == o for o in own], F.lit(False)))
        return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))

    parts = F.array(*(F.struct(F.lit(k).alias("size"), phrases(k).alias("terms")) for k in range(1, longest + 1)))
    each = words.select("id", "field", F.explode(parts).alias("p")).select("id", "field", "p.size", F.explode("p.terms").alias("term"))
    return each.groupBy("id", "field", "size", "term").agg(F.count("*").alias("n"))


def search_terms(query: str) -> list[tuple[str, int, float]]:
    """(term, words, weight): the whole phrase 1.0, shorter phrases 0.6 to 0.8 by length, words of three letters 0.5.

    Phrases of more than five words aren't in the index, so a longer query lives on its parts."""
    words = query.split()
    n, found = len(words), []
    if n > 1:
        found.append((" ".join(words), n, 1.0))
    for k in range(min(n - 1, 5), 1, -1):
        found += [(" ".join(words[i : i + k]), k, 0.6 + 0.2 * k / n) for i in range(n - k + 1)]
    found += [(w, 1, 0.5) for w in words if len(w) >= 3]
    return found


def index_search(index: DataFrame, query: str) -> DataFrame:
    """id, score, from an index: phrases 20 w; words w (3 in names, 1 in content) + half a point an occurrence up to
    five; words that only begin like a term 0.3 w (2 or 0.5). Sums are partial before the shuffle by id."""
    phrase, word, prefix = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    name = F.col("field") == "name"
    any_term = F.lit(False)
    for term, size, weight in search_terms(re.sub(r"[^\w\s]", "", query.lower())):
        hit = (F.col("size") == size) & (F.col("term") == term)
        any_term = any_term | hit
        if size > 1:
            phrase = phrase + F.when(hit, 20 * weight).otherwise(0.0)
        else:
            starts = (F.col("size") == 1) & F.col("term").startswith(term) & (F.col("term") != term)
            any_term = any_term | starts
            word = word + F.when(hit, weight * F.when(name, 3.0).otherwise(1.0) + 0.5 * F.least(F.col("n"), F.lit(5))).otherwise(0.0)
            prefix = prefix + F.when(starts, 0.3 * weight * F.when(name, 2.0).otherwise(0.5)).otherwise(0.0)
    return index.where(any_term).groupBy("id").agg(F.sum(phrase + word + prefix).alias("score"))


def verse_search(verses: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Verses with at least two of the query's words (one if it has only one), ranked by words and the whole phrase."""
    words = query.lower().split()
    low = F.lower(F.col("text"))
    found = T.tokens(F.regexp_replace(low, r"[^\w\s]", ""))
    count = sum((F.when(F.array_contains(found, w), 1).otherwise(0) for w in words), F.lit(0))
    rated = verses.withColumn("hits", count).where(F.col("hits") >= min(len(words), 2))
    bonus = F.when(F.contains(low, F.lit(" ".join(words))), 20.0).otherwise(0.0)
    return rated.withColumn("score", F.col("hits") + bonus).orderBy(F.desc("score"), "book", "chapter", "verse").limit(most)


def federated(sources: dict[str, DataFrame], query: str, most: int = 5) -> DataFrame:
    """(type, id, name, rank): the best ``most`` matches of each source; each source is cut before the union."""
    out = None
    for kind, df in sources.items():
        best = closest(df, query).orderBy(F.desc("similarity"), "id").limit(most)
        part = best.select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), "name", F.round("similarity", 6).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    return out


def panel_filter(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Lower-case substring filter over some columns; queries of one letter filter nothing."""
    if len(query.strip()) < 2:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query.lower().strip()))
    return df.where(hit)

"""Text analytics: sections, repeats, near-duplicate sections, splitting, wrapping, chords.

What is a function of one text is a column expression or an Arrow UDF over it; near-duplicate sections are found among
the distinct texts of a document, by steps of length.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import label_id, similarity

#: Group names that a label may have.
GROUPS = ("verse", "chorus", "bridge", "pre_chorus", "tag", "intro", "outro", "break", "ending", "interlude", "refrain")
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
CHORD = r"[A-G][b#]?(?:maj|min|m|aug|dim|sus|add|\d|\(|\))*(?:/[A-G][b#]?)?"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, section: blocks between blank lines, without empty ones."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select(key, F.posexplode(parts).alias("ordinal", "section"))


def header(text: Column) -> Column:
    """``key: value`` lines before the first blank line, as a map; empty if any line there is something else."""
    lines = F.split(F.regexp_extract(text, r"(?s)^(.*?)(?:\n\s*\n|$)", 1), "\n")
    every = F.forall(lines, lambda x: x.rlike(r"^\w[\w ]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))))
    return F.when(every, F.map_from_entries(F.array_distinct(pairs))).otherwise(F.expr("cast(map() as map<string,string>)"))


def explicit_label(section: Column) -> Column:
    """The group that the first line names, with or without brackets; null if it names none."""
    first = F.substring_index(section, "\n", 1)
    name = label_id(first)
    bracketed = first.rlike(r"^\s*\[[^\]]*\]\s*$") | first.rlike(r":\s*$")
    return F.when(name.isin(*GROUPS), name).when(bracketed, F.trim(F.regexp_replace(first, r"[\[\]'\":]|x?\d+", "")))


def repetitive(section: Column) -> Column:
    """Three lines or more of which the first two are alike."""
    lines = F.split(section, "\n")
    a, b = F.lower(F.get(lines, F.lit(0))), F.lower(F.get(lines, F.lit(1)))
    return (F.size(lines) >= 3) & (similarity(a, b) > 0.95)


def near_texts(rows: DataFrame, key: str, text: str, least: float = 0.7) -> DataFrame:
    """key, t, u, n: for each distinct lower-case text t of a key the other texts u of a similarity of ``least`` or more,
    and how many rows hold u.

    Rows of equal text are one row here. Edit similarity of a level bounds the ratio of the lengths by it, so on a
    logarithmic scale of lengths with steps of that ratio a pair lies in one step or in neighbours: an equi-join on key
    and step, checked by lengths before any distance. The key is a document, which holds a bounded number of texts."""
    low = F.lower(F.col(text))
    step = F.lit(-1.0) / F.log(F.lit(least))
    size = F.greatest(F.length(text), F.lit(1))
    block = F.floor(F.log(size.cast("double")) * step).cast("int")
    base = rows.select(key, low.alias("t"), block.alias("k")).groupBy(key, "t", "k").agg(F.count("*").alias("n"))
    left = base.select(key, "t", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    right = base.select(key, F.col("t").alias("u"), "k", "n")
    near = (F.col("t") != F.col("u")) & (F.length("u") >= least * F.length("t")) & (F.length("t") >= least * F.length("u"))
    return left.join(right, [key, "k"]).where(near).where(similarity(F.col("t"), F.col("u")) >= least).select(key, "t", "u", "n")


def near_sections(rows: DataFrame, key: str, section: str, least: float = 0.7) -> DataFrame:
    """``rows`` with ``n_similar``: the other sections of the key with a similarity of ``least`` or more, equal ones too."""
    others = near_texts(rows, key, section, least).groupBy(key, "t").agg(F.sum("n").alias("__others"))
    equal = rows.groupBy(key, F.lower(section).alias("t")).agg((F.count("*") - 1).alias("__equal"))
    counted = equal.join(others, [key, "t"], "left").select(key, F.col("t").alias("__t"), (F.col("__equal") + F.coalesce("__others", F.lit(0))).alias("n_similar"))
    return rows.withColumn("__t", F.lower(section)).join(counted, [key, "__t"], "left").drop("__t").withColumn("n_similar", F.coalesce("n_similar", F.lit(0)))


def classified(rows: DataFrame, key: str, section: str) -> DataFrame:
    """Adds ``group``: explicit label, else tag (short or repetitive), else chorus (a similar section exists), else verse."""
    text = F.col(section)
    short = F.length(F.replace(text, F.lit("\n"), F.lit(""))) < 30
    group = F.coalesce(explicit_label(text), F.when(short | repetitive(text), "tag").when(F.col("n_similar") > 0, "chorus").otherwise("verse"))
    return near_sections(rows, key, section).withColumn("group", group).drop("n_similar")


def deduped(rows: DataFrame, key: str, ordinal: str, *same: str) -> DataFrame:
    """Adds ``first``: the ordinal of the first row of the key with the same text (and group)."""
    return rows.withColumn("first", F.min(ordinal).over(Window.partitionBy(key, *same)))


def expanded_repeats(lines: DataFrame, key: str, ordinal: str, line: str) -> DataFrame:
    """A line that ends in ``x3`` stands three times; ``:/: ... :/:`` twice."""
    n = F.regexp_extract(F.col(line), r"\s+[xX](\d+)\s*$", 1)
    both = F.col(line).rlike(r"^\s*:/:.*:/:\s*$")
    times = F.when(n != "", F.least(n.cast("int"), F.lit(100))).when(both, 2).otherwise(1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.col(line), r"\s+[xX]\d+\s*$", ""), ":/:", ""))
    return lines.select(key, ordinal, F.posexplode(F.array_repeat(bare, times)).alias("copy", line))


def _halves(text: str) -> tuple[str, str] | None:
    """Two parts near the middle: at the end of a sentence or clause if one is close, else at a space."""
    middle, n = len(text) / 2, len(text)
    marks = [m.end() for m in re.finditer(r"[.!?;:,]\s+", text) if n * 0.25 <= m.end() <= n * 0.75]
    spaces = [m.end() for m in re.finditer(r"\s+", text) if 0 < m.start() and m.end() < n]
    if not (marks or spaces):
        return None
    at = min(marks or spaces, key=lambda k: (abs(k - middle), k))
    opened = text.rfind("[", 0, at)
    if opened > 0 and "]" not in text[opened:at] and 0 < len(text[opened:].split("]")[0].split()) < 4 and "]" in text[at:]:
        at = opened
    return text[:at].strip(), text[at:].strip()


def split_text(text: str | None, most: int) -> list[str]:
    """Pieces of at most ``most`` characters where white space allows it, by halving; short brackets stay whole."""
    todo, done = [(text or "").strip()], []
    while todo:
        x = todo.pop()
        if len(x) <= most:
            done += [x] if x else []
            continue
        parts = _halves(x)
        if parts is None or not all(parts):
            done.append(x)
        else:
            todo += [parts[1], parts[0]]
    return done


def splitter(most: int):
    """Arrow UDF of :func:`split_text`."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: split_text(x if isinstance(x, str) else "", most))

    return run


def wrapped_lines(text: Column, width: int) -> Column:
    """Number of lines that greedy word wrapping takes; a word longer than a line takes as many as it needs."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("at"))

    def step(s: Column, w: Column) -> Column:
        n = F.length(w)
        fits = (s["at"] > 0) & (s["at"] + 1 + n <= width)
        rows = F.ceil(n / width).cast("int")
        return F.struct(F.when(fits, s["lines"]).otherwise(s["lines"] + rows).alias("lines"), F.when(fits, s["at"] + 1 + n).otherwise(n - (rows - 1) * width).cast("int").alias("at"))

    return F.aggregate(words, start, step)["lines"]


def fitted_groups(verses: DataFrame, key: str, order: str, lines: str, most: int) -> DataFrame:
    """Adds ``slide``: verses in order, a new slide where the lines no longer fit. Greedy, so one fold over each key."""
    packed = verses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, lines))).alias("v"))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("slide"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, v: Column) -> Column:
        fits = (s["slide"] >= 0) & (s["used"] + v[lines] <= most)
        slide = F.when(fits, s["slide"]).otherwise(s["slide"] + 1)
        return F.struct(F.when(fits, s["used"] + v[lines]).otherwise(v[lines]).cast("int").alias("used"), slide.alias("slide"), F.concat(s["out"], F.array(slide)).alias("out"))

    slides = F.aggregate("v", start, step)["out"]
    each = packed.select(key, F.explode(F.arrays_zip(F.col("v"), slides.alias("s"))).alias("x"))
    return each.select(key, F.col(f"x.v.{order}").alias(order), F.col("x.s").alias("slide"))


def is_chord_line(line: Column) -> Column:
    """Every word is a chord, or at most a fifth of the characters isn't part of one."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    all_chords = (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(f"^{CHORD}$"))
    bare = F.regexp_replace(line, r"\s", "")
    left = F.length(F.regexp_replace(bare, CHORD, ""))
    return all_chords | (F.coalesce(F.try_divide(left, F.length(bare)) <= 0.2, F.lit(False)))


def chords(line: Column) -> Column:
    """Chords in brackets, in order."""
    return F.regexp_extract_all(line, F.lit(rf"\[({CHORD})\]"), F.lit(1))


def _shift(name: str, step: int) -> str:
    scale = SHARPS if step >= 0 else FLATS
    at = SHARPS.index(name) if name in SHARPS else FLATS.index(name) if name in FLATS else None
    return {"E#": "F", "B#": "C", "Cb": "B", "Fb": "E"}.get(name, name) if at is None else scale[(at + step) % 12]


def transpose(text: Column, step: int) -> Column:
    """Chords in brackets moved by half-tones: sharps upward, flats downward, bass notes too. A map literal, no UDF."""
    names = sorted(set(SHARPS + FLATS))
    moved = F.create_map(*(F.lit(x) for n in names for x in (n, _shift(n, step))))
    pattern = rf"\[{CHORD}\]"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001")

    def turn(chord: Column) -> Column:
        roots = F.regexp_extract_all(chord, F.lit(r"[A-G][b#]?"), F.lit(0))
        between = F.split(F.regexp_replace(chord, r"[A-G][b#]?", "\u0002"), "\u0002")
        both = F.arrays_zip(between, F.transform(roots, lambda r: F.coalesce(F.element_at(moved, r), r)))
        return F.array_join(F.flatten(F.transform(both, lambda z: F.array(F.coalesce(z["0"], F.lit("")), F.coalesce(z["1"], F.lit(""))))), "")

    both = F.arrays_zip(rest, F.transform(found, turn))
    return F.array_join(F.flatten(F.transform(both, lambda z: F.array(F.coalesce(z["0"], F.lit("")), F.coalesce(z["1"], F.lit(""))))), "")


def chart_data(text: Column) -> Column:
    """label, value of a chart: a JSON array of objects, else ``label: value`` lines; what isn't a number is 0."""
    parsed = F.from_json(text, "array<struct<label:string,value:string>>")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("label"), F.substring_index(x, ":", -1).alias("value")))
    rows = F.when(text.rlike(r"^\s*\["), parsed).otherwise(lines)
    return F.transform(rows, lambda r: F.struct(r["label"].alias("label"), F.coalesce(F.trim(F.replace(r["value"], F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0)).alias("value")))

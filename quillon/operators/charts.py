"""Chord and section charts: chord lines laid over the lyrics below them, and repeated blocks written out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.texts import CHORD, is_chord_line


def chord_places(line: Column) -> Column:
    """array<struct<at, chord>>: the chords of a line and the characters before them."""
    chords = F.regexp_extract_all(line, F.lit(f"({CHORD})"), F.lit(1))
    gaps = F.split(F.regexp_replace(line, CHORD, "\u0001"), "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<at:int,chord:string>>)").alias("found"))

    def step(s: Column, z: Column) -> Column:
        at = s["at"] + F.length(z["g"])
        return F.struct((at + F.length(z["c"])).cast("int").alias("at"), F.concat(s["found"], F.array(F.struct(at.cast("int").alias("at"), z["c"].alias("chord")))).alias("found"))

    pairs = F.transform(chords, lambda c, i: F.struct(F.get(gaps, i).alias("g"), c.alias("c")))
    return F.aggregate(pairs, start, step)["found"]


def with_chords(places: Column, lyrics: Column) -> Column:
    """The lyrics with each chord in brackets at its place; chords beyond the end come last."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(s: Column, p: Column) -> Column:
        return F.struct(p["at"].alias("at"), F.concat(s["text"], F.substring(lyrics, s["at"] + 1, p["at"] - s["at"]), F.lit("["), p["chord"], F.lit("]")).alias("text"))

    done = F.aggregate(places, start, step)
    return F.concat(done["text"], F.substring(lyrics, done["at"] + 1, F.length(lyrics)))


def merged_chords(lines: DataFrame, by: Sequence[str], order: str, line: str) -> DataFrame:
    """Lines with every chord line merged into the lyric line below it, an empty line between allowed. Headers in
    brackets stay, as does a chord line with no lyrics below it. ``order`` of a merged line is the chord line's."""
    w = Window.partitionBy(*by).orderBy(order)
    text = F.col(line)
    header, blank = text.rlike(r"^\s*\[.+\]\s*$"), F.trim(text) == ""
    marked = lines.withColumns({"__chords": is_chord_line(text) & ~header & ~blank, "__blank": blank, "__words": ~blank & ~header & ~is_chord_line(text)})
    far = {f"__{c}{k}": F.lead(f"__{c}", k).over(w) for c in ("words", "blank") for k in (1, 2)} | {"__next1": F.lead(line, 1).over(w), "__next2": F.lead(line, 2).over(w)}
    marked = marked.withColumns(far)
    direct, over = F.coalesce("__words1", F.lit(False)), F.coalesce(F.col("__blank1") & F.col("__words2"), F.lit(False))
    marked = marked.withColumn("__merge", F.when(F.col("__chords") & direct, 1).when(F.col("__chords") & over, 2).otherwise(0))
    back = lambda k: F.coalesce(F.lag("__merge", k).over(w), F.lit(0))
    kept = marked.withColumn("__taken", (back(1) >= 1) | (back(2) == 2)).where("not __taken")
    lyrics = F.when(F.col("__merge") == 1, F.col("__next1")).otherwise(F.col("__next2"))
    return kept.select(*by, order, F.when(F.col("__merge") > 0, with_chords(chord_places(text), lyrics)).otherwise(text).alias(line))


def repeated_blocks(lines: DataFrame, by: Sequence[str], order: str, line: str, start: str, end: str) -> DataFrame:
    """by, ordinal, line: blocks between a line with a ``start`` count and one with an ``end`` count stand as often as the
    larger count says, a block without an end as often as its start; blocks don't nest. A section is one fold."""
    rows = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("x"), F.col(start).cast("int").alias("a"), F.col(end).cast("int").alias("z")))).alias("rows"))
    none = F.expr("cast(array() as array<string>)")
    begin = F.struct(none.alias("done"), none.alias("block"), F.lit(0).alias("times"))
    again = lambda block, times: F.flatten(F.array_repeat(block, times))

    def step(s: Column, r: Column) -> Column:
        times = F.when(s["times"] > 0, s["times"]).otherwise(F.coalesce(r["a"], F.lit(0)))
        block = F.concat(s["block"], F.array(r["x"]))
        ends = (times > 0) & (F.coalesce(r["z"], F.lit(0)) > 0)
        done = F.when(times == 0, F.concat(s["done"], F.array(r["x"]))).when(ends, F.concat(s["done"], again(block, F.greatest(times, r["z"])))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when((times > 0) & ~ends, block).otherwise(none).alias("block"), F.when(ends, 0).otherwise(times).cast("int").alias("times"))

    every = F.aggregate("rows", begin, step, lambda s: F.concat(s["done"], again(s["block"], s["times"])))
    return rows.select(*by, F.posexplode(every).alias("ordinal", line))

"""Nested documents: flattening, playlists of sections, neighbours, ordinals, trees.

Documents hold ``slides`` (map of id to slide) and ``layouts`` (ordered references); rows of a flattened playlist
have ``doc``, ``pos`` and what the slide says. Windows are always partitioned by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.search import small

#: The nested schema that adapters produce.
SHOW = (
    "id string, name string, category string, meta map<string,string>, "
    "slides array<struct<id:string,group:string,notes:string,children:array<string>,items:array<struct<type:string,lines:array<string>>>>>, "
    "layout array<struct<id:string,disabled:boolean>>"
)


def map_rows(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """{id: value} as rows of the value's fields with the id."""
    other = [c for c in df.columns if c != column]
    return df.select(*other, F.explode(column).alias(key, "__v")).select(*other, key, "__v.*")


def rows_map(df: DataFrame, key: str, value: Column, within: Sequence[str]) -> DataFrame:
    """Rows back to one map for each group; of equal keys the last in value order stays."""
    last = df.groupBy(*within, key).agg(F.max(value).alias("__v"))
    return last.groupBy(*within).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__v")))).alias("map"))


def layout_ref(layout: DataFrame, slides: DataFrame) -> DataFrame:
    """References in order, each parent followed by its children, with a running ``layout_index`` in each document.

    ``layout``: doc, pos, id; ``slides``: doc, id, group, children (array of ids). References to slides that don't
    exist go. A parent has type ``parent``; children know their parent's id."""
    joined = layout.join(slides.select("doc", "id", "group", "children"), ["doc", "id"])
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.col("id").alias("slide"))), F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda c, k: F.struct(k.alias("k"), c.alias("slide"))))
    each = joined.select("doc", "pos", F.col("id").alias("parent"), "group", F.explode(parts).alias("p"))
    index = F.row_number().over(Window.partitionBy("doc").orderBy("pos", "parent", "p.k")) - 1
    return each.select("doc", "pos", index.cast("long").alias("layout_index"), F.col("p.slide").alias("id"), "parent", "group", F.when(F.col("p.k") < 0, "parent").otherwise("child").alias("type"))


def text_of(rows: DataFrame, within: Sequence[str], order: Sequence[str], text: str, separator: str = "\n") -> DataFrame:
    """Texts of a group joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"])
    return rows.groupBy(*within).agg(F.array_join(parts, separator).alias("text"))


def text_cache(shows: DataFrame) -> DataFrame:
    """id, content: the lower-cased text of all lines of a nested document, by nested transforms and no shuffle."""
    lines = F.flatten(F.transform("slides", lambda s: F.flatten(F.transform(s["items"], lambda i: i["lines"]))))
    return shows.select("id", F.lower(F.array_join(lines, " ")).alias("content"))


def export_text(shows: DataFrame) -> DataFrame:
    """id, text: sections in order under ``[group]`` headers, as a plain-text file holds them."""
    def section(s: Column) -> Column:
        lines = F.array_join(F.flatten(F.transform(s["items"], lambda i: i["lines"])), "\n")
        return F.concat(F.when(F.coalesce(s["group"], F.lit("")) != "", F.concat(F.lit("["), s["group"], F.lit("]\n"))).otherwise(""), lines)

    enabled = F.filter("layout", lambda r: ~F.coalesce(r["disabled"], F.lit(False)))
    by_id = F.map_from_entries(F.transform("slides", lambda s: F.struct(s["id"], s)))
    found = F.filter(F.transform(enabled, lambda r: F.element_at(by_id, r["id"])), lambda s: s.isNotNull())
    return shows.select("id", F.array_join(F.transform(found, section), "\n\n").alias("text"))


def group_names(rows: DataFrame, within: Sequence[str], group: str, *order: str) -> DataFrame:
    """Numbers groups that occur more than once (Verse 1, Verse 2); a single one keeps its plain name."""
    w = Window.partitionBy(*within, group)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    return rows.withColumn("group_name", F.when(n > 1, F.concat_ws(" ", F.col(group), k.cast("string"))).otherwise(F.col(group)))


def neighbours(rows: DataFrame, within: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    return rows.withColumns({f"{c}_previous": F.lag(c).over(w) for c in columns} | {f"{c}_next": F.lead(c).over(w) for c in columns})


def upcoming(rows: DataFrame, within: Sequence[str], order: Sequence[str], value: str, wanted: Column) -> DataFrame:
    """``current``: the value of the last wanted row up to here; ``upcoming``: that of the first after it."""
    w = Window.partitionBy(*within).orderBy(*order)
    hit = F.when(wanted, F.col(value))
    return rows.withColumns({"current": F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "upcoming": F.first(hit, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def islands(rows: DataFrame, within: Sequence[str], number: str) -> DataFrame:
    """Numbers as ranges: 1, 2, 3, 7 is ``1-3+7``. Repeated numbers count once."""
    once = rows.select(*within, number).distinct()
    at = F.row_number().over(Window.partitionBy(*within).orderBy(number))
    runs = once.withColumn("__r", F.col(number) - at).groupBy(*within, "__r").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(*within).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("a"), name.alias("n")))), lambda x: x["n"]), "+").alias("ranges"))


def chunks(rows: DataFrame, within: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Adds the number of the chunk of ``size`` rows that a row falls in."""
    k = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(k / size).cast("int"))


def bounds(rows: DataFrame, within: Sequence[str], index: str, disabled: Column) -> DataFrame:
    """First and last index that isn't disabled."""
    on = F.when(~disabled, F.col(index))
    return rows.groupBy(*within).agg(F.min(on).alias("first"), F.max(on).alias("last"))


def mode_of(rows: DataFrame, within: Sequence[str], value: str, *order: str) -> DataFrame:
    """The most frequent value; of equals the one that was seen first."""
    counts = rows.groupBy(*within, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return counts.groupBy(*within).agg(F.max_by(value, F.struct(F.col("n"), *(-F.col(f"first.{c}") for c in order))).alias("mode"))


def joined_distinct(rows: DataFrame, within: Sequence[str], value: str, separator: str = ", ") -> DataFrame:
    return rows.groupBy(*within).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias("joined"))


def tree_closure(nodes: DataFrame, root: str, name: str = "nodes") -> DataFrame:
    """Descendants of a node with depth and a path that sorts depth first. ``nodes``: id, parent, label (strings)."""
    spark: SparkSession = nodes.sparkSession
    view = f"__{name}_{abs(hash(root))}"
    nodes.select("id", "parent", "label").createOrReplaceTempView(view)
    return spark.sql(
        f"""WITH RECURSIVE t(id, parent, label, depth, path) AS (
              SELECT id, parent, label, 0, label FROM {view} WHERE id = :root
              UNION ALL SELECT n.id, n.parent, n.label, t.depth + 1, concat(t.path, '/', n.label) FROM {view} n JOIN t ON n.parent = t.id)
            SELECT * FROM t""",
        args={"root": root},
    )


def moved(a: Column, old: Column, new: Column) -> Column:
    """An array with the element at ``old`` put to ``new`` (from 0)."""
    x = F.get(a, old)
    rest = F.concat(F.slice(a, F.lit(1), old), F.slice(a, old + 2, F.size(a)))
    return F.array_insert(rest, new + 1, x)


def range_selected(selected: Column, anchor: Column, to: Column) -> Column:
    """Positions after a shift-click: those selected and all from the anchor to the click."""
    return F.array_sort(F.array_union(selected, F.sequence(F.least(anchor, to), F.greatest(anchor, to))))


def template_overlay(slides: DataFrame, template: DataFrame, keep_overflow: bool = True) -> DataFrame:
    """Items matched to template items by type and place within the type; the template's style wins.

    ``slides``: slide, pos, type, style; ``template``: pos, type, style."""
    nth = lambda *p: F.row_number().over(Window.partitionBy(*p, "type").orderBy("pos"))
    left = slides.withColumn("nth", nth("slide"))
    right = template.withColumn("nth", F.row_number().over(Window.partitionBy("type").orderBy("pos"))).select("type", "nth", F.col("style").alias("over"))
    out = left.join(small(right), ["type", "nth"], "left" if keep_overflow else "inner")
    return out.select("slide", "pos", "type", F.coalesce("over", "style").alias("style"))


def at_path(path: str) -> Column:
    """A field of a document, or of a field of it (``meta.title``); null where there is none."""
    head, _, tail = path.partition(".")
    return F.col(head)[tail] if tail else F.col(head)


def slides_of(shows: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """id, place and the slide's fields of the chosen slides (all of them by default) of each document."""
    chosen = F.col("slides") if ids is None else F.filter("slides", lambda s: s["id"].isin(*ids))
    return shows.select("id", F.posexplode(chosen).alias("place", "s")).select("id", "place", F.col("s.id").alias("slide"), "s.group", "s.notes", "s.children", "s.items")


def item_lines(slides: DataFrame, items: Sequence[int] | None = None, lines: Sequence[int] | None = None) -> DataFrame:
    """The chosen lines of the chosen items of slides: id, slide, item, line, text; numbers count from 0."""
    each = slides.select("id", "slide", F.posexplode("items").alias("item", "i"))
    each = each if items is None else each.where(F.col("item").isin(*items))
    out = each.select("id", "slide", "item", F.posexplode("i.lines").alias("line", "text"))
    return out if lines is None else out.where(F.col("line").isin(*lines))


def trimmed(shows: DataFrame, keep: Sequence[str] = ("number", "ccli")) -> DataFrame:
    """What a catalogue holds of a document: id, name, category and some of its metadata, no slides."""
    return shows.select("id", "name", "category", F.map_filter("meta", lambda k, _: k.isin(*keep)).alias("quick"))


def split_markup(text: Column, most: int | Column) -> Column:
    """A text with tags in pieces of at most ``most`` visible characters, cut between words; a word with its tags stays
    whole, so no tag is cut. A tag that is open at a cut is closed there and opened again in the next piece."""
    words = F.filter(F.split(text, r"\s+(?![^<]*>)"), lambda w: w != "")
    visible = lambda w: F.length(F.regexp_replace(w, "<[^>]*>", ""))
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("done"), F.lit("").alias("piece"), F.lit(0).alias("n"), none.alias("open"))

    def opened(have: Column, w: Column) -> Column:
        tags = F.regexp_extract_all(w, F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>"), F.lit(1))
        return F.aggregate(tags, have, lambda s, t: F.when(t.startswith("/"), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(t))))

    closing = lambda o: F.array_join(F.transform(F.reverse(o), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")
    opening = lambda o: F.array_join(F.transform(o, lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "")

    def step(s: Column, w: Column) -> Column:
        n = visible(w)
        fits = (s["n"] == 0) | (s["n"] + 1 + n <= most)
        piece = F.when(s["n"] == 0, F.concat(s["piece"], w)).when(fits, F.concat(s["piece"], F.lit(" "), w)).otherwise(F.concat(opening(s["open"]), w))
        done = F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(F.concat(s["piece"], closing(s["open"])))))
        return F.struct(done.alias("done"), piece.alias("piece"), F.when(fits & (s["n"] > 0), s["n"] + 1 + n).otherwise(n).cast("int").alias("n"), opened(s["open"], w).alias("open"))

    return F.aggregate(words, start, step, lambda s: F.when(s["piece"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["piece"]))))

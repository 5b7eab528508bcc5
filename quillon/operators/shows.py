"""Joins, sorts and counts around shows, timers and outputs; slides merged, split and put in groups; rules for stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.catalogue import ranked
from quillon.operators.search import relative, small


def upcoming_actions(events: DataFrame, now: Column, start: str = "start", kind: str = "type", action: str = "action", tick_ms: int = 1000) -> DataFrame:
    """Events that are actions and not over by more than a tick, in order of time."""
    return events.where((F.col(kind) == action) & (F.col(start) > now - F.expr(f"interval {tick_ms} milliseconds")))


def timers_detailed(timers: DataFrame, active: DataFrame) -> DataFrame:
    """``timers`` (id, name) with is_active, current_time and paused of the first entry of ``active`` (id, place,
    current_time, paused)."""
    first = active.groupBy("id").agg(F.min_by(F.struct("current_time", "paused"), "place").alias("a"))
    joined = timers.join(first, "id", "left")
    return joined.select("id", F.coalesce("name", F.lit("")).alias("name"), F.col("a").isNotNull().alias("is_active"), "a.current_time", "a.paused")


def scored(catalogue: DataFrame, scores: DataFrame, archived: DataFrame | None = None, active: str | None = None) -> DataFrame:
    """Rows of the catalogue (id, category) with a score above 0, as a percentage of the best; those of archived
    categories only while one is viewed."""
    rows = catalogue.join(scores.where("score > 0").withColumnRenamed("score", "match"), "id")
    if archived is not None:
        hidden = archived.select("category").where(~F.col("category").eqNullSafe(F.lit(active)))
        rows = rows.join(small(hidden), "category", "left_anti")
    return relative(rows)


def events_of_days(days: DataFrame, events: DataFrame, start: str, until: str, kind: Column) -> DataFrame:
    """day, place, same_day and the event for the events of the kind that start on one of the days, in order of time."""
    chosen = events.where(kind).withColumn("day", F.to_date(start)).join(days.select("day").distinct(), "day")
    place = F.row_number().over(Window.partitionBy("day").orderBy(start, until))
    return chosen.withColumns({"place": place, "same_day": F.to_date(until) == F.col("day")})


def reindexed(files: DataFrame, cached: DataFrame, rescan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (name) whose cached entry (name, id) still counts, with its id; and the names to read again. Of entries of
    one name the last id counts; names in ``rescan`` are read again."""
    names = files.where(F.lower("name").endswith(".show")).select(F.expr("substring(name, 1, length(name) - 5)").alias("name")).where("name <> ''").distinct()
    known = cached.join(rescan.select("name"), "name", "left_anti").groupBy("name").agg(F.max("id").alias("id"))
    return names.join(known, "name"), names.join(known.select("name"), "name", "left_anti")


def output_matches(outputs: DataFrame, items: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Pairs of outputs (output, type, key) and project items that they show: each type compares by a column of its own,
    so the condition on the type is an equi-join on type and key."""
    key = F.lit(None).cast("string")
    for kind, column in keys.items():
        key = F.when(F.col("type") == kind, F.col(column).cast("string")).otherwise(key)
    return items.withColumn("key", key).where("key is not null").join(outputs.withColumn("key", F.col("key").cast("string")), ["type", "key"]).drop("key")


def total_seconds(files: DataFrame, playlist: str, seconds: str) -> DataFrame:
    return files.groupBy(playlist).agg(F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"))


def peak_level(samples: DataFrame, by: Sequence[str], db: str, floor: float = -80.0) -> DataFrame:
    """The loudest channel, the floor at least."""
    return samples.groupBy(*by).agg(F.greatest(F.coalesce(F.max(db), F.lit(floor)), F.lit(floor)).alias("peak"))


def latest_modification(devices: DataFrame, by: Sequence[str], modified: str) -> DataFrame:
    return devices.groupBy(*by).agg(F.greatest(F.coalesce(F.max(modified), F.lit(0)), F.lit(0)).alias("latest"))


def locale_sorted(rows: DataFrame, name: str, translated: str, is_default: str, tie: str) -> DataFrame:
    """Rank by name in the order of the Unicode collation; defaults by their translated name."""
    shown = F.when(F.col(is_default), F.coalesce(translated, name)).otherwise(F.coalesce(name, F.lit("")))
    return ranked(rows.withColumn("__shown", F.collate(shown, "UNICODE")), F.col("__shown"), F.col(tie)).drop("__shown")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rank in an order drawn by the seed: that of a digest of seed and key, the same on every run."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return ranked(rows.withColumn("__drawn", drawn), F.col("__drawn"), F.col(key)).drop("__drawn")


def tablet_order(kind: str, descending: bool = False) -> list[Column]:
    """Plain order by modified (last change first made of created), number or name; numbers as numbers, blanks as 0, before texts."""
    if kind == "modified":
        keys = [F.coalesce("modified", "created", F.lit(0))]
    elif kind == "number":
        number = F.coalesce(F.col("number").cast("string"), F.lit(""))
        value = F.when(number == "", F.lit(0.0)).otherwise(number.try_cast("double"))
        keys = [value.isNull(), F.coalesce(value, F.lit(0.0)), F.when(value.isNull(), F.lower(number)).otherwise("")]
    else:
        keys = [F.lower(F.coalesce("name", F.lit("")))]
    return [k.desc() if descending else k.asc() for k in keys]


def numbered_sections(slides: DataFrame, by: Sequence[str], order: Sequence[str], group: str, fallback: str = "Verse") -> DataFrame:
    """``section``: the group's name (or the fallback) and how many of the name there are so far."""
    name = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit(fallback))
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return slides.withColumn("section", F.concat_ws(" ", name, nth.cast("string")))


def end_index(slides: DataFrame, by: Sequence[str], index: str, end: Column, disabled: Column) -> DataFrame:
    """Index of the first enabled slide that is marked as the end, or -1."""
    return slides.groupBy(*by).agg(F.coalesce(F.min(F.when(end & ~disabled, F.col(index))), F.lit(-1)).alias("end_index"))


def group_ids(labels: DataFrame, label: str, groups: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``group_id`` of a label: the group of that id, else the one of that own name, else of that name in the dictionary.

    ``groups``: id, name; ``dictionary``: id, name. Of groups of one name the last id counts."""
    wanted = F.trim(F.lower(F.col(label)))
    ids = small(groups.select(F.col("id").alias("__w"), F.col("id").alias("__a")).distinct())
    own = small(groups.groupBy(F.lower("name").alias("__w")).agg(F.max("id").alias("__b")))
    words = small(dictionary.groupBy(F.lower("name").alias("__w")).agg(F.max("id").alias("__c")))
    found = labels.withColumn("__w", wanted).join(ids, "__w", "left").join(own, "__w", "left").join(words, "__w", "left")
    return found.withColumn("group_id", F.coalesce("__a", "__b", "__c", F.lit(""))).drop("__w", "__a", "__b", "__c")


def merged_slides(slides: DataFrame, by: Sequence[str], order: str, lines: str) -> DataFrame:
    """The slides of a group as one: all their lines in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, lines)))
    return slides.groupBy(*by).agg(F.flatten(F.transform(parts, lambda x: x[lines])).alias(lines))


def split_items(items: DataFrame, lines: str, at: Column) -> DataFrame:
    """Each item as two rows, part 0 with the lines before a place and part 1 with the others; empty parts go."""
    n = F.size(lines)
    parts = F.array(F.struct(F.lit(0).alias("part"), F.slice(lines, F.lit(1), F.least(at, n)).alias("own")), F.struct(F.lit(1).alias("part"), F.slice(lines, at + 1, F.greatest(n - at, F.lit(0))).alias("own")))
    other = [c for c in items.columns if c != lines]
    return items.select(*other, F.explode(parts).alias("__p")).where(F.size("__p.own") > 0).select(*other, "__p.part", F.col("__p.own").alias(lines))


def regrouped(slides: DataFrame, by: Sequence[str], parent_order: Sequence[Column], parent: str, position: str) -> DataFrame:
    """``ordinal`` of slides whose parents are put in a new order; each child stays behind its parent, in its own order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*parent_order, F.col(parent), F.col(position)))
    return slides.withColumn("ordinal", (place - 1).cast("int"))


def store_strategy(store: Column, method: Column, individual: Sequence[str]) -> Column:
    """How a store is synchronised: uploads, replacements and reading only go by the method; a merge takes items one by one
    where the store has some of its own, else the newest file."""
    return F.when(method.isin("upload", "replace", "read_only"), method).when(store.isin(*individual), "per_item").otherwise("newest_file")


def poll_answers_in_time(answers: DataFrame, opened: DataFrame, limit_s: int) -> DataFrame:
    """Answers given before the poll closes, ``limit_s`` seconds after it opened (question, opened)."""
    joined = answers.join(opened, "question")
    return joined.where(F.col("time") < F.col("opened") + F.expr(f"interval {limit_s} seconds")).drop("opened")


def looped(rows: DataFrame, elapsed_ms: Column, duration_ms: int) -> DataFrame:
    """``position`` in a timeline that starts again at its end, and ``loop``, how often it has."""
    return rows.withColumns({"position": F.pmod(elapsed_ms, F.lit(duration_ms)), "loop": F.floor(elapsed_ms / duration_ms)})


def narrowed(before: DataFrame, every: DataFrame, new: str, old: str) -> DataFrame:
    """Where a search goes on: in the result before if the new query only adds words to the old one, else in everything."""
    was, now = old.lower().split(), new.lower().split()
    return before if was and set(was) <= set(now) else every


def styled(text: Column, style: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A style with the additions of every rule (pattern, style) whose pattern the text holds, in order."""
    for pattern, added in rules:
        style = F.when(text.rlike(pattern), F.concat(style, F.lit(added))).otherwise(style)
    return style


def dynamic_values(show: dict[str, Column], now: Column) -> dict[str, Column]:
    """Named values for templates: the parts of a time, and of a show, project or slide what its row has.

    ``show``: columns by name, such as name, text, number, total, group, notes, category, created, modified."""
    from quillon.functions import times as M

    out = {
        "time_s": F.second(now), "time_m": F.minute(now), "time_h": F.hour(now),
        "time_hms": F.date_format(now, "HH:mm:ss"), "date": M.date_text(now), "date_day": F.dayofmonth(now), "date_month": F.month(now),
        "date_year": F.year(now), "date_weekday": M.weekday_name(now), "date_monthname": F.date_format(now, "MMMM"), "date_week": F.weekofyear(now),
    }
    names = {"name": "show_name", "category": "show_category", "created": "show_created", "modified": "show_modified", "text": "slide_text", "group": "slide_group", "notes": "slide_notes", "number": "slide_number", "total": "slides", "project": "project_name", "section": "project_section"}
    out |= {shown: show[c] for c, shown in names.items() if c in show}
    if "text" in show:
        lines = F.split(show["text"], "\n")
        out |= {"slide_lines": F.size(lines), "slide_text_upper": F.upper(show["text"]), "slide_text_first_line": F.get(lines, F.lit(0)), "slide_words": F.size(T.tokens(show["text"]))}
    if "number" in show and "total" in show:
        out |= {"slides_left": show["total"] - show["number"], "slide_percent": F.floor(show["number"] * 100 / show["total"])}
    return out


#: Read actions by name: a function of the tables by name and of arguments.
READS = {
    "get_shows": lambda tables, **_: tables["shows"],
    "get_show": lambda tables, id, **_: tables["shows"].where(F.col("id") == id),
    "get_show_by_name": lambda tables, name, **_: tables["shows"].where(F.lower("name") == name.lower()),
    "get_projects": lambda tables, **_: tables["projects"],
    "get_project": lambda tables, id, **_: tables["projects"].where(F.col("id") == id),
    "get_categories": lambda tables, **_: tables["shows"].groupBy("category").agg(F.count("*").alias("n")),
    "get_timers": lambda tables, **_: timers_detailed(tables["timers"], tables["active_timers"]),
    "get_variables": lambda tables, **_: tables["variables"],
}


def read(action: str, tables: dict[str, DataFrame], **arguments) -> DataFrame:
    """The rows that a read action answers with."""
    if action not in READS:
        raise ValueError(f"unknown action: {action}")
    return READS[action](tables, **arguments)

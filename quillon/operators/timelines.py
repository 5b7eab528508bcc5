"""Calendars and timelines: as-of lookups, intervals, recurrences, rolling values, scheduled and logged events.

As-of lookups are one window over the union of both sides within a key: no theta join, one shuffle on the key. A
timeline with most of the rows can be split by ``bucket`` (a span of time): each bucket gets the last action before
it by a second, small window over bucket summaries. Interval joins expand intervals to the days or buckets they
touch and join on those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, columns: Sequence[str], forward: bool = False, bucket: str | None = None) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` at or before its time; ``forward``: the first after it.

    Of rows of ``right`` at one time the largest by ``columns`` counts. ``bucket``: an interval such as "1 day".
    """
    span = [F.date_trunc("day", F.col(time))] if bucket == "1 day" else [F.window(F.col(time), bucket)["start"]] if bucket else []
    spans = [s.alias("__b") for s in span]
    value = F.struct(*columns)
    others = [c for c in left.columns if c not in (*by, time)]
    rows = left.select(*by, time, F.lit(True).alias("__left"), F.struct(*others).alias("__row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v"))
    marks = right.select(*by, time, F.lit(False).alias("__left"), F.lit(None).cast(left.select(F.struct(*others).alias("r")).schema["r"].dataType).alias("__row"), value.alias("__v"))
    every = rows.unionByName(marks).withColumns({"__b": span[0]} if span else {})
    keys = [*by, *(["__b"] if spans else [])]
    order = [F.col(time), F.col("__left"), F.col("__v")]
    w = Window.partitionBy(*keys).orderBy(*([F.col(time).desc(), F.col("__left").desc(), F.col("__v").desc()] if forward else order))
    found = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Forward is strict: rows of the left at a time come before (in reversed order) the marks at that time.
    out = every.withColumn("__f", found).where("__left")
    if spans:
        edge = F.min_by("__v", F.struct(F.col(time), F.col("__v"))) if forward else F.max_by("__v", F.struct(F.col(time), F.col("__v")))
        summary = right.withColumns({"__b": span[0], "__v": value}).groupBy(*keys).agg(edge.alias("__e"))
        spine = summary.unionByName(left.withColumn("__b", span[0]).select(*keys).distinct().withColumn("__e", F.lit(None).cast(summary.schema["__e"].dataType)))
        spine = spine.groupBy(*keys).agg(F.first("__e", ignorenulls=True).alias("__e"))
        around = Window.partitionBy(*by).orderBy(F.col("__b").desc() if forward else F.col("__b"))
        carried = spine.select(*keys, F.last("__e", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
        out = out.join(carried, keys).withColumn("__f", F.coalesce("__f", "__c"))
    return out.select(*by, time, "__row.*", *(F.col(f"__f.{c}").alias(c) for c in columns))


def active_at(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, step: float) -> DataFrame:
    """Pairs with start <= at < end. Steps double in width from level to level; an interval is dealt to the one or two steps
    that it touches on the level of its own width, however long it is, and a point to its step on each level that
    has an interval: an equi-join on level and step."""
    width = F.greatest((F.col(end) - F.col(start)) / step, F.lit(1.0))
    leveled = intervals.where(F.col(start) < F.col(end)).withColumn("__l", F.ceil(F.log2(width)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("__l")) * step
    cells = leveled.withColumn("__c", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    levels = sorted(r[0] for r in leveled.select("__l").distinct().where("__l is not null").collect())  # a few dozen at most
    dealt = points.withColumn("__l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__c", F.floor(F.col(at) / size))
    joined = dealt.join(cells, [*by, "__l", "__c"])
    return joined.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__l", "__c")


def day_overlap(events: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each day that an event touches; without an end it is the day of its start."""
    first, last = F.to_date(start), F.to_date(F.coalesce(end, start))
    return events.withColumn("day", F.explode(F.sequence(first, F.greatest(first, last), F.expr("interval 1 day"))))


def recurrences(events: DataFrame, start: str, unit: str, every: str, times: str | None = None, until: str | None = None, horizon: str = "2100-01-01") -> DataFrame:
    """All dates of recurring events, the first included. ``unit`` holds day, week, month or year; ``every`` the step.

    It ends after ``times`` dates or with ``until``; an event with neither ends at the horizon. Months count from the
    first date, so the 31st falls on the last day of shorter months and on the 31st again after them."""
    unit_, step = F.col(unit), F.col(every).cast("int")
    limit = F.coalesce(F.col(until) if until else F.lit(None).cast("date"), F.lit(horizon).cast("date"))
    span = F.when(unit_.isin("day", "week"), F.datediff(limit, F.to_date(start)) / F.when(unit_ == "week", 7).otherwise(1)).otherwise(F.months_between(limit, F.to_date(start)) / F.when(unit_ == "year", 12).otherwise(1))
    most = F.greatest(F.floor(span / step), F.lit(-1))
    n = F.when(F.coalesce(F.col(times), F.lit(0)) > 0, F.col(times) - 1).otherwise(most) if times else most
    k = events.where(n >= 0).withColumn("occurrence", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    days = F.date_add(F.to_date(start), (F.col("occurrence") * step * F.when(unit_ == "week", 7).otherwise(1)).cast("int"))
    months = F.add_months(F.to_date(start), (F.col("occurrence") * step * F.when(unit_ == "year", 12).otherwise(1)).cast("int"))
    return k.withColumn("date", F.when(unit_.isin("day", "week"), days).otherwise(months))


def without_exceptions(dates: DataFrame, exceptions: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    return dates.join(exceptions.select(*by, date), [*by, date], "left_anti")


def rrule(rule: Column) -> Column:
    """struct(unit, every, times, until, byday) of an RRULE; without COUNT and UNTIL it is ten times."""
    m = F.str_to_map(F.regexp_replace(rule, "^RRULE:", ""), F.lit(";"), F.lit("="))
    freq = F.lower(F.element_at(m, "FREQ"))
    unit = F.when(freq == "daily", "day").when(freq == "weekly", "week").when(freq == "monthly", "month").when(freq == "yearly", "year")
    until = F.try_to_timestamp(F.regexp_extract(F.element_at(m, "UNTIL"), r"^(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")
    times = F.element_at(m, "COUNT").try_cast("int")
    return F.struct(unit.alias("unit"), F.coalesce(F.element_at(m, "INTERVAL").try_cast("int"), F.lit(1)).alias("every"), F.when(until.isNull(), F.coalesce(times, F.lit(10))).alias("times"), until.alias("until"), F.element_at(m, "BYDAY").alias("byday"))


def upcoming(events: DataFrame, start: str, now: Column, most: int = 0, one_day: bool = False) -> DataFrame:
    """Events from now on in order; 0 is no limit."""
    later = events.where(F.col(start) >= now)
    if one_day:
        later = later.where(F.to_date(start) == F.to_date(now))
    return later.orderBy(start, *[c for c in events.columns if c != start][:1]).limit(most) if most else later


def closest_upcoming(events: DataFrame, by: Sequence[str], start: str, now: Column, value: str) -> DataFrame:
    return events.where(F.col(start) >= now).groupBy(*by).agg(F.min_by(value, F.struct(start, value)).alias(value), F.min(start).alias(start))


def duration(actions: DataFrame, by: Sequence[str], time_ms: str, seconds: str) -> DataFrame:
    """End of a timeline in milliseconds; actions without a duration last no time."""
    return actions.groupBy(*by).agg(F.coalesce(F.max(F.col(time_ms) + F.coalesce(F.col(seconds), F.lit(0)) * 1000), F.lit(0)).alias("duration_ms"))


def rolling_mean(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int = 10) -> DataFrame:
    return rows.withColumn("mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)))


def smoothed(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.15) -> DataFrame:
    """Last exponentially weighted mean of each group: a sum of weights that fall with the rows that follow, so no group is
    held in one row."""
    later = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))) - 1
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    weight = F.pow(F.lit(1 - alpha), F.col("__later")) * F.when(F.col("__first"), 1.0).otherwise(alpha)
    ranked_ = rows.select(*by, F.col(value).cast("double").alias("__v"), later.alias("__later"), first.alias("__first"))
    return ranked_.groupBy(*by).agg(F.sum(weight * F.col("__v")).alias("smoothed"))


def interpolated(points: DataFrame, keys: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Value at each point between the key before (or at) and the key after; before the first and after the last it is theirs."""
    both = points.select(*by, time, F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__p")).unionByName(keys.select(*by, time, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__p")))
    w = Window.partitionBy(*by).orderBy(time, "__p")
    key = F.when(F.col("__p") == 0, F.struct(F.col(time).cast("double").alias("t"), F.col("__v").alias("v")))
    marked = both.withColumns({"a": F.last(key, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(key, True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("__p = 1")
    share = F.try_divide(F.col(time).cast("double") - F.col("a.t"), F.col("b.t") - F.col("a.t"))
    return marked.select(*by, time, F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share).alias(value))


def once_in_a_row(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | ~F.col(f"__b.{value}").eqNullSafe(F.col(value))).drop("__b")


def debounced(rows: DataFrame, by: Sequence[str], time: str, value: str, gap: str) -> DataFrame:
    """The last row of each burst; a burst ends with a pause of ``gap``."""
    return rows.groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.max_by(value, F.struct(time, value)).alias(value), F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), value, "n")


def throttled(rows: DataFrame, by: Sequence[str], time: str, value: str, size: str) -> DataFrame:
    """First and last row of each time slot (the leading and the trailing edge)."""
    edge = F.struct(time, value)
    return rows.groupBy(*by, F.window(time, size).alias("w")).agg(F.min_by(value, edge).alias("leading"), F.max_by(value, edge).alias("trailing")).select(*by, F.col("w.start").alias("start"), "leading", "trailing")


def timer_value(kind: Column, start: Column, end: Column, elapsed: Column, overflow: Column) -> Column:
    """Current value of a counter from start to end; it stops at its end unless it may overflow."""
    up = start <= end
    now = F.when(up, start + elapsed).otherwise(start - elapsed)
    held = F.when(up, F.least(now, end)).otherwise(F.greatest(now, end))
    return F.when(kind == "counter", F.when(overflow, now).otherwise(held)).otherwise(F.when(overflow, now).otherwise(F.greatest(now, F.lit(0))))


def crossed_zero(timers: DataFrame, left_s: Column, tick_s: float = 1.0) -> DataFrame:
    """Timers whose time left became negative within the last tick."""
    return timers.where((left_s < 0) & (left_s >= -tick_s))


def fetches(requests: DataFrame, by: Sequence[str], time: str, tie: str, life: int) -> DataFrame:
    """Requests with ``fetched``: whether the cached answer is older than its life, which a fetch starts anew. A fold over
    each key's times, as each fetch hangs on the one before."""
    rows = requests.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(tie).alias("k")))).alias("r"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        due = F.coalesce(x["t"] - s["last"] >= life, F.lit(True))
        return F.struct(F.when(due, x["t"]).otherwise(s["last"]).cast("long").alias("last"), F.concat(s["out"], F.array(due)).alias("out"))

    each = rows.select(*by, F.explode(F.arrays_zip("r", F.aggregate("r", start, step)["out"].alias("f"))).alias("z"))
    return each.select(*by, F.col("z.r.t").alias(time), F.col("z.r.k").alias(tie), F.col("z.f").alias("fetched"))

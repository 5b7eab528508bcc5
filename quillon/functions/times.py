"""Column builders for dates and times. The session's time zone decides about days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the named intervals in milliseconds.
INTERVALS_MS = {"hourly": 3_600_000, "daily": 86_400_000, "weekly": 604_800_000, "monthly": 2_592_000_000, "yearly": 31_536_000_000}


def time_parts(seconds: Column) -> Column:
    """struct(d, h, m, s) of a number of seconds."""
    s = F.floor(seconds)
    return F.struct(F.floor(s / 86400).alias("d"), F.floor(s % 86400 / 3600).alias("h"), F.floor(s % 3600 / 60).alias("m"), (s % 60).alias("s"))


def join_time(seconds: Column) -> Column:
    """mm:ss, hh:mm:ss from an hour on, with days before it from a day on."""
    p = time_parts(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat_ws(":", two(p["m"]), two(p["s"]))
    clock = F.concat_ws(":", two(p["h"]), short)
    return F.when(p["d"] > 0, F.concat(p["d"].cast("string"), F.lit(", "), clock)).when(p["h"] > 0, clock).otherwise(short)


def last_two(c: Column) -> Column:
    """Zero-padded to two places; longer values keep their last two digits."""
    return F.right(F.concat(F.lit("0"), c.cast("string")), F.lit(2))


def time_ago(seconds: Column) -> Column:
    """Largest whole unit that has passed; bounds belong to the larger unit."""
    found = F.lit("now")
    for size, name in ((1, "second"), (60, "minute"), (3600, "hour"), (86400, "day"), (604800, "week"), (2592000, "month"), (31536000, "year")):
        n = F.floor(seconds / size)
        found = F.when(seconds >= size, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))).otherwise(found)
    return found


def relative_date(then: Column, now: Column) -> Column:
    days = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 86_400_000)
    return F.when(days < 1, "Today").when(days < 2, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(then, "dd.MM.yyyy"))


def nth_weekday(day: Column) -> Column:
    """Which occurrence of its weekday in its month a date is: 1 to 5."""
    return F.ceil(F.dayofmonth(day) / 7).cast("int")


def weekday_of_month(month: Column, weekday: str, nth: int) -> Column:
    """Date of the n-th weekday (Mon ... Sun) of a month; -1 is the last; null if the month has none."""
    first = F.trunc(month, "month")
    if nth < 0:
        return F.next_day(F.date_sub(F.last_day(month), 7), weekday)
    found = F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (nth - 1))
    return F.when(F.trunc(found, "month") == first, found)


def until_clock(clock: Column, now: Column) -> Column:
    """Seconds from ``now`` to a time of the same day such as ``18:30``; negative after it."""
    target = F.hour(now) * 0 + F.split(clock, ":")[0].cast("int") * 3600 + F.split(clock, ":")[1].cast("int") * 60
    return target - (F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now))


def subtitle_time(ms: Column) -> Column:
    """01:02:03.004"""
    p = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(p / 3600), F.floor(p % 3600 / 60), p % 60, ms % 1000)


def date_text(day: Column, full: bool = False) -> Column:
    """DD.MM.YY, or ``Monday 6. February, 2021``."""
    return F.date_format(day, "EEEE d'. 'MMMM', 'yyyy") if full else F.date_format(day, "dd.MM.yy")


def weekday_name(day: Column, names: dict[int, str] | None = None) -> Column:
    """Name of the weekday, from a dictionary by number (1 is Monday) if there is one."""
    if names is None:
        return F.date_format(day, "EEEE")
    return F.initcap(F.element_at(F.create_map(*(F.lit(x) for k in names.items() for x in k)), F.weekday(day) + 1))


def combined(day: Column, clock: Column) -> Column:
    """The day at a time such as ``18:30``; without a time as it is."""
    at = F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.substring(clock, 1, 5)), "yyyy-MM-dd HH:mm")
    return F.coalesce(at, day.cast("timestamp"))


def interval_ms(name: Column) -> Column:
    """Milliseconds of a named interval; 0 for any other name."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in INTERVALS_MS.items() for x in k)), name), F.lit(0))


def forecast_times(now: Column, long_range: bool = False) -> Column:
    """Four times a forecast is shown for: the next full hour, 3, 6 and 11 hours on; or noon of four days from today."""
    if long_range:
        noon = F.date_trunc("day", now) + F.expr("interval 12 hours")
        return F.array(*(noon + F.expr(f"interval {k} days") for k in range(4)))
    hour = F.date_trunc("hour", now)
    return F.array(*(hour + F.expr(f"interval {k} hours") for k in (1, 4, 7, 12)))


def dated_name(pattern: Column, day: Column) -> Column:
    """A name with its date tokens filled in: {DD}, {MM}, {YY}, {YYYY} and {D1} to {D7}, the day of the month of the next
    Monday to Sunday (today counts)."""
    out = pattern
    for token, form in (("{YYYY}", "yyyy"), ("{YY}", "yy"), ("{MM}", "MM"), ("{DD}", "dd")):
        out = F.replace(out, F.lit(token), F.date_format(day, form))
    for k, name in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), 1):
        out = F.replace(out, F.lit(f"{{D{k}}}"), F.date_format(F.next_day(F.date_sub(day, 1), name), "dd"))
    return out


def trigger_of(left_ms: Column, tick_ms: int = 1000, minute_ms: int = 60_000) -> Column:
    """What a scheduled action sets off at a tick: a notice a minute, half a minute and ten seconds ahead, and its start."""
    found = F.lit(None).cast("string")
    for name, at in (("start", 0), ("ten_seconds", minute_ms // 6), ("half_minute", minute_ms // 2), ("minute", minute_ms)):
        found = F.when((left_ms <= at) & (left_ms > at - tick_ms), name).otherwise(found)
    return found

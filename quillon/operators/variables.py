"""User variables: resolution and changes as pure functions of a table of variables.

``variables``: id, type (number, text, text_set, random), value (string), step, low, high, sets (array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(index: int = 0) -> Column:
    """Value of a variable; of a text set the text with the number (from 0), or its active one."""
    active = F.coalesce(F.col("value").try_cast("int"), F.lit(index))
    return F.when(F.col("type") == "text_set", F.get("sets", active)).otherwise(F.coalesce("value", F.lit("")))


def changed(variables: DataFrame, name: str, action: str, amount: float | None = None) -> DataFrame:
    """increment, decrement, set, reset, next or previous on one variable; numbers stay within low and high."""
    number = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    step = F.coalesce(F.lit(amount), F.col("step").cast("double"), F.lit(1.0))
    n = F.greatest(F.size("sets"), F.lit(1))
    at = F.coalesce(F.col("value").try_cast("int"), F.lit(0))
    bound = lambda c: F.least(F.greatest(c, F.coalesce(F.col("low").cast("double"), F.lit(float("-inf")))), F.coalesce(F.col("high").cast("double"), F.lit(float("inf"))))
    shown = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    new = {
        "increment": shown(bound(number + step)),
        "decrement": shown(bound(number - step)),
        "set": shown(bound(F.lit(amount))),
        "reset": shown(F.coalesce(F.col("low").cast("double"), F.lit(0.0))),
        "next": F.pmod(at + 1, n).cast("string"),
        "previous": F.pmod(at - 1, n).cast("string"),
    }
    if action not in new:
        raise ValueError(f"unknown action: {action}")
    return variables.withColumn("value", F.when(F.col("id") == name, new[action]).otherwise(F.col("value")))


def drawn(ranges: DataFrame, used: DataFrame, seed: int, keep: int = 100) -> DataFrame:
    """One random number for each variable from its ranges (id, low, high), none of its last ``keep`` in ``used`` (id,
    value, time). A variable whose numbers are all used draws from all of them."""
    every = ranges.select("id", F.explode(F.sequence("low", "high")).alias("value")).distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("time")))
    recent = used.withColumn("k", place).where(F.col("k") <= keep).select("id", "value", F.lit(1).alias("seen")).distinct()
    order = F.struct(F.coalesce("seen", F.lit(0)), F.xxhash64(F.lit(seed), "id", "value"))
    return every.join(recent, ["id", "value"], "left").groupBy("id").agg(F.min_by("value", order).alias("value"))


def total_size(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("id").agg(F.sum(F.col("high") - F.col("low") + 1).alias("numbers"))

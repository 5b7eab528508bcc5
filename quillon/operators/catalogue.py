"""Facets, sorts, top-k and counts of a catalogue. Ranks are columns, so that no result hangs on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.search import small
from quillon.storage import store


def facet(df: DataFrame, selected: str | None, categories: DataFrame, category: str = "category", locked: str | None = None) -> DataFrame:
    """Rows of a facet: None all, ``locked``, ``unlabeled`` (no category, or one that doesn't exist), or a category."""
    if selected is None:
        return df
    if selected == "locked":
        return df.where(F.coalesce(F.col(locked), F.lit(False)))
    if selected == "unlabeled":
        return df.join(small(categories.select(category).distinct()), category, "left_anti")
    return df.where(F.col(category) == selected)


def allowed(df: DataFrame, access: DataFrame, key: str, level: str = "access") -> DataFrame:
    """Rows whose key isn't marked ``none`` in an access profile."""
    return df.join(small(access.where(F.col(level) == "none").select(key)), key, "left_anti")


def with_all_tags(df: DataFrame, tags: Sequence[str], column: str = "tags") -> DataFrame:
    """Rows that carry every one of the tags; no tags select all."""
    return df.where(F.size(F.array_except(F.array(*map(F.lit, tags)).cast("array<string>"), F.coalesce(column, F.array().cast("array<string>")))) == 0)


def live(df: DataFrame, *flags: str) -> DataFrame:
    """Rows without a tombstone, private or archived flag; a missing flag is false."""
    for f in flags:
        df = df.where(~F.coalesce(F.col(f), F.lit(False)))
    return df


def count_by(df: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Rows of each category, zeros included."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return categories.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def ranked(df: DataFrame, *order: Column, within: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Adds the row's place. Without ``within`` the whole table is put in one order, which is what the caller asks for:
    the sort is a range-partitioned one and places come from partition counts, not from a single-partition window.

    The sorted rows are written first. Two branches of one plan sample and coalesce their own ranges, so the number of
    a partition means the same in both only once it is stored."""
    if within:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    ordered = df.orderBy(*order).withColumn("__p", F.spark_partition_id())
    local = store(ordered.withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)))
    # A row for each partition of the sort.
    sizes = local.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.drop("__n")), "__p").withColumn(rank, (F.col("__before") + F.col("__k") + 1).cast("long")).drop("__p", "__k", "__before")


def top_k(df: DataFrame, k: int, within: Sequence[str], *order: Column) -> DataFrame:
    """The first k of each group; Spark cuts each partition to k before it shuffles."""
    return ranked(df, *order, within=within).where(F.col("rank") <= k)


def name_order(name: str, descending: bool = False) -> list[Column]:
    key = T.natural_key(F.col(name))
    return [key.desc() if descending else key, F.col(name).desc() if descending else F.col(name)]


def number_order(number: str, name: str, descending: bool = False) -> list[Column]:
    """Prefix, number, suffix, name; blanks last in either direction."""
    p = T.number_parts(F.col(number))
    keys = [p["prefix"], p["number"], p["suffix"], F.col(name)]
    return [p["empty"], *(k.desc() if descending else k.asc() for k in keys)]


def file_order(name: str) -> list[Column]:
    p = T.file_parts(F.col(name))
    return [p["stem"], p["number"], p["extension"]]


def catalogue_order(kind: str) -> list[Column]:
    """Sorts by name, name_des, number, created, modified or used; times that are missing fall back to created, then 0."""
    if kind in ("name", "name_des"):
        return name_order("name", kind.endswith("_des"))
    if kind == "number":
        return number_order("number", "name")
    time = F.coalesce(F.nullif(F.col(kind), F.lit(0)) if kind != "created" else F.col(kind), F.col("created"), F.lit(0))
    return [time.desc(), *name_order("name")]


def type_rank(column: str, ranks: Sequence[str]) -> Column:
    """Place of a type in a list; unknown types come last."""
    at = F.array_position(F.array(*map(F.lit, ranks)), F.col(column))
    return F.when(at > 0, at).otherwise(len(ranks) + 1)


def recently_used(df: DataFrame, now: Column, days: int = 5, least: int = 2, used: str = "used") -> DataFrame:
    """Rows used within some days, if there are at least two of them."""
    fresh = df.where(F.col(used) >= now - F.expr(f"interval {days} days"))
    enough = fresh.agg((F.count("*") >= least).alias("__enough"))
    return fresh.join(F.broadcast(enough)).where("__enough").drop("__enough")


def changed_columns(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each key the columns that differ, with keys of one side only listed whole."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    differ = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return a.join(b, key, "full").select(key, differ.alias("changed")).where(F.size("changed") > 0)


def object_equal(a: Column, b: Column) -> Column:
    """Equality of maps whatever the order of their keys."""
    return F.to_json(F.array_sort(F.map_entries(a))) == F.to_json(F.array_sort(F.map_entries(b)))


def keep_order(new: DataFrame, old: DataFrame, key: str, position: str) -> DataFrame:
    """Keys of ``new`` in their old order, those that are new at the end in their own order."""
    joined = new.select(key, F.col(position).alias("__new")).join(old.select(key, F.col(position).alias("__old")), key, "left")
    return ranked(joined, F.col("__old").isNull(), F.coalesce("__old", "__new"), F.col(key), rank="position").select(key, "position")

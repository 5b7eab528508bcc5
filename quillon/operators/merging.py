"""Merge of two copies of a data set by a ledger of creations and deletions.

Both outputs, decisions and the new ledger, come from one full outer join by (store, key); nothing is changed in
place. The ledger has a row for each (store, key): ``deleted`` and ``created`` hold the devices that know of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Run:
    """The device that merges, all devices of the set, and whether it joins now."""

    device: str
    devices: tuple[str, ...]
    new_device: bool = False


def newest(modified: Column, created: Column, fallback: Column) -> Column:
    """Time of the last change: modified, else created, else the file's; 0 is no time."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(modified, zero), F.nullif(created, zero), fallback)


def decide(cloud: DataFrame, local: DataFrame, ledger: DataFrame, run: Run) -> DataFrame:
    """store, key, action, value, created, deleted (the ledger after) for each key of either side.

    ``cloud`` and ``local``: store, key, value, modified; ``ledger``: store, key, created, deleted."""
    me, several = F.lit(run.device), len(run.devices) > 1
    left = cloud.select("store", "key", F.col("value").alias("cloud"), F.coalesce("modified", F.lit(0)).alias("cloud_time"), F.lit(True).alias("in_cloud"))
    right = local.select("store", "key", F.col("value").alias("local"), F.coalesce("modified", F.lit(0)).alias("local_time"), F.lit(True).alias("in_local"))
    rows = left.join(right, ["store", "key"], "full").join(ledger, ["store", "key"], "left")
    created, deleted = F.coalesce("created", F.expr(NONE)), F.coalesce("deleted", F.expr(NONE))
    is_created, is_deleted = F.size(created) > 0, F.size(deleted) > 0
    by_me, gone_by_me = F.array_contains(created, me), F.array_contains(deleted, me)
    new = F.lit(run.new_device)
    only_cloud, only_local = F.col("in_local").isNull(), F.col("in_cloud").isNull()
    newer = F.col("cloud_time") > F.col("local_time")
    action = (
        F.when(only_cloud, F.when(new | (is_created & ~by_me), "create").otherwise("skip"))
        .when(only_local, F.when(~new & is_deleted & ~gone_by_me, "delete").otherwise("upload"))
        .when(is_deleted & ~new, "delete")
        .when(newer, "download")
        .otherwise("upload")
    )
    mark = (
        F.when(only_cloud, F.when(new, "none").when(is_created & ~by_me, "created").otherwise("deleted"))
        .when(only_local, F.when(new, "none").when(is_deleted & ~gone_by_me, "deleted").otherwise("created"))
        .when(is_deleted & ~new, "deleted")
        .when(is_created, "created")
        .otherwise("none")
    )

    def after(kind: str, own: Column, other: str) -> Column:
        added = F.array_union(own, F.array(me)) if several else own
        done = F.when(F.size(added) >= len(run.devices), F.expr(NONE)).otherwise(added) if several else own
        return F.when(F.col("mark") == kind, done).when(F.col("mark") == other, F.expr(NONE)).otherwise(own)

    rows = rows.withColumns({"action": action, "mark": mark})
    value = F.when(F.col("action").isin("create", "download"), F.col("cloud")).when(F.col("action") == "upload", F.col("local"))
    return rows.select("store", "key", "action", value.alias("value"), after("created", created, "deleted").alias("created"), after("deleted", deleted, "created").alias("deleted"))


def merged(decisions: DataFrame) -> DataFrame:
    """What the local copy holds after the merge."""
    return decisions.where(F.col("action").isin("create", "download", "upload")).select("store", "key", "value")


def ledger_after(decisions: DataFrame) -> DataFrame:
    return decisions.where((F.size("created") > 0) | (F.size("deleted") > 0)).select("store", "key", "created", "deleted")


def newest_wins(a: DataFrame, b: DataFrame, key: str, modified: str, tolerance: int = 0) -> DataFrame:
    """One row a key: that of ``b`` only if it is newer by more than ``tolerance``."""
    columns = [c for c in a.columns if c != key]
    left, right = a.select(key, F.struct(*columns).alias("a")), b.select(key, F.struct(*columns).alias("b"))
    both = left.join(right, key, "full")
    take = F.when(F.col("a").isNull() | (F.col(f"b.{modified}") > F.col(f"a.{modified}") + tolerance), F.coalesce("b", "a")).otherwise(F.col("a"))
    return both.select(key, take.alias("x")).select(key, "x.*")


def local_only(local: DataFrame, cloud: DataFrame, *keys: str) -> DataFrame:
    return local.join(cloud.select(*keys), list(keys), "left_anti")


def is_stale(last: int | None, latest: int | None, days: int = 30) -> bool:
    """A copy that is a month behind the latest change may only be read."""
    return last is not None and latest is not None and latest - last > days * 86_400_000


def kept_snapshots(files: DataFrame, group: str, time: str, now: Column, keep: int = 2) -> DataFrame:
    """The newest ``keep`` snapshots, and of the others those older than an hour and younger than fourteen days."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time)))
    age = F.unix_seconds(now) - F.unix_seconds(F.col(time).cast("timestamp"))
    return files.withColumn("__k", k).where((F.col("__k") <= keep) | ((age >= 3600) & (age <= 14 * 86400))).drop("__k")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Change log with images of before and after, as undo and redo need them."""
    columns = [c for c in before.columns if c != key]
    both = before.select(key, F.struct(*columns).alias("before")).join(after.select(key, F.struct(*columns).alias("after")), key, "full")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, kind.alias("kind"), "before", "after")


def undo(state: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The state before the changes of ``log``."""
    old = log.where("kind <> 'insert'").select(key, "before.*")
    return state.join(log.select(key), key, "left_anti").unionByName(old)


def read_only(last: Column, latest: Column, days: int = 30) -> Column:
    """Whether a copy may only be read, as its last merge lies that many days or more behind the latest change of the set."""
    return F.coalesce(F.unix_seconds(latest) - F.unix_seconds(last) >= days * 86_400, F.lit(False))

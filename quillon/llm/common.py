"""What the operators share: tables written to the shared folder, row ids, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.storage import drop, scratch, store

__all__ = ["components", "drop", "local_roots", "numbered", "scratch", "store", "text_of", "unused"]


def numbered(df: DataFrame, rid: str = "rid") -> DataFrame:
    """Add a row number that is unique, not dense. Only stable once stored."""
    return df.withColumn(rid, F.monotonically_increasing_id())


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column's name."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over edges a-b, on top of ``roots`` already known."""
    roots = np.arange(n) if roots is None else roots
    while len(a):
        x, y = roots[a], roots[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
    return roots


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, as (node, root), for every node of ``edges`` (a long, b long) that isn't a root.

    Each round every node hooks onto its smallest smaller neighbour, the trees are flattened by pointer jumping,
    and the edges are rewritten between roots, so that the edges shrink to none in a logarithmic number of rounds.
    A star of any size is one round; its centre is met by joins whose large side adaptive execution may split.
    """
    a, b = F.col("a"), F.col("b")
    left = store(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    rounds: list[DataFrame] = []
    held: list[DataFrame] = []
    while not left.isEmpty():
        up = store(left.groupBy("a").agg(F.min("b").alias("p")))
        held += [left, up]
        while True:
            y = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = store(up.join(y, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            if jumped.where("moved").isEmpty():
                drop(jumped)
                break
            held.append(jumped)
            up = jumped.drop("moved")
        rounds.append(up)
        at_b = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(up.withColumnRenamed("p", "pa"), "a").join(at_b, "b", "left").select(F.col("pa"), F.coalesce("pb", "b").alias("pb"))
        left = store(moved.where("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = None
    for k, up in enumerate(rounds):
        for later in rounds[k + 1 :]:
            step = later.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(step, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        out = up if out is None else out.unionByName(up)
    found = store(out.select(F.col("a").alias("node"), F.col("p").alias("root")))
    drop(*held, left)
    return found


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))

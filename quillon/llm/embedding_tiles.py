"""Embedding near-duplicates: PCA-ordered tiled comparison of all vectors by cosine.

Unit vectors are turned into the basis of their principal components (fitted on a bounded sample; the basis only
changes speed, never a result). Rows are range-partitioned by the leading component, sorted by the second within each
part, and packed into strips of about ``strip`` rows that know their range in each of some leading components. A pair of
strips meets in one task, unless their boxes lie too far apart for the threshold: unit vectors of cosine t are
sqrt(2 - 2 t) apart at most, in any of the dimensions together. The pairs are found by a join of the strips' boxes on
steps of the leading component, so the driver holds none of them. In a task, the leading dimensions are
multiplied first; what is left of the product is bounded by the product of the suffix norms, and pairs that can't
reach the threshold stop there. The rest is compared over more dimensions, then in double precision on the
original unit vectors, which alone decides.

Equal vectors are compared once, with a number of times, and linked among themselves. A task never sends its pairs: it
sends a count for each row and a spanning set of links. So memory and rows are bounded by the strip, whatever the
size of a group of copies.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
vectors of different lengths don't link. Rows with equal ids are vectors of their own; a null id is never a
component's id unless all are null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import components, drop, local_roots, numbered, store

SLACK = 1e-4


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def basis(sample: list) -> np.ndarray:
    """Principal axes of unit vectors, the widest first, as columns."""
    x = unit(sample)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


class Strip:
    """Unit vectors, their turned form in single precision, and the norms of what follows each stage."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        d = x.shape[1]
        self.x, turned = x, (x @ axes)
        self.stages = sorted({max(1, d // 4), max(1, d // 2), d})
        rest = np.sqrt(np.maximum(0, 1 - np.cumsum(turned**2, axis=1)))
        first = self.stages[0]
        self.lead = np.concatenate([turned[:, :first], rest[:, first - 1 : first]], axis=1).astype(np.float32)
        self.turned, self.rest = turned.astype(np.float32), rest.astype(np.float32)


def compare(a: Strip, b: Strip, least: float, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs with a cosine of at least ``least``, tile by tile; of a strip with itself, i < j."""
    same = a is b
    for lo in range(0, len(a.x), tile):
        for lo2 in range(lo if same else 0, len(b.x), tile):
            near = a.lead[lo : lo + tile] @ b.lead[lo2 : lo2 + tile].T >= least - SLACK
            i, j = np.nonzero(near)
            i, j = i + lo, j + lo2
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                for upto in a.stages[1:-1]:
                    dot = np.einsum("ij,ij->i", a.turned[p, :upto], b.turned[q, :upto])
                    fine = dot + a.rest[p, upto - 1] * b.rest[q, upto - 1] >= least - SLACK
                    p, q = p[fine], q[fine]
                fine = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= least
                yield p[fine], q[fine]


def meetings(packs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of packs, a <= b, whose boxes (d, low, high) are in reach of each other."""
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    step = max(reach, 1e-3)
    boxes = packs.select("pack", "d", "low", "high")
    cell = lambda c, by=0.0: F.floor((c + by) / step)
    one = boxes.select(F.col("pack").alias("a"), "d", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
    two = boxes.select(F.col("pack").alias("b"), "d", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell(F.col("low")[0], -reach), cell(F.col("high")[0], reach))).alias("cell"))
    gaps = F.transform(F.arrays_zip("low_a", "high_a", "low_b", "high_b"), lambda x: F.greatest(F.lit(0.0), x["low_a"] - x["high_b"], x["low_b"] - x["high_a"]))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return one.join(two, ["d", "cell"]).where((F.col("a") <= F.col("b")) & (far <= reach * reach)).select("a", "b").distinct()


def near_links(vectors: DataFrame, least: float = 0.9, strip: int = 8192, sample: int = 4096, lead: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    base = store(numbered(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = base.where(F.col("v").isNotNull() & (F.size("v") > 0) & whole & F.exists("v", lambda x: x != 0))
    few: dict[int, list] = {}
    for row in fit.orderBy(F.xxhash64("rid")).limit(sample).select("v").collect():
        few.setdefault(len(row.v), []).append(row.v)
    shared = {d: basis(x) for d, x in few.items()}

    def axes(d: int) -> np.ndarray:
        return shared[d] if d in shared else np.eye(d)

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby(frame["v"].map(len)):
                x = unit(part["v"].tolist())
                y = x @ axes(d)[:, :lead]
                raw = [r.tobytes() for r in x]
                yield pd.DataFrame({"rid": part["rid"].to_numpy(), "d": int(d), "first": y[:, 0], "second": y[:, min(1, d - 1)], "h": [hashlib.md5(r).digest() for r in raw], "x": raw})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Neighbours of one length by ``strip`` rows, over the batches' ends."""
        held: list[pd.DataFrame] = []

        def packed() -> pd.DataFrame:
            rows = pd.concat(held)
            d = int(rows["d"].iloc[0])
            raw = b"".join(rows["x"])
            y = np.frombuffer(raw).reshape(-1, d) @ axes(d)[:, :lead]
            return pd.DataFrame({"d": [d], "low": [y.min(0)], "high": [y.max(0)], "n": [len(rows)], "ids": [rows["rid"].to_numpy(np.int64).tobytes()], "times": [rows["m"].to_numpy(np.int64).tobytes()], "x": [raw]})

        for frame in frames:
            for d, part in frame.groupby("d"):
                if held and held[0]["d"].iloc[0] != d:
                    yield packed()
                    held = []
                while len(part):
                    room = strip - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held)) == strip:
                        yield packed()
                        held = []
        if held:
            yield packed()

    turned = store(fit.select("rid", "v").mapInPandas(turn, "rid long, d int, first double, second double, h binary, x binary"))
    # Equal vectors are one row with a number of times; partial sums come first, so their number is no task's.
    same = store(turned.groupBy("h").agg(F.min(F.struct("rid", "d", "first", "second", "x")).alias("r"), F.count("*").alias("m")))
    copies = store(turned.select("rid", "h").join(same.select("h", F.col("r.rid").alias("to"), "m"), "h").select("rid", "to", "m"))
    alone = same.select("r.*", "m")
    drop(turned)
    strips = max(1, -(-alone.count() // strip))
    # Parts as wide in the first component as strips are in the second.
    ordered = alone.repartitionByRange(max(1, round(strips**0.5)), "d", "first", "rid").sortWithinPartitions("d", "second")
    packs = store(numbered(ordered.mapInPandas(pack, "d int, low array<double>, high array<double>, n long, ids binary, times binary, x binary"), "pack"))
    # Small neighbours are one strip, as many as there may be: the places come from running counts over a row a pack.
    before = F.sum("n").over(Window.partitionBy("d").orderBy(F.col("low")[0], "pack"))
    placed = store(packs.select("pack", "d", "low", "high", (F.col("d").cast("long") * (1 << 40) + F.floor((before - 1) / strip)).alias("strip")))
    edge = lambda f, c: F.array(*(f(F.get(c, F.lit(k))) for k in range(lead))).alias(c)
    boxes = placed.groupBy(F.col("strip").alias("pack"), "d").agg(edge(F.min, "low"), edge(F.max, "high"))
    plan = store(meetings(boxes, least))
    sides = plan.select("a", "b", F.col("a").alias("strip"), F.lit(False).alias("second")).unionByName(plan.where("a != b").select("a", "b", F.col("b").alias("strip"), F.lit(True).alias("second")))

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        d = int(frame["d"].iloc[0])

        def side(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Strip]:
            ids, times = (np.frombuffer(b"".join(part[c]), dtype=np.int64) for c in ("ids", "times"))
            return ids, times, Strip(np.frombuffer(b"".join(part["x"])).reshape(-1, d), axes(d))

        ids, times, one = side(frame[~frame["second"]])
        two, n_one = one, len(ids)
        if key[0] != key[1]:
            more, more_times, two = side(frame[frame["second"]])
            ids, times = np.concatenate([ids, more]), np.concatenate([times, more_times])
        at = 0 if two is one else n_one
        hits, roots = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i, j in compare(one, two, least):
            np.add.at(hits, i, times[j + at])
            np.add.at(hits, j + at, times[i])
            roots = local_roots(len(ids), i, j + at, roots)
        found = np.flatnonzero(hits)
        return pd.DataFrame({"rid": ids[found], "n": hits[found], "to": ids[roots[found]]})

    # A task has some pairs of strips only, as comparing them takes the time, not moving them.
    pairs = packs.join(placed.select("pack", "strip"), "pack").join(sides, "strip").repartition(max(1, -(-plan.count() // 2)), "a", "b")
    met = store(pairs.groupBy("a", "b").applyInPandas(meet, "rid long, n long, to long"))
    found = components(met.where("rid != to").select(F.col("rid").alias("a"), F.col("to").alias("b")))
    counts = met.select(F.col("rid").alias("to"), "n", F.lit(None).cast("long").alias("root"))
    of_rep = counts.unionByName(found.select(F.col("node").alias("to"), F.lit(0).cast("long").alias("n"), "root")).groupBy("to").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
    of_copy = copies.join(of_rep, "to", "left").select("rid", F.coalesce("root", "to").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    named = store(base.select("rid", "vec_id").join(of_copy, "rid", "left").select("vec_id", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least_id = store(named.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    return named.join(least_id, "root").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: The same over all pairs, for small tables: links by cosine, reach by recursion.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE a = v.vec_id) AS n_links, min(t) AS component_id, min(t) = v.vec_id AS kept FROM v JOIN r ON r.s = v.vec_id GROUP BY v.vec_id
"""

"""Shingle sets of a Jaccard similarity of 4/5 or more: prefix filtering as a complete candidate search.

All sets are put in one order of shingles, rare ones first. Two sets of similarity 4/5 or more share a shingle among
the first n // 5 + 1 of each, so whatever is in range meets at a shingle. Frequent shingles are known from partial
counts and at most ``HOT`` of them reach the driver; the order is the same for all sets whatever the counts are, so
they decide about time only.

Each set is first compared with some sets of every shingle it shares (``CENTRES``, by hash), which joins a large group by
links that grow with its size. Then all pairs of a shingle whose sets are not joined yet are compared. A candidate is
dropped by a sketch of each set, which the caller brings with the test of two sketches, and linked only if the sets of
both texts say so. A shingle of over ``BLOCK`` sets is dealt out over shards: each holds some of them and streams the
others past, so no task holds an unbounded group and none is dropped.

Defined results: texts of equal sets (those without words too) are one group. A set of under four shingles has no
other set in range. Rows are known by their row id, so null and repeated doc_ids are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, drop, store

#: Frequent shingles that the order knows, at most.
HOT = 1 << 17
#: Sets of a shingle that each of its sets is compared with first, and sets that one shard of a shingle holds.
CENTRES, BLOCK = 4, 2048
#: Ids that are broadcast, at most (eight bytes each); beyond they are merged.
FEW = 1_000_000

Sketch = Callable[[np.ndarray], bytes]
Test = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size`` words in a row, ASCII lower-cased; of all words if there are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line, ends, at = b" ".join(w), [], 0
    for x in w:
        at += len(x)
        ends.append(at)
        at += 1
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: len(w) - size])]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)), dtype=np.uint64, count=len(starts))


def pairs_of(n_held: np.ndarray, at_held: np.ndarray, n_other: np.ndarray, at_other: np.ndarray, most_pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (group, held row, other row) of groups given by sizes and first rows, in pieces of bounded size."""
    sizes = n_held * n_other
    order = np.concatenate(([0], np.cumsum(sizes)))
    for lo in range(0, int(order[-1]), most_pairs):
        x = np.arange(lo, min(lo + most_pairs, int(order[-1])))
        g = np.searchsorted(order, x, side="right") - 1
        r = x - order[g]
        yield g, at_held[g] + r // n_other[g], at_other[g] + r % n_other[g]


def shingles(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def in_range(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets of 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def scanned(rows: DataFrame, rid: str, size: int, sketch: Sketch, piece: int = 1 << 20) -> DataFrame:
    """One pass over the texts. For each row: rid, doc_id, digest (of the set), n, sketch. And rows without a rid: token,
    times of the shingles that are frequent within pieces of the input."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0

        def counted() -> pd.DataFrame:
            token, times = np.unique(np.concatenate(kept), return_counts=True)
            return pd.DataFrame({"token": token[times > 2].view(np.int64), "times": times[times > 2]})

        def shown(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.reindex(columns=["rid", "doc_id", "digest", "n", "sketch", "token", "times"]).astype({c: "Int64" for c in ("rid", "n", "token", "times")} | {c: object for c in ("doc_id", "digest", "sketch")})
            return frame.where(frame.notna(), None)

        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                each = [shingles(x, size) for x in part["text"]]
                yield shown(pd.DataFrame({"rid": part["rid"], "doc_id": part["doc_id"], "digest": [hashlib.sha256(x.tobytes()).digest() for x in each], "n": [len(x) for x in each], "sketch": [sketch(x) for x in each]}))
                kept += each
                n += sum(map(len, each))
                if n >= piece:
                    yield shown(counted())
                    kept, n = [], 0
        if n:
            yield shown(counted())

    own = rows.select(F.col(rid).alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = own.mapInPandas(run, "rid long, doc_id string, digest binary, n long, sketch binary, token long, times long")
    return store(made.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType)))


def frequent(scan: DataFrame, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a scan, ``HOT`` at most, sorted, and their counts there."""
    counts = store(scan.where("rid is null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= least))
    level = F.floor(F.log2("times")).cast("int")
    above, floor = 0, 64
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        above += r.n
        if above > HOT:
            break
        floor = r.level
    top = counts.where(level >= floor).toPandas().sort_values("token")
    drop(counts)
    return top["token"].to_numpy(np.int64), top["times"].to_numpy(np.int64)


def postings(held: DataFrame, size: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, node, n, pos of the shingles in the prefix of each set of four or more."""
    tokens, times = hot

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 256):
                part, out = frame.iloc[lo : lo + 256], []
                for node, text in zip(part["node"], part["text"], strict=True):
                    own = shingles(text, size).view(np.int64)
                    n = len(own)
                    if n < 4:
                        continue
                    rank = np.zeros(n, dtype=np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        rank = np.where(tokens[at] == own, times[at], 0)
                    first = own[np.lexsort((own, rank))[: n // 5 + 1]]
                    out.append((first, np.full(len(first), node), np.full(len(first), n), np.arange(len(first))))
                if out:
                    yield pd.DataFrame(dict(zip(("token", "node", "n", "pos"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return held.select("node", "text").mapInPandas(run, "token long, node long, n long, pos long")


def words_of(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype="<u8").reshape(len(sketches), -1)


def across(lists: DataFrame, test: Test) -> DataFrame:
    """Pairs (a, b) of different groups at a token that pass the test, of rows token, node, n, pos, part, sketch."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("held"))
    hot = store(sizes.where(F.col("held") > BLOCK).select("token", F.ceil(F.col("held") / BLOCK).cast("int").alias("shards")))
    columns = ["node", "n", "pos", "part", "sketch"]
    if hot.isEmpty():
        dealt = lists.select("token", F.lit(0).alias("shard"), F.lit(False).alias("other"), *columns)
    else:
        every = lists.join(hot, "token", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        own = every.select("token", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), F.lit(False).alias("other"), *columns)
        past = every.where("shards > 1").select("token", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("other"), *columns)
        dealt = own.unionByName(past)
    dealt = dealt.repartition("token", "shard").sortWithinPartitions("token", "shard", "other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lists arrive in order, held rows first; of the list at a batch's end only the held rows are carried."""
        carried: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            n_old = 0 if carried is None else len(carried)
            if n_old:
                frame = pd.concat([carried, frame], ignore_index=True)
            token, shard, node, n, pos, part = (frame[c].to_numpy(np.int64) for c in ("token", "shard", "node", "n", "pos", "part"))
            held, words = ~frame["other"].to_numpy(dtype=bool), words_of(frame["sketch"])
            new = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (shard[1:] != shard[:-1]))))
            size = np.diff(np.concatenate((new, [len(token)])))
            n_held = np.add.reduceat(held.astype(np.int64), new)
            # Held rows carried over have met each other already, so only rows that are new take part as the second.
            first = np.maximum(new, n_old)
            n_second = np.maximum(new + size - first, 0)
            use = (n_held > 0) & (n_second > 0)
            for _, i, j in pairs_of(n_held[use], new[use], n_second[use], first[use], 1 << 18):
                ahead = (i < j) & (part[i] != part[j])
                i, j = i[ahead], j[ahead]
                fine = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j]))
                i, j = i[fine], j[fine]
                fine = test(words[i], words[j], n[i], n[j])
                if fine.any():
                    x, y = node[i[fine]], node[j[fine]]
                    yield pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)}).drop_duplicates()
            carried = frame.iloc[new[-1] : new[-1] + n_held[-1]].reset_index(drop=True)

    return dealt.mapInPandas(run, "a long, b long").distinct()


def with_few(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids``: broadcast up to ``FEW`` of them, counted first, else merged."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), column, "left_semi")


def both(pairs: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the columns of each node."""
    for x in ("a", "b"):
        pairs = pairs.join(held.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)).hint("merge"), x)
    return pairs


def passing(pairs: DataFrame, reps: DataFrame, test: Test) -> DataFrame:
    """The pairs (a, b) whose sketches pass the test."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                fine = test(words_of(frame["sketch_a"]), words_of(frame["sketch_b"]), frame["n_a"].to_numpy(np.int64), frame["n_b"].to_numpy(np.int64))
                yield frame.loc[fine, ["a", "b"]]

    return store(both(pairs, reps, "n", "sketch").mapInPandas(run, "a long, b long"))


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets are in range. Only texts of a pair are moved."""

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fine = [in_range(shingles(x, size), shingles(y, size)) for x, y in zip(frame["text_a"], frame["text_b"], strict=True)]
            yield frame.loc[fine, ["a", "b"]]

    nodes = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    found = store(both(pairs, with_few(texts, nodes, "node"), "text").mapInPandas(exact, "a long, b long"))
    drop(nodes, pairs)
    return found


def kept(rows: DataFrame, rid: str, size: int, sketch: Sketch, test: Test) -> DataFrame:
    """The row id (as ``rid``) of one row of each group: the smallest doc_id, null last, then the smallest row id.

    ``rows`` is stored, as it is read several times."""
    scan = scanned(rows, rid, size, sketch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("rid").alias("node"), "n", "sketch")
    reps = store(scan.where("rid is not null").groupBy("digest").agg(F.min(order).alias("r")).select("r.*"))
    hot = frequent(scan)
    drop(scan)
    texts = rows.select(F.col(rid).alias("node"), "text")
    listed = store(postings(texts.join(reps.where("n >= 4").select("node").hint("merge"), "node", "left_semi"), size, hot))
    # The smallest node of each class by hash, so that lists of much the same sets have the same few centres.
    nth = [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(CENTRES)) == k, F.col("node"))).alias(f"c{k}") for k in range(CENTRES)]
    lists = store(listed.groupBy("token").agg(F.count("*").alias("times"), *nth).where("times > 1").select("token", F.array_compact(F.array(*(f"c{k}" for k in range(CENTRES)))).alias("centres")))
    shared = store(listed.join(lists.hint("merge"), "token"))
    drop(listed, lists)
    met = shared.select("node", F.explode("centres").alias("c")).where("node != c")
    stars = met.select(F.greatest("node", "c").alias("a"), F.least("node", "c").alias("b")).distinct()
    links = verified(passing(stars, reps, test), texts, size)
    grouped = components(links)
    parts = shared.select("token", "node", "n", "pos").join(grouped.withColumnRenamed("root", "part").hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = store(parts)
    drop(shared, grouped)
    mixed = store(parts.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("token"))
    left = with_few(parts, mixed, "token").join(reps.select("node", "sketch").hint("merge"), "node")
    more = verified(store(across(left, test)), texts, size)
    drop(parts, mixed)
    grouped = components(links.unionByName(more))
    named = reps.select("none", "doc_id", "node").join(grouped.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = store(named.groupBy("root").agg(F.min(F.struct("none", "doc_id", "node")).alias("r")).select(F.col("r.node").alias(rid)))
    drop(reps, links, more, grouped)
    return found

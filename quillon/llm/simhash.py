"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into segments that stand in a ring. If two fingerprints differ in at most ``most`` bits, then
some segment starts a chain in which each first l segments differ in at most l * most / segments bits (the
pigeonring principle). Chains of two segments make the lookup keys: the first equal, the second within its budget.
What shares a key is compared chain by chain, then in full, in blocks of numpy words.

Only distinct fingerprints are compared, so a group of exact copies is one row. Within a key only a spanning set
of links leaves the task, and a key with more than ``block`` fingerprints is dealt out over shards: each shard
holds ``block`` of them and streams the others past, so no task holds an unbounded group and none is dropped.

:func:`similar_kept` is the form for a similarity of texts: fingerprints of 256 bits, chains and the full distance prune
candidate pairs that share a rare shingle, and the shingle sets of both texts decide. A distance alone can't, as one
that keeps every pair of similarity 0.8 also holds pairs of 0.6.

Defined results: a text without words (null too) has fingerprint zero and links like any other. A null doc_id keeps
its row; it never becomes a component_id unless all ids of the component are null. Rows with the same id are rows
of their own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, local_roots, store
from quillon.llm.shingle_sets import kept, pairs_of, shingle_hashes


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Majority of each bit, as words of eight big-endian bytes; bits beyond 64 come from further mixes of each hash."""
    if not len(hashes):
        return bytes(bits // 8)
    out = b""
    for k in range(bits // 64):
        x = hashes
        if k:
            x = x + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        each = np.zeros(64, dtype=np.int64)
        for part in range(0, len(x), 1 << 16):
            each += np.unpackbits(x[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out += np.packbits(each * 2 > len(x), bitorder="little").tobytes()[::-1]
    return out


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id (as a string), fp (binary, 8 bytes), id (long, the same bits) for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = [fingerprint(shingle_hashes(x, size)) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": fps, "id": [int.from_bytes(x, "big", signed=True) for x in fps]})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, fp binary, id long")


def cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    edges = [bits * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def unpacked(fps: pd.Series, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(-1, words)


def ring_keys(fps: np.ndarray, most: int, segments: int, probes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row numbers, keys, probe) for 64-bit fingerprints. A key is chain start, first segment, second segment;
    probes have one bit of the second flipped, if the chain's budget of 2 * most // segments allows a difference."""
    parts = cuts(64, segments)
    rows = np.arange(len(fps))
    budget = 2 * most // segments
    for k, (at, width) in enumerate(parts):
        at2, width2 = parts[(k + 1) % segments]
        one = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        two = (fps >> np.uint64(at2)) & np.uint64((1 << width2) - 1)
        base = (np.uint64(k) << np.uint64(58)) | (one << np.uint64(width2)) | two
        yield rows, base, False
        if probes and budget >= 1:
            for bit in range(width2):
                yield rows, base ^ np.uint64(1 << bit), True


def in_ring(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int, segments: int) -> np.ndarray:
    """True where the chain from segment ``start`` keeps each of its first l segments within l * most / segments."""
    parts = cuts(64, segments)
    masks = np.array([((1 << w) - 1) << at for at, w in parts], dtype=np.uint64)
    differ, total, fine = a ^ b, np.zeros(len(a), dtype=np.int64), np.ones(len(a), dtype=bool)
    for length in range(1, segments + 1):
        total += np.bitwise_count(differ & masks[(start + length - 1) % segments])
        fine &= total * segments <= length * most
    return fine


def ring_of_words(differ: np.ndarray, most: int, chain: int = 4) -> np.ndarray:
    """True where some chain of ``chain`` bytes of the differing bits (rows of 64-bit words) keeps each of its first l
    bytes within l * most / bytes: by the pigeonring principle none of ``most`` differing bits or fewer fails."""
    bits = np.bitwise_count(np.ascontiguousarray(differ).view(np.uint8)).astype(np.int32)
    segments = bits.shape[1]
    total, fine = np.zeros_like(bits), np.ones(bits.shape, dtype=bool)
    for length in range(1, chain + 1):
        total += np.roll(bits, 1 - length, axis=1)
        fine &= total * segments <= length * most
    return fine.any(axis=1)


def links(distinct: DataFrame, most: int, segments: int = 5, block: int = 2048) -> DataFrame:
    """Spanning links (a, b: ids) of the rows (id long, fp binary) of ``distinct`` that lie within ``most`` bits."""

    def keys(frames: Iterator[pd.DataFrame], probes: bool = True) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 4096):
                part = frame.iloc[lo : lo + 4096]
                fps = unpacked(part["fp"], 1)
                ids, raw = part["id"].to_numpy(), part["fp"].to_numpy()
                for rows, key, probe in ring_keys(fps[:, 0], most, segments, probes):
                    yield pd.DataFrame({"key": key.view(np.int64), "probe": probe, "id": ids[rows], "fp": raw[rows]})

    def held_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (x[["key"]] for x in keys(frames, probes=False))

    keyed = distinct.mapInPandas(keys, "key long, probe boolean, id long, fp binary")
    sizes = distinct.mapInPandas(held_keys, "key long").groupBy("key").agg(F.count("*").alias("held"))
    hot = store(sizes.where(F.col("held") > block).select("key", F.ceil(F.col("held") / block).cast("int").alias("shards")))
    if hot.isEmpty():
        dealt = keyed.withColumn("shard", F.lit(0)).withColumn("other", F.col("probe"))
    else:
        # Rows of a hot key: held in one shard by id, and past every shard.
        every = keyed.join(hot, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        own = every.where("not probe").select("key", (F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int").alias("shard"), F.lit(False).alias("other"), "id", "fp")
        past = every.where("probe or shards > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("other"), "id", "fp")
        dealt = own.unionByName(past)
    dealt = dealt.select("key", "shard", "other", "id", "fp").repartition("key", "shard").sortWithinPartitions("key", "shard", "other")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups arrive in order, held rows first; of the group at a batch's end only the held rows are carried."""
        carried: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            if carried is not None and len(carried):
                frame = pd.concat([carried, frame], ignore_index=True)
            n_old = 0 if carried is None else len(carried)
            fps = unpacked(frame["fp"], 1)[:, 0]
            ids, key, shard = frame["id"].to_numpy(), frame["key"].to_numpy(), frame["shard"].to_numpy()
            other = frame["other"].to_numpy(dtype=bool)
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))))
            n = np.diff(np.concatenate((new, [len(key)])))
            n_held = np.add.reduceat((~other).astype(np.int64), new)
            start = (key[new].view(np.uint64) >> np.uint64(58)).astype(np.int64)
            # Held rows carried over have met each other already, so only rows that are new take part as the second.
            first = np.maximum(new, n_old)
            n_second = np.maximum(new + n - first, 0)
            use = (n_held > 0) & (n_second > 0)
            roots = np.arange(len(ids))
            for g, i, j in pairs_of(n_held[use], new[use], n_second[use], first[use]):
                ahead = i < j
                g, i, j = g[ahead], i[ahead], j[ahead]
                fine = in_ring(fps[i], fps[j], start[use][g], most, segments)
                i, j = i[fine], j[fine]
                fine = np.bitwise_count(fps[i] ^ fps[j]) <= most
                roots = local_roots(len(ids), i[fine], j[fine], roots)
            moved = np.flatnonzero((roots != np.arange(len(ids))) & (ids != ids[roots]))
            if len(moved):
                yield pd.DataFrame({"a": ids[moved], "b": ids[roots[moved]]}).drop_duplicates()
            carried = frame.iloc[new[-1] : new[-1] + n_held[-1]].reset_index(drop=True)

    return dealt.mapInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, size: int = 4, most: int = 4, segments: int = 5, block: int = 2048) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``: components over links of fingerprints within ``most`` bits."""
    kind = docs.schema["doc_id"].dataType
    rows = store(fingerprints(docs, size).withColumn("doc_id", F.col("doc_id").cast(kind)))
    distinct = store(rows.groupBy("fp", "id").agg(F.min("doc_id").alias("doc_id")))
    found = components(links(distinct.select("id", "fp"), most, segments, block))
    named = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = store(named.join(least, "root").select("fp", "component_id"))
    return rows.join(of, "fp")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, highest byte first), component_id."""
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Bits of the fingerprints and the largest distance of a candidate, and bits of the parity sketch.
WIDE, WIDE_MOST, PARITY = 256, 64, 512


def sketch(shingles: np.ndarray) -> bytes:
    """Fingerprint of ``WIDE`` bits and parities of the number of shingles in ``PARITY`` buckets, in one."""
    parity = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return fingerprint(shingles, WIDE) + np.packbits(parity.astype(np.uint8)).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """False for pairs of sketches (rows of words) and set sizes that aren't of similarity 4/5.

    Chains of the fingerprints, then their full distance, then the parities: they differ in at most as many buckets as
    there are shingles of one set alone, which is a ninth of both sizes at most. Sets under 32 shingles are too short for a
    distance of fingerprints to tell and go by the parities."""
    words = WIDE // 64
    fine = 9 * np.minimum(n_a, n_b) >= 4 * (n_a + n_b)
    at = np.flatnonzero(fine)
    differ = a[at] ^ b[at]
    long_ = np.minimum(n_a[at], n_b[at]) >= 32
    near = ~long_ | ring_of_words(differ[:, :words], WIDE_MOST)
    near[near] = ~long_[near] | (np.bitwise_count(differ[near][:, :words]).sum(1, dtype=np.int64) <= WIDE_MOST)
    near &= 9 * np.bitwise_count(differ[:, words:]).sum(1, dtype=np.int64) <= n_a[at] + n_b[at]
    fine[at] = near
    return fine


def similar_kept(rows: DataFrame, rid: str, size: int = 5) -> DataFrame:
    """The row id (as ``rid``) of one row of each group of rows of word-shingle similarity 0.8 or more and what that
    joins: the smallest doc_id, null last, then the smallest row id.

    Candidates share a shingle of their rare ones (see ``shingle_sets``), which misses no pair. The fingerprints' chains and
    distance prune them; a pair of similarity 0.8 differs in 39 of 256 bits on average, with a deviation of 6, so one over
    64 is a matter of some in a million. What is left is decided by the sets."""
    return kept(rows, rid, size, sketch, may_be_similar)

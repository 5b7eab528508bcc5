"""Suffix-array deduplication: bytes under a ``width``-byte string that starts anywhere else too are removed.

Suffixes whose first ``width`` bytes are equal must meet in one task. For that each window of ``width`` bytes is
given an anchor: of the ``GRAM``-byte strings inside it, the one with the smallest rolling hash (the leftmost, if
equal). Equal windows have equal anchors at equal places, so windows are compared within an anchor's hash only, and
the anchors of most of a corpus occur once and end there. The windows that share an anchor stand next to each
other and form its context, some ``2 * width`` bytes.

Contexts of a repeated anchor are made distinct first (a passage copied a million times is one row). A task then
takes contexts by the million bytes, sorts their suffixes to a depth of ``width`` bytes by prefix doubling, and
builds the arrays of longest previous and longest next factors: in suffix order, the nearest suffix on either side
that starts earlier (or later) shares the longest prefix with it of all that do. Bytes decide there; hashes only
choose what meets. A window is repeated if one of its two factors is as long as it is.

An anchor with more than ``warm`` distinct contexts is told apart further: its windows reach ``GRAM`` bytes or more
beyond it on one side, so the part of a context with the windows that reach to the left meets only parts with the
same bytes there, and so on the right. Parts that are equal are one row again. If more than ``hot`` distinct parts
still meet, their windows are grouped by their bytes with partial sums, so no task takes an unbounded group.

All sides of the joins grow with the corpus, so they are sort-merged at every size.

A text that occurs twice or more as a whole is removed as a whole and is represented once in all of this.

Defined results: texts are UTF-8 bytes, null is empty; matches never cross texts; texts shorter than ``width`` stay.
Rows of the same text are places of their own. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import store

GRAM = 64
#: An odd multiplier and its inverse, for rolling hashes in arithmetic modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 22
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, kept for the next call."""
    if len(_powers.get(base, ())) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        _powers[base] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, base, np.uint64))), dtype=np.uint64)
    return _powers[base][:n]


def _scatter() -> np.ndarray:
    """A fixed odd-looking 64-bit value for each byte."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


SCATTER = _scatter()


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each ``gram`` bytes in a row."""
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(SCATTER[data] * _power(BASE, n), dtype=np.uint64)))
    h = (sums[gram:] - sums[:-gram]) * _power(INVERSE, n)[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` values in a row, from running minima of blocks of ``w`` in both directions."""
    n = len(x)
    full = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text's number, hash, first window, number of windows, place behind the first window's start) of each anchor;
    windows count from their text's start."""
    lengths = np.array([len(x) for x in texts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none.astype(np.uint64), none, none, none
    h = rolling(data, GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1) & mask
    owner = np.repeat(np.arange(len(texts)), lengths)
    valid = owner[: len(place)] == owner[width - 1 : width - 1 + len(place)]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none
    at, who = place[starts].astype(np.int64), owner[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (who[1:] != who[:-1]))))
    first, who = starts[new], who[new]
    return who, h[at[new]], first - (ends[who] - lengths[who]), np.diff(np.concatenate((new, [len(starts)]))), at[new] - first


def batches(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbours of ``most`` bytes together, with the number of the first; places of a batch fit PLACE_BITS.

    The caller cuts texts that are too long for that."""
    at, held, own = 0, 0, []
    for k, x in enumerate(texts):
        own.append(x)
        held += len(x)
        if held >= most:
            yield at, own
            at, held, own = k + 1, 0, []
    if own:
        yield at, own


def all_anchors(texts: list[bytes], width: int, most: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """As :func:`anchors` for texts of any length: long ones are taken in parts whose windows join without a gap."""
    parts, number, start = [], [], []
    for k, x in enumerate(texts):
        for at in range(0, max(1, len(x) - width + 1), most):
            parts.append(x[at : at + most + width - 1])
            number.append(k)
            start.append(at)
    number, start = np.array(number, dtype=np.int64), np.array(start, dtype=np.int64)
    found = [(who + at, *rest) for at, own in batches(parts, most) for who, *rest in (anchors(own, width),)]
    if not found:
        return anchors([], width)
    who, h, first, n, off = (np.concatenate(x) for x in zip(*found, strict=True))
    return number[who], h, first + start[who], n, off


def suffix_ranks(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Rank of the suffix at each place by its first ``width`` bytes (at least 8, padded with zeros at the end); the first
    eight bytes as a number; and the ranks by 8, 16, 32, ... bytes."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(2 * width + 8, np.uint8))).astype(np.uint64)
    m = n + 2 * width
    key = np.zeros(m, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + m]

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        inorder = key[order]
        rank = np.empty(len(key), dtype=np.uint32)
        rank[order] = np.cumsum(np.concatenate(([0], inorder[1:] != inorder[:-1]))).astype(np.uint32)
        return rank

    rank, depth, levels = ranked(key), 8, {}
    while depth < width:
        levels[depth] = rank
        step = min(depth, width - depth)
        rank = ranked((rank[: len(rank) - step].astype(np.uint64) << np.uint64(32)) | rank[step:])
        depth += step
    return rank[:n], key, levels


def common_prefix(key: np.ndarray, levels: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Bytes that the suffixes at ``i`` and ``j`` share at their start, counted up to ``width``."""
    shared = np.zeros(len(i), dtype=np.int64)
    for depth in sorted(levels, reverse=True):
        shared += np.where(levels[depth][i + shared] == levels[depth][j + shared], depth, 0)
    differ = key[i + shared] ^ key[j + shared]
    for k in range(8):
        shared += differ < np.uint64(1) << np.uint64(8 * k)
    return np.minimum(shared, width)


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest one before it that is smaller, or -1: pointers jump over what is larger."""
    n = len(x)
    at = np.arange(-1, n - 1)
    held = np.concatenate((x, [np.iinfo(x.dtype).min]))  # place -1
    open_ = np.flatnonzero(held[at] >= x)
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[held[at[open_]] >= x[open_]]
    return at


def factors(places: np.ndarray, rank: np.ndarray, key: np.ndarray, levels: dict[int, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor at each of ``places`` (in order), counted up to ``width``: the most bytes
    there that also stand at an earlier (later) one of the places.

    In suffix order, with ties in order of place, of all earlier suffixes the one with the longest common prefix is the
    nearest one before or the nearest one behind that starts earlier."""
    order = np.argsort(rank[places], kind="stable")
    own = places[order]

    def longest(x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x), dtype=np.int64)
        for side in (1, -1):
            near = nearest_smaller(x[::side])
            has = np.flatnonzero(near >= 0)
            i, j = own[::side][has], own[::side][near[has]]
            part = np.zeros(len(x), dtype=np.int64)
            part[has] = common_prefix(key, levels, i, j, width)
            found = np.maximum(found, part[::side])
        out = np.empty_like(found)
        out[order] = found
        return out

    return longest(own), longest(-own)


def repeated_windows(contexts: list[bytes], width: int) -> list[np.ndarray]:
    """For each context its windows (numbers) that are equal to another window of any of the contexts."""
    lengths = np.array([len(x) for x in contexts])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    rank, key, levels = suffix_ranks(data, width)
    firsts = np.cumsum(lengths) - lengths
    n = lengths - width + 1
    places = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    lpf, lnf = factors(places, rank, key, levels, width)
    again = (lpf >= width) | (lnf >= width)
    return [np.flatnonzero(x) for x in np.split(again, np.cumsum(n)[:-1])]


def runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of neighbouring numbers."""
    if not len(windows):
        return []
    gap = np.flatnonzero(np.diff(windows) > 1)
    return list(zip(windows[np.concatenate(([0], gap + 1))].tolist(), windows[np.concatenate((gap, [len(windows) - 1]))].tolist(), strict=True))


def repeats(docs: DataFrame, width: int = 200, warm: int = 64, hot: int = 1 << 15, block: int = 1 << 19) -> DataFrame:
    """Marks for texts: t1, t2 (the text's digest), whole (it occurs as a whole again), spans (array<struct<first,
    last>> of windows that occur again). Texts without a mark have no row."""
    t1, t2 = F.xxhash64("text"), F.crc32(F.col("text").cast("binary")) * (1 << 31) + F.octet_length("text")
    texts = docs.where(F.octet_length("text") >= width).select(t1.alias("t1"), t2.alias("t2"), "text")

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 256):
                part = frame.iloc[lo : lo + 256]
                who, h, first, _, _ = all_anchors([x.encode("utf-8", "surrogatepass") for x in part["text"]], width)
                yield pd.DataFrame({"h": h.view(np.int64), "t1": part["t1"].to_numpy()[who], "t2": part["t2"].to_numpy()[who], "at": first.astype(np.int32)})

    found = store(texts.mapInPandas(find, "h long, t1 long, t2 long, at int"))
    place = F.struct("t1", "t2", "at")
    again = store(found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a != z").select("h"))
    wanted = store(found.join(again.hint("merge"), "h").groupBy("t1", "t2").agg(F.collect_set("h").alias("hs")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 256):
                part = frame.iloc[lo : lo + 256]
                raw = [x.encode("utf-8", "surrogatepass") for x in part["text"]]
                who, h, first, n, off = all_anchors(raw, width)
                h = h.view(np.int64)
                take = np.zeros(len(h), dtype=bool)
                for k, hs in enumerate(part["hs"]):
                    own = slice(*np.searchsorted(who, [k, k + 1]))
                    take[own] = np.isin(h[own], np.asarray(hs, dtype=np.int64))
                who, h, first, n, off = (x[take] for x in (who, h, first, n, off))
                yield pd.DataFrame({"h": h, "context": [raw[k][a : a + c + width - 1] for k, a, c in zip(who, first, n, strict=True)], "t1": part["t1"].to_numpy()[who], "t2": part["t2"].to_numpy()[who], "at": first.astype(np.int32), "off": off.astype(np.int32)})

    places = store(texts.join(wanted.hint("merge"), ["t1", "t2"]).mapInPandas(cut, "h long, context binary, t1 long, t2 long, at int, off int").withColumn("c", F.xxhash64("context")))
    distinct = store(places.groupBy("h", "c", "context", "off").agg(F.min(place).alias("a"), F.max(place).alias("z")).select("h", "c", "context", "off", (F.col("a") != F.col("z")).alias("again")))
    sizes = store(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    several = distinct.join(sizes.hint("merge"), "h")
    # A context that occurs again is repeated throughout; the others need a partner of another context.
    none = F.lit(0).cast("long")
    cold = several.where(f"n <= {warm}").select("h", F.lit(0).alias("side"), none.alias("key"), "c", "context", "again")
    # The windows whose anchor stands ``half`` bytes or more behind their start hold the bytes to its left, the others those to its right.
    half = (width - GRAM) // 2
    beside = min(GRAM, half)
    length, off = F.octet_length("context"), F.col("off")
    left = F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring("context", off - beside + 1, F.lit(beside))).alias("key"), F.lit(0).alias("base"), F.least(off - half, length - width).alias("end"))
    right = F.struct(F.lit(2).alias("side"), F.xxhash64(F.substring("context", off + GRAM + 1, F.lit(beside))).alias("key"), F.greatest(F.lit(0), off - half + 1).alias("base"), (length - width).alias("end"))
    sides = several.where(f"n > {warm}").withColumn("s", F.explode(F.array(left, right))).where("s.base <= s.end")
    part = F.substring("context", F.col("s.base") + 1, F.col("s.end") - F.col("s.base") + width)
    dealt = store(sides.select("h", "s.side", "s.key", "c", "s.base", "again", part.alias("part")).withColumn("p", F.xxhash64("part")))
    group = ["h", "side", "key"]
    parts = store(dealt.groupBy(*group, "p", "part").agg((F.max("again") | (F.min("c") != F.max("c"))).alias("again")))
    met = store(parts.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1"))
    some = parts.join(met.hint("merge"), group)
    warmed = some.where(f"n <= {hot}").select(*group, F.col("p").alias("c"), F.col("part").alias("context"), "again")
    alone = store(cold.unionByName(warmed))
    size = alone.agg(F.sum(F.octet_length("context")).alias("n")).first().n or 0
    # A number of its own, as it is the sorting that takes time, not the bytes.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * block)))
    alone = alone.repartition(tasks, *group).sortWithinPartitions(*group)

    def sort(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups together, by ``block`` bytes or more."""
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += frame["context"].map(len).sum()
            if size >= block:
                every = pd.concat(held, ignore_index=True)
                last = (every[group] != every[group].iloc[-1]).any(axis=1).to_numpy()
                cut_at = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut_at:
                    yield from solve(every.iloc[:cut_at])
                held = [every.iloc[cut_at:]]
                size = held[0]["context"].map(len).sum()
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    def solve(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(frame):
            return
        ids = frame[group].to_numpy()
        heads = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1))
        ends = np.cumsum(frame["context"].map(len).to_numpy())
        before = np.concatenate(([0], ends))[heads]
        # Cut at groups only, so that all contexts of one are sorted together.
        firsts = [*heads[np.flatnonzero(np.diff(before // block, prepend=-1))].tolist(), len(frame)]
        for lo, hi in zip(firsts, firsts[1:], strict=False):
            own = frame.iloc[lo:hi]
            out = [(*g, c, a, z) for g, c, again_, x in zip(own[group].itertuples(index=False, name=None), own["c"], own["again"], repeated_windows(list(own["context"]), width), strict=True) if not again_ for a, z in runs(x)]
            if out:
                yield pd.DataFrame(out, columns=[*group, "c", "first", "last"])

    sorted_ = store(alone.mapInPandas(sort, "h long, side int, key long, c long, first int, last int"))
    windows = some.where(f"n > {hot}").select(*group, "p", "again", "part", F.explode(F.sequence(F.lit(0), F.octet_length("part") - width)).alias("w"))
    windows = windows.select(*group, "p", "again", "w", F.substring("part", F.col("w") + 1, F.lit(width)).alias("bytes"))
    place_w = F.struct(*group, "p", "w")
    twice = store(windows.groupBy("bytes").agg(F.min(place_w).alias("a"), F.max(place_w).alias("z")).where("a != z").select("bytes"))
    spread = windows.where("not again").join(twice.hint("merge"), "bytes").select(*group, "p", F.col("w").alias("first"), F.col("w").alias("last"))
    whole_part = parts.where("again").select(*group, "p", F.lit(0).alias("first"), (F.octet_length("part") - width).alias("last"))
    in_parts = sorted_.where("side > 0").withColumnRenamed("c", "p").unionByName(spread).unionByName(whole_part)
    of_parts = dealt.where("not again").select(*group, "p", "c", "base").join(in_parts.hint("merge"), [*group, "p"]).select("h", "c", (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("last")).alias("last"))
    whole_context = distinct.where("again").select("h", "c", F.lit(0).alias("first"), (F.octet_length("context") - width).alias("last"))
    marks = store(sorted_.where("side = 0").select("h", "c", "first", "last").unionByName(of_parts).unionByName(whole_context))
    spans = places.select("h", "c", "t1", "t2", "at").join(marks.hint("merge"), ["h", "c"]).select("t1", "t2", F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")).alias("span"))
    twin = texts.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2", F.lit(True).alias("whole"), F.lit(None).cast("struct<first:int,last:int>").alias("span"))
    every = spans.select("t1", "t2", F.lit(False).alias("whole"), "span").unionByName(twin)
    return store(every.groupBy("t1", "t2").agg(F.max("whole").alias("whole"), F.collect_set("span").alias("spans")))


def removed(n: int, whole: bool, spans: list, width: int) -> list[tuple[int, int]]:
    """Byte ranges (start, end) under repeated windows, merged where they touch or overlap."""
    if whole and n >= width:
        return [(0, n)]
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + width)
        else:
            out.append([first, last + width])
    return [(a, b) for a, b in out]


def dedupe(docs: DataFrame, width: int = 200, keep_bytes: bool = True, **how) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of removed bytes), kept (binary, or null), kept_sha256 for each row."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = repeats(rows, width, **how)
    keyed = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.crc32(F.col("text").cast("binary")) * (1 << 31) + F.octet_length("text")})

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, whole, spans in zip(frame["doc_id"], frame["text"], frame["whole"], frame["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = removed(len(raw), whole is True or whole == 1, [] if spans is None else [(x["first"], x["last"]) for x in spans], width)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), [{"start": a, "end": b} for a, b in gone], left if keep_bytes else None, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    joined = keyed.join(marks.hint("merge"), ["t1", "t2"], "left").select("doc_id", "text", "whole", "spans")
    found = joined.mapInPandas(take, "doc_id string, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: The same over every window of 200 bytes by its digest, in hexadecimal text (two characters a byte).
ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM t),
x AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM w),
m AS (SELECT r, i FROM x SEMI JOIN (SELECT k FROM x GROUP BY k HAVING count(*) > 1) USING (k)),
s AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM m),
g AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
n AS (SELECT r, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, run),
p AS (SELECT n.*, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM n),
k AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM p JOIN t USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN k USING (r)
"""

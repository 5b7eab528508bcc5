"""Packing documents into sequences: a configuration linear program over the length histogram.

Documents become token ids; those longer than a sequence are cut into full pieces, what is left over coming first.
Only the histogram of piece lengths (at most one count for each length) reaches the driver. There the linear
program "fewest sequences that cover all lengths, over all ways to fill a sequence" is solved by multiplicative
weights: each length has a price that falls as it is covered, and a knapsack by dynamic programming finds the
fillings of the highest price; all fillings near the best are raised together, until every length is covered. The
fractional solution is rounded, and what is left of the histogram is packed best fit, longest first. Both give
patterns with a number of times; time and memory there depend on the number of lengths, not of documents.

Each piece then finds its place by its rank among the pieces of its length. The ranks come from counters within
each input partition and a running sum over partitions, so no task sees all pieces of a length.

Token ids follow the vocabulary's merge ranks; the string of an added token in a text is that token's id, as in
``tokenizers`` by default. The ids are the same from either library; tiktoken is faster.

Defined results: a null or empty text is the end token alone. Rows are packed one by one, repeated rows and null
ids included; ids keep their type and value (they pass Python as strings, so a null among them changes none). Extra columns are not read. No documents give no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import store

_encoders: dict[tuple[str, str], Callable[[list[str]], list[list[int]]]] = {}


def encoder(path: str, library: str = "tiktoken") -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids with a byte-level BPE file (``tokenizer.json``), loaded once a worker."""
    if (path, library) in _encoders:
        return _encoders[path, library]
    if library == "tokenizers":
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        encode = lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    else:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        # Byte-level files write each byte as one printable character; the others are moved beyond Latin-1.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        at = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        added = held.get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: added tokens that match more or less than their own string need library='tokenizers'")
        special = {x["content"]: x["id"] for x in added}
        ranks = {bytes(at[c] for c in token): k for token, k in held["model"]["vocab"].items() if token not in special}
        model = tiktoken.Encoding(re.sub(r"\W", "_", path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        encode = lambda texts: [model.encode(x, allowed_special="all") for x in texts]
    _encoders[path, library] = encode
    return encode


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length): whole if it fits, else full pieces after what is left over."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def tokenized(docs: DataFrame, path: str, size: int, end: int, library: str = "tiktoken", keep_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit) or null, ids_crc32, and
    chunk and nth (the input partition and the rank within it among pieces of the length)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, chunk = encoder(path, library), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for frame in frames:
            out = []
            for lo in range(0, len(frame), 64):
                part = frame.iloc[lo : lo + 64]
                for doc_id, ids in zip(part["doc_id"], encode([x or "" for x in part["text"]]), strict=True):
                    raw = np.array([*ids, end], dtype="<u4")
                    for k, (at, n) in enumerate(pieces_of(len(raw), size)):
                        data = raw[at : at + n].tobytes()
                        out.append((doc_id, k, at, n, data if keep_ids else None, zlib.crc32(data), chunk, seen[n]))
                        seen[n] += 1
            columns = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "chunk", "nth"]
            yield pd.DataFrame(out, columns=columns)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, piece int, start long, length long, ids binary, ids_crc32 long, chunk int, nth long")


def knapsack(prices: np.ndarray, items: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price within each capacity of any number of ``items`` (lengths, the longest first), and the one taken last
    (0: less will do). Of equal prices the longest counts, so that fillings have few pieces."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    own = prices[items]
    fits = np.searchsorted(-items, -np.arange(size + 1))
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k < len(items):
            with_ = best[c - items[k:]] + own[k:]
            j = int(with_.argmax())
            if with_[j] > best[c]:
                best[c], took[c] = with_[j], items[k + j]
    return best, took


def fillings_of(took: np.ndarray) -> Callable[[int], tuple[int, ...]]:
    """The filling that the knapsack found for a capacity; what capacities share is built once."""
    known: dict[int, tuple[int, ...]] = {0: ()}

    def filling(c: int) -> tuple[int, ...]:
        way = []
        while c not in known:
            way.append(c)
            c -= int(took[c]) or 1
        found = known[c]
        for c in reversed(way):
            known[c] = found = (int(took[c]), *found) if took[c] else found
        return found

    return filling


def fractional(n: np.ndarray, size: int, share: float = 0.01, step: float = 0.5, near: float = 0.5, rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """A fractional cover of the histogram ``n`` (by length): filling -> times, and each length's cover (1 or more).

    A length's price is its share of a sequence, lowered by exp(-step * cover) for what is covered already. In a round
    the knapsack prices the best filling around each length, and those near the best price are raised together, those
    around the least covered lengths first, as far as no length's cover runs more than a share ahead of the rounds.
    What is left uncovered at the end is covered by the best fillings around it, whatever they cover twice."""
    present = np.flatnonzero(n)
    done, x = np.zeros(size + 1), defaultdict(float)
    items = present[::-1]

    def raised(f: tuple[int, ...], need: dict[int, int], times: float) -> None:
        x[tuple(sorted(f, reverse=True))] += times
        for length, c in need.items():
            done[length] += times * c / n[length]

    for r in range(rounds if len(present) else 0):
        cover = done[present]
        prices = np.zeros(size + 1)
        prices[present] = present * np.exp(-step * (cover - cover.mean()))
        best, took = knapsack(prices, items, size)
        filling = fillings_of(took)
        values = prices[present] + best[size - present]
        allowed = np.zeros(size + 1)
        allowed[present] = np.maximum(0, min(1.0, share * (r + 3)) - cover) * n[present]
        fine = values >= (1 - near) * values.max()
        for length in present[fine][np.lexsort((-present[fine], cover[fine].round(6)))].tolist():
            if allowed[length] > 0:
                f = (length, *filling(size - length))
                need = {k: f.count(k) for k in f}
                times = min(allowed[k] / c if c <= n[k] else 0 for k, c in need.items())
                if times > 0:
                    raised(f, need, times)
                    for k, c in need.items():
                        allowed[k] -= times * c
        if done[present].min() >= 1:
            break
    for length in present[np.argsort(done[present], kind="stable")].tolist():
        if done[length] < 1:
            f = (length, *filling(size - length))
            need = {k: f.count(k) for k in f}
            raised(f, need, (1 - done[length]) * float(n[length]) / need[length])
    if len(present):
        least = done[present].min()
        x, done = {f: times / least for f, times in x.items()}, done / least
    return dict(x), done


def rounded(x: dict[tuple[int, ...], float], n: np.ndarray, size: int, share: float, most: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole times of about ``share`` of the fractional solution, and the pieces left: floors first, then the fillings
    with the largest rests, while each length holds out to its share. Fillings that waste space or hold over ``most``
    pieces are left out: the shortest pieces serve the rest better."""
    left, took = n.copy(), defaultdict(int)
    order = sorted((f for f in x if len(f) <= most and sum(f) >= size - size // 512), key=lambda f: (len(f), -x[f], f))
    for up in (0.0, 0.5, 0.999):
        for f in order:
            need = {k: f.count(k) for k in f}
            k = min(int(x[f] * share + up) - took[f], *((int(share * n[l] + (up > 0) * 0.999) - int(n[l] - left[l])) // c for l, c in need.items()), *(int(left[l]) // c for l, c in need.items()))
            if k > 0:
                took[f] += k
                for l, c in need.items():
                    left[l] -= k * c
    return [(f, k) for f, k in took.items() if k], left


def best_fit(n: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, with equal sequences held as one group."""
    free: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    spaces: list[int] = []

    def put(space: int, held: tuple[int, ...], times: int) -> None:
        if not free[space]:
            insort(spaces, space)
        free[space][held] = free[space].get(held, 0) + times

    for length in range(size, 0, -1):
        left = int(n[length])
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                held, times = free[space].popitem()
                if not free[space]:
                    spaces.pop(at)
                fits = space // length
                whole, rest = divmod(min(left, times * fits), fits)
                if whole:
                    put(space - fits * length, held + (length,) * fits, whole)
                if rest:
                    put(space - rest * length, held + (length,) * rest, 1)
                if times - whole - bool(rest):
                    put(space, held, times - whole - bool(rest))
                left -= whole * fits + rest
            else:
                fits = size // length
                whole, rest = divmod(left, fits)
                if whole:
                    put(size - fits * length, (length,) * fits, whole)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
                left = 0
    return [(held, times) for group in free.values() for held, times in group.items()]


def plan(counts: dict[int, int], size: int, shares: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.35, 0.2)) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Fillings and times that hold exactly ``counts`` pieces of each length, and how many of the pieces are in
    fillings of the linear program.

    Several shares of the fractional solution are rounded and the rest is packed best fit; the fewest sequences count,
    of as many the most pieces from the program. Best fit alone is tried too, so there are never more than it makes."""
    n = np.zeros(size + 1, dtype=np.int64)
    for length, times in counts.items():
        n[length] = times
    x, _ = fractional(n, size)
    tried = [(best_fit(n, size), 0)]
    for most in (2, size):
        for share in shares:
            fillings, left = rounded(x, n, size, share, most)
            tried.append((fillings + best_fit(left, size), int(n.sum() - left.sum())))
    return min(tried, key=lambda t: (sum(k for _, k in t[0]), -t[1]))


def places(fillings: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ranks, sorted by length and first rank: length, first rank, first sequence, offset; and their keys."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for f, times in fillings:
        offset = 0
        for length in f:
            rows.append((length, next_rank[length], sequence, offset))
            next_rank[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return (*table.T, (table[:, 0] << 48) + table[:, 1])


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2, library: str = "tiktoken", keep_ids: bool = True, most_rows: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset for each piece.

    The counters of partitions and lengths are broadcast up to ``most_rows``, counted first; beyond they are merged."""
    pieces = store(tokenized(docs, path, size, end, library, keep_ids))
    by_chunk = store(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths, ranks, sequences, offsets, keys = places(plan(counts, size)[0])
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if by_chunk.count() <= most_rows else bases.hint("merge")
    ranked = pieces.join(bases, ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("chunk", "nth", "base")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield frame.drop(columns="rank").assign(sequence_id=sequences[at] + rank - ranks[at], offset=offsets[at])

    placed = ranked.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "rank").mapInPandas(place, "doc_id string, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))

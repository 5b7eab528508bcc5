"""Benchmark decontamination: Wu-Manber multi-pattern search for windows of test items.

Texts and items become words (ASCII lower case, digits, anything beyond ASCII); a window of ``size`` words of an
item is a pattern. Patterns of a length share a search: the shift table says how far the last block of words
under the window lets the search jump, a zero shift leads to the bucket of patterns with that last block, and a
comparison of all words confirms an occurrence. Items shorter than a window are one pattern each and are searched
in a table of their own length, so they don't shorten the jumps of the others.

Items are shipped to the executors in blocks of at most ``block_bytes`` of text; each block is one pass over the
documents, and the passes' spans are merged, so the number of items is not bounded. A worker builds a block's tables
once and keeps the last ones; they take some 100 times the block's text (measured: 280 MB for 2.6 MB of random words).

Defined results: null or wordless texts have no hits, and null or wordless items no windows. Items that repeat a
text are each counted. A null item_id counts as the empty string. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import numbered, store

#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Searcher:
    """Windows of ``size`` words of items (name, text); ``find`` gives (start, length, items) of every occurrence.

    Words are numbers of the block's own vocabulary, windows the bytes of their numbers."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        windows: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        for name, text in items:
            own = array("i", (self.number.setdefault(w, len(self.number)) for w in words(text)))
            m = min(len(own), size)
            for at in range(len(own) - m + 1 if m else 0):
                names = windows[m].setdefault(own[at : at + m].tobytes(), [])
                if name not in names[-1:]:
                    names.append(name)
        self.many = len(self.number)
        self.tables = [(m, *self._tables(m, own), own) for m, own in sorted(windows.items())]

    def _key(self, words_: array) -> int:
        return words_[0] if len(words_) == 1 else words_[0] * self.many + words_[1]

    def _tables(self, m: int, windows: dict[bytes, list[str]]) -> tuple[int, dict[int, int], dict[int, list[tuple[int, bytes]]]]:
        """Words of a block; how far its last words let the search jump; and windows by their last and first words."""
        block = min(2, m)
        shift: dict[int, int] = {}
        buckets: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for raw in windows:
            own = array("i", raw)
            for at in range(m - block + 1):
                key, far = self._key(own[at : at + block]), m - block - at
                if far < shift.get(key, m):
                    shift[key] = far
            buckets[self._key(own[m - block :])].append((self._key(own[:block]), raw))
        return block, shift, dict(buckets)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        get, n, many = self.number.get, len(text), self.many
        for m, block, shift, buckets, windows in self.tables:
            far, end = m - block + 1, m
            while end <= n:
                # Only words that the search stops at are looked up.
                key = get(text[end - 1], -1)
                if key < 0:
                    end += m
                    continue
                if block == 2:
                    before = get(text[end - 2], -1)
                    key = before * many + key if before >= 0 else -1
                jump = shift.get(key, far)
                if jump:
                    end += jump
                    continue
                start = end - m
                here = array("i", [get(w, -1) for w in text[start:end]])
                if min(here) >= 0:
                    first, raw = self._key(here[:block]), here.tobytes()
                    if any(head == first and bytes_ == raw for head, bytes_ in buckets[key]):
                        yield start, m, windows[raw]
                end += 1


_searchers: dict[str, Searcher] = {}


def searcher(block: str, items: list[tuple[str, str | None]], size: int) -> Searcher:
    """The tables of a block, built once a worker; only the last block's are kept."""
    if block not in _searchers:
        _searchers.clear()
        _searchers[block] = Searcher(items, size)
    return _searchers[block]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null").toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(docs: DataFrame, items: list[tuple[str, str | None]], size: int) -> DataFrame:
    """rid, doc_id, n_words, spans of hit words (start, end; merged), items."""
    block = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = searcher(block, items, size)
        for frame in frames:
            counts, spans, names = [], [], []
            for text in frame["text"]:
                w = words(text)
                hits: list[list[int]] = []
                mine: set[str] = set()
                for start, m, ids in sorted(search.find(w), key=lambda x: x[:2]):
                    mine.update(ids)
                    if hits and start <= hits[-1][1]:
                        hits[-1][1] = max(hits[-1][1], start + m)
                    else:
                        hits.append([start, start + m])
                counts.append(len(w))
                spans.append([{"start": a, "end": b} for a, b in hits])
                names.append(sorted(mine))
            yield pd.DataFrame({"rid": frame["rid"], "doc_id": frame["doc_id"], "n_words": counts, "spans": spans, "items": names})

    return docs.mapInPandas(run, "rid long, doc_id string, n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 4 << 20, rid: str | None = None) -> DataFrame:
    """For each row of ``docs``: rid, doc_id, n_words, spans (of hit words, merged and in order), items (ids in string order).

    The rids are those of column ``rid``, which has to be stored, or numbers made here.
    With one block of items there is no shuffle; with more, spans and items of the passes are merged by row.
    """
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    kind = docs.schema["doc_id"].dataType
    own = [F.col("doc_id").cast("string").alias("doc_id"), "text"]
    rows = docs.select(*own, F.col(rid).alias("rid")) if rid else numbered(docs.select(*own))
    if second is None:
        return _search(rows, first, size).withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = store(rows)
    passes = [store(_search(rows, first, size)), store(_search(rows, second, size)), *(store(_search(rows, x, size)) for x in blocks)]
    every = passes[0]
    for x in passes[1:]:
        every = every.unionByName(x)
    grouped = every.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    merged = F.aggregate("spans", start, lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))))
    return grouped.withColumns({"spans": merged, "doc_id": F.col("doc_id").cast(kind)})


def digest(found: DataFrame) -> DataFrame:
    """The result's columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same by joining windows as text, for each window length.
ORACLE = """
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bp AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM bi),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bp) WHERE len(w) >= m),
h AS (SELECT doc_id, i, di.m AS m, item FROM di JOIN bp ON di.m = bp.m AND array_to_string(w[i:i + di.m - 1], ' ') = p),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import suffix_dedup
from tests.llm import cases


def brute(rows, width):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[k : k + width] for _, x in raw for k in range(len(x) - width + 1))
    out = []
    for d, x in raw:
        gone = [False] * (len(x) + 1)
        for k in range(len(x) - width + 1):
            if seen[x[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        spans = sum(gone[k] and not gone[k - 1] for k in range(len(gone)))
        out.append((str(d), len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


def passages(n=40, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(r.randint(20, 120)) for _ in range(6)]
    rows = []
    for k in range(n):
        x = text(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(x))
            p = r.choice(shared)
            lo = r.randint(0, len(p))
            x = x[:at] + p[lo : lo + r.randint(100, 600)] + x[at:]
        rows.append((k, x))
    near = text(400)
    for k in range(30):
        at = r.randint(0, len(near))
        rows.append((500 + k, near[:at] + word() + near[at:]))
    return rows + [(900, "z" * 700), (901, "z" * 450), (902, "xy" * 300), (903, "a" * 199), (904, "a" * 200), (904, "a" * 200)]


def test_against_brute_force(spark):
    docs = cases.documents(spark).select("doc_id", "text").union(spark.createDataFrame(passages(), "doc_id long, text string")).repartition(6)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 200)
    for warm, hot in ((256, 1 << 16), (3, 1 << 16), (3, 2)):
        got = suffix_dedup.digest(suffix_dedup.dedupe(docs, warm=warm, hot=hot, block=1 << 14)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert suffix_dedup.dedupe(cases.empty(spark)).collect() == []


def test_long_texts_are_taken_in_parts():
    r = random.Random(4)
    text = bytes(r.choice(b"abcd") for _ in range(5000)) * 3
    whole = suffix_dedup.anchors([text], 200)
    parts = suffix_dedup.all_anchors([b"", text, b"xx"], 200, most=1000)
    windows = lambda x: sorted(w for at, n in zip(x[2], x[3], strict=True) for w in range(at, at + n))
    assert windows(whole) == windows(parts) == list(range(len(text) - 199))
    assert set(parts[0]) == {1}
    of = lambda x: {w: h for h, at, n in zip(x[1], x[2], x[3], strict=True) for w in range(at, at + n)}
    assert of(whole) == of(parts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=12, max_size=40), min_size=1, max_size=5), st.sampled_from([9, 12, 30]))
def test_ranks_and_factors(texts, width):
    """Suffix order, and the lengths of the longest previous and next factors, of all places and of some of them."""
    data = "".join(texts).encode()
    rank, key, levels = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), width)
    padded = data + bytes(3 * width)
    for i in range(len(data)):
        for j in range(0, len(data), 7):
            assert (rank[i] < rank[j]) == (padded[i : i + width] < padded[j : j + width])

    def shared(i, j):
        return next((k for k in range(width) if padded[i + k] != padded[j + k]), width)

    for places in (range(len(data)), range(0, len(data), 3)):
        lpf, lnf = suffix_dedup.factors(np.array(places), rank, key, levels, width)
        for at, i in enumerate(places):
            assert lpf[at] == max((shared(i, j) for j in places if j < i), default=0)
            assert lnf[at] == max((shared(i, j) for j in places if j > i), default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60))
def test_nearest_smaller(x):
    got = suffix_dedup.nearest_smaller(np.array(x, dtype=np.int64)).tolist()
    assert got == [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(len(x))]


def test_ids_keep_their_value_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "some words"), (None, "more words"), (7, None)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.n_bytes) for r in suffix_dedup.dedupe(docs).collect()} == {((1 << 53) + 1, 10), (None, 10), (7, 0)}

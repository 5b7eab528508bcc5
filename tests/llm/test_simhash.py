import numpy as np
import xxhash

from quillon.llm import simhash
from tests.llm import cases


def brute_fp(text, size):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, most):
    """rows: (doc_id, fp). Component's smallest id of each."""
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                part[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(rows))]


def check(spark, docs, **how):
    rows = [(r.doc_id, brute_fp(r.text, 4)) for r in docs.collect()]
    want = sorted((str(d), f"{fp:016x}", str(c)) for (d, fp), c in zip(rows, brute(rows, 4), strict=True))
    got = simhash.digest(simhash.near_groups(docs, **how)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_awkward_rows(spark):
    check(spark, cases.documents(spark))
    assert simhash.near_groups(cases.empty(spark)).collect() == []


def test_dense_ball_and_hot_keys(spark):
    """Many fingerprints around a few centres, given straight to the link stage, also with keys dealt over shards."""
    r = np.random.default_rng(3)
    fps = {0}
    for c in r.integers(0, 1 << 63, 4):
        for _ in range(150):
            x = int(c)
            for b in r.integers(0, 64, r.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(k, bytearray(x.to_bytes(8, "big"))) for k, x in enumerate(fps)], "id long, fp binary").repartition(5)
    want = brute(list(enumerate(fps)), 4)
    for block in (2048, 7):
        edges = simhash.links(frame, 4, block=block).collect()
        assert all((fps[e.a] ^ fps[e.b]).bit_count() <= 64 for e in edges)
        part = list(range(len(fps)))

        def top(i, part=part):
            while part[i] != i:
                i = part[i]
            return i

        for e in edges:
            x, y = top(e.a), top(e.b)
            part[max(x, y)] = min(x, y)
        assert [top(i) for i in range(len(fps))] == want


def test_chains_of_long_fingerprints_drop_no_pair_in_range():
    """Every pair within the limit passes, whatever the bits; pairs of half the bits nearly never do."""
    r = np.random.default_rng(5)
    for flips in (1, 17, 40, 63, 64):
        differ = np.zeros((2000, 256), dtype=np.uint8)
        for row in differ:
            row[r.permutation(256)[:flips]] = 1
        words = np.packbits(differ, axis=1).view(np.uint64)
        assert simhash.ring_of_words(words, 64).all()
    unlike = r.integers(0, 1 << 63, (4000, 4), dtype=np.int64).view(np.uint64)
    assert simhash.ring_of_words(unlike, 64).mean() < 0.2


def test_sketches_keep_pairs_of_similarity_four_fifths():
    r = np.random.default_rng(6)
    kept, unlike = 0, 0
    for k in range(600):
        n = int(r.integers(5, 400))
        own = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        gone = int(r.integers(0, len(own) // 9 + 1))
        a = own[: len(own) - gone] if gone else own
        b = np.unique(np.concatenate([own[gone:], r.integers(0, 1 << 62, 0).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        words = lambda x: np.frombuffer(simhash.sketch(x), dtype="<u8")[None, :]
        fine = simhash.may_be_similar(words(a), words(b), np.array([len(a)]), np.array([len(b)]))[0]
        if 5 * both >= 4 * (len(a) + len(b) - both):
            assert fine
            kept += 1
        c = np.unique(r.integers(0, 1 << 62, len(a)).astype(np.uint64))
        unlike += simhash.may_be_similar(words(a), words(c), np.array([len(a)]), np.array([len(c)]))[0]
    assert kept > 200 and unlike == 0


def test_ids_keep_their_value_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "some words"), (None, "more words"), (7, None)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()} == {((1 << 53) + 1, (1 << 53) + 1), (None, None), (7, 7)}

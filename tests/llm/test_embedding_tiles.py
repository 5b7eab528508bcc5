import math

import numpy as np

from quillon.llm import embedding_tiles


def brute(rows, least):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v)
            ok[k] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    part, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in ok:
        for j in ok:
            if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least:
                n[i] += 1
                part[max(top(i), top(j))] = min(top(i), top(j))
    least_id = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least_id[top(k)] = min(least_id.get(top(k), d), d)
    return [(str(d), n[k], str(least_id.get(top(k)))) for k, (d, _) in enumerate(rows)]


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = r.normal(size=16)
        rows += [(len(rows) + k, [float(x) for x in centre + r.normal(size=16) * 0.2 * (c % 4)]) for k in range(25)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None] * 8), (505, [float("inf")] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[0][1]), (3, rows[3][1]), (508, [1e-200] * 16), (509, [1e200] * 16)]
    frame = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, rid long, d int, n double").repartition(7)
    want = sorted(brute(rows, 0.9))
    for strip in (2048, 32):
        got = embedding_tiles.near_links(frame, strip=strip).collect()
        assert sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in got) == want
    assert embedding_tiles.near_links(frame.limit(0)).collect() == []


def test_strips_within_reach_meet(spark):
    """The join of boxes gives every pair within reach, itself included, once, and no pair beyond it."""
    r = np.random.default_rng(8)
    low = r.uniform(-1, 0.9, (60, 3))
    high = low + r.uniform(0, 0.3, (60, 3)) * (r.random((60, 1)) < 0.8)
    rows = [(k, 8 if k % 5 else 9, low[k].tolist(), high[k].tolist()) for k in range(60)]
    packs = spark.createDataFrame(rows, "pack long, d int, low array<double>, high array<double>")
    for least in (0.9, 0.99):
        reach = math.sqrt(2 - 2 * least) + embedding_tiles.SLACK
        gap = lambda a, b: np.linalg.norm(np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a])))
        want = sorted((a, b) for a in range(60) for b in range(a, 60) if rows[a][1] == rows[b][1] and gap(a, b) <= reach)
        assert sorted((x.a, x.b) for x in embedding_tiles.meetings(packs, least).collect()) == want


def test_equal_vectors_are_counted(spark):
    """A third of all rows hold one vector: each of them links with all the others."""
    r = np.random.default_rng(9)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else [float(x) for x in r.normal(size=3)]) for k in range(240)]
    want = sorted(brute(rows, 0.9))
    got = embedding_tiles.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6), strip=16).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in got) == want

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = cases.documents(spark).where("doc_id is not null")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, docs.where("doc_id = 20").first().text), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, rows = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    step = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, d)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        rows = step[name] = spark.read.parquet(str(tmp_path / name))
    ids = lambda name: {r.doc_id for r in step[name].select("doc_id").collect()}
    assert {r.doc_id for r in docs.collect()} - ids("language") == {300, 301, 302, 305}
    assert ids("lines") == ids("language")
    alone = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, d).collect()}
    assert not alone & {100 + k for k in range(8)} and set(range(8)) <= alone
    assert ids("near_copies") <= ids("lines")
    assert 20 not in ids("clean") and ids("clean") <= ids("near_copies")
    assert ids("packed") == ids("clean")
    whole = corpus_pipeline.run(spark, d)
    assert sorted(whole.select("doc_id", "piece", "length").collect()) == sorted(step["packed"].select("doc_id", "piece", "length").collect())


def test_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_of_the_corpus(spark):
    """Every pair of five-word similarity 0.8 or more loses one; documents without a similar one stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    shingles = {}
    for r in rows:
        w = r.text.lower().split()
        shingles[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    owners = {}
    for d, s in shingles.items():
        for x in s:
            owners.setdefault(x, []).append(d)
    best, pairs = {}, set()
    for group in owners.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in pairs:
                    pairs.add((a, b))
                    j = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
                    best[a], best[b] = max(best.get(a, 0), j), max(best.get(b, 0), j)
                    assert j < 0.8 or not {a, b} <= kept
    assert {d for d in shingles if best.get(d, 0) < 0.3} <= kept
    assert docs.where(F.col("doc_id").isin([d for d in shingles if d not in kept])).count() == len(rows) - len(kept)


def similarity(a, b):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def brute_groups(rows):
    """The smallest id of each row's group, by comparing all pairs of (id, text)."""
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                part[top(i)] = top(j)
    return {min(d for k, (d, _) in enumerate(rows) if top(k) == top(i)) for i in range(len(rows))}


def copies(n=320, seed=11):
    """Texts of 40 to 120 words in families whose members differ by 1 to 8 changed words: similarities from 0.3 to 1."""
    import random

    r = random.Random(seed)
    rows = []
    while len(rows) < n:
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(40, 120))]
        for _ in range(4):
            own = list(words)
            for at in r.sample(range(len(own)), r.choice([1, 1, 2, 3, 4, 5, 8])):
                own[at] = f"v{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_copies_are_those_of_similarity_from_four_fifths(spark):
    """Pairs of 0.5 to 0.8 stay and none of 0.8 or more is missed: the same rows as by comparing all pairs."""
    rows = copies()
    best = {d: max(similarity(t, u) for e, u in rows if e != d) for d, t in rows}
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "").collect()}
    assert got == brute_groups(rows)
    middling = {d for d, j in best.items() if 0.5 <= j < 0.8}
    assert len(middling) >= 20 and middling <= got
    assert sum(0.8 <= j < 0.9 for j in best.values()) >= 20


def boundary(n=60):
    """Pairs (id, text) of similarity exactly 4/5 (ids 4k, 4k + 1) and of just less (4k + 2, 4k + 3)."""
    rows = []
    for k in range(n):
        for side in range(2):
            alike = 8 + 4 * k
            words = [f"b{k}s{side}w{i}" for i in range(alike + 4)]
            more = [f"b{k}s{side}m{i}" for i in range(alike // 4 + side)]
            rows += [(4 * k + 2 * side, " ".join(words)), (4 * k + 2 * side + 1, " ".join(words + more))]
    return rows


def test_no_pair_at_the_boundary_is_missed(spark):
    rows = boundary()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {d for d, _ in rows if d % 4 != 1}


def test_rows_without_an_id_or_with_a_shared_one_are_decided_by_themselves(spark, tmp_path):
    word = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    item = word("item")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item), (None, word("a")), (7, item), (7, word("b")), (8, word("c"))]
    got = corpus_pipeline.clean(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[4]], "doc_id long, text string").collect()))
    near = word("b") + " end"
    rows = [(None, word("a")), (None, word("a")), (None, near), (7, word("b")), (7, word("b")), (7, word("d")), (9, near)]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    texts = [(r.doc_id, r.text) for r in got]
    assert len(texts) == 3 and {(None, word("a")), (7, word("d"))} <= set(texts) and texts.count((7, word("b"))) == 1

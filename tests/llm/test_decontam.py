import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import decontam
from tests.llm import cases


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size):
    w, hit, names = fold(text), set(), set()
    for name, item in items:
        x = fold(item)
        for at in range(max(1, len(x) - size + 1) if x else 0):
            p = x[at : at + size]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def items_of(docs):
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    return [(1, texts[2]), (2, "word"), (11, texts[9][:80]), (3, None), (4, ""), (5, "!!"), (20, texts[2]), (21, "straße"), (22, "no such words")]


def test_against_brute_force(spark):
    docs = cases.documents(spark)
    items = items_of(docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(r.doc_id), *brute(r.text, items, 10)) for r in docs.collect())
    for block in (1 << 20, 60):
        got = decontam.digest(decontam.contamination(docs, benchmark, block_bytes=block)).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


def test_empty_tables(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.contamination(docs, none)).where("contaminated").count() == 0
    assert decontam.digest(decontam.contamination(cases.empty(spark), none)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), max_size=6))
def test_search(text, items):
    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    found = decontam.Searcher(named, 4).find([x.encode() for x in text])
    hits = {k for start, m, _ in found for k in range(start, start + m)}
    assert len(hits) == brute(" ".join(text), named, 4)[1]


def test_ids_keep_their_value_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "some words"), (None, "more words"), (7, None)], "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([(1, "some words"), (2, "other")], "item_id long, text string")
    for block in (1 << 20, 3):
        got = decontam.digest(decontam.contamination(docs, benchmark, block_bytes=block)).collect()
        assert {(r.doc_id, r.contaminated) for r in got} == {((1 << 53) + 1, True), (None, False), (7, False)}


def test_tables_of_a_block_stay_small():
    import tracemalloc

    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(40_000))
    tracemalloc.start()
    decontam.Searcher([("x", text)], 10)
    assert tracemalloc.get_traced_memory()[0] < 150 * len(text)
    tracemalloc.stop()

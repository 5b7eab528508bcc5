import collections
import math
import zlib

from pyspark.sql import functions as F

from quillon.llm import langid
from tests.llm import cases


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where(F.col("lang") == F.col("lang_pred")).count() >= 0.98 * got.count()


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in langid.identify(cases.documents(spark)).collect()}
    assert got[300].lang_pred == got[301].lang_pred == got[302].lang_pred == got[305].lang_pred == "und"
    assert got[300].score == 0 and 0 < got[1].score <= 1
    assert got[304].lang_pred in ("en", "de", "fr")
    assert langid.identify(cases.documents(spark)).count() == cases.documents(spark).count()


def test_nothing_to_learn_from(spark):
    assert langid.identify(cases.empty(spark)).collect() == []
    bare = cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}


def test_grams_stay_within_their_text():
    a, _, has = langid.grams(["abc", "", "1 2", "xé"], 15, 3)
    assert has.tolist() == [True, False, False, True]
    alone = sorted(langid.grams(["xé"], 15, 3)[1].tolist())
    who, what, _ = langid.grams(["abc", "xé"], 15, 3)
    assert sorted(what[who == 1].tolist()) == alone


def plain_grams(text, longest, bits):
    """Hashed letter n-grams of a text, one by one."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower().replace("\n", " "))
    chars = " ".join(runs.split()).strip()
    if not chars:
        return []
    # A space stands before the first letter only where the text has something there, and after the last one always.
    found = []
    chars = chars + " "
    for k in range(1, longest + 1):
        for at in range(len(chars) - k + 1):
            g = chars[at : at + k]
            if g[0] == " " and g[-1] == " ":
                continue
            code = 0
            for n, c in enumerate(g, 1):
                code = (code * 0x110001 + ord(c) + n) % (1 << 64)
            mixed = code * 0x9E3779B97F4A7C15 % (1 << 64)
            mixed ^= mixed >> 29
            mixed = mixed * 0xBF58476D1CE4E5B9 % (1 << 64)
            found.append(mixed >> (64 - bits))
    return found


def test_against_plain_naive_bayes(spark):
    """Counts, log-probabilities, best language and posterior, recomputed text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if r.text is not None and len(r.text) < 4000]
    rows = [r for r in rows if r.text[:1].isalpha()]
    frame = spark.createDataFrame(rows, docs.schema)
    train = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    bits, longest, smooth = 12, 3, 0.5
    counts, n_docs = {}, collections.Counter()
    for r in train:
        n_docs[r.lang] += 1
        counts.setdefault(r.lang, collections.Counter()).update(plain_grams(r.text, longest, bits))
    names = sorted(n_docs)
    weight = {g: math.log((sum(counts[g].values())) + smooth * (1 << bits)) for g in names}
    got = {r.doc_id: r for r in langid.identify(frame, bits=bits, longest=longest, smooth=smooth).collect()}
    for r in rows[::3]:
        grams = collections.Counter(plain_grams(r.text, longest, bits))
        total = {g: math.log((n_docs[g] + 1) / (sum(n_docs.values()) + len(names))) + sum(n * (math.log(counts[g][x] + smooth) - weight[g]) for x, n in grams.items()) for g in names}
        best = max(names, key=lambda g: (total[g], -names.index(g)))
        assert got[r.doc_id].lang_pred == best
        assert math.isclose(got[r.doc_id].score, 1 / sum(math.exp(v - total[best]) for v in total.values()), rel_tol=1e-6)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("the and of with " * 100_000, "en"), ("der die und nicht " * 10, "de"), ("the of and " * 5, "en"), ("und die der " * 120_000, None)])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[3] == "de" and got[0] in ("en", "de")

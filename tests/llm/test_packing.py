import random
import time
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import packing
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, docs, size):
    model = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        cut = [ids[:first], *(ids[k : k + size] for k in range(first, len(ids), size))]
        at = 0
        for k, x in enumerate(cut):
            want.append((str(r.doc_id), k, at, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
            at += len(x)
    got = packing.pack(docs, PATH, size=size).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= size
    return len(held), sum(x[3] for x in want)


def test_round_trip_and_places(spark):
    docs = cases.documents(spark).repartition(5)
    for size in (64, 1024):
        n, tokens = check(spark, docs, size)
        assert n <= 1.1 * tokens / size + 2
    assert packing.pack(cases.empty(spark), PATH).collect() == []


def test_corpus_against_tokenizers(spark):
    n, tokens = check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 1024)
    assert n <= 1.01 * tokens / 1024 + 1


def test_special_strings_are_text():
    assert packing.encoder(PATH)(["a<|endoftext|>b"]) == packing.encoder(PATH, "tokenizers")(["a<|endoftext|>b"])


def histogram(counts, size):
    n = np.zeros(size + 1, dtype=np.int64)
    for k, v in counts.items():
        n[k] = v
    return n


def test_plans_hold_every_piece():
    r = random.Random(1)
    for size, make in ((100, lambda: r.randint(1, 100)), (100, lambda: r.choice([34, 33, 51, 49, 26])), (64, lambda: r.randint(20, 40)), (10, lambda: 6)):
        counts = {}
        for _ in range(3000):
            n = make()
            counts[n] = counts.get(n, 0) + 1
        out, _ = packing.plan(counts, size)
        held = {}
        for f, times in out:
            assert sum(f) <= size and times > 0
            for n in f:
                held[n] = held.get(n, 0) + times
        assert held == counts
        assert sum(t for _, t in out) <= sum(t for _, t in packing.best_fit(histogram(counts, size), size))


def corpus_like(pieces, seed):
    """Rests of long documents (any length), short documents, and full pieces."""
    r = np.random.default_rng(seed)
    lengths = np.concatenate([r.integers(1, 1025, pieces // 2), np.clip(r.gamma(2.0, 90.0, pieces // 2).astype(int) + 1, 1, 1024), np.full(pieces // 3, 1024)])
    return {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}


def test_the_linear_program_covers_every_length_and_places_most_pieces():
    for counts in (corpus_like(1500, 1), corpus_like(15_000, 2), {k: 1000 * v for k, v in corpus_like(15_000, 2).items()}):
        n = histogram(counts, 1024)
        x, cover = packing.fractional(n, 1024)
        every = np.zeros(1025)
        for f, times in x.items():
            assert sum(f) <= 1024
            for length in f:
                every[length] += times / n[length]
        assert (cover[n > 0] >= 1).all() and np.allclose(every[n > 0], cover[n > 0])
        start = time.time()
        out, placed = packing.plan(counts, 1024)
        assert time.time() - start < 20
        assert sum(t for _, t in out) <= sum(t for _, t in packing.best_fit(n, 1024))
        assert placed > n.sum() / 2


def test_ids_keep_their_value_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "some words"), (None, "more"), (7, None)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, PATH, size=64)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert {r.doc_id for r in got.collect()} == {(1 << 53) + 1, None, 7}


def test_added_tokens_in_texts_get_their_ids(spark):
    """As the tokenizer file says, with no switch set."""
    model = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", " <|endoftext|> \n<|endoftext|", "<|endoftext |>", "plain", ""]
    want = [model.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 50256, 65]
    assert packing.encoder(PATH)(texts) == want == packing.encoder(PATH, "tokenizers")(texts)
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, size=64).collect()
    assert {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in got} == {k: [*x, 2] for k, x in enumerate(want)}

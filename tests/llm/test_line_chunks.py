import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import line_chunks
from tests.llm import cases


def cut(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, at = [], 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or i >= 2 and (h[i - 2] * 31 + h[i - 1]) % 3 == 0:
            out.append(lines[at:i])
            at = i
    return out


def brute(rows):
    seen, order = defaultdict(set), sorted({(-1 if d is None else d, t) for d, t in rows if t is not None}, key=lambda x: x[0])
    first = {}
    for d, t in order:
        for k, c in enumerate(cut(t)):
            if len(c) > 1 and "".join(c).strip():
                first.setdefault(tuple(c), (d, k))
    for d, t in order:
        for k, c in enumerate(cut(t)):
            if tuple(c) in first and first[tuple(c)] != (d, k):
                seen[d, t].add(k)
    out = []
    for d, t in rows:
        if t is None:
            out.append((str(d), 0, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        gone, cs = seen[-1 if d is None else d, t], cut(t)
        kept = "\n".join("\n".join(c) for k, c in enumerate(cs) if k not in gone)
        out.append((str(d), sum(map(len, cs)), sum(len(cs[k]) for k in gone), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    got = line_chunks.digest(docs)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got.where("n_chunks > 0").count() >= 3
    assert line_chunks.dedupe(docs).columns[: len(docs.columns)] == docs.columns
    assert line_chunks.digest(cases.empty(spark)).collect() == []


def test_columns_of_clashing_names_pass(spark):
    docs = cases.documents(spark).select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(("dk", "dk_", "__key", "__gone", "__left", "c", "digest"))))
    for out in (line_chunks.dedupe(docs), line_chunks.without_passages(docs)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert {tuple(r) for r in out.select(*docs.columns[2:]).collect()} == {tuple(range(7))}
        assert out.count() == docs.count()


def test_shifted_passages_are_cut_alike(spark):
    passage = "\n".join(f"line {k} of a passage that many texts share" for k in range(40))
    docs = spark.createDataFrame([(k, f"intro {k}\n" * k + passage + f"\nend {k}") for k in range(30)], "doc_id long, text string")
    got = line_chunks.digest(docs).where("doc_id > 0")
    assert got.where("n_removed < 20").count() == 0  # all but the ends and single-line chunks


def test_short_passages_between_other_lines_go(spark):
    """Passages of two to six lines, with other neighbours in each document: later ones lose every line, single lines none."""
    passages = {n: [[f"passage {n} {p} line {k}" for k in range(n)] for p in range(20)] for n in range(2, 7)}
    rows, want = [], {}
    for n, some in passages.items():
        for p, passage in enumerate(some):
            for copy in range(3):
                own = [[f"{side} {n} {p} {copy} {k}" for k in range((p + copy) % 4)] for side in ("before", "after")]
                doc = len(rows)
                rows.append((doc, "\n".join([*own[0], *passage, *own[1]])))
                want[doc] = "\n".join([*own[0], *([] if copy else passage), *own[1]])
    alone = "a line that stands alone"
    extra = ["x\n" + alone + "\ny", "z\n" + alone + "\nv", None, "", "q\nq\nq\nq", "one\n\ntwo\nthree", "four\none\n\ntwo\nfive", "one\n\nelse"]
    stay = [*extra[:4], "q\nq", extra[5], "four\nfive", extra[7]]
    for text, kept in zip(extra, stay, strict=True):
        want[len(rows)] = kept
        rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in line_chunks.without_passages(docs).collect()}
    assert got == want


def test_no_repeated_pair_of_lines_is_missed(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen, want = {}, []
    for d, t in sorted({(-1 if d is None else d, t) for d, t in rows if t is not None}):
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for i, j in zip(full, full[1:], strict=False):
            pair = tuple(lines[i : j + 1])
            if pair in seen:
                at = seen[pair]
                gone |= set(range(i, j + 1)) - (set(range(at[1], at[2] + 1)) if at[0] == (d, t) else set())
            else:
                seen[pair] = ((d, t), i, j)
        want.append((d, t, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    kept = {(d, t): x for d, t, x in want}
    got = line_chunks.without_passages(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((d, None if t is None else kept[-1 if d is None else d, t])) for d, t in rows)
    assert line_chunks.without_passages(cases.empty(spark)).collect() == []


def test_the_pipeline_takes_short_passages_out(spark):
    import corpus_pipeline

    rows = [(k, f"own {k} a\nshared one\nshared two\nown {k} b", 40) for k in range(20)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got if r.doc_id} == {k: (t, len(t)) for k in range(1, 20) for t in [f"own {k} a\nown {k} b"]}


def passage_cut(text, spread=3):
    """Chunks and windows of the lines with text, as (first line, last line, text[, rolling hash])."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:14], 16) for i in full]
    rolls = [h[j - 1] * 31 + h[j] for j in range(1, len(full))]
    ends = [0, *(j for j in range(1, len(full)) if j == len(full) - 1 or rolls[j - 1] % spread == 0)]
    chunks = [(full[a] + 1, full[b] + 1, b - a, "\n".join(lines[full[a] : full[b] + 1])) for a, b in zip(ends, ends[1:], strict=False)]
    return chunks, [(full[j - 1] + 1, full[j] + 1, rolls[j - 1], "\n".join(lines[full[j - 1] : full[j] + 1])) for j in range(1, len(full))]


def test_passages_are_cut_by_the_rolling_hash(spark):
    docs = cases.documents(spark).where("text is not null")
    got = docs.select("text", line_chunks.passage_chunks(F.col("text"), 3).alias("c"), line_chunks.windows(F.col("text")).alias("w")).collect()
    assert len(got) == docs.count()
    for r in got:
        chunks, windows = passage_cut(r.text)
        assert [tuple(c) for c in r.c] == chunks and [tuple(w) for w in r.w] == windows
        assert sum(c.n for c in r.c) == len(windows)
    assert max(c.n for r in got for c in r.c) > 1 and max(len(r.c) for r in got) > 2


@pytest.mark.parametrize("same", [0, 1])
def test_passages_of_equal_hashes_are_told_apart_by_their_bytes(spark, monkeypatch, same):
    """All hashes equal: 0 ends a chunk at every line, 1 at none. What goes is the same."""
    docs = cases.documents(spark).select("doc_id", "text")
    some = lambda: sorted(map(str, line_chunks.without_passages(docs).collect()))
    want = some()
    monkeypatch.setattr(line_chunks, "wide_hash", lambda line: F.lit(same).cast("long"), raising=False)
    monkeypatch.setattr(line_chunks, "chunk_digest", lambda chunk: F.lit(b"same"), raising=False)
    monkeypatch.setattr(line_chunks.F, "sha2", lambda text, bits: F.lit("00"))
    assert some() == want


def test_copies_of_passages_go_by_their_chunks(spark, monkeypatch):
    """Only the windows of chunks that stay are looked up: of twenty copies those of one, and some by the ends."""
    passage = "\n".join(f"line {k} of a passage that many texts share" for k in range(40))
    docs = spark.createDataFrame([(k, f"intro {k}\n" * (k % 4) + passage + f"\nend {k}") for k in range(20)], "doc_id long, text string")
    looked_up, store = [], line_chunks.store

    def counted(df, *rest):
        found = store(df, *rest)
        looked_up.extend([found.count()] if df.columns[-2:] == ["roll", "pair"] else [])
        return found

    monkeypatch.setattr(line_chunks, "store", counted)
    got = {r.doc_id: r.text for r in line_chunks.without_passages(docs).collect()}
    assert got[0] == passage + "\nend 0" and all("passage" not in t for k, t in got.items() if k)
    assert len(looked_up) == 1 and 41 <= looked_up[0] < 20 * 41 / 2

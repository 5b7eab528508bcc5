import hashlib
import re

from quillon.llm import pii
from tests.llm import cases

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    line = ",".join(x[2] for x in sorted(spans))
    return tuple(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(line.encode()).hexdigest(), line


TEXTS = [
    "write to a.b+c@d-e.co.uk, or x@y.z_w@v.u. 😀 é@b.c a@b a@b..c @b.c",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3 99999999999999999999.1.1.1 ..1.2.3.4.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 4111  1111 1111 1111 378282246310005378282246310005",
    "+49 (30) 1234-5678 90 +1 2 +12345678901234567 ++4912345678901 +4 ",
    "phone 555-123-4567, not 555-123-4567; IBAN DE89370400440532013000 DE89370400440532013001 GB82WEST12345698765432",
    "\u0001a@b.c\u0002 d@e.f\u0003 \u0001\u0002",
    "a@b.c" * 300,
    "x@y.zw 10.0.0.1, " * 3000,
    "1" * 30000 + " " + "a" * 30000 + "@" + " +1" + " " * 30000 + "(1-1)." * 5000,
    "١٢٣.٤.٥.٦ ｱ@b.c ß@b.c K@b.c",
]


def test_against_python(spark):
    docs = cases.documents(spark).select("doc_id", "text").union(spark.createDataFrame([(1000 + k, x) for k, x in enumerate(TEXTS)], "doc_id long, text string"))
    want = sorted((str(r.doc_id), *brute(r.text)[0], brute(r.text)[1]) for r in docs.collect())
    got = pii.digest(pii.personal_data(docs)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    added = {r.doc_id: r.spans for r in got}[1004].split(",")
    assert added == ["phone:6:18", "iban:43:65", "iban:89:111"]
    assert pii.personal_data(cases.empty(spark)).collect() == []


def test_against_python_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)[0], brute(r.text)[1]) for r in docs.collect())
    got = pii.digest(pii.personal_data(docs))
    assert sorted(tuple(r)[:6] for r in got.collect()) == want
    assert "PythonUDF" not in got._jdf.queryExecution().toString()


def test_against_sql(spark, tmp_path):
    """The registered SQL over the awkward texts, where every kind and every condition around a match occurs."""
    import duckdb

    more = ["call 555-123-4567 or 555.123.4567 now", "tel +1 555-123-4567 and mobile 555 123 4567", "fax 12555-123-4567 phone 555-123-4567-8", "xDE89370400440532013000 DE89370400440532013000_ GB82WEST12345698765432."]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*(t for t in TEXTS if len(t) < 20_000), *more, None, ""])], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = pii.digest(pii.personal_data(docs))
    want = con.execute(pii.ORACLE).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert sum("iban" in r[-1] for r in want) >= 2 and sum("phone" in r[-1] for r in want) >= 4

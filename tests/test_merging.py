"""Ledger decisions: device A or B of two, marks after the run."""

import pytest

from quillon.operators import merging as G

A, B = G.Run("A", ("A", "B")), G.Run("B", ("A", "B"))
NEW = G.Run("B", ("A", "B"), new_device=True)


def decide(spark, run, cloud=None, local=None, created=(), deleted=(), newer=False):
    side = "store string, key string, value string, modified long"
    rows = lambda v, m: [] if v is None else [("s", "k", v, m)]
    c, loc = spark.createDataFrame(rows(cloud, 2 if newer else 1), side), spark.createDataFrame(rows(local, 1), side)
    marks = [("s", "k", list(created), list(deleted))] if created or deleted else []
    ledger = spark.createDataFrame(marks, "store string, key string, created array<string>, deleted array<string>")
    return G.decide(c, loc, ledger, run).first()


@pytest.mark.parametrize(
    ("run", "given", "action", "created", "deleted"),
    [
        (A, {"local": "l"}, "upload", ["A"], []),
        (B, {"cloud": "c", "created": ["A"]}, "create", [], []),
        (A, {"cloud": "c", "created": ["A"]}, "skip", [], ["A"]),
        (B, {"cloud": "c"}, "skip", [], ["B"]),
        (B, {"cloud": "c", "local": "l", "deleted": ["A"]}, "delete", [], []),
        (B, {"cloud": "c", "deleted": ["A"]}, "skip", [], []),
        (A, {"cloud": "c", "local": "l", "newer": True}, "download", [], []),
        (A, {"cloud": "c", "local": "l"}, "upload", [], []),
        (B, {"cloud": "c", "local": "l", "deleted": ["A"], "newer": True}, "delete", [], []),
        (NEW, {"cloud": "c", "local": "l", "deleted": ["A"], "newer": True}, "download", [], ["A"]),
        (NEW, {"cloud": "c"}, "create", [], []),
        (NEW, {"local": "l"}, "upload", [], []),
        (B, {"local": "l", "deleted": ["A"]}, "delete", [], []),
        (A, {"local": "l", "deleted": ["A"]}, "upload", ["A"], []),
        (G.Run("A", ("A",)), {"local": "l"}, "upload", [], []),
        (G.Run("A", ("A", "B", "C")), {"cloud": "c", "local": "l", "created": ["B"]}, "upload", ["A", "B"], []),
        (G.Run("A", ("A", "B", "C")), {"local": "l", "deleted": ["B"]}, "delete", [], ["A", "B"]),
    ],
)
def test_decisions(spark, run, given, action, created, deleted):
    r = decide(spark, run, **given)
    assert (r.action, sorted(r.created), sorted(r.deleted)) == (action, created, deleted)


def test_merge_is_a_union_and_idempotent(spark):
    side = "store string, key string, value string, modified long"
    cloud = spark.createDataFrame([("s", "a", "A", 1)], side)
    local = spark.createDataFrame([("s", "b", "B", 1)], side)
    ledger = spark.createDataFrame([("s", "a", ["A"], [])], "store string, key string, created array<string>, deleted array<string>")
    d = G.decide(cloud, local, ledger, B)
    once = {(r.key, r.value) for r in G.merged(d).collect()}
    assert once == {("a", "A"), ("b", "B")}
    again = G.decide(G.merged(d).selectExpr("store", "key", "value", "1L AS modified"), G.merged(d).selectExpr("store", "key", "value", "1L AS modified"), G.ledger_after(d), B)
    assert {(r.key, r.value) for r in G.merged(again).collect()} == once


def test_stale_copies():
    day = 86_400_000
    assert G.is_stale(0, 31 * day) and not G.is_stale(5 * day, 31 * day) and not G.is_stale(None, day)
